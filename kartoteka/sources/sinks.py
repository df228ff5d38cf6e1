"""Results out: JSON documents, sheet rows, workbook and template files, and the batch report."""

from __future__ import annotations

import io
import json
import re
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartoteka.schema import ALIASES, CHECKED, FIELDS
from kartoteka.sources import file_sink, shared

# Labels of the sheet's rows.
SHEET_LABELS = (
    "Полное наименование организации", "Сокращённое наименование", "Юридический адрес", "Почтовый адрес", "ОГРН / ОГРНИП", "ИНН", "КПП",
    "Наименование банка", "Расчётный счёт (Р/счет)", "Корреспондентский счёт (К/счет)", "БИК", "Должность руководителя",
    "ФИО руководителя (полностью)", "ФИО руководителя (кратко)", "Телефон", "Электронная почта",
)
# Headings of the two sheets, and of the errors below the second.
FIELD_HEADINGS = ("Поле", "Значение", "Статус валидации")
CHECK_HEADINGS = ("Поле", "Валидно", "Значение", "Причина ошибки")
ERRORS_HEADING = "Ошибки / кросс-проверки:"


def aliased(details: Column) -> Column:
    """A struct of the template's names; nulls are empty strings."""
    return F.struct(*[F.coalesce(details[f], F.lit("")).alias(a) for f, a in ALIASES.items()])


def _compact(whole: Column) -> Column:
    """JSON with nulls written out; an empty extracted_by is an empty list."""
    return F.replace(F.to_json(whole, {"ignoreNullFields": "false"}), F.lit('"extracted_by":{}'), F.lit('"extracted_by":[]'))


def _validation() -> Column:
    return F.struct(F.col("checks.*"), "cross_checks", "errors", "review_reasons").alias("validation")


def json_document(results: DataFrame) -> Column:
    """One JSON text a row; which fields came from patterns stands in extracted_by alone."""
    meta = F.col("processing_meta").dropFields("fallback_fields").alias("processing_meta")
    return _compact(F.struct("document_id", "needs_review", "fill_rate", F.col("details").alias("data"), aliased(F.col("details")).alias("data_aliases"), _validation(), "extracted_by", meta))


def payload(results: DataFrame) -> Column:
    """What a service answers for a result, as JSON; paths of files that there aren't are null."""
    there = lambda c: (F.col(c) if c in results.columns else F.lit(None).cast("string")).alias(c)
    return _compact(F.struct("document_id", "status", "needs_review", "fill_rate", F.col("details").alias("data"), _validation(), "warnings", "processing_meta", *map(there, ("json_path", "xlsx_path", "docx_path"))))


def _status(value: Column, check: Column | None) -> Column:
    """Only a null is not found; a field that has no rule is in order, one whose check is missing was not checked."""
    out = F.when(value.isNull(), F.lit("не найдено"))
    if check is None:
        return out.otherwise(F.lit("ок"))
    return out.when(check["valid"].isNull(), F.lit("ок (не проверялось)")).when(check["valid"], F.lit("ок")).otherwise(F.concat(F.lit("ошибка: "), F.coalesce(check["reason"], F.lit("None"))))


def sheet_rows(results: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, row, label, value, status): sixteen rows a document."""
    d, rows = F.col("details"), []
    for k, (f, label) in enumerate(zip(FIELDS, SHEET_LABELS, strict=True)):
        rows.append(F.struct(F.lit(k + 1).alias("row"), F.lit(label).alias("label"), d[f].alias("value"), _status(d[f], F.col("checks")[f] if f in CHECKED else None).alias("status")))
    return results.select(key, F.explode(F.array(*rows)).alias("r")).select(key, "r.*")


def check_rows(results: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, row, field, valid, value, reason): six rows a document."""
    rows = []
    for k, f in enumerate(CHECKED):
        c = F.col("checks")[f]
        rows.append(F.struct(F.lit(k + 1).alias("row"), F.lit(f).alias("field"), F.when(c["valid"], F.lit("Да")).otherwise(F.lit("Нет")).alias("valid"), F.coalesce(c["value"], F.lit("")).alias("value"), F.coalesce(c["reason"], F.lit("")).alias("reason")))
    return results.select(key, F.explode(F.array(*rows)).alias("r")).select(key, "r.*")


def _sheet(rows: list[list[str | None]]) -> str:
    cells = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v or "")}</t></is></c>' for v in r) + "</row>" for r in rows)
    return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{cells}</sheetData></worksheet>'


def workbook(sheets: dict[str, list[list[str | None]]]) -> bytes:
    """A workbook file of text cells; equal rows give equal bytes."""
    n = range(1, len(sheets) + 1)
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    types = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in n)
    names = "".join(f'<sheet name="{escape(s)}" sheetId="{k}" r:id="rId{k}"/>' for k, s in zip(n, sheets, strict=True))
    rels = "".join(f'<Relationship Id="rId{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in n)
    package = "http://schemas.openxmlformats.org/package/2006"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{names}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships">{rels}</Relationships>',
    } | {f"xl/worksheets/sheet{k}.xml": _sheet(rows) for k, rows in zip(n, sheets.values(), strict=True)}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text)
    return out.getvalue()


def _state(field: str, value: str | None, check: dict | None) -> str:
    if value is None:
        return "не найдено"
    if field not in CHECKED:
        return "ок"
    if check is None or check["valid"] is None:
        return "ок (не проверялось)"
    return "ок" if check["valid"] else f"ошибка: {check['reason']}"


def _book(details: dict, checks: dict, errors) -> bytes:
    """The workbook of one document."""
    first = [[*FIELD_HEADINGS], *[[label, details[f], _state(f, details[f], checks.get(f))] for f, label in zip(FIELDS, SHEET_LABELS, strict=True)]]
    second = [[*CHECK_HEADINGS], *[[f, "Да" if c["valid"] else "Нет", c["value"], c["reason"]] for f in CHECKED if (c := checks[f]) is not None]]
    second += [[], [ERRORS_HEADING], *[["", "", x] for x in errors]] if len(errors) else []
    return workbook({"Реквизиты": first, "Валидация": second})


def workbooks(results: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, content): a workbook of fields and checks for each document; rows of a document are few."""

    # whole columns go in, so that no expression above them is computed twice
    def made(details: pd.DataFrame, checks: pd.DataFrame, errors: pd.Series) -> pd.Series:
        return pd.Series([_book(d, c, e) for d, c, e in zip(details.to_dict("records"), checks.to_dict("records"), errors, strict=True)], dtype=object)

    return results.select(key, F.pandas_udf(made, "binary")("details", "checks", "errors").alias("content"))


def template_text(template: Column, details: Column) -> Column:
    """The template's text with each quoted alias replaced by its value."""
    out = template
    for f, a in ALIASES.items():
        out = F.replace(out, F.lit(f"'{a}'"), F.coalesce(details[f], F.lit("")))
    return out


_PARAGRAPH = re.compile(r"<w:p[ >].*?</w:p>", re.S)
_RUN_TEXT = re.compile(r"(<w:t(?: [^>]*)?>)(.*?)(</w:t>)", re.S)


def filled_docx(template: bytes, values: dict[str, str]) -> bytes:
    """The template file with quoted aliases replaced; a paragraph that has one is put whole into its first run."""

    def paragraph(m: re.Match) -> str:
        p = m[0]
        text = "".join(x[2] for x in _RUN_TEXT.finditer(p))
        new = text
        for alias, value in values.items():
            new = new.replace(f"'{alias}'", escape(value)).replace(f"&apos;{alias}&apos;", escape(value))
        if new == text:
            return p
        rest = iter([new])
        return _RUN_TEXT.sub(lambda r: r[1] + next(rest, "") + r[3], p)

    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(template)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as to:
        for name in z.namelist():
            data = z.read(name)
            if name == "word/document.xml":
                data = _PARAGRAPH.sub(paragraph, data.decode()).encode()
            to.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


def filled_templates(results: DataFrame, template: bytes, key: str = "document_id") -> DataFrame:
    """(key, content): the template filled for each document; the template is one small file."""

    def made(values: pd.DataFrame) -> pd.Series:
        return pd.Series([filled_docx(template, dict(zip(ALIASES.values(), r, strict=True))) for r in values.itertuples(index=False)], dtype=object)

    return results.select(key, F.pandas_udf(made, "binary")(aliased(F.col("details"))).alias("content"))


FAILED = ("error", "exception")


def files_of(results: DataFrame, template: bytes | None = None, key: str = "document_id") -> DataFrame:
    """(key, name, content): the files of each row that didn't fail; a plain function of the row, without side effects.

    <id>_result.json, <id>_result.xlsx, <id>_raw.txt and <id>_normalized.txt, and <id>_result.docx if a template is given that
    can be filled.
    """
    texts = [c for c in ("text", "normalized_text") if c in results.columns]
    fills = template is not None and template_error(template) is None
    rows = results.where(~F.col("status").isin(*FAILED)).select(key, json_document(results).alias("_json"), "details", "checks", "errors", *texts)

    def made(rows: pd.DataFrame) -> pd.Series:
        out = []
        for r in rows.to_dict("records"):
            i, d = r[key], r["details"]
            files = [(f"{i}_result.json", json.dumps(json.loads(r["_json"]), ensure_ascii=False, indent=2).encode()), (f"{i}_result.xlsx", _book(d, r["checks"], r["errors"]))]
            files += [(f"{i}_{name}.txt", r[c].encode()) for c, name in (("text", "raw"), ("normalized_text", "normalized")) if r.get(c) is not None]
            if fills:
                files.append((f"{i}_result.docx", filled_docx(template, {a: d[f] or "" for f, a in ALIASES.items()})))
            out.append([{"name": n, "content": c} for n, c in files])
        return pd.Series(out, dtype=object)

    # whole columns go in, so that no expression above them is computed twice
    files = F.pandas_udf(made, "array<struct<name:string,content:binary>>")(F.struct(*rows.columns))
    return rows.select(key, F.explode(files).alias("f")).select(key, "f.*")


def template_error(template: bytes) -> str | None:
    """Why the template can't be filled, for any values."""
    try:
        filled_docx(template, {})
    except Exception as e:  # whatever is wrong with the file, documents have their other files
        return f"DOCX export failed: {e}"
    return None


def with_paths(results: DataFrame, folder: str, template: bytes | None = None, key: str = "document_id") -> DataFrame:
    """Adds the paths that `files_of` gives in a folder; a template that can't be filled gives a warning and no path."""
    failed = F.col("status").isin(*FAILED)
    error = template_error(template) if template is not None else None
    path = lambda name, *having: F.when(~failed & having[0] if having else ~failed, F.concat(F.lit(f"{folder}/"), key, F.lit(name)))
    none = F.lit(None).cast("string")
    text = lambda c, name: path(name, F.col(c).isNotNull()) if c in results.columns else none
    out = results.withColumns({
        "json_path": path("_result.json"), "xlsx_path": path("_result.xlsx"), "docx_path": none if template is None or error else path("_result.docx"),
        "raw_text_path": text("text", "_raw.txt"), "normalized_text_path": text("normalized_text", "_normalized.txt"),
    })
    return out.withColumn("warnings", F.when(failed, F.col("warnings")).otherwise(F.concat("warnings", F.array(F.lit(error))))) if error else out


def write_files(results: DataFrame, folder: str, template: bytes | None = None, key: str = "document_id") -> DataFrame:
    """Writes each document's files into a folder that all executors reach, once and now, and returns the rows with their paths.

    results: best a table, as the record plan is long and is computed here and wherever the rows are used. If the job fails, no
    file of it is in the folder. Failed rows get no files. Equal documents have one id and equal files.
    """
    file_sink.write(files_of(results, template, key), folder)
    return with_paths(results, folder, template, key)


def batch_report(results: DataFrame) -> DataFrame:
    """One flat row a file in the order of paths, errors included; warnings as an array.

    A failed row has its error as the only warning, and neither id, verdict nor files.
    """
    failed = F.col("status").isin(*FAILED)
    errors = [F.col(c) for c in ("error", "answer_error") if c in results.columns]
    error = F.array(F.coalesce(*errors)) if errors else F.array().cast("array<string>")
    own = lambda c: F.when(~failed, F.col(c)).alias(c) if c in results.columns else F.lit(None).cast("string").alias(c)
    order = "storage_path" if "storage_path" in results.columns else "original_filename"
    rows = results.orderBy(order, "original_filename")
    return rows.select(
        F.col("original_filename").alias("file_name"),
        own("document_id"),
        "status",
        own("needs_review"),
        own("fill_rate"),
        F.when(failed, error).otherwise(F.col("warnings")).alias("warnings"),
        *[own(c) for c in ("json_path", "xlsx_path", "docx_path")],
    )


def _json_text(value: Column, kind: str) -> Column:
    """A value as JSON, an array over several lines."""
    if kind == "string":
        text = F.to_json(F.array(value))
        value = F.substring(text, F.lit(2), F.length(text) - 2)
    elif kind.startswith("array"):
        # a line of its own for each
        each = F.transform(value, lambda x: _json_text(x, "string"))
        value = F.when(F.size(value) == 0, F.lit("[]")).otherwise(F.concat(F.lit("[\n      "), F.array_join(each, ",\n      "), F.lit("\n    ]")))
    return F.coalesce(value.cast("string"), F.lit("null"))


def _csv_text(value: Column, kind: str) -> Column:
    if kind == "boolean":
        value = F.initcap(value.cast("string"))
    elif kind.startswith("array"):
        value = F.array_join(value, "; ")
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def _merged(lines: DataFrame, to: str, between: str, start: str, end: str, empty: str, last: bool) -> None:
    """Rows of text in order as one file: parts are written by tasks, and their bytes are copied one after the other.

    last: whether the separator stands behind the last row too.
    """
    spark = lines.sparkSession
    at = shared.own_path(spark, "report")
    try:
        lines.write.option("lineSep", between).text(at)
        shared.joined(spark, at, to, start, end, 0 if last else len(between.encode()), empty)
    finally:
        shared.removed(spark, at)


def write_report(results: DataFrame, folder: str, name: str = "batch_report") -> tuple[str, str]:
    """The report as one JSON array and one CSV file with a heading, both in the order of paths; their paths.

    Rows are sorted by ranges of paths over all tasks, and no row comes to the driver but as bytes of a file.
    """
    report = batch_report(results)
    kinds = dict(report.dtypes)
    json_path, csv_path = f"{folder}/{name}.json", f"{folder}/{name}.csv"
    pairs = [F.concat(F.lit(f'    "{c}": '), _json_text(F.col(c), kinds[c])) for c in report.columns]
    objects = report.select(F.concat(F.lit("  {\n"), F.concat_ws(",\n", *pairs), F.lit("\n  }")).alias("value"))
    _merged(objects, json_path, ",\n", "[\n", "\n]", "[]", last=False)
    heads = [*[c for c in report.columns if c != "warnings"], "warnings"]
    lines = report.select(F.concat_ws(",", *[_csv_text(F.col(c), kinds[c]) for c in heads]).alias("value"))
    heading = ",".join(heads) + "\r\n"
    _merged(lines, csv_path, "\r\n", heading, "", heading, last=True)
    return json_path, csv_path

"""Folders of documents as rows: scan, identity, routing, and text by kind. A damaged file is an error text of its row."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kartoteka.operators import routing
from kartoteka.schema import Settings
from kartoteka.sources import docx

TEXT = "text string, extractor string, pages int, ocr_used boolean, extraction_warnings array<string>, error string, failure string"
#: A PDF of more pages is dealt out over all tasks in runs of so many.
PAGES_AT_ONCE = 32
#: Pages by whose text a PDF is told from a scan.
PROBED = 3


class Pdf(Protocol):
    """What the user gives for an opened PDF, as no such library is bundled; pages are numbered from 0.

    text and tables may be of the text layer alone, image is for recognition; what a backend hasn't got may raise.
    """

    def __len__(self) -> int: ...
    def text(self, page: int) -> str | None: ...
    def tables(self, page: int) -> list[list[list]]: ...
    def image(self, page: int) -> bytes: ...


#: Opens a PDF. An attribute `extractor` names the backend in results; the same holds for Ocr.
OpenPdf = Callable[[bytes], Pdf]
#: An image's text: lines, or words as dicts of block_num, line_num, text.
Ocr = Callable[[bytes], list]


def glob(extensions) -> str:
    """A file name pattern of extensions in any case."""
    return "{" + ",".join("*." + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e.lstrip(".")) for e in extensions) + "}"


def scan(spark: SparkSession, folder: str, settings: Settings = Settings(), recursive: bool = False) -> DataFrame:
    """Files of a folder with the settings' extensions: document_id, original_filename, extension, mime_type, size_bytes, storage_path, sha256, content.

    Other files are not opened, nor are those above the settings' size: these are rows without id and content. A folder without
    such files gives no row; none_found says so.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", glob(settings.extensions)).load(folder)
    most = settings.max_upload_mb * 2**20
    # the bound on length reaches the scan, so content of longer files is never read
    large = files.where(F.col("length") > most).select("path", "modificationTime", "length", F.lit(None).cast("binary").alias("content"))
    return described(files.where(F.col("length") <= most).unionByName(large))


def none_found(files: DataFrame, folder: str, settings: Settings = Settings()) -> str | None:
    """The message for a scan without any file."""
    return f"No files with extensions {', '.join(settings.extensions)} in {folder}" if files.select("storage_path").isEmpty() else None


def described(files: DataFrame, *also: str) -> DataFrame:
    """Rows of path, length and content with their identity; the id is the first 8 characters of the content's hash."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    sha = F.sha2("content", 256)
    ext = routing.extension(name)
    return files.select(F.substring(sha, 1, 8).alias("document_id"), name.alias("original_filename"), ext.alias("extension"), routing.mime(F.col("content"), ext).alias("mime_type"), F.col("length").alias("size_bytes"), F.col("path").alias("storage_path"), sha.alias("sha256"), "content", *also)


def _numbered(pages: list[str]) -> str:
    return "\n\n".join(f"[Страница {i}]\n{p}" for i, p in enumerate(pages, 1) if p)


def _lines(found: list) -> str:
    """Recognised lines, or words put together by block and line number in the order of their first words."""
    if found and isinstance(found[0], dict):
        lines: dict[tuple, list[str]] = {}
        for w in found:
            if w["text"].strip():
                lines.setdefault((w["block_num"], w["line_num"]), []).append(w["text"].strip())
        found = [" ".join(words) for words in lines.values()]
    return "\n".join(found).strip()


class _Failed(Exception):
    """A failure that is foreseen: its text is the row's error."""


def _docx(content: bytes) -> tuple:
    try:
        text = docx.text(content)
    except Exception as e:
        raise _Failed(f"Cannot open DOCX: {e}") from e
    return text, "python_docx", None, False, [] if text else ["DOCX extracted text is empty — document may be blank or image-only"]


def _text_page(doc: Pdf, k: int) -> tuple[str, str | None]:
    """A page's text, then its tables as rows of `a | b`; and a warning if a part of it can't be read."""
    parts, said = [], None
    try:
        parts.append((doc.text(k) or "").strip())
    except Exception as e:  # one page doesn't cost the others
        return "", f"Page {k + 1}: text extraction failed — {e}"
    try:
        for table in doc.tables(k):
            rows = [[str(c).strip() for c in row if c is not None] for row in table]
            parts.append("\n".join(" | ".join(r) for r in rows if any(r)))
    except Exception as e:
        said = f"Page {k + 1}: table extraction failed — {e}"
    return "\n".join(p for p in parts if p), said


def _scanned_page(doc: Pdf, k: int, ocr: Ocr) -> tuple[str, str | None]:
    try:
        text = _lines(ocr(doc.image(k)))
    except Exception as e:
        return "", f"Page {k + 1}: OCR failed — {e}"
    return text, None if text else f"Page {k + 1}: OCR returned empty text"


def _name(backend, usual: str) -> str:
    return getattr(backend, "extractor", usual)


class _Backends:
    """The user's backends and the settings, as tasks get them."""

    def __init__(self, settings: Settings, pdf: OpenPdf | None, ocr: Ocr | None):
        self.settings, self.pdf, self.ocr = settings, pdf, ocr

    def recognised(self, kind: str) -> bool:
        return kind == "pdf_scan" and self.ocr is not None

    def opened(self, content: bytes, kind: str) -> Pdf:
        try:
            if self.pdf is None:
                raise ValueError("no backend is given")
            return self.pdf(content)
        except Exception as e:
            raise _Failed(f"Cannot {'OCR' if self.recognised(kind) else 'open'} PDF: {e}") from e

    def page(self, doc: Pdf, kind: str, k: int) -> tuple[str, str | None]:
        return _scanned_page(doc, k, self.ocr) if self.recognised(kind) else _text_page(doc, k)

    def probe(self, content: bytes | None) -> tuple[int | None, list[str] | None]:
        """The number of pages and the first pages' text; nulls for a file that can't be opened."""
        try:
            doc = self.opened(content, "")
            n = len(doc)
            return n, [(doc.text(k) or "").strip() for k in range(min(PROBED, n))]
        except Exception:  # what is wrong is said where its text is asked for
            return None, None

    def whole(self, content: bytes, kind: str) -> tuple:
        """A PDF's pages one after the other."""
        doc = self.opened(content, kind)
        found = [self.page(doc, kind, k) for k in range(len(doc))]
        return self.row(kind, _numbered([t for t, _ in found]), len(found), [w for _, w in found if w])

    def row(self, kind: str, text: str, pages: int, said: list[str]) -> tuple:
        if self.recognised(kind):
            return text, _name(self.ocr, "tesseract"), pages, True, said
        least = self.settings.min_pdf_chars
        if (n := len(text.strip())) < least:
            said = [*said, f"PDF text layer too small ({n} chars < {least}). Likely a scanned PDF — use OCR extractor instead."]
        return text, _name(self.pdf, "pdfplumber"), pages, False, said


def _image(content: bytes, ocr: Ocr | None) -> tuple:
    try:
        if ocr is None:
            raise ValueError("no backend is given")
        text = _lines(ocr(content))
    except Exception as e:
        raise _Failed(f"Cannot OCR image: {e}") from e
    return text, _name(ocr, "tesseract"), 1, True, [] if text else ["OCR returned empty text"]


def _guarded(make: Callable[[], tuple]) -> tuple:
    try:
        return *make(), None, None
    except _Failed as e:
        return None, None, None, False, [], str(e), "error"
    except Exception as e:  # nothing of a single file may end the batch
        return None, None, None, False, [], f"{type(e).__name__}: {e}", "exception"


def _extracted(kind: str, ext: str, content: bytes | None, b: _Backends) -> tuple:
    def make() -> tuple:
        if content is None:
            raise _Failed(f"File is larger than {b.settings.max_upload_mb} MB")
        if kind == "docx":
            return _docx(content)
        if kind.startswith("pdf"):
            return b.whole(content, kind)
        if kind == "image":
            return _image(content, b.ocr)
        raise _Failed(f"Unsupported file type: .{ext}")

    return _guarded(make)


_COLUMNS = [x.split()[0] for x in TEXT.split(", ")]


def _kind(has_text: Column) -> Column:
    return routing.kind(F.col("extension"), F.col("mime_type"), has_text)


def _by_row(files: DataFrame, b: _Backends) -> DataFrame:
    def texts(kinds: pd.Series, exts: pd.Series, contents: pd.Series) -> pd.DataFrame:
        rows = [_extracted(k, e, None if c is None else bytes(c), b) for k, e, c in zip(kinds, exts, contents, strict=True)]
        return pd.DataFrame(rows, columns=_COLUMNS).astype({"pages": "Int32"})

    udf = F.pandas_udf(texts, TEXT)
    return files.withColumn("_t", udf("doc_kind", "extension", "content")).drop("content").select("*", "_t.*").drop("_t")


def _by_page(files: DataFrame, b: _Backends) -> DataFrame:
    """PDFs with `_pages`: runs of pages are dealt over all tasks, and their texts are put in order under the file's path.

    A run holds the file's content, which the settings bound; no page's image leaves its task.
    """
    meta = [c for c in files.columns if c not in ("content", "_pages")]
    runs = files.select(F.struct(*meta).alias("m"), "content", "_pages", F.explode(F.sequence(F.lit(0), F.col("_pages") - 1, F.lit(PAGES_AT_ONCE))).alias("first"))
    dealt = runs.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col("m.storage_path"), "first")
    schema = "page int, text string, said string, error string, failure string"

    def read(kind: str, content: bytes, first: int, n: int) -> list[tuple]:
        try:
            doc = b.opened(content, kind)
        except _Failed as e:
            return [(first, None, None, str(e), "error")]
        return [(k, *b.page(doc, kind, k), None, None) for k in range(first, min(first + PAGES_AT_ONCE, n))]

    def pages(metas: pd.DataFrame, contents: pd.Series, firsts: pd.Series, ns: pd.Series) -> pd.Series:
        keys = [x.split()[0] for x in schema.split(", ")]
        rows = zip(metas["doc_kind"], contents, firsts.tolist(), ns.tolist(), strict=True)
        return pd.Series([[dict(zip(keys, p, strict=True)) for p in read(k, bytes(c), f, n)] for k, c, f, n in rows], dtype=object)

    made = F.pandas_udf(pages, f"array<struct<{', '.join(x.replace(' ', ':') for x in schema.split(', '))}>>")
    page = dealt.select("m", F.explode(made("m", "content", "first", "_pages")).alias("p"))
    # a row of text for each page of one file comes together
    whole = page.groupBy(F.col("m.storage_path").alias("_path")).agg(F.first("m").alias("m"), F.array_sort(F.collect_list("p")).alias("p"))
    texts = F.transform(F.filter("p", lambda x: x["text"] != ""), lambda x: F.concat(F.lit("[Страница "), (x["page"] + 1).cast("string"), F.lit("]\n"), x["text"]))
    failed = F.exists("p", lambda x: x["error"].isNotNull())
    first_error = F.element_at(F.filter("p", lambda x: x["error"].isNotNull()), 1)
    kind, text = F.col("m.doc_kind"), F.array_join(texts, "\n\n")
    recognised = (kind == "pdf_scan") & F.lit(b.ocr is not None)
    said = F.filter(F.transform("p", lambda x: x["said"]), lambda x: x.isNotNull())
    least, size = b.settings.min_pdf_chars, F.length(F.trim(text))
    small = F.concat(F.lit("PDF text layer too small ("), size.cast("string"), F.lit(f" chars < {least}). Likely a scanned PDF — use OCR extractor instead."))
    said = F.when(~recognised & (size < least), F.concat(said, F.array(small))).otherwise(said)
    ok = lambda c: F.when(~failed, c)
    return whole.select(
        "m.*", ok(text).alias("text"), ok(F.when(recognised, F.lit(_name(b.ocr, "tesseract"))).otherwise(F.lit(_name(b.pdf, "pdfplumber")))).alias("extractor"),
        ok(F.size("p")).alias("pages"), (recognised & ~failed).alias("ocr_used"), F.when(failed, F.array().cast("array<string>")).otherwise(said).alias("extraction_warnings"),
        F.when(failed, first_error["error"]).alias("error"), F.when(failed, first_error["failure"]).alias("failure"),
    )


def with_text(files: DataFrame, settings: Settings = Settings(), pdf: OpenPdf | None = None, ocr: Ocr | None = None) -> DataFrame:
    """Adds doc_kind and TEXT's columns and drops the content; failure is error, or exception where nothing foresaw it.

    A PDF whose first pages have little text is a scan, and is recognised page by page if there is an OCR backend. In a batch,
    PDFs of more than PAGES_AT_ONCE pages are dealt out by runs of pages; for that the folder is read twice. All other files,
    and all of a stream's, stay in one task each, without a shuffle.
    """
    b = _Backends(settings, pdf, ocr)
    if pdf is None:
        return _by_row(files.withColumn("doc_kind", _kind(F.lit(False))), b)

    def probe(kinds: pd.Series, contents: pd.Series) -> pd.DataFrame:
        found = [b.probe(None if c is None else bytes(c)) if k.startswith("pdf") else (None, None) for k, c in zip(kinds, contents, strict=True)]
        return pd.DataFrame(found, columns=["n", "first"]).astype({"n": "Int32"})

    probed = files.withColumn("_probe", F.pandas_udf(probe, "n int, first array<string>")(_kind(F.lit(False)), "content"))
    known = probed.withColumn("doc_kind", _kind(routing.text_layer(F.col("_probe.first"), settings.min_pdf_chars))).withColumn("_pages", F.col("_probe.n")).drop("_probe")
    if files.isStreaming:
        return _by_row(known.drop("_pages"), b)
    large = F.coalesce(F.col("_pages") > PAGES_AT_ONCE, F.lit(False))
    return _by_row(known.where(~large).drop("_pages"), b).unionByName(_by_page(known.where(large), b))

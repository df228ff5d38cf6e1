"""One query for each family of operators, and its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kartoteka.functions import checks, normal
from kartoteka.functions.checks import INN_10, INN_11, INN_12
from kartoteka.functions.rx import let
from kartoteka.operators import answers, extract, merge, pages, routing
from kartoteka.plans import cards as K
from kartoteka.plans.details import counters, with_details
from kartoteka.schema import ALIASES, CHECKED, FIELDS, WEB_EXTENSIONS
from kartoteka.sources import shared, sinks, store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

_IDS, _CARDS, _NOISY = (x.replace("{customer}", "customer") for x in (K.IDS, K.CARDS, K.NOISY))


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def named(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return named


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# --- checks of single values


def _checked_sql(column: str, rules: str) -> str:
    """The check of one identifier column: rules are WHEN clauses over v, the compact value, and n, its length."""
    return f"""select id, reason is null as valid, case when reason is null then v else raw end as value, reason from (
  select *, case when raw is null or raw = '' then 'field is null' when not regexp_full_match(v, '[0-9]+') then 'contains non-digit chars' {rules} end as reason
  from (select *, length(v) as n from (select id, {column} as raw, replace(trim({column}), ' ', '') as v from ({_IDS}))))"""


def _digit(i: int) -> str:
    return f"try_cast(substr(v, {i}, 1) as int)"


_RULES = {
    "inn": f"""when n = 10 and {K.weighted("v", INN_10)} <> {_digit(10)} then 'invalid checksum (10-digit INN)'
      when n = 12 and {K.weighted("v", INN_11)} <> {_digit(11)} then 'invalid checksum digit 11 (12-digit INN)'
      when n = 12 and {K.weighted("v", INN_12)} <> {_digit(12)} then 'invalid checksum digit 12 (12-digit INN)'
      when n not in (10, 12) then 'wrong length: ' || n || ', expected 10 or 12'""",
    "kpp": "when n <> 9 then 'wrong length: ' || n || ', expected 9'",
    "ogrn": f"""when n in (8, 10, 11) then 'likely OKPO/OKTMO classifier, not OGRN (length=' || n || ')'
      when n = 13 and try_cast(left(v, 12) as bigint) % 11 % 10 <> {_digit(13)} then 'invalid OGRN checksum'
      when n = 15 and try_cast(left(v, 14) as bigint) % 13 % 10 <> {_digit(15)} then 'invalid OGRNIP checksum'
      when n not in (13, 15) then 'wrong length: ' || n || ', expected 13 or 15'""",
    "bik": "when n <> 9 then 'wrong length: ' || n || ', expected 9' when not starts_with(v, '04') then 'BIK must start with 04'",
    "rs": "when n <> 20 then 'wrong length: ' || n || ', expected 20' when not starts_with(v, '40') then 'checking account must start with 40'",
    "ks": "when n <> 20 then 'wrong length: ' || n || ', expected 20' when not starts_with(v, '30') then 'correspondent account must start with 30'",
}


def _checked(name: str, check: Callable[[Column], Column]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return K.ids(spark, sf_dir).select("id", check(F.col(name)).alias("c")).select("id", "c.*")

    run.__name__ = f"q_validate_{name}"
    return run


for _name, _field in zip(_RULES, CHECKED, strict=True):
    query(_checked_sql(_name, _RULES[_name]))(_checked(_name, checks.FIELD_CHECKS[_field]))


@query(f"select id, case when substr(bik, 7, 3) <> substr(ks, 18, 3) then 'BIK and correspondent account mismatch' end as mismatch from ({_IDS})")
def q_cross_bik_ks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.ids(spark, sf_dir).select("id", checks.cross(F.col("bik"), F.col("ks")).alias("mismatch"))


# --- cards: fields, record, counters

_FOUND = f"""select id, 'ООО Фирма ' || id as company_name, nullif(regexp_extract(text, '(?:^|\\n)ИНН:[^\\n]*?([0-9]{{10}})', 1), '') as inn,
  nullif(regexp_extract(text, '(?:^|\\n)КПП:[^\\n]*?([0-9]{{9}})', 1), '') as kpp, nullif(regexp_extract(text, '(?:^|\\n)ОГРН:[^\\n]*?([0-9]{{13}})', 1), '') as ogrn,
  nullif(regexp_extract(text, '(?:^|\\n)БИК:[^\\n]*?([0-9]{{9}})', 1), '') as bik, nullif(regexp_extract(text, '(?:^|\\n)Расчетный счет:[^\\n]*?([0-9]{{20}})', 1), '') as rs,
  nullif(regexp_extract(text, '(?:^|\\n)Корр. счет:[^\\n]*?([0-9]{{20}})', 1), '') as ks, regexp_extract(text, '(?:^|\\n)Банк: ([^\\n]*)', 1) as bank_name,
  '+7' || substr(regexp_replace(regexp_extract(text, 'Телефон: ([^\\n]*)', 1), '[^0-9]', '', 'g'), 2) as phone, regexp_extract(text, 'E-mail: ([^\\n]*)', 1) as email,
  'Директор' as ceo_position, 'Иванов Иван Иванович' as ceo_fio_full, 'Иванов И.И.' as ceo_fio from ({_CARDS})"""


def _record_sql() -> str:
    """Each field's reason, the values left, errors in order."""
    labels = dict(zip(_RULES, CHECKED.values(), strict=True))
    steps = [f"f as ({_FOUND})"]
    for name, rules in _RULES.items():
        steps.append(f"""c_{name} as (select id, case when v is null then 'field is null' {rules} end as reason_{name} from (select id, {name} as v, length({name}) as n from f))""")
    left = ", ".join(f"case when reason_{n} is null then {n} end as {n}_left" for n in _RULES)
    joins = " ".join(f"join c_{n} using (id)" for n in _RULES)
    said = ", ".join(f"case when {n} is not null then reason_{n} end" for n in _RULES)
    missing = ", ".join(f"case when {n}_left is null then '{labels[n]} отсутствует' end" for n in _RULES)
    filled = " + ".join(f"({n}_left is not null)::bigint" for n in _RULES)
    return f"""with {", ".join(steps)}, r as (select *, {left} from f {joins}),
  e as (select *, case when substr(bik_left, 7, 3) <> substr(ks_left, 18, 3) then 'BIK and correspondent account mismatch' end as mismatch, 7 + {filled} as filled from r),
  l as (select *, list_filter([{said}, mismatch, {missing}], lambda x: x is not null) as raw_errors from e),
  record as (select *, list_filter(raw_errors, lambda x, i: list_position(raw_errors, x) = i) as errors from l)"""


@query(f"{_record_sql()} select case when len(errors) > 0 then 'needs_review' else 'done' end as status, count(*) as n, sum(filled)::bigint as filled, sum(len(errors))::bigint as errors from record group by 1")
def q_entry_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From card texts to checked records, summed up by status: one narrow stage and one shuffle of two rows a task."""
    done = with_details(K.cards(spark, sf_dir), compose=False)
    filled = F.lit(len(FIELDS)) - F.size("missing_fields")
    return done.groupBy("status").agg(F.count("*").alias("n"), F.sum(filled).cast("bigint").alias("filled"), F.sum(F.size("errors")).cast("bigint").alias("errors"))


@query(f"{_record_sql()} select id, array_to_string(errors, '; ') as errors, len(errors) > 0 as needs_review, {', '.join(f'{n}_left as {n}' for n in _RULES)}, round_even(filled / 16.0, 2)::double as fill_rate from record")
def q_validate_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = with_details(K.cards(spark, sf_dir), compose=False)
    return r.select("id", F.array_join("errors", "; ").alias("errors"), "needs_review", *[F.col("details")[f].alias(n) for n, f in zip(_RULES, CHECKED, strict=True)], "fill_rate")


@query(f"select id, company_name, inn, kpp, ogrn, bik, rs, ks, bank_name, phone, email, ceo_position, ceo_fio_full, ceo_fio from ({_FOUND})")
def q_card_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = extract.with_found(K.cards(spark, sf_dir)).select("id", "found.*")
    return d.select("id", "company_name", "inn", "kpp", "ogrn", "bik", F.col("checking_account").alias("rs"), F.col("correspondent_account").alias("ks"), "bank_name", "phone", "email", "ceo_position", "ceo_fio_full", "ceo_fio")


@query(f"{_record_sql()} select case when id % 10 = 3 then 'failed' when len(errors) > 0 then 'needs_review' else 'done' end as status, count(*) as n from record group by 1")
def q_batch_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth card's file failed: the one half foreseen, the other not."""
    failure = F.when(F.col("id") % 20 == 3, F.lit("error")).when(F.col("id") % 20 == 13, F.lit("exception"))
    return counters(with_details(K.cards(spark, sf_dir).withColumn("failure", failure), compose=False))


_SHEET = " union all ".join(
    f"select {k + 1} as row, '{label}' as label, case when {f'{dict(zip(CHECKED, _RULES, strict=True))[f]}_left is null' if f in CHECKED else str(f in ('short_name', 'legal_address', 'postal_address')).lower()} then 'не найдено' else 'ок' end as status from record"
    for k, (f, label) in enumerate(zip(FIELDS, sinks.SHEET_LABELS, strict=True))
)


@query(f"{_record_sql()} select row, label, status, count(*) as n from ({_SHEET}) group by 1, 2, 3")
def q_sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sinks.sheet_rows(with_details(K.cards(spark, sf_dir), compose=False), "id")
    return rows.groupBy("row", "label", "status").agg(F.count("*").alias("n"))


_CHECKS = " union all ".join(f"select {k + 1} as row, '{f}' as field, case when reason_{n} is null then 'Да' else 'Нет' end as valid, coalesce(reason_{n}, '') as reason from record" for k, (f, n) in enumerate(zip(CHECKED, _RULES, strict=True)))


@query(f"{_record_sql()} select row, field, valid, reason, count(*) as n from ({_CHECKS}) group by 1, 2, 3, 4")
def q_check_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sinks.check_rows(with_details(K.cards(spark, sf_dir), compose=False), "id")
    return rows.groupBy("row", "field", "valid", "reason").agg(F.count("*").alias("n"))


@query()
def q_json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = with_details(K.cards(spark, sf_dir).withColumnRenamed("id", "document_id"), compose=False)
    return r.select("document_id", sinks.json_document(r).alias("json"))


@query()
def q_workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = sinks.workbooks(with_details(K.cards(spark, sf_dir), compose=False), "id")
    return books.select("id", F.length("content").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


@query(f"select id, coalesce(inn, '') as \"INN\", coalesce(kpp, '') as \"KPP\", coalesce(bank_name, '') as \"BANK_NAME\", '' as \"LEGAL_ADDRES\" from ({_FOUND})")
def q_alias_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = extract.with_found(K.cards(spark, sf_dir))
    return d.select("id", sinks.aliased(F.col("found")).alias("a")).select("id", "a.INN", "a.KPP", "a.BANK_NAME", "a.LEGAL_ADDRES")


@query(f"select id, 'ИНН ' || coalesce(inn, '') || ', БИК ' || coalesce(bik, '') || ' ''NONE''' as filled from ({_FOUND})")
def q_template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = extract.with_found(K.cards(spark, sf_dir))
    return d.select("id", sinks.template_text(F.lit("ИНН 'INN', БИК 'BIK' 'NONE'"), F.col("found")).alias("filled"))


# --- merging

_LLM = """select id, inn, bik, case id % 4 when 0 then null when 1 then '' when 2 then substr(inn, 1, 9) else inn end as llm_inn,
  case id % 5 when 0 then null when 1 then '12' || substr(bik, 3) else bik end as llm_bik, case id % 3 when 0 then 'Фирма' when 1 then null else 'ООО Фирма Большая' end as llm_name,
  'ООО Фирма ' || cast(id as string) as name, case id % 2 when 0 then 'нет' else 'a@b.ru' end as llm_email, 'c@d.ru' as email from ({ids}) x"""


@query(f"""select id, case when (coalesce(llm_inn, '') = '' and inn is not null) or (length(di) in (10, 12) and length(dl) not in (10, 12) and dl <> '') then inn else llm_inn end as inn,
  case when llm_bik is null or (starts_with(bik, '04') and not starts_with(llm_bik, '04')) then bik else llm_bik end as bik,
  case when llm_name is null or length(name) > length(llm_name) then name else llm_name end as company_name,
  case when id % 2 = 0 then email else llm_email end as email, (llm_name is null or length(name) > length(llm_name)) as name_by_regex
  from (select *, regexp_replace(inn, '[^0-9]', '', 'g') as di, regexp_replace(llm_inn, '[^0-9]', '', 'g') as dl from ({_LLM.replace('{ids}', _IDS)}))""")
def q_merge_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = K.read(spark, sf_dir, _LLM.replace("{ids}", K.IDS))
    none = F.lit(None).cast("string")
    own = {"inn": "inn", "bik": "bik", "company_name": "name", "email": "email"}
    said = {"inn": "llm_inn", "bik": "llm_bik", "company_name": "llm_name", "email": "llm_email"}
    answer = F.create_map(*[x for f, c in said.items() for x in (F.lit(f), F.col(c))])
    found = F.struct(*[(F.col(own[f]) if f in own else none).alias(f) for f in FIELDS])
    m = merge.with_merged(rows.select("id", answer.alias("answer"), found.alias("found")))
    d = F.col("details")
    return m.select("id", d["inn"].alias("inn"), d["bik"].alias("bik"), d["company_name"].alias("company_name"), d["email"].alias("email"), F.coalesce(F.col("extracted_by")["company_name"] == "regex", F.lit(False)).alias("name_by_regex"))


_RAW = """select id, '{"inn": ' || coalesce('"' || inn || '"', 'null') || ', "extra": "x", "bik": "' || bik || '"' || case when id % 20 = 0 then '' else '}' end as raw from ({ids}) x"""


@query(f"select id, case when id % 20 <> 0 then json_extract_string(raw, '$.inn') end as inn, case when id % 20 <> 0 then 2::bigint end as n_keys from ({_RAW.replace('{ids}', _IDS)})")
def q_llm_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = K.read(spark, sf_dir, _RAW.replace("{ids}", K.IDS).replace('{"inn"', '{{"inn"').replace("'}'", "'}}'"))
    known = rows.withColumn("t", answers.typed(F.col("raw"))).select("id", F.col("t.answer").alias("known"))
    return known.select("id", F.col("known")["inn"].alias("inn"), F.when(F.col("known").isNotNull(), F.size("known").cast("bigint")).alias("n_keys"))


# Values of all kinds of JSON, an answer that is a list, one that is broken.
_ANSWERS = """select id, case id % 8 when 0 then '[' || cast(id as string) || ']' when 1 then '{"inn": ' || cast(id as string) || ', "kpp": null' else '{"inn": ' || case id % 8 when 2 then cast(id as string)
  when 3 then 'true' when 4 then '["a","' || cast(id as string) || '"]' when 5 then '{"x":' || cast(id as string) || '}' when 6 then cast(id as string) || '.5' else '"' || cast(id as string) || '"' end
  || ', "other": [1], "bik": ' || case when id % 3 = 0 then '40702810000000012345' else '"04"' end || '}' end as raw from ({ids}) x"""
_WHY = "  Input should be a valid {} [type={}_type, input_value="


@query(f"""with a as ({_ANSWERS.replace('{ids}', _IDS)}), v as (select *, case when json_valid(raw) then raw end as json from a),
  k as (select id, raw, json, json_type(json) as whole, list_transform(['inn', 'bik'], lambda f: case json_type(json, '$.' || f) when 'UBIGINT' then 'int' when 'HUGEINT' then 'int' when 'DOUBLE' then case when contains(json_extract_string(json, '$.' || f), '.') then 'float' else 'int' end when 'BOOLEAN' then 'bool' when 'ARRAY' then 'list' when 'OBJECT' then 'dict' end) as kinds from v),
  e as (select *, list_filter([case when kinds[1] is not null then 'INN' || chr(10) || '{_WHY.format('string', 'string')}' || json_extract_string(json, '$.inn') || ', input_type=' || kinds[1] || ']' end,
    case when kinds[2] is not null then 'BIK' || chr(10) || '{_WHY.format('string', 'string')}40702810000000012345, input_type=' || kinds[2] || ']' end], lambda x: x is not null) as wrong from k)
  select id, case when whole = 'OBJECT' then json_extract_string(json, '$.inn') end as inn, case when whole = 'OBJECT' then kinds[1] end as inn_kind,
    case when whole = 'ARRAY' then '1 validation error for LLMExtractionResult' || chr(10) || 'parsed_data' || chr(10) || '{_WHY.format('dictionary', 'dict')}' || raw || ', input_type=list]' end as answer_error,
    case when whole = 'OBJECT' and len(wrong) > 0 then len(wrong) || case when len(wrong) > 1 then ' validation errors' else ' validation error' end || ' for RequisitesData' || chr(10) || array_to_string(wrong, chr(10)) end as record_error from e""")
def q_answer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of an answer is no text, for answers whose values no pattern replaces."""
    sql = _ANSWERS.replace("{", "{{").replace("}", "}}").replace("{{ids}}", K.IDS)
    t = K.read(spark, sf_dir, sql).withColumn("t", answers.typed(F.col("raw"))).select("id", "t.*")
    by_model = F.transform_values("answer", lambda k, v: F.lit("llm"))
    return t.select("id", F.col("answer")["inn"].alias("inn"), F.col("kinds")["inn"].alias("inn_kind"), F.col("error").alias("answer_error"), answers.record_error(F.col("answer"), F.col("kinds"), by_model).alias("record_error"))


@query(f"select doc_id, sha256('{answers.PROMPTS['v1'].split('{')[0]}' || coalesce(text, '')) as prompt_sha256 from documents")
def q_prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.sha2(answers.prompt(F.coalesce("text", F.lit("")), "v1"), 256).alias("prompt_sha256"))


# --- normalisation

_STEPS = r"""regexp_replace(regexp_replace(translate(regexp_replace(regexp_replace(text, '[\x{0b}\x{0c}\r\x{1c}-\x{1f}\x{85}\x{a0}\x{2028}\x{2029}]+', ' ', 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), chr(160) || chr(8203) || chr(65279), ' '), '[ \t]{2,}', ' ', 'g'), '(?m)^[ \t]+|[ \t]+$', '', 'g')"""
_JOIN = r"regexp_replace({}, '([^.!?:;,\-–—|\n])\n([а-яёa-z0-9(])', '\1 \2', 'g')"
_NORMAL = rf"left(regexp_replace(regexp_replace({_JOIN.format(_JOIN.format(_STEPS))}, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g'), 12000)"


@query(f"select id, {_NORMAL} as normalized, length(text) as chars_before, length({_NORMAL}) as chars_after from ({_NOISY})")
def q_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = normal.normalized(F.col("text"), compose=False)
    rows = K.noisy(spark, sf_dir).withColumn("normalized", t)
    return rows.select("id", "normalized", F.length("text").cast("bigint").alias("chars_before"), F.length("normalized").cast("bigint").alias("chars_after"))


@query(f"select doc_id, sha256({_NORMAL}) as normalized_sha256, length({_NORMAL}) as chars_after from documents")
def q_normalize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).select("doc_id", normal.normalized(F.col("text"), compose=False).alias("t"))
    return rows.select("doc_id", F.sha2("t", 256).alias("normalized_sha256"), F.length("t").cast("bigint").alias("chars_after"))


@query()
def q_normalize_nfkc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).select("doc_id", normal.composed(F.concat("text", F.lit("ﬁ①"))).alias("t"))
    return rows.select("doc_id", F.sha2("t", 256).alias("nfkc_sha256"))


_OCR_LINES = r"""regexp_replace(regexp_replace(regexp_replace(text, '([^\n])(ОКПО|ОКТМО|ОКВЭД|ОКАТО|ОКОПФ|ОКФС|КБК)', '\1' || chr(10) || '\2', 'g'),
  '\r\n|[\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]', chr(10), 'g'), '\n$', '')"""


@query(f"""select id, array_to_string(list_transform(string_split({_OCR_LINES}, chr(10)),
  lambda x: case when regexp_matches(x, '(?i)инн|кпп|огрн|бик|расчётн|корр|счёт|счет|р/с|к/с') then regexp_replace(regexp_replace(x, '([0-9]) ([0-9])', '\\1\\2', 'g'), '([0-9]) ([0-9])', '\\1\\2', 'g') else x end), chr(10)) as cleaned
  from ({_NOISY})""")
def q_ocr_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.noisy(spark, sf_dir).select("id", normal.ocr_cleaned(F.col("text")).alias("cleaned"))


# --- patterns over documents

_TRIM = "regexp_replace(x, '^\\s+|\\s+$', '', 'g')"


@query(f"""select doc_id, list_filter(list_transform(string_split(replace(replace(text, 'E mail', 'E-mail'), 'E-mail;', 'E-mail:'), chr(10)),
  lambda x: regexp_extract(replace({_TRIM}, ' ', ''), '{extract.EMAIL}')), lambda x: x <> '')[1] as email from documents""")
def q_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", extract.email(F.col("text")).alias("email"))


_PHONES = f"""list_filter(list_transform(regexp_extract_all(text, '{extract.PHONE}'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')), lambda x: length(x) = 11)"""


@query(f"""select doc_id, nullif(array_to_string(list_filter(p, lambda x, i: list_position(p, x) = i), ', '), '') as phones from (
  select doc_id, list_transform({_PHONES}, lambda x: case when x[1] in ('7', '8') then '+7' || x[2:] else x end) as p from documents)""")
def q_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", extract.joined_phones(F.col("text")).alias("phones"))


@query(f"select id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ',') as windows from (select id, regexp_extract_all(text, '[0-9]{{9}}') as w from ({_CARDS}))")
def q_digit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.cards(spark, sf_dir).select("id", F.array_join(extract.digit_windows(F.col("text"), 9), ",").alias("windows"))


_CEO = """select id, case id % 4 when 0 then 'Должность: Директор | Иванова Елена Петровна' when 1 then 'Генеральный директор: Петров Пётр Петрович' when 2 then 'Президент Сидоров А.Б.' else 'нет' end as text from ({ids}) x"""


@query(f"""select id, case id % 4 when 0 then 'Директор' when 1 then 'Генеральный директор' when 2 then 'Президент' end as position,
  case id % 4 when 0 then 'Петровна Иванова Елена' when 1 then 'Петров Пётр Петрович' end as full_name, case id % 4 when 0 then 'Петровна И.Е.' when 1 then 'Петров П.П.' when 2 then 'Сидоров А.Б.' end as short_name
  from ({_IDS})""")
def q_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = K.read(spark, sf_dir, _CEO.replace("{ids}", K.IDS)).withColumn("h", extract.head(F.col("text")))
    return rows.select("id", F.col("h.p").alias("position"), F.col("h.f").alias("full_name"), F.col("h.s").alias("short_name"))


_FREE = """select id, 'Компания, ИНН/КПП ' || coalesce(inn, '') || '/' || coalesce(kpp, '') || chr(10) || 'р/с ' || rs || chr(10) || 'к/с: ' || ks || chr(10) || 'в банке, БИК ' || bik || chr(10) || 'Наш ОГРН ' || coalesce(ogrn, '') || '.' as text, inn, kpp, ogrn, bik, rs, ks from ({ids}) x"""


@query(f"""select id, case when regexp_full_match(inn, '[0-9]{{10}}|[0-9]{{12}}') then inn end as inn,
  case when regexp_full_match(kpp, '[0-9]{{9}}') and not starts_with(case when regexp_full_match(inn, '[0-9]{{10}}|[0-9]{{12}}') then inn else '' end, kpp) then kpp end as kpp,
  case when length(ogrn) = 13 then ogrn end as ogrn, case when starts_with(rs, '40') then rs end as rs, ks from ({_FREE.replace('{ids}', _IDS)})""")
def q_free_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = extract.with_found(K.read(spark, sf_dir, _FREE.replace("{ids}", K.IDS))).select("id", "found.*")
    return d.select("id", "inn", "kpp", "ogrn", F.col("checking_account").alias("rs"), F.col("correspondent_account").alias("ks"))


# --- routing, identity, pages


_FILES = """select c_custkey as id, 'file.' || cast(c_custkey as string) || '.' || case c_custkey % 7 when 0 then 'PDF' when 1 then 'docx' when 2 then 'jpg' when 3 then 'bin' when 4 then 'csv' when 5 then 'TIF' else 'pdf' end as name,
  case c_custkey % 5 when 0 then 'application/pdf' when 1 then 'image/png' when 2 then 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' else 'text/csv' end as mime,
  c_custkey % 2 = 0 as has_text, c_custkey * 300000 as size from {customer}"""


@query(f"""select id, ext, case when ext = 'docx' or contains(mime, 'wordprocessingml') then 'docx' when ext in ('jpg', 'jpeg', 'png', 'tiff', 'tif', 'bmp', 'webp') or starts_with(mime, 'image/') then 'image'
  when ext = 'pdf' or mime = 'application/pdf' then case when has_text then 'pdf_text' else 'pdf_scan' end else 'unsupported' end as kind,
  case when ext not in ('pdf', 'docx', 'png', 'jpg', 'jpeg', 'tiff', 'bmp') then 400 when size > 20971520 then 413 end as code from (select *, lower(split_part(name, '.', 3)) as ext from ({_FILES.replace('{customer}', 'customer')}))""")
def q_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = routing.extension(F.col("name"))
    return K.read(spark, sf_dir, _FILES).select("id", ext.alias("ext"), routing.kind(ext, F.col("mime"), F.col("has_text")).alias("kind"), routing.upload_code(F.col("name"), F.col("size")).alias("code"))


@query("select doc_id, left(sha256(text), 8) as document_id, sha256(text) as sha256 from documents")
def q_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    sha = F.sha2("text", 256)
    return _documents(spark, sf_dir).select("doc_id", F.substring(sha, 1, 8).alias("document_id"), sha.alias("sha256"))


@query("""select doc_id, sha256(array_to_string(list_filter(list_transform(p, lambda x, i: case when trim(x) <> '' then '[Страница ' || i || ']' || chr(10) || trim(x) end), lambda x: x is not null), chr(10) || chr(10))) as blocks_sha256,
  (coalesce(length(trim(p[1])), 0) + coalesce(length(trim(p[2])), 0) + coalesce(length(trim(p[3])), 0)) >= 50 as has_text from (select doc_id, string_split(text, chr(10)) as p from documents)""")
def q_page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).select("doc_id", F.split("text", "\n").alias("p"))
    return rows.select("doc_id", F.sha2(pages.page_blocks(F.col("p")), 256).alias("blocks_sha256"), routing.text_layer(F.col("p")).alias("has_text"))


@query("""select doc_id, page, idx, line from (select doc_id, page, min(i) as idx, string_agg(w, ' ' order by i) as line, block from (
  select doc_id, i, i // 400 as page, i // 40 as block, (i // 7) % 3 as line_num, words[i + 1] as w from (select doc_id, words, unnest(range(len(words))) as i from (select doc_id, string_split(text, ' ') as words from documents)))
  where trim(w) <> '' group by doc_id, page, block, line_num)""")
def q_recognised_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    of_pages = lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / 400).cast("int")), lambda p: F.slice(w, p * 400 + 1, 400))
    paged = _documents(spark, sf_dir).select("doc_id", F.posexplode(let(F.split("text", " "), of_pages)).alias("p", "texts"))
    at = lambda i: F.col("p").cast("bigint") * 400 + i
    words = F.transform("texts", lambda t, i: F.struct(at(i).alias("idx"), F.floor(at(i) / 40).alias("block_num"), (F.floor(at(i) / 7) % 3).alias("line_num"), t.alias("text")))
    return pages.recognised_lines(paged.select("doc_id", F.col("p").cast("bigint").alias("page"), words.alias("words")))


@query("""select id, case when c = '' then '' else c end as rows from (select c_custkey as id, case c_custkey % 3 when 0 then 'ИНН | 77' || chr(10) || 'БИК' when 1 then 'a |  | b' else '' end as c from customer)""")
def q_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.array(F.array(F.lit("ИНН "), F.lit("77")), F.array(F.lit(" "), F.lit(None).cast("string")), F.array(F.lit("БИК"), F.lit(None).cast("string")))
    two = F.array(F.array(F.lit("a"), F.lit(""), F.lit("b")))
    none = F.array(F.array(F.lit(""), F.lit(" ")))
    k = F.col("c_custkey") % 3
    cells = F.when(k == 0, one).when(k == 1, two).otherwise(none)
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), F.array_join(pages.table_rows(cells), "\n").alias("rows"))


# --- all fields, labelled and free

_VALUES = {
    "company_name": "'Общество Ромашка ' || id", "short_name": "'ООО Ромашка ' || id", "legal_address": "'101000, Москва, дом ' || id", "postal_address": "'300000, Тула, дом ' || id",
    "ogrn": "'1027700' || lpad(cast(id as string), 6, '0')", "inn": "'77' || lpad(cast(id as string), 8, '0')", "kpp": "'55' || lpad(cast(id as string), 7, '0')", "bank_name": "'ПАО Берег ' || id",
    "checking_account": "'40702810' || lpad(cast(id as string), 12, '0')", "correspondent_account": "'30101810' || lpad(cast(id as string), 12, '0')", "bik": "'04' || lpad(cast(id as string), 7, '0')",
    "ceo_position": "'Директор'", "ceo_fio_full": "'Иванова Анна Петровна'", "ceo_fio": "'Иванова А.П.'", "phone": "'+7495' || lpad(cast(id as string), 7, '0')", "email": "'a' || id || '@example.ru'",
}
_VALUES = {f: v.replace("|| id", "|| cast(id as string)") for f, v in _VALUES.items()}
_LINES = {
    "company_name": "Полное наименование организации: ", "short_name": "Краткое наименование организации — ", "legal_address": "ЮРИДИЧЕСКИЙ АДРЕС:", "postal_address": "Почтовый адрес ", "ogrn": "ОГРН ", "inn": "ИНН: ", "kpp": "КПП: ",
    "bank_name": "Банк:", "checking_account": "Расчетный счет № ", "correspondent_account": "Корр. счет ", "bik": "БИК ", "ceo_fio_full": "Директор: ", "phone": "Телефон: 8", "email": "E-mail: ",
}
#: A card with every label; a legal address stands in the line after its label, a phone is written with 8.
_ALL = "select id, " + " || chr(10) || ".join(f"'{label}' || " + ("chr(10) || " if f == "legal_address" else "") + (f"substr({_VALUES[f]}, 3)" if f == "phone" else _VALUES[f]) for f, label in _LINES.items()) + " as text from ({ids}) x"
_FIELDS_SQL = ", ".join(f"{v} as {f}" for f, v in _VALUES.items())


@query(f"select id, {_FIELDS_SQL} from ({_IDS})")
def q_labelled_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sixteen fields of a card that labels each of them."""
    return extract.with_found(K.read(spark, sf_dir, _ALL.replace("{ids}", K.IDS))).select("id", "found.*")


@query(f"""select id, {', '.join(f'coalesce({v}, {chr(39) * 2}) as "{a}"' for (f, a), v in zip(ALIASES.items(), _VALUES.values(), strict=True))} from ({_IDS})""".replace("'Общество Ромашка ' || cast(id as string)", "case when id % 4 > 0 then 'Общество Ромашка ' || cast(id as string) end"))
def q_alias_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All names of the template; one that has no value is empty."""
    rows = K.read(spark, sf_dir, f"select id, {_FIELDS_SQL} from ({K.IDS}) x")
    d = F.struct(*[(F.when(F.col("id") % 4 > 0, F.col(f)) if f == "company_name" else F.col(f)).alias(f) for f in FIELDS])
    return rows.select("id", sinks.aliased(d).alias("a")).select("id", "a.*")


_TEMPLATE = "; ".join(f"{a}='{a}'" for a in ALIASES.values()) + "; 'OTHER'"


@query(f"select id, {' || '.join(f'{chr(39)}{a}={chr(39)} || {_VALUES[f]} || {chr(39)}; {chr(39)}' for f, a in ALIASES.items())} || '''OTHER''' as filled from ({_IDS})")
def q_template_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = K.read(spark, sf_dir, f"select id, {_FIELDS_SQL} from ({K.IDS}) x")
    return rows.select("id", sinks.template_text(F.lit(_TEMPLATE), F.struct(*FIELDS)).alias("filled"))


_LOOSE = """select id, 'Договор. Полное наименование стороны' || chr(10) || 'Общество Ромашка ' || cast(id as string) || chr(10) || '1. Краткое наименование стороны' || chr(10) || 'ООО Ромашка ' || cast(id as string) || chr(10)
  || '2. Юридический адрес:' || chr(10) || '101000, Москва, дом ' || cast(id as string) || chr(10) || case id % 3 when 0 then '3. Почтовый адрес: Тула, дом ' || cast(id as string) when 1 then 'Отделение почтовой связи ' || cast(id as string) else '3. Прочее' end || chr(10)
  || case when id % 2 = 0 then 'Счёт в банке: ПАО Дом, БИК ' else 'Обслуживающий банк ПАО Берег' || chr(10) || 'Код БИК: ' end || bik || chr(10) || 'тел. +7 (495) 000-' || lpad(cast(id % 100 as string), 2, '0') || '-11' as text, bik from ({ids}) x"""


@query(f"""select id, 'Общество Ромашка ' || id as company_name, 'ООО Ромашка ' || id as short_name, '101000, Москва, дом ' || id as legal_address,
  case id % 3 when 0 then 'Тула, дом ' || id when 1 then 'Отделение почтовой связи ' || id end as postal_address, case when id % 2 = 0 then 'ПАО Дом' else 'Обслуживающий банк ПАО Берег' end as bank_name,
  case when starts_with(bik, '04') then bik end as bik, '+7495000' || lpad(cast(id % 100 as string), 2, '0') || '11' as phone from ({_IDS})""")
def q_free_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, addresses, bank, BIK and phone of texts whose lines begin with no label."""
    d = extract.with_found(K.read(spark, sf_dir, _LOOSE.replace("{ids}", K.IDS)))
    return d.select("id", *[F.col("found")[f].alias(f) for f in ("company_name", "short_name", "legal_address", "postal_address", "bank_name", "bik", "phone")])


# --- merging of all fields

# Of each field: a model's value that a pattern's may replace, one that it may not, and the pattern's.
_SAID = {
    "company_name": ("Фирма", "Общество с ограниченной ответственностью", "ООО Ромашка Плюс"), "short_name": ("Общество Ромашка", "АО", "ООО Ромашка"), "legal_address": ("Москва", "101000, город Москва, улица Новая, дом 1", "101000, Москва, дом 5"),
    "postal_address": ("Тула", " 300000, Тула ", "300000, Тула"), "ogrn": ("102", "102 7700123450", "1027700123450"), "inn": ("7744", "500100732259", "7744012347"), "kpp": ("77", "774 401 001", "774401001"), "bank_name": ("", "Банк А", "Банк Б"),
    "checking_account": ("30702810000000012345", "40702810000000012340", "40702810000000012345"), "correspondent_account": ("40101810400000000225", "30101810400000000220", "30101810400000000225"), "bik": ("144525225", "044525220", "044525225"),
    "ceo_position": ("", "Президент", "Директор"), "ceo_fio_full": ("", "Петров Пётр Петрович", "Иванов Иван Иванович"), "ceo_fio": ("", "Петров П.П.", "Иванов И.И."), "phone": ("12-34", "8 (495) 111-22-33", "+74951112244"), "email": ("нет", "x@y.ru", "a@b.ru"),
}


def _pair(k: int, f: str) -> tuple[str, str]:
    """SQL of the model's and the pattern's value of the k-th field; each field meets all cases in another order."""
    worse, same, found = _SAID[f]
    return f"case (id + {k}) % 4 when 0 then null when 1 then '' when 2 then '{worse}' else '{same}' end", f"case (id * 7 + {k}) % 5 when 0 then null when 1 then '' else '{found}' end"


def _merged(k: int, f: str) -> tuple[str, str]:
    """SQL of what is left of the two, and of where it comes from."""
    model, found = _pair(k, f)
    case = f"(id * 7 + {k}) % 5 > 1 and (id + {k}) % 4 < 3"
    return f"case when {case} then '{_SAID[f][2]}' else {model} end as {f}", f"case when {case} then '{f}=regex' when (id + {k}) % 4 > {1 if _SAID[f][0] else 2} then '{f}=llm' end"


@query(f"select id, {', '.join(_merged(k, f)[0] for k, f in enumerate(FIELDS))}, array_to_string(list_filter([{', '.join(_merged(k, f)[1] for k, f in enumerate(FIELDS))}], lambda x: x is not null), ',') as sources from ({_IDS})")
def q_merge_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sixteen fields, each with no value, an empty, a worse and an equal one of the model against none, an empty and a good one."""
    values = ", ".join(f"{_pair(k, f)[0]} as a_{f}, {_pair(k, f)[1]} as b_{f}" for k, f in enumerate(FIELDS))
    rows = K.read(spark, sf_dir, f"select id, {values} from ({K.IDS}) x")
    answer = F.map_from_arrays(F.array(*map(F.lit, FIELDS)), F.array(*[F.col(f"a_{f}") for f in FIELDS]))
    m = merge.with_merged(rows.select("id", answer.alias("answer"), F.struct(*[F.col(f"b_{f}").alias(f) for f in FIELDS]).alias("found")))
    sources = F.transform(F.map_entries("extracted_by"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return m.select("id", "details.*", F.array_join(sources, ",").alias("sources"))


# --- what is told of a record

_TOLD = ", ".join(f"case when {n} is not null and reason_{n} is not null then '{label}: значение ''' || {n} || ''' отклонено — ' || reason_{n} end" for n, label in zip(_RULES, CHECKED.values(), strict=True))
_LACKS = ", ".join(f"case when {n}_left is null then '{label} отсутствует' end" for n, label in zip(_RULES, CHECKED.values(), strict=True))
_OF = dict(zip(CHECKED, _RULES, strict=True))
_MISSING = ", ".join(f"case when {_OF[f]}_left is null then '{f}' end" if f in _OF else f"'{f}'" for f in FIELDS if f in _OF or f in ("short_name", "legal_address", "postal_address"))
_FULL = "list_filter(x, lambda v, i: v is not null and list_position(x, v) = i)"


@query(f"""{_record_sql()}, t as (select *, [{_TOLD}, 'Кросс-проверка: ' || mismatch, {_LACKS}] as told, list_filter([{_MISSING}], lambda x: x is not null) as missing from record)
  select id, array_to_string({_FULL.replace('x,', 'told,')}, '; ') as review_reasons, array_to_string(missing, ', ') as missing_fields,
    array_to_string(list_concat(errors, ['Missing fields: ' || array_to_string(missing, ', ')]), '; ') as warnings from t""".replace("list_filter(told, lambda v, i: v is not null and list_position(x, v) = i)", "list_filter(told, lambda v, i: v is not null and list_position(told, v) = i)"))
def q_review_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader is told of a record: rejected values, the cross-check, what is missing, and all warnings."""
    r = with_details(K.cards(spark, sf_dir), compose=False)
    return r.select("id", F.array_join("review_reasons", "; ").alias("review_reasons"), F.array_join("missing_fields", ", ").alias("missing_fields"), F.array_join("warnings", "; ").alias("warnings"))


@query(" union all ".join(f"select * from ({_checked_sql(n, r)}) where id % 7 = {k}" for k, (n, r) in enumerate(_RULES.items())) + f" union all select id, null, null, null from ({_IDS}) where id % 7 = 6")
def q_single_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One value against the rule that its row names; a kind that there isn't has no verdict."""
    kind = value = None
    for k, n in enumerate(_RULES):
        kind = (F if kind is None else kind).when(F.col("id") % 7 == k, n)
        value = (F if value is None else value).when(F.col("id") % 7 == k, F.col(n))
    rows = K.ids(spark, sf_dir).select("id", kind.otherwise("swift").alias("kind"), value.otherwise(F.col("inn")).alias("value"))
    return rows.withColumn("c", checks.single(F.col("value"), F.col("kind"))).select("id", "c.*")


# --- exports and the store of results

_JSON_CHECK = "{{valid: reason_{n} is null, value: {n}, reason: {r}}}"
_JSON_DATA = {f: f"{_OF[f]}_left" if f in _OF else "null" if f in ("short_name", "legal_address", "postal_address") else f for f in FIELDS}


ORACLE["q_json_export"] = f"""{_record_sql()}, t as (select *, [{_TOLD}, 'Кросс-проверка: ' || mismatch, {_LACKS}] as told from record)
  select id as document_id, to_json({{document_id: id, needs_review: len(errors) > 0, fill_rate: round_even(filled / 16.0, 2)::double,
    data: {{{', '.join(f"{f}: {v}" for f, v in _JSON_DATA.items())}}}, data_aliases: {{{', '.join(f"'{a}': coalesce({_JSON_DATA[f]}, '')" for f, a in ALIASES.items())}}},
    validation: {{{', '.join(f"{f}: {_JSON_CHECK.format(n=n, r=f'reason_{n}')}" for f, n in _OF.items())}, cross_checks: list_filter([mismatch], lambda x: x is not null), errors: errors, review_reasons: list_filter(told, lambda v, i: v is not null and list_position(told, v) = i)}},
    extracted_by: map_from_entries(list_filter([{', '.join(f"('{f}', case when {_OF.get(f, f)} is not null then 'regex' end)" for f in FIELDS if f not in ('short_name', 'legal_address', 'postal_address'))}], lambda e: e[2] is not null)),
    processing_meta: {{llm_provider: 'mock', llm_model: 'mock', prompt_version: 'v1', fallback_used: true, fallback_count: 7 + {' + '.join(f'({n} is not null)::int' for n in _RULES)}}}}})::varchar as json from t"""

#: Results twice over: of the second time every third id, with another payload and a file of another format gone.
_STORED = """select 'd' || cast(id as string) as document_id, '{"inn":"' || coalesce(inn, '') || '","n":' || '$n' || '}' as payload, 'out/' || cast(id as string) || '.json' as json_path,
  case when $n = 2 then null else 'out/' || cast(id as string) || '.xlsx' end as xlsx_path, case when id % 5 = 0 then 'out/' || cast(id as string) || '.docx' end as docx_path from ({ids}) x where $n = 1 or id % 3 = 0"""


def _stored(spark: SparkSession, sf_dir: str) -> store.Store:
    kept = store.create(spark, shared.own_path(spark, "store"), buckets=16)
    for n in (1, 2):
        sql = _STORED.replace("$n", str(n)).replace('{"', '{{"').replace("'}'", "'}}'").replace("{ids}", K.IDS)
        store.upsert(kept, K.read(spark, sf_dir, sql), n)
    return kept


_HELD = f"""with s as ({' union all '.join(f"select *, {n} as n from ({_STORED.replace('$n', str(n)).replace('{ids}', _IDS)})" for n in (1, 2))}), held as (select * from s qualify row_number() over (partition by document_id order by n desc) = 1)"""


@query(f"""{_HELD} select a.document_id, case when held.document_id is null then 404 else 200 end as code, payload, case when held.document_id is null then 'No result for document_id=''' || a.document_id || '''' end as message
  from (select 'd' || (id * 2) as document_id from ({_IDS})) a left join held using (document_id)""")
def q_result_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second id is asked for, and as many that aren't there: the later of two results counts."""
    asked = K.ids(spark, sf_dir).select(F.concat(F.lit("d"), (F.col("id") * 2).cast("string")).alias("document_id"))
    return store.lookup(spark, _stored(spark, sf_dir), asked)


@query(f"""{_HELD}, a as (select 'd' || (case when id % 4 = 3 then -id else id end) as document_id, lower(case id % 5 when 0 then 'JSON' when 1 then 'xlsx' when 2 then 'Docx' when 3 then 'pdf' else 'json' end) as format from ({_IDS})),
  b as (select a.*, held.document_id is not null as found, case format when 'json' then json_path when 'xlsx' then xlsx_path when 'docx' then docx_path end as place from a left join held using (document_id))
  select document_id, format, case when not found then 404 when format = 'pdf' then 400 when place is null then 404 else 200 end as code, case when found then place end as path,
    case when not found then 'No result for document_id=''' || document_id || '''' when format = 'pdf' then 'Unknown format ''pdf''. Supported: json, xlsx, docx' when place is null then 'File not found for format=''' || format || '''' end as message from b""")
def q_result_download(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    fmt = F.when(i % 5 == 0, "JSON").when(i % 5 == 1, "xlsx").when(i % 5 == 2, "Docx").when(i % 5 == 3, "pdf").otherwise("json")
    asked = K.ids(spark, sf_dir).select(F.concat(F.lit("d"), F.when(i % 4 == 3, -i).otherwise(i).cast("string")).alias("document_id"), fmt.alias("format"))
    return store.download(spark, _stored(spark, sf_dir), asked)


# --- names and media types of uploads

_UPLOADS = """select id, case id % 6 when 0 then '../../etc/Pass ' || cast(id as string) || '.PDF' when 1 then 'Карта № ' || cast(id as string) || '.docx' when 2 then 'éte_' || cast(id as string) || '.tar.png' when 3 then '.скрыто' when 4 then '' else 'C:' || chr(92) || 'x' || chr(92) || 'a b.jpg' end as name,
  'abc' || cast(id as string) as document_id, case id % 8 when 0 then '255044462D' when 1 then 'FFD8FFE0' when 2 then '89504E470D' when 3 then '49492A0001' when 4 then '4D4D002A00' when 5 then '504B030414' when 6 then '' else '00' end as head,
  case id % 5 when 0 then 'docx' when 1 then 'pdf' when 2 then 'png' when 3 then 'jpeg' else 'zip' end as ext from ({ids}) x"""


@query(f"""select id, case id % 6 when 0 then 'etc_Pass_' || id || '_abc' || id || '.PDF' when 1 then 'No_' || id || '_abc' || id || '.docx' when 2 then 'ete_' || id || '.tar_abc' || id || '.png' when 5 then 'Cxa_b_abc' || id || '.jpg' else '_abc' || id end as stored,
  case when id % 6 in (3, 4) then 400 end as code,
  case when id % 8 = 0 then 'application/pdf' when id % 8 = 1 then 'image/jpeg' when id % 8 = 2 then 'image/png' when id % 8 in (3, 4) then 'image/tiff' when id % 5 = 0 then 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
    when id % 5 = 1 then 'application/pdf' when id % 5 = 2 then 'image/png' when id % 5 = 3 then 'image/jpeg' else 'application/octet-stream' end as mime from ({_IDS})""")
def q_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as a web form stores them, its codes without a bound of size, and media types by first bytes and extension."""
    rows = K.read(spark, sf_dir, _UPLOADS.replace("{ids}", K.IDS))
    name = F.col("name")
    return rows.select("id", routing.stored_name(name, F.col("document_id")).alias("stored"), routing.upload_code(name, F.lit(1 << 40), WEB_EXTENSIONS, None).alias("code"), routing.mime(F.unhex("head"), F.col("ext")).alias("mime"))

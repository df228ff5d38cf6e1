"""Single values, worked examples, merging rules and record validation."""

import re
import unicodedata

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kartoteka.functions import checks, normal
from kartoteka.operators import answers, merge, pages
from kartoteka.plans.details import with_details
from kartoteka.schema import FIELDS, Settings

CHECKS = [
    ("inn", "7744012347", None), ("inn", "500100732259", None), ("inn", None, "null"), ("inn", "", "null"), ("inn", "123abc456", "non-digit"), ("inn", "1234567890", "checksum"), ("inn", "12345", "length"), ("inn", "12345678901234", "length"),
    ("kpp", "774401001", None), ("kpp", "770101001", None), ("kpp", None, "null"), ("kpp", "12345", "length"),
    ("ogrn", "1027700123450", None), ("ogrn", "304500116000157", None), ("ogrn", "", "null"), ("ogrn", "12345", "length"), ("ogrn", "1027700123451", "checksum"), ("ogrn", "12345678", "OKPO/OKTMO"), ("ogrn", "1234567890", "OKPO/OKTMO"),
    ("bik", "044525225", None), ("bik", "12345", "length"), ("bik", "124525225", "04"),
    ("rs", "40702810000000012345", None), ("rs", "4070281000000001234", "length"), ("rs", "30101810400000000225", "40"), ("ks", "30101810400000000225", None), ("ks", "40101810400000000225", "30"),
]


def test_single_values(spark):
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(CHECKS)], "k int, kind string, value string, want string")
    for r in df.select("*", checks.single(F.col("value"), F.col("kind")).alias("c")).collect():
        assert r.c.valid == (r.want is None), r
        assert r.want is None or r.want in r.c.reason, r


def test_unknown_account(spark):
    (r,) = spark.range(1).select(checks.account(F.lit("40702810000000012345"), "savings").alias("c")).collect()
    assert r.c.reason == "unknown account type: savings"


CARD = "ООО Тест\nОГРН: 1027700123450\nИНН: 7744012347\nКПП: 774401001\nБанк: ПАО Сбербанк\nРасчетный счет: 40702810000000012345\nКорр. счет: 30101810400000000225\nБИК: 044525225\nТел.: 8 (495) 123-45-67\nE-mail: test@testorg.ru"
EXAMPLES = [
    (CARD, {"ogrn": "1027700123450", "inn": "7744012347", "kpp": "774401001", "bank_name": "ПАО Сбербанк", "checking_account": "40702810000000012345", "correspondent_account": "30101810400000000225", "bik": "044525225", "phone": "+74951234567", "email": "test@testorg.ru"}),
    ("ИНН: 500100732259", {"inn": "5001007322"}),
    ("Исполнитель ИНН 500100732259", {"inn": "500100732259"}),
    ("ИНН/КПП: 7744012347/774401001", {"inn": "7744012347", "kpp": "774401001"}),
    ("ОГРНИП: 304500116000157", {"ogrn": "3045001160001"}),
    ("Банковские реквизиты:", {"bank_name": "овские реквизиты"}),
    ("Банковские реквизиты:\nБанк: ПАО Пример", {"bank_name": "ПАО Пример"}),
    ("Полное наименование: ООО Пример\nИНН: 7744012347", {"company_name": "ИНН: 7744012347", "inn": "7744012347"}),
    ("Наш E-mail a@b.ru", {"email": "E-maila@b.ru"}),
    ("тел. 8 495 111-22-33 8 495 111-22-44", {}),
    ("тел. 8 495 111-22-33, 8 495 111-22-44", {"phone": "+74951112233, +74951112244"}),
    ("Должность: Директор | Иванова Елена Петровна", {"ceo_position": "Директор", "ceo_fio_full": "Петровна Иванова Елена", "ceo_fio": "Петровна И.Е."}),
    ("Директор: Иванов Иван Иванович", {"ceo_position": "Директор", "ceo_fio_full": "Иванов Иван Иванович", "ceo_fio": "Иванов И.И."}),
    ("Почтовый адрес: 101000, Москва", {"postal_address": "101000, Москва"}),
    ("", {}),
    (None, {}),
]


def test_worked_examples(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(EXAMPLES)], "k int, text string")
    for r in with_details(df).select("k", "found", "fill_rate", "status").collect():
        assert {f: v for f, v in r.found.asDict().items() if v is not None} == EXAMPLES[r.k][1], EXAMPLES[r.k][0]
        if r.k == 0:
            assert (r.fill_rate, r.status) == (0.56, "done")


@pytest.mark.parametrize(
    "field,llm,found,value,source",
    [
        ("inn", "7744 012347", "7744012347", "7744 012347", "llm"), ("inn", "774401234", "7744012347", "7744012347", "regex"), ("inn", None, "7744012347", "7744012347", "regex"), ("inn", "", None, "", None),
        ("company_name", "ООО", "ООО Пример", "ООО Пример", "regex"), ("short_name", "ООО Пример", "Пример", "ООО Пример", "llm"), ("short_name", "Общество Пример", "ООО Пример", "ООО Пример", "regex"),
        ("postal_address", "Москва", "Тула", "Тула", "regex"), ("email", "нет", "a@b.ru", "a@b.ru", "regex"), ("email", "x@y.ru", "a@b.ru", "x@y.ru", "llm"), ("phone", "123", "+74951234567", "+74951234567", "regex"), ("bank_name", "А", "Банк Б", "А", "llm"),
        ("bik", "124525225", "044525225", "044525225", "regex"),
    ],
)
def test_merging(spark, field, llm, found, value, source):
    none = F.lit(None).cast("string")
    df = spark.range(1).select(F.create_map(F.lit(field), F.lit(llm).cast("string")).alias("answer"), F.struct(*[(F.lit(found).cast("string") if f == field else none).alias(f) for f in FIELDS]).alias("found"))
    r = merge.with_merged(df).first()
    assert r.details[field] == value
    assert r.extracted_by.get(field) == source


def test_record_with_a_model(spark):
    """A client's answer is used; a failing call and a broken answer are the row's own."""

    def client(settings):
        def ask(prompt):
            if "сбой" in prompt:
                raise OSError("no service")
            return '{"inn": "1234567890", "short_name": "ООО Б", "ceo_fio": "", "other": 1}' if "хорошо" in prompt else "no json"

        return ask

    df = spark.createDataFrame([(1, "хорошо"), (2, "сбой"), (3, "иначе")], "k int, text string")
    r = {x.k: x for x in with_details(df, Settings(provider="test"), client=client).collect()}
    assert r[1].details.inn is None and r[1].details.company_name == "ООО Б" and r[1].details.ceo_fio == ""
    assert "ИНН: значение '1234567890' отклонено — invalid checksum (10-digit INN)" in r[1].review_reasons and r[1].errors[0] == "invalid checksum (10-digit INN)"
    assert r[1].fill_rate == 0.19 and r[1].extracted_by == {"inn": "llm", "short_name": "llm"}
    assert r[2].answer_error == "test call failed: no service" and r[3].answer_error == "Cannot parse LLM JSON: Expecting value: line 1 column 1 (char 0)"
    assert r[2].status == r[3].status == "error"


@pytest.mark.parametrize("provider,called,parsed", [("openai", "OpenAI call failed: no", "Cannot parse LLM JSON: Expecting value: line 1 column 1 (char 0)"), ("ollama", "Ollama call failed: no", "Cannot parse Ollama JSON: Expecting value: line 1 column 1 (char 0)")])
def test_messages_of_providers(provider, called, parsed):
    def ask(prompt):
        if prompt == "a":
            raise OSError("no")
        return None if prompt == "b" else "{}"

    assert [answers._one(ask, provider, p) for p in "abc"] == [(None, None, called), ("", None, parsed), ("{}", "{}", None)]


def test_values_that_are_no_text(spark):
    """A number that no pattern replaces ends the row; one that is replaced doesn't; nothing is written as Python writes it."""

    def client(settings):
        return lambda prompt: prompt.rsplit("\n", 1)[1]

    said = ['{"inn": 7744012347}', '{"bank_name": ["a", true], "kpp": {"x": null}}', '{"inn": 12, "email": false}', "[1, 2]", "null", '"text"', '{"inn": null, "inn": "77", "phone": 1.5}', '{"bik": 40702810000000012345}']
    rows = [(k, ("Исполнитель ИНН 500100732259\n" if k == 2 else "") + "\n" + t) for k, t in enumerate(said)]
    df = spark.createDataFrame(rows, "k int, text string")
    got = {r.k: r for r in with_details(df, Settings(provider="test"), client=client).collect()}
    one = lambda alias, value, kind: f"{alias}\n  Input should be a valid string [type=string_type, input_value={value}, input_type={kind}]"
    head = "1 validation error for RequisitesData\n"
    assert got[0].answer_error == head + one("INN", "7744012347", "int") and got[0].answer["inn"] == "7744012347"
    assert got[1].answer_error == "2 validation errors for RequisitesData\n" + one("KPP", '{"x":null}', "dict") + "\n" + one("BANK_NAME", '["a",true]', "list")
    assert got[2].extracted_by["inn"] == "regex" and got[2].answer_error == head + one("E-MAIL", "false", "bool")
    dictionary = "1 validation error for LLMExtractionResult\nparsed_data\n  Input should be a valid dictionary [type=dict_type, input_value="
    assert [got[k].answer_error for k in (3, 4, 5)] == [dictionary + x for x in ("[1, 2], input_type=list]", "null, input_type=NoneType]", '"text", input_type=str]')]
    assert got[6].answer_error == head + one("TEL", "1.5", "float") and got[6].details.inn is None  # the last of two keys counts, and is no INN
    assert got[7].answer_error == head + one("BIK", "40702810000000012345", "int")
    assert {r.status for r in got.values()} == {"exception"}


def test_equal_prompts_are_asked_once(spark, tmp_path):
    """Calls are counted in files: one for each distinct prompt whatever the rows and actions, a few at once in a task."""
    log = str(tmp_path)

    def client(settings):
        def ask(prompt):
            import os
            import time
            import uuid

            began = time.time()
            time.sleep(0.05)
            with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
                f.write(f"{os.getpid()} {began} {time.time()} {prompt[-9:]}")
            return '{"short_name": "ООО %s"}' % prompt[-1]

        return ask

    df = spark.range(300).selectExpr("id", "concat('документ ', id % 40) as text").repartition(5)
    settings = Settings(provider="test", calls_at_once=3)
    out = answers.with_answer(df, settings, "text", client)
    assert out.count() == 300 and {(r.id % 10, r.answer["short_name"]) for r in out.collect()} == {(k, f"ООО {k}") for k in range(10)}
    calls = [f.read_text().split(" ", 3) for f in tmp_path.iterdir()]
    assert len(calls) == len({c[3] for c in calls}) == 40
    most = 0
    for pid in {c[0] for c in calls}:
        own = [(float(a), float(b)) for p, a, b, _ in calls if p == pid]
        most = max(most, *(sum(a <= t < b for a, b in own) for t, _ in own))
    assert 2 <= most <= 3


def test_cross_check_and_truncation(spark):
    text = CARD.replace("30101810400000000225", "30101810400000000999") + "\n" + "слово " * 3000
    r = with_details(spark.createDataFrame([(1, text)], "k int, text string")).first()
    assert r.errors == ["BIK and correspondent account mismatch"] and r.details.bik == "044525225"
    assert r.warnings[0] == f"Text truncated: {len(text)} → 12000 chars"


def test_normalisation(spark):
    rows = ["a  b\tc\t\td", "ﬁ①", "строка\nпродолжение\nEще", "конец.\nдалее", "a\n\n\n\nb", " \xa0x​ ", "a\r\nb\x07", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, t string")
    got = [r.n for r in df.select("k", normal.normalized(F.col("t")).alias("n")).orderBy("k").collect()]
    assert got == ["a b\tc d", "fi1", "строка продолжение\nEще", "конец.\nдалее", "a\n\nb", "x", "a b", None]


def test_composition_of_all_code_points(spark):
    """Equal to Python's tables, but for characters that these don't have yet."""
    cps = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    texts = ["a" + chr(c) + "\u0301" + chr(c) for c in cps] + ["\u1100\u1161\u11a8 ﬁ①№\u00a0", "e\u0301\u0327", ""]
    df = spark.createDataFrame(pd.DataFrame({"t": texts}))
    got = df.select("t", normal.composed(F.col("t")).alias("n")).toPandas()
    assert got.n.tolist() == [unicodedata.normalize("NFKC", t) for t in got.t] and len(got) == len(texts)
    stable = [chr(c) for c in cps if re.match(f"[{normal.STABLE}]", chr(c))]
    assert len(stable) > 400 and all(unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c) for c in stable)
    joined = "".join(a + b for a in stable for b in stable)
    assert unicodedata.normalize("NFKC", joined) == joined
    (none,) = spark.createDataFrame([(None,)], "t string").select(normal.composed(F.col("t"))).first()
    assert none is None


def test_lines_of_recognised_text(spark):
    texts = ["ИНН 77 12\r\nКПП 1 2\x0cв 1 2\n", "a\n\n", "\n", "", "БИК 0 4\u2028р/с 4 0\x85x", "ОКПО 1ОКВЭД 2"]
    got = [r.c for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(normal.ocr_cleaned(F.col("t")).alias("c")).collect()]
    assert got == ["ИНН 7712\nКПП 12\nв 1 2", "a\n", "", "", "БИК 04\nр/с 40\nx", "\nОКПО 1\nОКВЭД 2"]


def test_providers_and_prompts():
    assert answers.provider(Settings(provider="openai")) == "mock" and answers.provider(Settings(provider="openai", api_key="k")) == "openai"
    assert answers.provider(Settings(provider="other")) == "mock"
    with pytest.raises(ValueError):
        answers.prompt(F.lit("x"), "v9")


def test_recognised_lines_are_made_without_a_shuffle(spark):
    words = [(0, 1, 1, "a"), (1, 1, 2, "b"), (2, 1, 1, " "), (3, 1, 1, "c\nd"), (4, 2, 1, "e"), (5, None, 1, "f"), (6, 1, 2, "g"), (7, None, 1, "h"), (8, 2, 1, None)]
    schema = "doc_id int, page long, words array<struct<idx:long,block_num:long,line_num:long,text:string>>"
    df = pages.recognised_lines(spark.createDataFrame([(1, 0, words), (1, 1, []), (2, 0, [(0, 1, 1, " ")]), (3, 0, None), (3, 1, words[::-1])], schema))
    want = [(0, "a c\nd"), (1, "b g"), (4, "e"), (5, "f h")]
    assert sorted(tuple(r) for r in df.collect()) == [(1, 0, *x) for x in want] + [(3, 1, *x) for x in want]
    from kartoteka.plans.queries import QUERIES

    plan = QUERIES["q_recognised_lines"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_answers_are_parsed_once(spark):
    df = spark.createDataFrame([("{}",)], "raw string").select(answers.typed(F.col("raw")).alias("t"))
    plan = df.select("t.*")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json(") + plan.count("parseJson") <= 3 and plan.count("variant_get(") <= 4


def test_white_space_and_joined_lines_are_those_of_the_plain_patterns(spark):
    """Every code point of the first plane, in its line and at both sides of a line's end."""
    df = spark.range(1, 0x10000).where("id not between 55296 and 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    df = df.select(F.concat(F.lit("a"), "c", "c", F.lit("b")).alias("s"), F.concat("c", F.lit("\n"), "c", F.lit("\nb\n"), "c").alias("j"))
    spaced = F.regexp_replace("s", r"(?U)[\s\x1c-\x1f&&[^ \t\n]]+", " ")
    joined = F.regexp_replace("j", rf"(?<=[^{normal._ENDS}\n])\n(?=[а-яёa-z0-9(])", " ")
    assert df.where((normal.spaced(F.col("s")) != spaced) | (normal.rejoined(F.col("j")) != joined)).count() == 0
    assert "(?U)" not in normal._EXOTIC


def test_classifiers_and_gaps_are_those_of_the_plain_patterns(spark):
    """Every code point of the first plane as the first letter of a classifier, and as a digit."""
    df = spark.createDataFrame(pd.DataFrame({"c": [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]}), "c string")
    df = df.select(F.concat(F.lit("a"), "c", F.lit("КПО "), "c", F.lit("бк\n"), "c", F.lit("КВЭД")).alias("s"), F.concat(F.lit("ИНН "), "c", F.lit(" "), "c", F.lit(" 1 2")).alias("g"))
    plain = F.regexp_replace("s", rf"(?iu)(?<!\n)({'|'.join(normal.CLASSIFIERS)})", "\n$1")
    assert df.where(normal.split_classifiers(F.col("s")) != plain).count() == 0
    text = F.regexp_replace(F.regexp_replace("g", rf"(?:{normal.LINE_END})\z", ""), normal.LINE_END, "\n")
    assert df.where((F.instr(text, "\n") == 0) & (normal.without_digit_gaps(F.col("g")) != F.regexp_replace("g", r"(?U)(?<=\d) (?=\d)", ""))).count() == 0

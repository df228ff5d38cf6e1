"""Language-model answers: prompts, a mock without a model, clients over HTTP, and what of an answer is no text.

Equal prompts are asked once: prompts are deduplicated by hash and dealt over all tasks, a task has a bounded number of calls
open at once, and answers are written before they are joined back, so that no later action asks again.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartoteka.functions.rx import let
from kartoteka.schema import ALIASES, FIELDS, Settings
from kartoteka.sources import shared

_NAMES = ", ".join(FIELDS)
#: Prompts by version; the placeholder is replaced plainly, so any braces reach the model as they stand.
PROMPTS = {
    "v1": f"Extract company details from the document as JSON with the keys {_NAMES}. Use null for what is absent.\n\n{{document_text}}",
    "v2": f"Return one JSON object only, with the keys {_NAMES}. Copy values exactly; null for what is absent.\n\n{{document_text}}",
    "v3": f"The text below is a Russian business document. Find the details of the counterparty, not of our own firm. JSON keys: {_NAMES}; null for what is absent.\n\n{{document_text}}",
    "image": f"The text below was recognised from an image and may have wrong letters. JSON keys: {_NAMES}; null for what is absent.\n\n{{document_text}}",
}


def prompt(text: Column, version: str = "v1") -> Column:
    if version not in PROMPTS:
        raise ValueError(f"unknown prompt version: {version}")
    return F.replace(F.lit(PROMPTS[version]), F.lit("{document_text}"), text)


def mock_answer() -> Column:
    """All fields null."""
    return F.map_from_arrays(F.array(*map(F.lit, FIELDS)), F.array_repeat(F.lit(None).cast("string"), len(FIELDS)))


def _post(url: str, body: dict, settings: Settings, headers: dict[str, str]) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"} | headers)
    with urllib.request.urlopen(request, timeout=settings.timeout_s) as reply:
        return json.load(reply)


def chat_client(settings: Settings) -> Callable[[str], str]:
    """A chat-completions service in JSON mode."""

    def ask(text: str) -> str:
        body = {"model": settings.model, "messages": [{"role": "user", "content": text}], "temperature": settings.temperature, "max_tokens": settings.max_tokens, "response_format": {"type": "json_object"}}
        return _post(f"{settings.base_url or 'https://api.openai.com/v1'}/chat/completions", body, settings, {"Authorization": f"Bearer {settings.api_key}"})["choices"][0]["message"]["content"]

    return ask


def generate_client(settings: Settings) -> Callable[[str], str]:
    """A local generate service, not streaming, in JSON mode."""

    def ask(text: str) -> str:
        return _post(f"{settings.base_url or 'http://localhost:11434'}/api/generate", {"model": settings.model, "prompt": text, "stream": False, "format": "json"}, settings, {})["response"]

    return ask


def provider(settings: Settings) -> str:
    """The provider that a run uses: mock for unknown ones and for openai without a key."""
    name = settings.provider.lower()
    if name == "openai" and (settings.api_key or "none").lower() == "none":
        return "mock"
    return name if name in ("openai", "ollama") else "mock"


# The names by which a failed call and an answer that is no JSON are reported, by provider.
CALLED = {"openai": "OpenAI", "ollama": "Ollama"}
PARSED = {"openai": "LLM", "ollama": "Ollama"}
#: What a service may return: its text, that text as plain JSON, and what went wrong.
ASKED = "answer_raw string, answer_json string, answer_error string"

Client = Callable[[Settings], Callable[[str], str]]


def _one(ask: Callable[[str], str], name: str, prompt: str) -> tuple[str | None, str | None, str | None]:
    try:
        raw = ask(prompt) or ""
    except Exception as e:  # the service's failure belongs to the row
        return None, None, f"{CALLED.get(name, name)} call failed: {e}"
    try:
        return raw, json.dumps(json.loads(raw), ensure_ascii=False), None
    except ValueError as e:
        return raw, None, f"Cannot parse {PARSED.get(name, 'LLM')} JSON: {e}"


def _asked(prompts: pd.Series, ask: Callable[[str], str], name: str, pool: ThreadPoolExecutor) -> pd.DataFrame:
    """Answers to a batch's distinct prompts, several at once."""
    distinct = list(dict.fromkeys(prompts))
    found = dict(zip(distinct, pool.map(lambda p: _one(ask, name, p), distinct), strict=True))
    return pd.DataFrame([found[p] for p in prompts], columns=[x.split()[0] for x in ASKED.split(", ")])


def _table(prompts: DataFrame, make: Client, settings: Settings, name: str) -> DataFrame:
    """Answers by key of distinct prompts, written."""
    spark = prompts.sparkSession
    # prompts are few bytes and long to answer: as many tasks as the session shuffles to, whatever their size
    dealt = prompts.dropDuplicates(["_key"]).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))

    def asked(batches):
        ask = make(settings)
        with ThreadPoolExecutor(settings.calls_at_once) as pool:
            for b in batches:
                yield pd.concat([b[["_key"]], _asked(b["_prompt"], ask, name, pool)], axis=1)

    path = shared.own_path(spark, "answers")
    dealt.mapInPandas(asked, f"_key string, {ASKED}").write.parquet(path)
    return spark.read.parquet(path)


def with_answer(df: DataFrame, settings: Settings, text: str = "text", client: Client | None = None) -> DataFrame:
    """Adds answer_raw, answer (a map of strings), answer_kinds (of those values that are no strings) and answer_error to each row.

    The mock needs no Python. Else the rows' distinct prompts are asked now, each once, and the rows are read again to be joined
    with the answers: rows best are a table. Tasks make one client each, which their calls share. A stream asks batch by batch.
    A failed call, or an answer that is no JSON object, is an error text of its rows, whose answer is null.
    """
    name = provider(settings) if client is None else settings.provider
    none = F.lit(None).cast("map<string,string>")
    if name == "mock":
        return df.withColumns({"answer_raw": F.lit("{}"), "answer": mock_answer(), "answer_kinds": none, "answer_error": F.lit(None).cast("string")})
    make = client or {"openai": chat_client, "ollama": generate_client}[name]
    said = prompt(F.coalesce(F.col(text), F.lit("")), settings.prompt_version)
    if df.isStreaming:

        def answered(batches):
            ask = make(settings)
            with ThreadPoolExecutor(settings.calls_at_once) as pool:
                for b in batches:
                    yield _asked(b, ask, name, pool)

        out = df.withColumn("_a", F.pandas_udf(answered, ASKED, F.PandasUDFType.SCALAR_ITER)(said)).select("*", "_a.*").drop("_a")
    else:
        keyed = df.withColumn("_key", F.sha2(said, 256))
        out = keyed.join(_table(keyed.select("_key", said.alias("_prompt")), make, settings, name), "_key", "left").drop("_key")
    t = typed(F.col("answer_json"))
    out = out.withColumn("_t", t).withColumns({"answer": F.col("_t.answer"), "answer_kinds": F.col("_t.kinds"), "answer_error": F.coalesce("answer_error", F.col("_t.error"))})
    return out.drop("_t", "answer_json")


def _kind(value: Column) -> Column:
    """What a JSON value other than a string or null is; null for those."""
    return let(F.schema_of_variant(value), _kind_of)


def _kind_of(schema: Column) -> Column:
    return (
        F.when(schema.startswith("OBJECT"), F.lit("dict")).when(schema.startswith("ARRAY"), F.lit("list")).when(schema == "BOOLEAN", F.lit("bool"))
        .when((schema == "BIGINT") | schema.endswith(",0)"), F.lit("int")).when(schema.startswith("DECIMAL") | (schema == "DOUBLE") | (schema == "FLOAT"), F.lit("float"))
    )


def typed(raw: Column) -> Column:
    """A JSON text as a struct: answer, a map of the fields that it has, as strings; kinds, what those are that are no strings;
    error, for a JSON value that is no object. A null, or what is no JSON, gives nulls. Keys that are no fields are left out.
    """
    return let(F.try_parse_json(raw), lambda v: _parts(v, raw))


def _parts(v: Column, raw: Column) -> Column:
    """What typed() tells of a parsed value; each field that is there is read once."""
    is_object = F.schema_of_variant(v).startswith("OBJECT")
    values = F.when(is_object, F.try_variant_get(v, "$", "map<string,variant>"))
    said = F.transform(
        F.filter(F.map_entries(F.map_filter(values, lambda k, x: k.isin(*FIELDS) & x.isNotNull())), lambda e: e.isNotNull()),
        lambda e: F.struct(e["key"].alias("name"), F.try_variant_get(e["value"], "$", "string").alias("text"), _kind(e["value"]).alias("kind")),
    )
    whole = F.coalesce(_kind(v), F.when(F.is_variant_null(v), F.lit("NoneType")).otherwise(F.lit("str")))
    no_object = F.concat(F.lit("1 validation error for LLMExtractionResult\nparsed_data\n  Input should be a valid dictionary [type=dict_type, input_value="), raw, F.lit(", input_type="), whole, F.lit("]"))
    # in the order of the fields
    placed = let(said, lambda s: F.flatten(F.transform(F.array(*map(F.lit, FIELDS)), lambda f: F.filter(s, lambda e: e["name"] == f))))
    return let(
        placed,
        lambda s: F.struct(
            F.map_from_entries(F.transform(s, lambda e: F.struct(e["name"], e["text"]))).alias("answer"),
            F.map_from_entries(F.transform(F.filter(s, lambda e: e["kind"].isNotNull()), lambda e: F.struct(e["name"], e["kind"]))).alias("kinds"),
            F.when(v.isNotNull() & ~is_object, no_object).alias("error"),
        ),
    )


def record_error(answer: Column, kinds: Column, sources: Column) -> Column:
    """Why an answer's values can't be a record's, for fields whose value is the model's and no string; null if all can."""
    said = [
        F.when((sources[f] == "llm") & kinds[f].isNotNull(), F.concat(F.lit(f"{a}\n  Input should be a valid string [type=string_type, input_value="), answer[f], F.lit(", input_type="), kinds[f], F.lit("]")))
        for f, a in ALIASES.items()
    ]

    def told(wrong: Column) -> Column:
        n = F.size(wrong)
        head = F.concat(n.cast("string"), F.when(n > 1, F.lit(" validation errors")).otherwise(F.lit(" validation error")), F.lit(" for RequisitesData\n"))
        return F.when(n > 0, F.concat(head, F.array_join(wrong, "\n")))

    return let(F.filter(F.array(*said), lambda x: x.isNotNull()), told)

"""The whole plan from text to a checked record: one narrow stage, no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartoteka.functions import normal
from kartoteka.operators import answers, extract, merge, validate
from kartoteka.schema import Settings


def with_details(df: DataFrame, settings: Settings = Settings(), compose: bool = True, client: Callable | None = None) -> DataFrame:
    """Adds to rows with `text` (and, if there, `extraction_warnings`) the record, its checks and what is reported of it.

    A null text gives a record of nulls. The status is error or exception if `failure` says so, error if the model call failed,
    and exception if its answer has values that are no text. Columns added: normalized_text, answer_raw, answer, answer_kinds, answer_error, found, details,
    extracted_by, checks, cross_checks, errors, review_reasons, needs_review, fill_rate, missing_fields, warnings, status,
    processing_meta.
    """
    text = normal.normalized(F.col("text"), settings.max_chars, compose)
    if settings.ocr_cleanup:
        text = normal.ocr_cleaned(text)
    out = answers.with_answer(df.withColumn("normalized_text", text), settings, "normalized_text", client)
    name = answers.provider(settings) if client is None else settings.provider
    # the mock answers nothing, so nothing is compared with it
    out = merge.with_merged(extract.with_found(out, "normalized_text"), None if name == "mock" else "answer")
    unfit = F.lit(None).cast("string") if name == "mock" else answers.record_error(F.col("answer"), F.col("answer_kinds"), F.col("extracted_by"))
    if name != "mock":
        out = out.withColumn("_unfit", unfit)
        unfit = F.col("_unfit")
    out = validate.with_validated(out.withColumn("details", merge.name_filled(F.col("details"))))
    said = F.col("extraction_warnings") if "extraction_warnings" in df.columns else F.lit(None).cast("array<string>")
    d = F.col("details")
    there = set(df.columns)
    # what no rule foresaw of an answer is an exception, a failed call or a broken answer an error
    odd = unfit.isNotNull() | F.col("answer_error").contains(" validation error")
    failed = F.when(odd, F.lit("exception")).when(F.col("answer_error").isNotNull(), F.lit("error"))
    failure = F.coalesce(F.col("failure") if "failure" in there else F.lit(None).cast("string"), failed)
    origin = lambda *names: [F.col(c).alias(c) for c in names if c in there]
    out = out.withColumns({
        "answer_error": F.coalesce("answer_error", unfit),
        "fill_rate": validate.fill_rate(d),
        "missing_fields": validate.missing_fields(d),
        "warnings": validate.warnings(said, F.length("text"), F.col("errors"), d, settings.max_chars),
        "status": validate.status(F.col("needs_review"), failure),
        "processing_meta": F.struct(
            *origin("extractor", "ocr_used"), F.lit(name).alias("llm_provider"), F.lit(settings.model if name != "mock" else "mock").alias("llm_model"), F.lit(settings.prompt_version).alias("prompt_version"),
            *origin("sha256"), (F.size("extracted_by") > 0).alias("fallback_used"), F.size("extracted_by").alias("fallback_count"), F.map_keys("extracted_by").alias("fallback_fields"),
        ),
    })
    return out.drop("_unfit")


def counters(results: DataFrame) -> DataFrame:
    """Documents by status: done, needs_review, and failed for those that ended in an error or exception."""
    state = F.when(F.col("status").isin("error", "exception"), F.lit("failed")).otherwise(F.col("status"))
    return results.groupBy(state.alias("status")).agg(F.count("*").alias("n"))

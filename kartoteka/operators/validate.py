"""Validation of a record, and what is reported of it. Row by row, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartoteka.functions import checks, rx
from kartoteka.schema import CHECKED, FIELDS


def quoted(value: Column) -> Column:
    """The value as a quoted literal: in single quotes, in double ones if it has only single ones inside."""
    v = value
    for a, b in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        v = F.replace(v, F.lit(a), F.lit(b))
    double = value.contains("'") & ~value.contains('"')
    return F.when(double, F.concat(F.lit('"'), v, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(v, F.lit("'"), F.lit("\\'")), F.lit("'")))


@rx.built_once
def _checks(details: str) -> Column:
    return rx.once(F.struct(*[checks.FIELD_CHECKS[f](F.col(details)[f]).alias(f) for f in CHECKED]))


def with_validated(df: DataFrame, details: str = "details") -> DataFrame:
    """Nulls invalid identifiers in the struct and adds checks, cross_checks, errors, review_reasons and needs_review.

    The six checks come first, then BIK against correspondent account on what is left, then a message for each identifier
    that is empty now. Messages keep their order and are distinct.
    """
    staged = df.withColumn("checks", _checks(details))
    bad = {f: ~F.col("checks")[f]["valid"] for f in CHECKED}
    rejected = {f: bad[f] & F.col(details)[f].isNotNull() for f in CHECKED}
    reason = {f: F.col("checks")[f]["reason"] for f in CHECKED}
    said = [F.when(rejected[f], reason[f]) for f in CHECKED]
    told = [F.when(rejected[f], F.concat(F.lit(f"{label}: значение "), quoted(F.col(details)[f]), F.lit(" отклонено — "), reason[f])) for f, label in CHECKED.items()]
    staged = staged.withColumns({"_said": F.array(*said), "_told": F.array(*told)})
    left = F.struct(*[(F.when(~bad[f], F.col(details)[f]) if f in CHECKED else F.col(details)[f]).alias(f) for f in FIELDS])
    staged = staged.withColumn(details, left)
    d = F.col(details)
    staged = staged.withColumn("_cross", checks.cross(d["bik"], d["correspondent_account"]))
    missing = F.array(*[F.when(rx.blank(d[f]), F.lit(f"{label} отсутствует")) for f, label in CHECKED.items()])
    full = lambda *arrays: F.array_distinct(F.filter(F.concat(*arrays), lambda x: x.isNotNull()))
    out = staged.withColumns({
        "cross_checks": F.filter(F.array("_cross"), lambda x: x.isNotNull()),
        "errors": full("_said", F.array("_cross"), missing),
        "review_reasons": full("_told", F.array(F.concat(F.lit("Кросс-проверка: "), F.col("_cross"))), missing),
    })
    return out.withColumn("needs_review", F.size("errors") > 0).drop("_said", "_told", "_cross")


def missing_fields(details: Column) -> Column:
    """Names of the fields that are null, in order; the empty string counts as filled."""
    return F.filter(F.array(*[F.when(details[f].isNull(), F.lit(f)) for f in FIELDS]), lambda x: x.isNotNull())


def fill_rate(details: Column) -> Column:
    """The share of fields that are not null, rounded half to even to two places."""
    return F.bround((F.lit(len(FIELDS)) - F.size(missing_fields(details))) / F.lit(float(len(FIELDS))), 2)


def warnings(extraction: Column, raw_chars: Column, errors: Column, details: Column, max_chars: int) -> Column:
    """What a reader should know: extraction's warnings, truncation, errors, missing fields; distinct, in that order."""
    cut = F.when(raw_chars > max_chars, F.array(F.concat(F.lit("Text truncated: "), raw_chars.cast("string"), F.lit(f" → {max_chars} chars")))).otherwise(F.array().cast("array<string>"))
    missing = missing_fields(details)
    lacks = F.when(F.size(missing) > 0, F.array(F.concat(F.lit("Missing fields: "), F.array_join(missing, ", ")))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.coalesce(extraction, F.array().cast("array<string>")), cut, errors, lacks))


def status(needs_review: Column, failure: Column | None = None) -> Column:
    """done or needs_review; of a file or model call that failed, error, or exception where nothing foresaw it."""
    done = F.when(needs_review, F.lit("needs_review")).otherwise(F.lit("done"))
    return done if failure is None else F.coalesce(failure, done)

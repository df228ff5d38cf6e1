"""A model's answer and the patterns' findings, merged field by field with their provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartoteka.functions import rx
from kartoteka.schema import FIELDS

# Legal forms that a short name should have.
LEGAL_FORMS = ("ООО", "АО", "ИП", "ПАО")


def _size(digits: Column, *sizes: int) -> Column:
    return F.length(digits).isin(*sizes)


# How many digits an identifier may have, and how some begin.
SIZES = {"inn": (10, 12), "kpp": (9,), "ogrn": (13,), "bik": (9,), "checking_account": (20,), "correspondent_account": (20,)}
BEGINS = {"bik": "04", "checking_account": "40", "correspondent_account": "30"}


def better(field: str, llm: Column, found: Column) -> Column:
    """Whether the patterns' value replaces the model's, neither being empty."""
    if field in SIZES:
        fine = lambda d: _size(d, *SIZES[field]) & d.startswith(BEGINS.get(field, ""))
        digits = F.struct(rx.digits(rx.trimmed(llm)).alias("a"), rx.digits(rx.trimmed(found)).alias("b"))
        out = rx.let(digits, lambda d: d["a"].isNotNull() & d["b"].isNotNull() & fine(d["b"]) & ~fine(d["a"]))
    elif field == "phone":
        a, b = rx.digits(llm), rx.digits(found)
        out = _size(b, 11) & F.coalesce(~_size(a, 11), F.lit(True))
    elif field == "email":
        out = found.contains("@") & ~llm.contains("@")
    elif field in ("company_name", "legal_address", "short_name", "postal_address"):

        def compared(x: Column) -> Column:
            a, b = x["a"], x["b"]
            if field == "short_name":
                return (F.length(b) <= F.length(a)) & F.upper(b).rlike("|".join(LEGAL_FORMS))
            return a != b if field == "postal_address" else F.length(b) > F.length(a)

        out = rx.let(F.struct(rx.trimmed(llm).alias("a"), rx.trimmed(found).alias("b")), compared)
    else:
        out = F.lit(False)
    return F.coalesce(out, F.lit(False))


@rx.built_once
def _picks(answer: str | None, found: str) -> Column:
    """A struct of value and source for each field."""

    def picked(field: str, a: Column, b: Column) -> Column:
        take = ~rx.blank(b) & (rx.blank(a) | better(field, a, b))
        return rx.let(take, lambda t: F.struct(F.when(t, b).otherwise(a).alias("value"), F.when(t, F.lit("regex")).when(~rx.blank(a), F.lit("llm")).alias("source")))

    def alone(b: Column) -> Column:
        return F.struct(F.when(~rx.blank(b), b).alias("value"), F.when(~rx.blank(b), F.lit("regex")).alias("source"))

    one = lambda f: alone(F.col(found)[f]) if answer is None else picked(f, F.col(answer)[f], F.col(found)[f])
    return rx.once(F.struct(*[one(f).alias(f) for f in FIELDS]))


def with_merged(df: DataFrame, answer: str | None = "answer", found: str = "found", to: str = "details", by: str = "extracted_by") -> DataFrame:
    """Adds the merged struct and a map of each filled field's source, 'llm' or 'regex'.

    answer: a map of the model's values, null for no answer, or None if no row has any; found: a struct. Where both are empty the
    model's value, null or the empty string, stays.
    """
    source = F.map_from_arrays(F.array(*map(F.lit, FIELDS)), F.array(*[F.col("_picks")[f]["source"] for f in FIELDS]))
    staged = df.withColumn("_picks", _picks(answer, found))
    values = F.struct(*[F.col("_picks")[f]["value"].alias(f) for f in FIELDS])
    return staged.withColumns({to: values, by: F.map_filter(source, lambda k, v: v.isNotNull())}).drop("_picks")


def name_filled(details: Column) -> Column:
    """An empty company name takes the short name."""
    take = rx.blank(details["company_name"]) & ~rx.blank(details["short_name"])
    return details.withField("company_name", F.when(take, details["short_name"]).otherwise(details["company_name"]))

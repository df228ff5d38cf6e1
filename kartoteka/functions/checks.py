"""Checks of identifiers: column functions that give a struct of valid, value and reason."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from kartoteka.functions import rx

# Weights of the INN's check digits.
INN_10 = (2, 4, 10, 3, 5, 9, 4, 6, 8)
INN_11 = (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
INN_12 = (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)


def compact(value: Column) -> Column:
    """The value without white space at its ends and without spaces inside."""
    return F.replace(rx.trimmed(value), F.lit(" "), F.lit(""))


def _checked(value: Column, rules: Callable[[Column], list[tuple[Column, Column | str]]]) -> Column:
    """The first rule that holds of the compact value gives the reason and the raw value; if none does, the compact one is valid."""

    def reason(v: Column) -> Column:
        said = F.when(rx.blank(value), F.lit("field is null")).when(~v.rlike("^[0-9]+$"), F.lit("contains non-digit chars"))
        for holds, why in rules(v):
            said = said.when(holds, F.lit(why) if isinstance(why, str) else why)
        return said

    def result(v: Column) -> Column:
        return rx.let(reason(v), lambda said: F.struct(said.isNull().alias("valid"), F.when(said.isNull(), v).otherwise(value).alias("value"), said.alias("reason")))

    return rx.let(compact(value), result)


def _length(v: Column, expected: str) -> Column:
    return F.concat(F.lit("wrong length: "), F.length(v).cast("string"), F.lit(f", expected {expected}"))


def _digit(v: Column, place: int) -> Column:
    return F.substring(v, place, 1).cast("int")


def inn_digit(v: Column, weights: tuple[int, ...]) -> Column:
    """The check digit that follows the first len(weights) digits."""
    total = F.lit(0)
    for i, w in enumerate(weights):
        total = total + _digit(v, i + 1) * w
    return total % 11 % 10


def inn(value: Column) -> Column:
    """10 digits with one check digit, or 12 with two."""

    def rules(v: Column) -> list:
        ten, twelve = F.length(v) == 10, F.length(v) == 12
        return [
            (ten & (inn_digit(v, INN_10) != _digit(v, 10)), "invalid checksum (10-digit INN)"),
            (twelve & (inn_digit(v, INN_11) != _digit(v, 11)), "invalid checksum digit 11 (12-digit INN)"),
            (twelve & (inn_digit(v, INN_12) != _digit(v, 12)), "invalid checksum digit 12 (12-digit INN)"),
            (~(ten | twelve), _length(v, "10 or 12")),
        ]

    return _checked(value, rules)


def kpp(value: Column) -> Column:
    return _checked(value, lambda v: [(F.length(v) != 9, _length(v, "9"))])


def ogrn(value: Column) -> Column:
    """13 digits (remainder by 11) or 15 (by 13); lengths of classifiers are named as such."""

    def rules(v: Column) -> list:
        n = F.length(v)

        def wrong(size: int, by: int) -> Column:
            return (n == size) & (F.substring(v, 1, size - 1).try_cast("bigint") % by % 10 != _digit(v, size))

        classifier = F.concat(F.lit("likely OKPO/OKTMO classifier, not OGRN (length="), n.cast("string"), F.lit(")"))
        return [
            (n.isin(8, 10, 11), classifier),
            (wrong(13, 11), "invalid OGRN checksum"),
            (wrong(15, 13), "invalid OGRNIP checksum"),
            (~n.isin(13, 15), _length(v, "13 or 15")),
        ]

    return _checked(value, rules)


def bik(value: Column) -> Column:
    return _checked(value, lambda v: [(F.length(v) != 9, _length(v, "9")), (~v.startswith("04"), "BIK must start with 04")])


def account(value: Column, kind: str | Column) -> Column:
    """20 digits; a checking account starts with 40, a correspondent one with 30."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return _checked(
        value,
        lambda v: [
            (F.length(v) != 20, _length(v, "20")),
            ((kind == "checking") & ~v.startswith("40"), "checking account must start with 40"),
            ((kind == "correspondent") & ~v.startswith("30"), "correspondent account must start with 30"),
            (~kind.isin("checking", "correspondent"), F.concat(F.lit("unknown account type: "), kind)),
        ],
    )


def cross(bik: Column, correspondent: Column) -> Column:
    """The mismatch of a BIK's and a correspondent account's last three digits; null where they match or can't be compared."""


    def compared(x: Column) -> Column:
        b, k = x["b"], x["k"]
        both = b.rlike("^[0-9]{9}$") & k.rlike("^[0-9]{20}$")
        return F.when(both & (F.substring(b, 7, 3) != F.substring(k, 18, 3)), F.lit("BIK and correspondent account mismatch"))

    return rx.let(F.struct(compact(bik).alias("b"), compact(correspondent).alias("k")), compared)


FIELD_CHECKS: dict[str, Callable[[Column], Column]] = {
    "inn": inn,
    "kpp": kpp,
    "ogrn": ogrn,
    "bik": bik,
    "checking_account": lambda v: account(v, "checking"),
    "correspondent_account": lambda v: account(v, "correspondent"),
}


def single(value: Column, kind: Column) -> Column:
    """The check that `kind` names (inn, kpp, ogrn, bik, rs, ks); null for other kinds."""
    return (
        F.when(kind == "inn", inn(value))
        .when(kind == "kpp", kpp(value))
        .when(kind == "ogrn", ogrn(value))
        .when(kind == "bik", bik(value))
        .when(kind == "rs", account(value, "checking"))
        .when(kind == "ks", account(value, "correspondent"))
    )

"""Small column helpers over regular expressions, with the flags that Russian text needs."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Case-insensitive for Cyrillic too, Unicode classes, and a dot that stops at \n alone.
FOLD = "(?diuU)"
#: The same, but case-sensitive.
EXACT = "(?dU)"


def built_once(make: Callable) -> Callable:
    """Columns over names are the same for any table: a long expression is sent to the JVM once for the same arguments."""
    kept: dict = {}

    @functools.wraps(make)
    def of(*args):
        key = (id(SparkContext._gateway), *args)
        if key not in kept:
            kept[key] = make(*args)
        return kept[key]

    return of


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """What `use` makes of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def once(value: Column) -> Column:
    """The value, as an expression that the optimizer doesn't copy to each place where the column is used."""
    return let(value, lambda x: x)


def filled(text: Column) -> Column:
    """The text, or null if it is empty."""
    return let(text, lambda x: F.when(x != "", x))


def first(text: Column, pattern: str, group: int = 0, flags: str = FOLD) -> Column:
    """The leftmost match's group; null where nothing, or the empty string, matches."""
    return filled(F.regexp_extract(text, flags + pattern, group))


def every(text: Column, pattern: str, group: int = 0, flags: str = FOLD) -> Column:
    """All matches from left to right that do not overlap."""
    return F.regexp_extract_all(text, F.lit(flags + pattern), F.lit(group))


def replaced(text: Column, pattern: str, by: str = "", flags: str = FOLD) -> Column:
    return F.regexp_replace(text, flags + pattern, by)


def matches(text: Column, pattern: str, flags: str = FOLD) -> Column:
    return text.rlike(flags + pattern)


def trimmed(text: Column) -> Column:
    """Without white space, Unicode's included, at either end."""
    return F.regexp_replace(text, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def cleaned(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def digits(text: Column) -> Column:
    """The digits alone; null if there are none."""
    return filled(F.regexp_replace(text, r"(?U)\D", ""))


def blank(text: Column) -> Column:
    """True for null and the empty string."""
    return text.isNull() | (text == "")


def first_of(array: Column) -> Column:
    """The first element that is not null; null if there is none."""
    return F.get(F.filter(array, lambda x: x.isNotNull()), F.lit(0))


def last_of(array: Column) -> Column:
    return F.try_element_at(F.filter(array, lambda x: x.isNotNull()), F.lit(-1))

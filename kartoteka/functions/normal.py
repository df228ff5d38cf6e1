"""Normalisation of extracted text as column expressions, without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space other than space, tab and newline.
_EXOTIC = r"[\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
_CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
#: A line that ends so is complete; the dashes are hyphen-minus, en dash and em dash.
_ENDS = ".!?:;,\\-–—|"

# Labels whose lines hold digits that may be spaced, and classifiers that begin a line.
GAP_LABELS = ("ИНН", "КПП", "ОГРН", "БИК", "расчётн", "корр", "счёт", "счет", "р/с", "к/с")
CLASSIFIERS = ("ОКПО", "ОКТМО", "ОКВЭД", "ОКАТО", "ОКОПФ", "ОКФС", "КБК")


#: Characters that composition leaves as they are, whatever stands beside them; most texts have no others.
STABLE = r"\x00-\x7f\u0400-\u0482\u048a-\u052f\u2013\u2014\u2018-\u201e\u00ab\u00bb"


def composed(text: Column) -> Column:
    """Unicode compatibility composition (NFKC), by the Unicode tables of the library that Spark has its collations from.

    Only texts with a character beyond STABLE are given to it.
    """
    whole = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    return F.when(text.rlike(f"[^{STABLE}]"), whole).otherwise(text)


def decomposed(text: Column) -> Column:
    """Unicode compatibility decomposition (NFKD)."""
    whole = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), text, F.lit(True))
    return F.when(text.rlike(r"[^\x00-\x7f]"), whole).otherwise(text)


def spaced(text: Column) -> Column:
    """Each run of white space other than space, tab and newline as one space."""
    return F.regexp_replace(text, _EXOTIC, " ")


def uncontrolled(text: Column) -> Column:
    """Without control characters, zero-width spaces and byte-order marks; no-break spaces as spaces."""
    return F.translate(F.regexp_replace(text, _CONTROL, ""), " ​﻿", " ")


def collapsed(text: Column) -> Column:
    """Runs of two or more spaces and tabs as one space; a single tab stays. No space or tab at the ends of lines."""
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]{2,}", " "), r"(?m)(?d)^[ \t]+|[ \t]+$", "")


def rejoined(text: Column) -> Column:
    """A line that goes on in the next, by its last and the next's first character, as one line."""
    # a pattern that begins with the newline is tried there alone
    return F.regexp_replace(text, rf"\n(?<=[^{_ENDS}\n]\n)(?=[а-яёa-z0-9(])", " ")


def unblanked(text: Column) -> Column:
    """At most one blank line at a time, and no white space at the ends of the text."""
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"(?U)\A\s+|\s+\z", "")


def normalized(text: Column, max_chars: int = 12_000, compose: bool = True) -> Column:
    """All steps in order, and the first max_chars code points of what is left; null stays null."""
    t = composed(text) if compose else text
    return F.left(unblanked(rejoined(collapsed(uncontrolled(spaced(t))))), F.lit(max_chars))


#: What ends a line of recognised text.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def without_digit_gaps(text: Column) -> Column:
    """On lines with one of GAP_LABELS, a single space between two digits is removed; tabs and longer gaps stay.

    Lines end at any of Unicode's line ends and are joined by \\n; an end behind the last line goes.
    """
    label = "(?iu)" + "|".join(GAP_LABELS)
    # begins with the space, and is tried there alone; few lines have such a gap
    gap = r"(?U) (?<=\d )(?=\d)"
    lines = F.split(F.regexp_replace(text, rf"(?:{LINE_END})\z", ""), LINE_END)
    return F.array_join(F.transform(lines, lambda x: F.when(x.rlike(gap) & x.rlike(label), F.regexp_replace(x, gap, "")).otherwise(x)), "\n")


def split_classifiers(text: Column) -> Column:
    """Each of CLASSIFIERS begins a line."""
    # a first letter is looked for alone; the third is U+1C82, which counts as a small o
    return F.regexp_replace(text, rf"(?=[Оо\u1c82Кк])(?<!\n)((?iu:{'|'.join(CLASSIFIERS)}))", "\n$1")


def ocr_cleaned(text: Column) -> Column:
    """For recognised text: classifiers on lines of their own, then digits without gaps."""
    return without_digit_gaps(split_classifiers(text))

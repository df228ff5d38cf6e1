"""Details from text by patterns: a card parser over labelled lines first, free patterns second. No shuffle, no Python.

Text is expected as normalisation leaves it, with \n as the only line end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartoteka.functions import rx
from kartoteka.schema import FIELDS

# Patterns, and the labels with which a card's lines begin, in the order in which they are tried.
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PHONE = r"(?:\+7|8)[\s(.-]*\d[\d\s().-]{8,}\d"
BIK = r"(?:\bБИК\s+банка\b|\bКод\s+БИК\b|\bБИК\b)[^\d]{0,20}([\d\s]{9,20})"
CHECKING = r"(?:\d+[\.\)]\s*)?(?:Р/с|Р\\с|р/с|расч[её]тн(?:ый|ого)?\s+сч[её]т)[^\d]{0,20}([\d\s]{20,40})"
CORRESPONDENT = r"(?:\d+[\.\)]\s*)?(?:К/с|К\\с|к/с|корр\.\s*сч[её]т|корреспондентск(?:ий|ого)?\s+сч[её]т)[^\d]{0,20}([\d\s]{20,40})"
BANK = r"(?:банк|банке)[:\s]+(.{5,120})"
BANK_END = r"(?:\bБИК\b|\bр/с\b|\bк/с\b|\bИНН\b|\bКПП\b)"
FULL_NAME = r"(?:Полное\s+наименование|наименование\s+контрагента)[^\n]{0,30}\n?\s*(.{10,200})"
SHORT_NAME = r"(?:Краткое\s+наименование|Сокращ[её]нное\s+наименование)[^\n]{0,30}\n?\s*(.{3,150})"
LEGAL = r"(?:Юридический\s+адрес)[^\n]{0,10}\n?\s*(.{10,250})"
POSTAL = r"(?:Почтовый\s+адрес)[^\n]{0,10}\n?\s*(.{10,250})"
TITLES = r"Генеральный\s+директор|Директор|Исполнительный\s+директор|Президент|Руководитель"
NAME = r"[А-ЯЁ][а-яё]+"
CEO_ROW = rf"({TITLES}|ИП)[^|\n]{{0,80}}[|\t]\s*({NAME}(?:\s+{NAME}){{1,2}})"
CEO_FULL = rf"({TITLES})[,:\s]+({NAME}\s+{NAME}\s+{NAME})"
CEO_SIGNED = rf"({TITLES}|ИП)\s+({NAME}\s+[А-ЯЁ]\.[А-ЯЁ]\.)"
CHARTER = r"\s+Действует\s+на\s+основании\s+Устава.*$"
PATRONYMICS = r"(?:ич|на|вна|евна|овна|евич|ович)$"
INLINE = (
    ("инн", "inn", r"(?:\d{10}|\d{12})"),
    ("кпп", "kpp", r"\d{9}"),
    ("огрн", "ogrn", r"\d{13}"),
    ("бик", "bik", r"\d{9}"),
    ("корр. счет", "correspondent_account", r"\d{20}"),
    ("корр счет", "correspondent_account", r"\d{20}"),
    ("корреспондентский счет", "correspondent_account", r"\d{20}"),
    ("расчетный счет", "checking_account", r"\d{20}"),
    ("расчётный счёт", "checking_account", r"\d{20}"),
    ("телефон", "phone", r"(?:\+7|8)[\d\s().-]{10,}"),
    ("e-mail", "email", EMAIL),
    ("email", "email", EMAIL),
)
TAILED = (
    ("полное наименование организации", "company_name"),
    ("краткое наименование организации", "short_name"),
    ("юридический адрес", "legal_address"),
    ("почтовый адрес", "postal_address"),
    ("банк", "bank_name"),
    ("директор", "ceo_fio_full"),
)


def lines_of(text: Column) -> Column:
    """The lines with their white space cleaned, empty ones left out."""
    return F.filter(F.transform(F.split(text, "\n"), rx.cleaned), lambda x: x != "")


def phones(text: Column) -> Column:
    """Distinct Russian numbers in order of appearance, as an array of +7 and ten digits."""

    def normal(x: Column) -> Column:
        d = F.regexp_replace(x, r"(?U)\D", "")
        return F.when((F.length(d) == 11) & d.rlike("^[78]"), F.concat(F.lit("+7"), F.substring(d, 2, 10))).when(F.length(d) == 11, d)

    found = F.transform(rx.every(text, PHONE, flags=rx.EXACT), normal)
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull()))


def joined_phones(text: Column) -> Column:
    return rx.filled(F.array_join(phones(text), ", "))


#: The same addresses in linear time: a run of the local part's characters is tried at its start alone, and never given back.
_EMAIL = r"(?<![A-Za-z0-9._%+\-])" + EMAIL.replace("]+@", "]++@", 1)


def email(text: Column) -> Column:
    """The first address of the first line that has one; spaces inside a line are ignored."""
    repaired = F.replace(F.replace(text, F.lit("E mail"), F.lit("E-mail")), F.lit("E-mail;"), F.lit("E-mail:"))
    return rx.first_of(F.transform(F.split(repaired, "\n"), lambda x: F.when(x.contains("@"), rx.first(F.replace(rx.trimmed(x), F.lit(" "), F.lit("")), _EMAIL))))


def short_person(full: Column) -> Column:
    """Surname and initials of a name of two or more words; null for fewer."""


    def short(w: Column) -> Column:
        initial = lambda k: F.concat(F.left(F.get(w, F.lit(k)), F.lit(1)), F.lit("."))
        return F.when(F.size(w) >= 3, F.concat(F.get(w, F.lit(0)), F.lit(" "), initial(1), initial(2))).when(F.size(w) == 2, F.concat(F.get(w, F.lit(0)), F.lit(" "), initial(1)))

    return rx.let(F.split(rx.cleaned(full), " "), short)


def ordered_person(full: Column) -> Column:
    """A name of three words whose second is the first to end as a patronymic, with its surname put in front."""


    def ordered(w: Column) -> Column:
        part = lambda k: F.get(w, F.lit(k))
        turn = (F.size(w) == 3) & ~part(0).rlike(PATRONYMICS) & part(1).rlike(PATRONYMICS)
        return F.when(turn, F.concat_ws(" ", part(2), part(0), part(1))).when(F.size(w) == 3, F.array_join(w, " ")).otherwise(full)

    return rx.let(F.split(rx.cleaned(full), " "), ordered)


#: Fields of labelled lines, and what lines without a label may have.
CARD = tuple(dict.fromkeys([f for _, f, *_ in INLINE] + [f for _, f in TAILED]))
LOOSE = ("inn", "kpp", "ogrn")
#: Labels by their fields' places in CARD, in the order in which they are tried.
_LABELS = [(label, CARD.index(f)) for label, f, *_ in (*INLINE, *TAILED)]


def _labelled(line: Column, low: Column) -> tuple[Column, Column]:
    """Of a line: its label's field as a place in CARD, and the value that stands in the line; nulls without a label.

    Labels are prefixes, the first that fits counts. A line is matched against its own label's pattern alone.
    """
    field = value = None
    own = {f: p for _, f, p in INLINE}
    for label, place in _LABELS:
        hit, f = low.startswith(label), CARD[place]
        if f in own:  # of labels with one field the first one's pattern
            found = rx.trimmed(rx.first(line, next(p for _, g, p in INLINE if g == f)))
        else:
            found = rx.filled(F.btrim(F.substr(line, F.lit(len(label) + 1)), F.lit(" :;-—")))
        field = (F if field is None else field).when(hit, place)
        value = (F if value is None else value).when(hit, found)
    return field, value


def _bounded(line: Column, digits: str) -> Column:
    return rx.first(line, rf"\b(?:{digits})\b")


def of_lines(lines: Column) -> Column:
    """One pass over cleaned lines: a struct of CARD's fields, and of LOOSE's as `free_...`.

    Of several lines with one label's field the last counts; a tailed label whose line ends with it has its value in the next
    line. Free identifiers are the first 12- or 10-digit word of a line that names an INN, and so on; a KPP must not begin the INN that
    is known up to its line.
    """
    places, tailed = range(len(CARD)), [CARD.index(f) for _, f in TAILED]
    none = F.lit(None)
    start = F.struct(*[none.cast("string").alias(f) for f in CARD], *[none.cast("string").alias(f"free_{f}") for f in LOOSE], none.cast("int").alias("waits"))

    def step(acc: Column, line: Column) -> Column:
        def known(x: Column) -> Column:
            low, inn = x["low"], x["inn"]
            c = F.when(low.contains("кпп"), _bounded(line, r"\d{9}"))
            kpp = F.coalesce(acc["free_kpp"], rx.let(c, lambda c: F.when(~F.coalesce(inn.startswith(c), F.lit(False)), c)))
            ogrn = F.coalesce(acc["free_ogrn"], F.when(low.contains("огрн"), _bounded(line, r"\d{13}")))

            def told(m: Column) -> Column:
                of = lambda k: F.when((m["field"] == k) & m["value"].isNotNull(), m["value"])
                kept = lambda k: F.when(acc["waits"] == k, line).otherwise(acc[CARD[k]])
                waits = F.when(m["value"].isNull() & m["field"].isin(*tailed), m["field"])
                return F.struct(*[F.coalesce(of(k), kept(k)).alias(CARD[k]) for k in places], inn.alias("free_inn"), kpp.alias("free_kpp"), ogrn.alias("free_ogrn"), waits.alias("waits"))

            field, value = _labelled(line, low)
            return rx.let(F.struct(field.alias("field"), value.alias("value")), told)

        def named(low: Column) -> Column:
            inn = F.coalesce(acc["free_inn"], F.when(low.contains("инн"), _bounded(line, r"\d{12}|\d{10}")))
            return rx.let(F.struct(low.alias("low"), inn.alias("inn")), known)

        return rx.let(F.lower(line), named)

    return F.aggregate(lines, start, step)


def card(found: Column) -> dict[str, Column]:
    """Fields of a card's labelled lines, from what one pass over them found."""
    out = {f: found[f] for f in CARD}
    out["phone"] = joined_phones(out["phone"])
    out["email"] = email(out["email"])
    person = rx.trimmed(rx.replaced(out["ceo_fio_full"], CHARTER))
    out["ceo_fio_full"] = person
    out["ceo_position"] = F.when(found["ceo_fio_full"].isNotNull(), F.lit("Директор"))
    out["ceo_fio"] = short_person(person)
    return out


def digit_windows(text: Column, size: int) -> Column:
    """Distinct runs of so many digits from left to right, also inside longer runs."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?U)\d{{{size}}}"), F.lit(0)))


def labelled_number(text: Column, pattern: str, size: int, prefix: str) -> Column:
    """The digits after the label, cut to size, if they begin with the prefix; else the text's first window that does."""
    labelled = rx.let(F.left(rx.digits(rx.first(text, pattern, 1)), F.lit(size)), lambda d: F.when((F.length(d) == size) & d.startswith(prefix), d))
    return F.coalesce(labelled, F.get(F.filter(digit_windows(text, size), lambda x: x.startswith(prefix)), F.lit(0)))


def bank_name(text: Column, lines: Column) -> Column:
    """The first line about a bank that is no BIK or account, else what follows the word up to the next label."""

    def plain(x: Column) -> Column:
        return rx.let(F.lower(x), lambda low: about(low, x))

    def about(low: Column, x: Column) -> Column:
        return low.contains("банк") & ~low.contains("бик") & ~low.contains("счет") & ~low.contains("счёт") & (F.length(x) >= 5)

    after = F.get(F.split(rx.cleaned(rx.first(text, BANK, 1)), rx.FOLD + BANK_END, 2), F.lit(0))
    return F.coalesce(F.get(F.filter(lines, plain), F.lit(0)), rx.filled(F.btrim(after, F.lit(" ,;:"))))


def postal_address(text: Column, lines: Column) -> Column:
    label, office = "почтовый адрес", "отделение почтовой связи"
    hit = F.get(F.filter(lines, lambda x: rx.let(F.lower(x), lambda low: low.contains(label) | low.contains(office))), F.lit(0))
    free = rx.filled(rx.cleaned(rx.first(text, POSTAL, 1)))

    def named(hit: Column) -> Column:
        rest = F.btrim(rx.replaced(hit, r"^.*почтовый\s+адрес[:\s]*"), F.lit(" ,;:"))
        return F.when(F.lower(hit).contains(label), rx.filled(rest)).when(hit.isNotNull(), hit).otherwise(free)

    return rx.let(hit, named)


def _at_least(value: Column, n: int) -> Column:
    return rx.let(value, lambda x: F.when(F.length(x) >= n, x))


_HEAD = ("ceo_position", "ceo_fio_full", "ceo_fio")


def head(text: Column) -> Column:
    """A struct of position, full and short name: of a table row, else of three words after a title, else of a signature.

    Each pattern is looked for once, the later ones where the earlier ones fail, and its groups are taken from what it matched.
    """

    def found(pattern: str, names) -> Column:
        group = lambda m, k: rx.first(m, pattern, k)

        def made(m: Column) -> Column:
            whole = rx.let(group(m, 2), lambda who: F.struct(rx.trimmed(group(m, 1)).alias("p"), *[x.alias(n) for x, n in zip(names(who), "fs", strict=True)]))
            return F.when(m.isNotNull(), whole)

        return rx.let(rx.first(text, pattern), made)

    row = found(CEO_ROW, lambda who: (ordered_person(rx.trimmed(who)), short_person(ordered_person(rx.trimmed(who)))))
    full = found(CEO_FULL, lambda who: (rx.trimmed(who), short_person(who)))
    signed = found(CEO_SIGNED, lambda who: (F.lit(None).cast("string"), rx.trimmed(who)))
    return F.coalesce(row, full, signed)


def free(text: Column, lines: Column, found: Column) -> dict[str, Column]:
    """Fields by patterns anywhere in the text, but for the head's."""
    return {
        "company_name": _at_least(rx.cleaned(rx.first(text, FULL_NAME, 1)), 5),
        "short_name": _at_least(rx.cleaned(rx.first(text, SHORT_NAME, 1)), 3),
        "legal_address": rx.cleaned(rx.first(text, LEGAL, 1)),
        "postal_address": postal_address(text, lines),
        **{f: found[f"free_{f}"] for f in LOOSE},
        "bik": labelled_number(text, BIK, 9, "04"),
        "checking_account": labelled_number(text, CHECKING, 20, "40"),
        "correspondent_account": labelled_number(text, CORRESPONDENT, 20, "30"),
        "bank_name": bank_name(text, lines),
        "email": email(text),
        "phone": joined_phones(text),
    }


@rx.built_once
def _stages(text: str) -> list[tuple[str, Column]]:
    """Columns that `with_found` adds one after the other; the last is what was found."""
    t, card_of = F.col(text), card(F.col("_card"))
    people = F.struct(*[card_of[f].alias(f) for f in _HEAD])
    p = F.col("_people")
    lacks = p["ceo_position"].isNull() | F.coalesce(p["ceo_fio_full"] == "", F.lit(True)) | F.coalesce(p["ceo_fio"] == "", F.lit(True))
    loose = free(t, F.col("_lines"), F.col("_card")) | dict(zip(_HEAD, (F.col("_head")[n] for n in ("p", "f", "s")), strict=True))
    own = card_of | {f: p[f] for f in _HEAD}
    fields = [(F.coalesce(rx.filled(own[f]), loose[f]) if f in own else loose[f]).alias(f) for f in FIELDS]
    # free patterns about the head are looked for if one of its fields is missing
    return [("_lines", rx.once(lines_of(t))), ("_card", of_lines(F.col("_lines"))), ("_people", rx.once(people)), ("_head", rx.once(F.when(lacks, head(t)))), ("", rx.once(F.struct(*fields)))]


def with_found(df: DataFrame, text: str = "text", to: str = "found") -> DataFrame:
    """Adds a struct of the sixteen fields found in each row's text; a null text finds nothing.

    Lines and what they have are columns of their own, and values are bound where they are used more than once, so that each
    pattern stands in the plan once and runs only where what comes before it found nothing.
    """
    stages = _stages(text)
    for name, column in stages:
        df = df.withColumn(name or to, column)
    return df.drop(*[name for name, _ in stages if name])

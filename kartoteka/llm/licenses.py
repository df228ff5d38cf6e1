"""Licence scans by a positional index of rare words, in DataFrame functions only.

Templates are bodies of licences (license_texts.py) and single key phrases. Rarity comes from the templates: a word's IDF is the log
of the number of templates over those that have it. The index holds, for each body's rarest words, postings (template, place). A
file's words that have postings, its licence words of highest IDF, are looked up; each posting votes for the place where the body
would start, and votes of one template that agree up to a drift, which insertions and deletions may use up, are intersected: half
of the template's rarest words must be among them. There the mandatory key phrases are verified word by word. A template that is a
key phrase only is found by its rarest word, whose occurrences propose a start that its other words must confirm.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartoteka.llm.license_texts import BODIES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rarest words of a body that have postings.
RAREST = 16

# Labels and their mandatory key phrases. The first three are the base.
BASE = (
    ("cc-by", ("cc by",)),
    ("gpl", ("general public license",)),
    ("reserved", ("all rights reserved",)),
)
MORE = (
    ("agpl", ("affero general public license",)),
    ("apache-2.0", ("apache license", "version 2 0")),
    ("bsd", ("redistribution and use in source and binary forms",)),
    ("bsd-3-clause", ("redistribution and use in source and binary forms", "neither the name of")),
    ("cc-by-nc", ("cc by nc",)),
    ("cc-by-nd", ("cc by nd",)),
    ("cc-by-sa", ("cc by sa",)),
    ("cc-by-sa", ("creative commons attribution sharealike",)),
    ("cc0", ("cc0 1 0 universal",)),
    ("epl", ("eclipse public license",)),
    ("isc", ("permission to use copy modify and or distribute this software",)),
    ("lgpl", ("lesser general public license",)),
    ("mit", ("mit license",)),
    ("mit", ("permission is hereby granted free of charge", "the software is provided as is")),
    ("mpl", ("mozilla public license",)),
    ("proprietary", ("confidential and proprietary",)),
    ("unlicense", ("free and unencumbered software released into the public domain",)),
)


@dataclass(frozen=True)
class Phrase:
    """A key phrase and how it is looked up: its words from rarest to most common, each with its place in the phrase."""

    words: tuple[str, ...]
    order: tuple[int, ...]


@dataclass(frozen=True)
class Body:
    """A licence body in the index: how many words it has, its rarest ones with their places, and what a match of it needs."""

    label: str
    phrases: tuple[tuple[str, ...], ...]
    length: int
    rarest: tuple[tuple[str, tuple[int, ...]], ...]
    weight: float

    @property
    def need(self) -> int:
        """Rarest words that must agree."""
        return -(-len(self.rarest) // 2)

    @property
    def drift(self) -> int:
        """Words by which starts that agree may differ."""
        return 4 + self.length // 10

    @property
    def most(self) -> int:
        """Votes that starts within the drift can have: one a start and posting."""
        return (self.drift + 1) * sum(len(places) for _, places in self.rarest)


class Index:
    """Bodies and key phrases, the rarity of their words, and postings. Its size is that of the templates, not of the data."""

    def __init__(self, templates=BASE + MORE, bodies=BODIES):
        self.templates = [(label, tuple(tuple(p.split()) for p in phrases)) for label, phrases in templates]
        texts = [(label, tuple(tuple(p.split()) for p in phrases), split_words(body)) for label, phrases, body in bodies]
        df: dict[str, int] = {}
        for words in [{w for p in phrases for w in p} for _, phrases in self.templates] + [set(words) for *_, words in texts]:
            for w in words:
                df[w] = df.get(w, 0) + 1
        n = len(self.templates) + len(texts)
        self.idf = {w: math.log(1 + n / d) for w, d in df.items()}
        distinct = dict.fromkeys(p for _, phrases in self.templates for p in phrases)
        # of words equally rare the longer is the better anchor
        self.phrases = [Phrase(p, tuple(sorted(range(len(p)), key=lambda i: (-self.idf[p[i]], -len(p[i]), i)))) for p in distinct]
        self.number = {p.words: k for k, p in enumerate(self.phrases)}
        self.bodies = [self._body(*t) for t in texts]
        self.postings: dict[str, list[tuple[int, int, int]]] = {}  # word: (body, which of its rarest, place)
        for t, body in enumerate(self.bodies):
            for k, (w, places) in enumerate(body.rarest):
                self.postings.setdefault(w, []).extend((t, k, p) for p in places)
        self.anchors = sorted({p.words[p.order[0]] for p in self.phrases})

    def _body(self, label: str, phrases: tuple, words: list[str]) -> Body:
        rarest = sorted(dict.fromkeys(words), key=lambda w: (-self.idf[w], -len(w), w))[:RAREST]
        places = tuple((w, tuple(i for i, x in enumerate(words) if x == w)) for w in rarest)
        return Body(label, phrases, len(words), places, sum(self.idf[w] for w in rarest))

    def weight(self, phrases) -> float:
        return sum(self.idf[w] for p in phrases for w in p)


def split_words(text: str) -> list[str]:
    """words_of for a template, on the driver."""
    return [w for w in re.split(NOT_WORD, text.translate(str.maketrans(UPPER, LOWER))) if w]


def words_of(text: Column) -> Column:
    """The words of a text: A-Z lower-cased, runs of what is not ASCII punctuation, white space or control."""
    joined = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD, " ")
    return F.filter(F.split(joined, " "), lambda w: w != "")


def _starts(words: Column, hits: Column, phrase: Phrase) -> Column:
    """Where the phrase stands, ascending: anchors that its other words confirm by relative position, rarest first."""
    first, *others = phrase.order

    def at(start: Column, k: int) -> Column:
        return F.get(words, start + k) == phrase.words[k]

    found = F.filter(hits, lambda h: h["w"] == phrase.words[first])
    starts = F.transform(found, lambda h: h["i"] - first)

    def confirmed(s: Column) -> Column:
        ok = s >= 0
        for k in others:
            ok = ok & F.coalesce(at(s, k), F.lit(False))
        return ok

    return F.filter(starts, confirmed)


def _votes(hits: Column, index: Index) -> Column:
    """(body, start, which of its rarest words) of every posting of every licence word, in that order."""
    of_words = {w: [{"t": t, "k": k, "p": p} for t, k, p in of] for w, of in index.postings.items()}
    postings = F.from_json(F.lit(json.dumps(of_words)), "map<string, array<struct<t: int, k: int, p: int>>>")

    def of_word(h: Column) -> Column:
        return F.transform(F.try_element_at(postings, h["w"]), lambda p: F.struct(p["t"].alias("t"), (h["i"] - p["p"]).alias("start"), p["k"].alias("k")))

    return F.array_sort(F.flatten(F.filter(F.transform(hits, of_word), lambda v: v.isNotNull())))


def _bodies_found(words: Column, votes: Column, index: Index) -> Column:
    """(label, weight, place) of the bodies that enough agreeing votes propose and whose key phrases stand there."""
    rows = [{"label": b.label, "weight": b.weight, "length": b.length, "n": len(b.rarest), "need": b.need, "drift": b.drift, "most": b.most, "phrases": b.phrases} for b in index.bodies]
    table = F.from_json(F.lit(json.dumps(rows)), "array<struct<label: string, weight: double, length: int, n: int, need: int, drift: int, most: int, phrases: array<array<string>>>>")

    def body(v: Column) -> Column:
        return F.get(table, v["t"])

    def agreeing(v: Column, i: Column) -> Column:
        near = F.filter(F.slice(votes, i + 1, body(v)["most"]), lambda o: (o["t"] == v["t"]) & (o["start"] <= v["start"] + body(v)["drift"]))
        return F.size(F.array_distinct(F.transform(near, lambda o: o["k"])))

    def enough(v: Column, i: Column) -> Column:
        # votes are sorted: if the one that would be the last needed is too far, there are too few
        last = F.get(votes, i + body(v)["need"] - 1)
        return F.coalesce((last["t"] == v["t"]) & (last["start"] <= v["start"] + body(v)["drift"]), F.lit(False))

    def stands(phrase: Column, v: Column) -> Column:
        region = F.sequence(F.greatest(v["start"] - body(v)["drift"], F.lit(0)), v["start"] + body(v)["length"] + body(v)["drift"])
        return F.exists(region, lambda s: F.coalesce(F.get(words, s) == F.get(phrase, F.lit(0)), F.lit(False)) & (F.slice(words, s + 1, F.size(phrase)) == phrase))

    proposed = F.transform(votes, lambda v, i: F.when(enough(v, i), F.struct(v["t"].alias("t"), v["start"].alias("start"), agreeing(v, i).alias("n"))))
    likely = F.filter(proposed, lambda v: v.isNotNull() & (v["n"] >= body(v)["need"]))
    verified = F.filter(likely, lambda v: F.forall(body(v)["phrases"], lambda p: stands(p, v)))

    def best(of: Column, t: Column) -> Column:
        same = F.filter(of, lambda v: v["t"] == t)
        return F.struct(
            F.get(table, t)["label"].alias("label"),
            (F.get(table, t)["weight"] * F.array_max(F.transform(same, lambda v: v["n"])) / F.get(table, t)["n"]).alias("weight"),
            F.greatest(F.array_min(F.transform(same, lambda v: v["start"])), F.lit(0)).alias("place"),
        )

    # the verified votes are computed once, as the only element of an array
    return F.flatten(F.transform(F.array(verified), lambda of: F.transform(F.array_distinct(F.transform(of, lambda v: v["t"])), lambda t: best(of, t))))


def scan(df: DataFrame, index: Index | None = None, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """`keep` columns of every row, and n_words, starts (for each phrase of the index its places), found (label, weight, place).

    The place is the first word of a key phrase, or about the first of a body: bodies that were edited shift it by a few words.
    Row by row, without a shuffle; repeated rows stay. Null and empty texts have no words and find nothing. Texts without
    any licence word end after one look at each word; long ones are read whole. An empty table gives an empty one. `keep`
    columns named like one of the results are replaced by it; other names may be any.
    """
    index = index or Index()
    wanted = [k for k in keep if k not in ("n_words", "starts", "found")]
    keep = ("_row",)
    words = df.select(F.struct(F.lit(0).alias("_"), *wanted).alias("_row"), words_of(F.col(text)).alias("_words"))
    looked_up = sorted({*index.anchors, *index.postings})
    hits = F.filter(F.transform("_words", lambda w, i: F.when(w.isin(looked_up), F.struct(w.alias("w"), i.alias("i")))), lambda h: h.isNotNull())
    words = words.select(*keep, F.size("_words").cast("long").alias("n_words"), "_words", hits.alias("_hits"))
    anchored = F.filter("_hits", lambda h: h["w"].isin(index.anchors))
    words = words.select(*keep, "n_words", "_words", anchored.alias("_anchors"), _votes(F.col("_hits"), index).alias("_votes"))
    none = F.array(*[F.array().cast("array<int>") for _ in index.phrases])
    places = F.when(F.size("_anchors") > 0, F.array(*[_starts(F.col("_words"), F.col("_anchors"), p) for p in index.phrases])).otherwise(none)
    bodies = _bodies_found(F.col("_words"), F.col("_votes"), index)
    placed = words.select(*keep, "n_words", places.alias("starts"), bodies.alias("_bodies"))
    has = [F.size(F.get("starts", k)) > 0 for k in range(len(index.phrases))]
    found = []
    for label, phrases in index.templates:
        all_there = has[index.number[phrases[0]]]
        for p in phrases[1:]:
            all_there = all_there & has[index.number[p]]
        place = F.array_min(F.get("starts", index.number[phrases[0]]))
        found.append(F.when(all_there, F.struct(F.lit(label).alias("label"), F.lit(index.weight(phrases)).alias("weight"), place.alias("place"))))
    of_phrases = F.filter(F.array(*found), lambda x: x.isNotNull())
    return placed.select(*[F.col("_row")[k].alias(k) for k in wanted], "n_words", "starts", F.concat(of_phrases, "_bodies").alias("found"))


def licenses_of_documents(docs: DataFrame) -> DataFrame:
    """The digest of a scan: places of the base phrases, base labels, all labels, and a score.

    score: 0 without a label, else 1 - exp(-weight) of the weightiest template found; longer and rarer phrases weigh more,
    and bodies by the share of their rarest words that agree.
    """
    index = Index()
    s = scan(docs, index, keep=("doc_id",))
    base = [index.number[tuple(p.split())] for _, (p,) in BASE]
    starts = F.flatten(F.array(*[F.get("starts", k) for k in base]))
    base_labels = F.filter(F.array(*[F.when(F.size(F.get("starts", k)) > 0, F.lit(label)) for k, (label, _) in zip(base, BASE, strict=True)]), lambda x: x.isNotNull())
    weight = F.array_max(F.transform("found", lambda x: x["weight"]))
    return s.select(
        "doc_id",
        "n_words",
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda x: x["label"]))), ",").alias("labels"),
        F.coalesce(F.round(1 - F.exp(-weight / 4), 6), F.lit(0.0)).alias("score"),
    )


def oracle() -> str:
    """The same digest in DuckDB SQL, which looks for each phrase in the joined words and counts a body's votes in a window frame."""
    index = Index()
    pattern = NOT_WORD.replace("\\x", "\\x")
    values = lambda rows: ", ".join(f"('{a}', '{b}', {c!r})" for a, b, c in rows)
    base = values((label, p, 0.0) for label, (p,) in BASE)
    phrases = [(k, label, " ".join(p), index.weight(ps), len(ps)) for k, (label, ps) in enumerate(index.templates) for p in ps]
    more = ", ".join(f"({k}, '{label}', '{p}', {w!r}, {n})" for k, label, p, w, n in phrases)
    rows = lambda of: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else repr(x) for x in r) + ")" for r in of)
    postings = rows((w, t, k, p) for w, of in index.postings.items() for t, k, p in of)
    bodies = rows((t, b.label, b.weight, b.length, len(b.rarest), b.need, b.drift, len(b.phrases)) for t, b in enumerate(index.bodies))
    body_phrases = rows((t, " ".join(p), len(p)) for t, b in enumerate(index.bodies) for p in b.phrases)
    return f"""
WITH n AS (
  SELECT rowid_ AS r, doc_id, ' ' || trim(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{pattern}', ' ', 'g'), ' ') || ' ' AS t
  FROM (SELECT row_number() OVER () AS rowid_, doc_id, text FROM documents)),
w AS (SELECT *, CASE WHEN trim(t, ' ') = '' THEN [] ELSE string_split(trim(t, ' '), ' ') END AS words FROM n),
base(label, phrase, zero) AS (VALUES {base}),
hits AS (
  SELECT r, label, i - 1 AS place
  FROM w, base, unnest(range(1, len(words) + 1)) AS u(i)
  WHERE contains(t, ' ' || phrase || ' ') AND array_to_string(words[i : i + len(string_split(phrase, ' ')) - 1], ' ') = phrase),
b AS (SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM hits GROUP BY r),
templates(k, label, phrase, weight, n) AS (VALUES {more}),
f AS (SELECT r, k, label, weight FROM w, templates WHERE contains(t, ' ' || phrase || ' ') GROUP BY r, k, label, weight, n HAVING count(*) = n),
postings(word, t, k, p) AS (VALUES {postings}),
bodies(t, label, weight, length, n, need, drift, n_phrases) AS (VALUES {bodies}),
body_phrases(t, phrase, n_words) AS (VALUES {body_phrases}),
votes AS (
  SELECT r, t, k, i - 1 - p AS start
  FROM (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w) JOIN postings USING (word)),
agreeing AS (
  SELECT DISTINCT v.r, v.t, v.start, count(DISTINCT o.k) AS n
  FROM votes v JOIN bodies USING (t) JOIN votes o ON o.r = v.r AND o.t = v.t AND o.start BETWEEN v.start AND v.start + drift
  GROUP BY v.r, v.t, v.start),
standing AS (
  SELECT DISTINCT a.r, a.t, a.start, a.n, phrase
  FROM agreeing a JOIN bodies b USING (t) JOIN body_phrases q USING (t) JOIN w USING (r),
    unnest(range(greatest(a.start - drift, 0), a.start + length + drift + 1)) AS u(s)
  WHERE a.n >= need AND array_to_string(words[s + 1 : s + q.n_words], ' ') = phrase),
verified AS (
  SELECT r, t, start, standing.n FROM standing JOIN bodies USING (t)
  GROUP BY r, t, start, standing.n, n_phrases HAVING count(*) = n_phrases),
g AS (
  SELECT r, label, weight FROM f
  UNION ALL
  SELECT r, label, weight * max(verified.n) / bodies.n FROM verified JOIN bodies USING (t) GROUP BY r, t, label, weight, bodies.n),
m AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(weight) AS weight FROM g GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(round(1 - exp(-weight / 4), 6), 0.0)::DOUBLE AS score
FROM w LEFT JOIN b USING (r) LEFT JOIN m USING (r)"""

"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histograms of character classes and of common words are compared with its language's, which are summed over
all documents, by Jensen-Shannon distance (base 2, so 0 to 1). Texts too short for a histogram to say anything are not
judged by it. The greatest distance of common words is a share of what a text without any has in that language.
"""

from __future__ import annotations

from math import log2, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartoteka.llm import _common as C

SPACE = r"[\x20\x09-\x0D]"
WINDOW = 8
CLASSES = ("space", "digit", "upper", "stop", "symbol", "letter")

# Frequent function words of English, German, Spanish, French.
COMMON = tuple(
    dict.fromkeys(
        "the of and to in is that for it was as with on are be at by this from or "
        "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als "
        "de la que el en y a los se del las un por con no una su para es al "
        "de la le et les des en un du une que est pour qui dans par plus pas au sur".split()
    )
)

#: The verdict's parameters: greatest distances (that of common words as a share of the distance of a text without any), and
#: least characters and words to judge by them.
MAX_CLASS, MAX_COMMON, MIN_CHARS, MIN_WORDS = 0.32, 0.85, 200, 50
#: Common words that a text of its length has on average in its language, at least, to be judged by them.
MIN_COMMON = 10
#: Documents that a language needs for a reference of its own; those of others are compared with all documents' sums.
MIN_DOCS = 20

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def features(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """`keep` columns, FEATURES, classes (characters by CLASSES) and common (word, n) of every row; row by row, no shuffle.

    A null text is empty: all counts are 0. Words are runs without ASCII white space. A window is WINDOW words; windows
    are equal if the 64-bit hashes of their words' hashes are.
    """
    text = docs.select(*keep, F.coalesce("text", F.lit("")).alias("t"))
    words = text.select("*", F.filter(F.split("t", SPACE + "+"), lambda w: w != "").alias("w"))
    counted = words.select(
        *keep,
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.length("t").cast("long").alias("n_chars"),
        F.regexp_count("t", F.lit(r"[0-9]")).cast("long").alias("digits"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).cast("long").alias("uppers"),
        F.regexp_count("t", F.lit(r"[.,;:!?'\"()\-]")).cast("long").alias("stops"),
        F.sort_array(F.filter(F.transform("w", F.lower), lambda x: x.isin(*COMMON))).alias("common"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    hashed = counted.withColumn(
        "h",
        F.when(F.col("n_words") >= WINDOW, F.transform(F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int")), lambda i: F.xxhash64(*[F.get("h", i + j) for j in range(WINDOW)]))),
    )
    # only texts with an equal pair of windows go on: sorted by hash, equal windows are neighbours
    ordered = hashed.withColumn("h", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    twice = ordered.withColumn("h", F.filter("h", lambda x, k: F.coalesce((k > 0) & (F.get("h", k - 1)["h"] == x["h"]), F.lit(False)) | F.coalesce(F.get("h", k + 1)["h"] == x["h"], F.lit(False))))
    starts = twice.withColumn("h", F.sort_array(F.transform("h", lambda x: x["i"])))
    # each word is counted with the last window that starts at or before it
    covered = F.aggregate(F.transform("h", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("h", k + 1), p + WINDOW) - p)), F.lit(0), lambda a, b: a + b)
    ends = starts.withColumn("ends", F.filter(F.transform("common", lambda x, k: F.when(F.get("common", k + 1).eqNullSafe(x), F.lit(None)).otherwise(F.struct(x.alias("word"), k.alias("k")))), lambda x: x.isNotNull()))
    c = F.col
    return ends.select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.array(c("n_chars") - c("word_chars"), c("digits"), c("uppers"), c("stops"), c("n_symbols"), c("word_chars") - c("digits") - c("uppers") - c("stops") - c("n_symbols")).alias("classes"),
        F.transform("ends", lambda x, k: F.struct(x["word"].alias("word"), (x["k"] - F.coalesce(F.get("ends", k - 1)["k"], F.lit(-1))).cast("long").alias("n"))).alias("common"),
    )


class References:
    """By language: shares of the character classes and of the common words, summed over all its documents."""

    def __init__(self, table: DataFrame, min_docs: int = MIN_DOCS):
        sums = table.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n_words").alias("words"), F.count_if(F.col("n_words") >= MIN_WORDS).alias("long"), F.count_if((F.col("n_words") >= MIN_WORDS) & (F.size("common") > 0)).alias("some"), *[F.sum(F.get("classes", k)).alias(f"c{k}") for k in range(len(CLASSES))]).collect()
        words = table.select("lang", F.explode("common").alias("x")).groupBy("lang", "x.word").agg(F.sum("x.n").alias("n")).collect()
        self.classes, self.common, self.usual = {}, {}, {}
        for lang in [None, *sorted(r["lang"] for r in sums if r["lang"] is not None and r["docs"] >= min_docs)]:
            rows = [r for r in sums if lang is None or r["lang"] == lang]  # None: all documents
            self.classes[lang] = self._shares([sum(r[f"c{k}"] or 0 for r in rows) for k in range(len(CLASSES))])
            n = dict.fromkeys(COMMON, 0)
            for r in words:
                if lang is None or r["lang"] == lang:
                    n[r["word"]] += r["n"]
            total = max(1, sum(r["words"] or 0 for r in rows))
            self.common[lang] = {w: x / total for w, x in n.items() if x}
            # in a language of which COMMON has no words, a text without any is usual
            self.usual[lang] = 2 * sum(r["some"] for r in rows) > sum(r["long"] for r in rows)

    @staticmethod
    def _shares(counts: list[int]) -> list[float]:
        return [x / max(1, sum(counts)) for x in counts]

    def without(self, lang: str | None) -> float:
        """common_distance of a text that has none of the language's common words."""
        rest = 1 - sum(self.common[lang].values())
        m = (1 + rest) / 2
        return sqrt(max(0.0, (1 - rest - log2(m) + (rest * log2(rest / m) if rest > 0 else 0.0)) / 2))

    def of(self, lang: Column, what) -> Column:
        """what(reference) by language; languages without a reference get that of all documents."""
        out = None
        for name in self.classes:
            if name is not None:
                out = (F if out is None else out).when(lang == name, what(name))
        return what(None) if out is None else out.otherwise(what(None))


def _half(p: Column, q: Column) -> Column:
    """A category's part of the Jensen-Shannon divergence."""
    m = (p + q) / 2
    return F.when(p > 0, p * F.log2(p / m) / 2).otherwise(F.lit(0.0)) + F.when(q > 0, q * F.log2(q / m) / 2).otherwise(F.lit(0.0))


def distances(table: DataFrame, refs: References) -> DataFrame:
    """Adds class_distance, common_distance and common_without to rows of features with their lang.

    common_without: common_distance of a text without common words; null where the text or its language has too few of them to
    judge by.
    """
    n = F.aggregate("classes", F.lit(0).cast("long"), lambda a, b: a + b)
    shares = table.withColumns({
        "_q": refs.of(F.col("lang"), lambda a: F.array(*map(F.lit, refs.classes[a]))),
        "_r": refs.of(F.col("lang"), lambda a: F.create_map(*[F.lit(x) for w in refs.common[a].items() for x in w]) if refs.common[a] else F.create_map().cast("map<string,double>")),
        "_n": n,
    })
    p = F.transform("classes", lambda x: x / F.greatest(F.col("_n"), F.lit(1)))
    parts = shares.withColumns({
        "_c": F.aggregate(F.zip_with(p, "_q", _half), F.lit(0.0), lambda a, b: a + b),
        "_w": F.transform("common", lambda x: F.struct((x["n"] / F.greatest(F.col("n_words"), F.lit(1))).alias("p"), F.coalesce(F.try_element_at("_r", x["word"]), F.lit(0.0)).alias("q"))),
    })
    total = lambda f: F.aggregate("_w", F.lit(0.0), lambda a, x: a + f(x))
    sums = parts.withColumns({
        "_p": total(lambda x: x["p"]),
        "_m": total(lambda x: x["q"]),
        "_d": total(lambda x: _half(x["p"], x["q"])),
        "_all": F.aggregate(F.map_values("_r"), F.lit(0.0), lambda a, x: a + x),
    })
    # of a word that the document lacks, half its share in the reference is left; all other words are one category
    common = F.col("_d") + (F.col("_all") - F.col("_m")) / 2 + _half(1 - F.col("_p"), 1 - F.col("_all"))
    without = F.when(F.col("n_words") * F.col("_all") >= MIN_COMMON, refs.of(F.col("lang"), lambda a: F.lit(refs.without(a) if refs.usual[a] else None).cast("double")))
    root = lambda x: F.sqrt(F.greatest(x, F.lit(0.0)))
    return sums.withColumns({"class_distance": root(F.col("_c")), "common_distance": root(common), "common_without": without}).drop("_q", "_r", "_n", "_c", "_w", "_p", "_m", "_d", "_all")


def verdict(max_class: float = MAX_CLASS, max_common: float = MAX_COMMON, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS) -> Column:
    """False for a text long enough to judge whose histogram is too far from its language's."""
    return ~(((F.col("word_chars") >= min_chars) & (F.col("class_distance") > max_class)) | ((F.col("n_words") >= min_words) & F.coalesce(F.col("common_distance") > max_common * F.col("common_without"), F.lit(False))))


def judged(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns of every row with FEATURES, the two distances, base_failed and kept.

    Row by row but for the references: repeated rows stay and get equal verdicts, an empty table gives an empty one, a null or
    empty text fails the base rules, long texts are judged whole. A null lang counts with all documents. `keep` columns named
    like one of the results are replaced by it; other names may be any.
    """
    results = (*FEATURES, "base_failed", "kept", "class_distance", "common_distance")
    keep = tuple(k for k in keep if k not in results)
    own = docs.select(F.struct(F.lit(0).alias("_"), *keep).alias("_row"), "text", "lang")
    table = C.written(features(own, ("_row", "lang")), "quality")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rated = distances(table, References(table)).withColumns({"base_failed": failed, "_fine": verdict()})
    return rated.select(*[F.col("_row")[k].alias(k) for k in keep], *FEATURES, "base_failed", (~F.col("base_failed") & F.col("_fine")).alias("kept"), "class_distance", "common_distance")

"""Hard negatives by distributed radix selection over integer scores.

An anchor's positives, and the negatives of each of its positives, are the first k rows of a window of scores, by score and
then by id. Tasks score their rows against a group of anchors as matrix products and count, for each window, how many rows fall
into each value of the next digit of the key; the summed counts name the bucket that holds the k-th row, and the next scan
refines that bucket alone. Digits go down to a single score and then, where many rows tie, through the ids. A window is done as
soon as no more than GATHER rows stand up to the end of its bucket: only these are gathered and ranked. So what is shuffled for
a window is a few counts a task and GATHER rows, however many rows tie or fall into it.

A task's counts stop at the bucket in which its own rows make k: the k-th row of all tasks stands there or before. Anchors are
dealt into groups of about GROUP; vectors, windows and counters of one group are all that the driver or a task holds of them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kartoteka.llm import _common as C

#: Anchors of a group, about.
GROUP = 2048
#: Bits of a digit.
DIGIT_BITS = 8
#: A window's rows are gathered once so many or fewer are left.
GATHER = 64
#: Cells of one matrix of scores.
CELLS = 1 << 20
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@dataclass
class Windows:
    """Windows [low, top] of scores, `slots` to an anchor, and how far each is refined.

    A row's key is top - score, so that it ascends as rows come. start, end: the bucket of keys under examination; where `tied`,
    it is one key, and id_start, id_end are the bucket of id offsets in it. before: rows that stand before the bucket.
    Once done, end and id_end are the last place that is gathered.
    """

    slots: int
    k: int
    same: bool
    low: np.ndarray
    top: np.ndarray
    id_span: int
    digit_bits: int = field(default_factory=lambda: DIGIT_BITS)
    start: np.ndarray = field(init=False)
    end: np.ndarray = field(init=False)
    id_start: np.ndarray = field(init=False)
    id_end: np.ndarray = field(init=False)
    before: np.ndarray = field(init=False)
    tied: np.ndarray = field(init=False)
    open: np.ndarray = field(init=False)

    def __post_init__(self):
        n = len(self.low)
        self.start, self.end = np.zeros(n, np.int64), self.top - self.low
        self.id_start, self.id_end = np.zeros(n, np.uint64), np.full(n, self.id_span, np.uint64)
        self.before, self.tied = np.zeros(n, np.int64), np.zeros(n, bool)
        self.open = self.end >= 0

    def shifts(self) -> np.ndarray:
        """Bits below the next digit."""
        width = np.where(self.tied, self.id_end - self.id_start, np.maximum(self.end - self.start, 0).astype(np.uint64))
        return np.array([max(0, int(w).bit_length() - self.digit_bits) for w in width.tolist()], np.uint64)

    def refine(self, found: list) -> None:
        """found: for each open window with rows, (window, digit of the k-th row, rows up to that digit, rows of that digit)."""
        shift, seen = self.shifts(), np.zeros(len(self.low), bool)
        for w, digit, upto, n in found:
            seen[w], bits = True, int(shift[w])
            first, last = digit << bits, ((digit + 1) << bits) - 1
            if self.tied[w]:
                a = int(self.id_start[w])
                self.id_start[w], self.id_end[w] = a + first, min(a + last, int(self.id_end[w]))
            else:
                a = int(self.start[w])
                self.start[w], self.end[w] = a + first, min(a + last, int(self.end[w]))
            if self.before[w] + upto <= max(GATHER, self.k):
                self.open[w] = False
            else:
                self.before[w] += upto - n
                self.tied[w] |= self.start[w] == self.end[w]
        empty = self.open & ~seen
        self.end[empty], self.open[empty] = -1, False


@dataclass
class Group:
    """Anchors: ids, labels and vectors; the least id of all rows; positives as (id, score) by window, where they are known."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    least_id: int
    positives: np.ndarray | None = None


def _vectors(column: pa.ListArray, dim: int, dtype) -> np.ndarray:
    """Rows of a list column as a matrix, zeros behind the shorter ones."""
    sizes = np.asarray(column.value_lengths())
    flat = np.asarray(column.flatten()).astype(dtype)
    if (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim), dtype)
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def _scored(batches: Iterator[pa.RecordBatch], g: Group, w: Windows) -> Iterator[tuple]:
    """(windows, keys, id offsets, ids, scores) of all rows that stand in the windows, part by part."""
    n = len(g.ids)
    usable = w.end >= 0
    top = np.where(usable, w.top, np.iinfo(np.int64).min).reshape(n, w.slots)
    low = np.where(usable, w.low, np.iinfo(np.int64).max).reshape(n, w.slots)
    most, least = top.max(1), low.min(1)
    for b in batches:
        ids, labels = np.asarray(b.column("vec_id")), np.asarray(b.column("label"))
        if not len(ids):
            continue
        rows = _vectors(b.column("v"), g.vectors.shape[1], g.vectors.dtype).T
        step = max(1, CELLS // len(ids))
        for a in range(0, n, step):
            part = slice(a, a + step)
            scores = (g.vectors[part] @ rows).astype(np.int64)
            ok = (g.labels[part, None] == labels) == w.same
            ok &= (scores <= most[part, None]) & (scores >= least[part, None])
            if w.same:
                ok &= g.ids[part, None] != ids
            ai, ri = np.nonzero(ok)
            if not len(ai):
                continue
            s, i = scores[ai, ri], ids[ri]
            ai += a
            offset = i.astype(np.int64).view(np.uint64) - np.array([g.least_id]).view(np.uint64)
            for slot in range(w.slots):
                inside = np.flatnonzero((s <= top[ai, slot]) & (s >= low[ai, slot]))
                at = ai[inside] * w.slots + slot
                yield at, w.top[at] - s[inside], offset[inside], i[inside], s[inside]


def _counted(batches, g: Group, w: Windows) -> Iterator[pa.RecordBatch]:
    shift, digits = w.shifts(), 1 << w.digit_bits
    counts = np.zeros((len(w.low), digits), np.int64)
    for at, key, offset, _, _ in _scored(batches, g, w):
        tied = w.tied[at]
        ok = w.open[at] & (key >= w.start[at]) & (key <= w.end[at])
        ok &= ~tied | (offset >= w.id_start[at]) & (offset <= w.id_end[at])
        at, key, offset, tied = at[ok], key[ok], offset[ok], tied[ok]
        inside = np.where(tied, offset - w.id_start[at], (key - w.start[at]).astype(np.uint64))
        np.add.at(counts, (at, (inside >> shift[at]).astype(np.int64)), 1)
    left = w.k - w.before
    wanted = (counts > 0) & (np.cumsum(counts, 1) - counts < left[:, None])
    at, digit = np.nonzero(wanted)
    yield pa.RecordBatch.from_pydict({"w": pa.array(at, pa.int64()), "digit": pa.array(digit, pa.int64()), "n": pa.array(counts[at, digit], pa.int64()), "wanted": pa.array(left[at], pa.int64())})


def _gathered(batches, g: Group, w: Windows) -> Iterator[pa.RecordBatch]:
    for at, key, offset, ids, scores in _scored(batches, g, w):
        ok = (key < w.end[at]) | (key == w.end[at]) & (offset <= w.id_end[at])
        at = at[ok]
        anchor = at // w.slots
        known = g.positives[at] if g.positives is not None else np.zeros((len(at), 2), np.int64)
        columns = {"w": at, "anchor_id": g.ids[anchor], "positive_id": known[:, 0], "positive_score": known[:, 1], "vec_id": ids[ok], "score": scores[ok]}
        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in columns.items()})


def _selected(rows: DataFrame, g: Group, w: Windows) -> DataFrame:
    """The first k rows of each window, with their rank."""
    sc = rows.sparkSession.sparkContext
    while w.open.any():
        sent = sc.broadcast((g, w))
        counts = rows.mapInArrow(lambda batches, sent=sent: _counted(batches, *sent.value), "w long, digit long, n long, wanted long")
        summed = counts.groupBy("w", "digit", "wanted").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("w").orderBy("digit"))
        # one row a window of the group comes back
        found = summed.withColumn("upto", upto).where("upto - n < wanted").groupBy("w").agg(F.max("digit"), F.max("upto"), F.max_by("n", "digit")).collect()
        w.refine([tuple(r) for r in found])
        sent.unpersist()
    sent = sc.broadcast((g, w))
    few = rows.mapInArrow(lambda batches: _gathered(batches, *sent.value), "w long, anchor_id long, positive_id long, positive_score long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("score"), "vec_id"))
    return few.withColumn("rank", rank).where(F.col("rank") <= w.k)


def _negative_windows(g: Group, found: list, positives: int, negatives: int, id_span: int) -> Windows:
    """found: (window, rank, id, score) of positives. Negatives score from half of their positive's score to 95 % of it."""
    n = len(g.ids) * positives
    g.positives, low, top = np.zeros((n, 2), np.int64), np.ones(n, np.int64), np.zeros(n, np.int64)
    for w, rank, vec_id, score in found:
        at = w * positives + rank - 1
        g.positives[at] = vec_id, score
        low[at], top[at] = -(-50 * score // 100), 95 * score // 100
    return Windows(positives, negatives, False, low, top, id_span)


def quantised(embeddings: DataFrame, relabel: bool = True) -> DataFrame:
    """vec_id, label and floor(256 * x) of the components of the rows that take part, one row an id.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part. Of several rows with one id the
    one with the least label, then the least vector, counts. relabel: a label becomes (label + 1) % 10 where 7 divides the id.
    """
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    label = F.col("label").cast("long")
    if relabel:
        label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    one = rows.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.struct(label.alias("label"), v.alias("v"))).alias("r"))
    return one.select("vec_id", "r.label", "r.v")


def hard_negatives(embeddings: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, relabel: bool = True) -> DataFrame:
    """For each anchor (an id that `every` divides) and each of its positives, the first negatives in the positive's window.

    Columns are those of RESULT. Scores are integer inner products; of vectors of different lengths the shorter counts as filled
    up with zeros. Higher scores come first, ties by the smaller id. Other columns have no effect; an empty table, or one
    without anchors, gives no rows. Scores of 2^62 or more are an error, as a long could not hold them.
    """
    spark: SparkSession = embeddings.sparkSession
    C.small_batches(spark)
    # dealt anew, so that all tasks score like numbers of rows
    rows = C.written(quantised(embeddings, relabel).repartition(C.width(spark)), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    is_anchor = F.col("vec_id") % every == 0
    n, least, most, norm, dim = rows.agg(F.count_if(is_anchor), F.min("vec_id"), F.max("vec_id"), F.max(square), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], RESULT)
    bound = int(norm * 1.001) + 1  # of any score, by Cauchy and Schwarz, and of any partial sum
    if bound >= 1 << 62:
        raise ValueError("scores do not fit into a long")
    dtype = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
    groups = max(1, round(n / GROUP))
    of = F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")
    anchors = rows.where(is_anchor)
    if groups > 1:
        anchors = C.written(anchors.withColumn("anchor_group", of), "anchors", "anchor_group")
    path = f"{C.shared_folder(spark)}/negatives-{uuid.uuid4().hex}"
    for k in range(groups):
        table = (anchors.where(F.col("anchor_group") == k) if groups > 1 else anchors).select("vec_id", "label", "v").toArrow().combine_chunks()
        if not table.num_rows:
            continue
        v = pa.concat_arrays(table.column("v").chunks)
        g = Group(np.asarray(table.column("vec_id")), np.asarray(table.column("label")), _vectors(v, dim, dtype), least)
        size, span = len(g.ids), most - least
        windows = Windows(1, positives, True, np.full(size, -bound), np.full(size, bound), span)
        found = _selected(rows, g, windows).select("w", "rank", "vec_id", "score").collect()
        windows = _negative_windows(g, [tuple(r) for r in found], positives, negatives, span)
        result = _selected(rows, g, windows)
        result.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(path)
    C.remove_at_end(spark, path)
    return spark.read.schema(RESULT).parquet(path)


def oracle() -> str:
    """The same in DuckDB's SQL."""
    return """
with r as (
    select vec_id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end)::bigint as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
    from embeddings
    where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
    select a.vec_id as anchor_id, r.vec_id, a.label = r.label as same, list_inner_product(a.v, r.v)::bigint as score
    from r as a join r on r.vec_id <> a.vec_id where a.vec_id % 50 = 0
), p as (
    select anchor_id, vec_id as positive_id, score as positive_score from s where same
    qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select p.anchor_id, positive_id, (row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id))::int as rank,
    vec_id as negative_id, positive_score, score as negative_score
from p join s on s.anchor_id = p.anchor_id and not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id) <= 3
"""

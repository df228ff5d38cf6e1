"""What several operators share: reading, the shared folder, word hashing and packing of sorted keys."""

from __future__ import annotations

import uuid

import numpy as np
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries that a worker's memo of words may hold; it starts anew beyond that, so memory stays bounded.
MEMO = 200_000
#: Longer words are computed each time: a memo of them would not be bounded in bytes.
MEMO_BYTES = 64
#: Bytes of an Arrow batch.
BATCH_BYTES = 2 << 20
#: What may be broadcast; beyond that a join is shuffled.
BROADCAST_BYTES = 32 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lowers Spark's bound of an Arrow batch's bytes, as all of a batch's texts are in a worker's memory at once.

    Only Spark's own default is lowered, not what the user chose. It holds for the session, as results are computed later;
    other queries just get smaller batches.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, str(BATCH_BYTES))


def free_name(name: str, columns: list[str]) -> str:
    """The name, with as many underscores in front as no column of a table has; names differ in case only count as equal."""
    taken = {c.lower() for c in columns}
    name = f"_{name}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def id_crc(doc_id: Column | str) -> Column:
    """crc32 of the id as text; a null id counts as 0."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")), F.lit(0))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the warehouse, which must be no local one on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = spark.conf.get("spark.sql.warehouse.dir")
        if folder.startswith("file:") and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return folder.rstrip("/")


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read again: lineage ends there and lost executors cost nothing.

    The table is removed when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    # the shuffle files of a finished write are of no further use
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.set(key, before)
    remove_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def remove_at_end(spark: SparkSession, path: str) -> None:
    """The table at the path goes when the driver's JVM ends, whether or not the session was stopped before."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def width(spark: SparkSession) -> int:
    """Buckets for a keyed exchange: the setting by which a Spark user sizes shuffles."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_claimed: list = [None]


def claim(owner) -> None:
    """Only one operator's memo is alive in a worker, as Spark reuses workers: the one before is told to forget()."""
    if _claimed[0] is not owner:
        if _claimed[0] is not None:
            _claimed[0].forget()
        _claimed[0] = owner


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= MEMO_BYTES:
            if len(self) >= MEMO:
                self.clear()
            self[word] = h
        return h

    def forget(self) -> None:
        self.clear()


_words = _Words()


def word_hashes(texts, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and each text's number of words.

    Words are maximal runs without ASCII white space, which is what bytes.split() yields; lower turns A-Z into a-z only.
    """
    return byte_word_hashes([t.encode() if t else b"" for t in texts], lower)


def byte_word_hashes(texts: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    claim(_words)
    split = [(t.lower() if lower else t).split() for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    get = _words.__getitem__
    out = np.empty(int(counts.sum()), np.uint64)
    at = 0
    for words in split:
        out[at : at + len(words)] = np.fromiter(map(get, words), np.uint64, len(words))
        at += len(words)
    return out, counts


def slices(texts: list, chars: int = 2_000_000):
    """Consecutive parts of a batch whose texts have about so many characters, as a batch's rows may all be long."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def parts(b, text: str):
    """(texts, rows) of consecutive parts of a pandas batch, as slices of its texts."""
    at = 0
    for texts in slices(b[text].tolist()):
        yield texts, b.iloc[at : at + len(texts)]
        at += len(texts)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(words: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of words[i : i + k] for every i that has k words after it."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, 0x9E3779B97F4A7C15 + salt, np.uint64)
    for j in range(k):
        h = mixed(h * np.uint64(0xD6E8FEB86659FD93) + words[j : j + n])
    return h


def rolling_at(words: np.ndarray, at: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """The same at some positions, each of which has k words after it."""
    h = np.full(len(at), 0x9E3779B97F4A7C15 + salt, np.uint64)
    for j in range(k):
        h = mixed(h * np.uint64(0xD6E8FEB86659FD93) + words[at + j])
    return h


def packed(a: np.ndarray, delta: bool = False) -> bytes:
    """Integers as compressed byte planes; delta for ascending values, whose differences have empty high planes."""
    if delta and len(a):
        a = np.diff(a, prepend=a.dtype.type(0))
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T
    return zstandard.compress(planes.tobytes(), 1)


def unpacked(data: bytes, dtype, delta: bool = False) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    size = np.dtype(dtype).itemsize
    a = np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).view(dtype).reshape(-1)
    return np.cumsum(a, dtype=dtype) if delta else a

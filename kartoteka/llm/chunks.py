"""Chunks of documents that ask keyed buckets for corpus-wide facts about their keys.

Documents are put together into chunks of a few megabytes and written once. A chunk sends each bucket its own distinct keys
(64-bit hashes, ascending, compressed), so a key that stands everywhere costs one entry a chunk; a bucket sees all entries of
its keys and sends an answer back to each chunk. It is a shuffled hash join whose two sides are deduplicated before the
shuffle: no task holds more than a chunk or a bucket. Their sizes grow with the square root of the input up to LARGEST times,
so that a message from a chunk to a bucket stays a kilobyte up to some TB and carries several keys at 100 TB. Buckets are
ranges of a hash, so none is hot; adaptive execution can't split one, nor need it.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartoteka.llm import _common as C

#: UTF-8 bytes of a chunk's texts, and of the input for each bucket, up to an input of FROM bytes; a longer document is a chunk
#: of its own. Above, both grow with the square root of the input, up to LARGEST times.
CHUNK_BYTES = 4_000_000
BUCKET_BYTES = 6_000_000
FROM, LARGEST = 30e9, 16.0
CHUNK_SCHEMA = "chunk long, part int, n_docs long, n_words long, n_bytes long, ids binary, no_id binary, sizes binary, texts binary, distinct binary, codes binary"


def sizes_for(n_bytes: int) -> tuple[int, int]:
    """Bytes of a chunk and of a bucket's share of an input of so many bytes."""
    times = min(LARGEST, max(1.0, (n_bytes / FROM) ** 0.5))
    return int(CHUNK_BYTES * times), int(BUCKET_BYTES * times)


class Chunk:
    """Documents: ids (where no_id, the id is null), and UTF-8 texts (null: empty) or the hashes of their words."""

    def __init__(self, row):
        self.ids = np.frombuffer(row.ids, np.int64)
        self.no_id = np.frombuffer(row.no_id, bool)
        self.sizes = np.frombuffer(row.sizes, np.int64)
        self.row = row

    @functools.cached_property
    def texts(self) -> list[bytes]:
        whole, ends = zstandard.decompress(self.row.texts), np.cumsum(self.sizes).tolist()
        return [whole[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    @functools.cached_property
    def words(self) -> np.ndarray:
        """Hashes of all words in order."""
        return C.unpacked(self.row.distinct, np.uint64, True)[C.unpacked(self.row.codes, np.uint32)]

    def doc_ids(self) -> pd.Series:
        return pd.Series(pd.array(self.ids, dtype="Int64")).mask(self.no_id)


def _row(part: int, ids: list, texts: list[bytes], lower: bool | None) -> pd.DataFrame:
    # any name will do, as the table is written once
    name = int.from_bytes(np.random.default_rng().bytes(8), "little", signed=True)
    known = np.array([i if i is not None else 0 for i in ids], np.int64)
    whole, distinct, codes, n_words, sizes = None, None, None, None, np.array([len(t) for t in texts], np.int64)
    n_bytes = int(sizes.sum())
    if lower is None:
        whole = zstandard.compress(b"".join(texts), 1)
    else:
        words, sizes = C.byte_word_hashes(texts, lower)
        n_words = len(words)
        found, place = np.unique(words, return_inverse=True)
        distinct, codes = C.packed(found, True), C.packed(place.astype(np.uint32))
    none = np.array([i is None for i in ids], bool)
    return pd.DataFrame([(name, part, len(ids), n_words, n_bytes, known.tobytes(), none.tobytes(), sizes.tobytes(), whole, distinct, codes)], columns=[c.split()[0] for c in CHUNK_SCHEMA.split(", ")])


def _chunked(batches, lower: bool | None, chunk_bytes: int) -> Iterator[pd.DataFrame]:
    open_chunks: dict[int, tuple[list, list]] = {}
    sizes: dict[int, int] = {}
    for b in batches:
        for i, null, part, t in zip(b["doc_id"].tolist(), b["no_id"].tolist(), b["part"].tolist(), b["text"], strict=True):
            ids, texts = open_chunks.setdefault(part, ([], []))
            ids.append(None if null else i)
            texts.append((t or "").encode())
            sizes[part] = sizes.get(part, 0) + len(texts[-1]) + 64
            if sizes[part] >= chunk_bytes:
                yield _row(part, ids, texts, lower)
                del open_chunks[part], sizes[part]
    for part, (ids, texts) in open_chunks.items():
        yield _row(part, ids, texts, lower)


def chunked(docs: DataFrame, lower: bool | None = None, part: Column | None = None) -> tuple[DataFrame, int]:
    """The documents (doc_id, text) in chunks, written; and a number of buckets for them.

    lower: the chunks have the hashes of words instead of texts, with A-Z lower-cased or not. part: a small number; documents
    of different parts are not in one chunk.
    """
    C.small_batches(docs.sparkSession)
    part = F.lit(0) if part is None else part
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), part.cast("int").alias("part"), "text")
    size = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    chunk_bytes, bucket_bytes = sizes_for(size)
    chunks = C.written(rows.mapInPandas(lambda batches: _chunked(batches, lower, chunk_bytes), CHUNK_SCHEMA), "chunks")
    return chunks, max(8, -(-size // bucket_bytes))


def sent(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """(bucket, slice) of ascending keys; a bucket is a range of the hash."""
    step = (1 << 64) // buckets + 1
    edges = np.searchsorted(keys, np.arange(1, buckets, dtype=np.uint64) * np.uint64(step)) if buckets > 1 else np.empty(0, np.int64)
    starts = [0, *edges.tolist(), len(keys)]
    for b in range(buckets):
        if starts[b] < starts[b + 1]:
            yield b, slice(starts[b], starts[b + 1])


def answered(asked: DataFrame, answer: Callable[[pd.DataFrame], pd.DataFrame], schema: str, name: str, buckets: int) -> DataFrame:
    """What answer makes of all rows of each bucket, written."""
    # about a bucket to a task, however large the input
    dealt = asked.repartition(max(C.width(asked.sparkSession), buckets), "bucket")
    return C.written(dealt.groupBy("bucket").applyInPandas(lambda rows: answer(rows), schema), name)


def together(chunks: DataFrame, answers: DataFrame, made: Callable[[Chunk, pd.DataFrame], Iterator[pd.DataFrame] | pd.DataFrame], schema: str) -> DataFrame:
    """What made gives for each chunk and all answers to it."""

    def both(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([made(Chunk(row), right) for row in left.itertuples()], ignore_index=True)

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(both, schema)


def merged(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of several ascending arrays, and the place there of each entry of all arrays in order."""
    return np.unique(np.concatenate(keys), return_inverse=True)

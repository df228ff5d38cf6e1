"""SentencePiece by a table of distinct chunks: each marked word is segmented once, and its ids are joined by position.

In the model's vocabulary the marker U+2581 stands at the start of a piece alone, so no piece crosses the place between another
character and a marker; neither does one cross a line feed that is in no piece of several characters. A text is cut at these
places into chunks: spaces with what follows them, or a line feed with what follows. A model of which this is not true, or that
rewrites texts, is refused. Chunks that a worker has met are looked up; the others of a batch are segmented together.
"""

from __future__ import annotations

import functools
import hashlib
import re
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartoteka.llm import _common as C

MARK = "▁"
#: Chunks of a text with a marker in front: spaces and what follows, or a line feed and what follows.
CHUNK = re.compile(" +[^ \n]*|\n[^ \n]*")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Ids of texts as little-endian unsigned 32-bit integers, without begin and end ids."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        whole = [self.model.id_to_piece(i) for i in range(self.size) if not (self.model.is_control(i) or self.model.is_byte(i) or self.model.is_unknown(i))]
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in whole):
            raise ValueError("a piece of the model crosses a marker or a line feed")
        sample = " AÅ  ﬁ\n"
        if self.model.decode(self.model.encode(sample)) != sample or self.model.encode(" a") == self.model.encode("a"):
            raise ValueError("the model rewrites texts")
        self.mark = np.array([self.model.piece_to_id(MARK)], "<u4").tobytes()
        self.begin, self.end = (np.array([i], "<u4").tobytes() for i in (self.model.bos_id(), self.model.eos_id()))
        self.forget()

    def forget(self) -> None:
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks. The library puts a marker in front of what it is given: it stands for a chunk's first space, and a
        chunk that starts with a line feed loses it again."""
        given = [c[1:] if c[0] == " " else c for c in chunks]
        return [self.mark if not g else np.array(ids[c[0] != " " :], "<u4").tobytes() for c, g, ids in zip(chunks, given, self.model.encode(given, num_threads=1), strict=True)]

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        out, new = {}, []
        for c in chunks:
            if (v := self.old.get(c)) is not None:
                out[c] = v
            else:
                new.append(c)
        out.update(zip(new, self.chunks(new), strict=True))
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        C.claim(self)
        split = []
        for t in texts:
            t = " " + t.replace(MARK, " ") if t else ""
            plain = "\0" not in t and "  " not in t
            split.append(t.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")[1:] if plain else CHUNK.findall(t))
        all_chunks = list(chain.from_iterable(split))
        values = list(map(self.young.get, all_chunks))
        absent = [i for i, v in enumerate(values) if v is None]
        found = self._learn({all_chunks[i] for i in absent})
        for i in absent:
            values[i] = found[all_chunks[i]]
        out, at = [], 0
        for s in split:
            out.append(b"".join(values[at : at + len(s)]))
            at += len(s)
        # what was not met for a generation is forgotten; long chunks are not kept at all
        self.young.update((c, v) for c, v in found.items() if len(c) <= C.MEMO_BYTES)
        if len(self.young) > C.MEMO:
            self.young, self.old = {}, self.young
        return out

    def decode(self, ids: bytes) -> str:
        return self.model.decode(np.frombuffer(ids, "<u4").tolist())


@functools.cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode(df: DataFrame, text: str = "text", to: str = "ids", path: str | None = None, ends: bool = True) -> DataFrame:
    """Adds the ids of a text column as an array, with begin and end ids or without; null gives null. All rows and columns stay."""
    path = path or default_model()

    def ids(texts: pd.Series) -> pd.Series:
        p = pieces(path)
        done = [p.begin + x + p.end if ends else x for part in C.slices([t or "" for t in texts]) for x in p(part)]
        return pd.Series([None if t is None else np.frombuffer(x, "<u4").astype(np.int32) for t, x in zip(texts, done, strict=True)], dtype=object)

    C.small_batches(df.sparkSession)
    return df.withColumn(to, F.pandas_udf(ids, "array<int>")(F.col(text)))


def decode(df: DataFrame, ids: str = "ids", to: str = "text", path: str | None = None) -> DataFrame:
    """Adds the text of an id column; null gives null, and bytes that are no UTF-8 become U+FFFD, as in the library."""
    path = path or default_model()

    def back(column: pd.Series) -> pd.Series:
        p = pieces(path)
        return pd.Series([None if x is None else p.model.decode(np.asarray(x).tolist()) for x in column], dtype=object)

    return df.withColumn(to, F.pandas_udf(back, "string")(F.col(ids)))


def digests(df: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id with the number of all ids of its text and the SHA-256 of the ids and of the text that they decode to.

    Row by row: a null text is empty and has begin and end ids alone, as has an empty one; repeated rows stay, an empty table
    gives an empty one, null ids stay, other columns have no effect. A long text or chunk is segmented whole.
    """
    C.small_batches(df.sparkSession)
    path = path or default_model()

    def row(texts: pd.Series) -> pd.DataFrame:
        p, out = pieces(path), []
        for part in C.slices([t or "" for t in texts]):
            for x in p(part):
                ids = p.begin + x + p.end
                out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(p.decode(ids).encode()).hexdigest()))
        return pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    made = F.pandas_udf(row, "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return df.select("doc_id", made(F.col("text")).alias("m")).select("doc_id", "m.*")

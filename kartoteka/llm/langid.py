"""Language ID by unigram pieces, marginalised over segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is the sum over all ways
to segment it into pieces, by the forward algorithm; a text's is the product over its words. Probabilities are learned by
expectation-maximisation, whose counts come from the same lattice.
"""

from __future__ import annotations

import functools
import re
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartoteka.llm import _common as C

WORD = re.compile(r"[^\W\d_]+")
MARK = "▁"
UNDETERMINED = "und"
#: Bound of the labelled documents of each language that the model is fitted on, whole texts each; drawn by a hash of the text.
TRAIN_ROWS = 2000
ROUNDS = 2


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@functools.cache
def vocabulary(path: str) -> tuple[dict[str, int], int]:
    """Lower-case pieces of letters, with or without the mark of a word's start, and their greatest length. Id 0: any other character."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    fine = sorted(p for p in found if p == MARK or (p[1:] if p[0] == MARK else p).isalpha())
    return {p: i + 1 for i, p in enumerate(fine)}, max(map(len, fine))


class _Table:
    """Piece ids by a hash of their characters, looked up for whole arrays: rounds of one slot each, until all have one."""

    BITS, BASE = 18, np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: dict[str, int]):
        self.rounds = []
        keys = np.array([self.of([p])[0] for p in pieces], np.uint64)
        ids = np.fromiter(pieces.values(), np.int32, len(pieces))
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces have one hash")
        while len(keys):
            slot = self._slot(keys, len(self.rounds))
            _, first = np.unique(slot, return_index=True)
            names, found = np.zeros(1 << self.BITS, np.uint64), np.full(1 << self.BITS, -1, np.int32)
            names[slot[first]], found[slot[first]] = keys[first], ids[first]
            self.rounds.append((names, found))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, ids = keys[rest], ids[rest]

    def _slot(self, keys: np.ndarray, k: int) -> np.ndarray:
        return (keys >> np.uint64(64 - self.BITS - 11 * k % 40)) & np.uint64((1 << self.BITS) - 1)

    @classmethod
    def of(cls, words: list[str]) -> np.ndarray:
        """Hashes of words of one length."""
        h = np.zeros(len(words), np.uint64)
        for c in characters(words).T:
            h = cls.longer(h, c)
        return h

    @classmethod
    def longer(cls, h: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (h + c + np.uint64(1)) * cls.BASE

    def ids(self, h: np.ndarray) -> np.ndarray:
        out = np.full(h.shape, -1, np.int32)
        for k, (names, found) in enumerate(self.rounds):
            slot = self._slot(h, k)
            out = np.where(names[slot] == h, found[slot], out)
        return out


def characters(words: list[str]) -> np.ndarray:
    """Code points of words of one length, one row each."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1).astype(np.uint64)


@functools.cache
def _table(path: str) -> _Table:
    return _Table(vocabulary(path)[0])


def lattice(words: list[str], path: str) -> np.ndarray:
    """For marked words of one length: ids[word, end, k] of the piece of k + 1 characters before `end`, else -1."""
    _, most = vocabulary(path)
    table, c = _table(path), characters(words)
    n = c.shape[1]
    most = min(most, n)
    ids = np.full((len(words), n + 1, most), -1, np.int32)
    h = np.zeros(c.shape, np.uint64)
    for k in range(most):  # hashes of the k + 1 characters from each place on
        h = table.longer(h[:, : n - k], c[:, k:])
        ids[:, k + 1 :, k] = table.ids(h)
    single = ids[:, 1:, 0]
    single[single < 0] = 0
    return ids


def forward(ids: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(alpha[word, end, model], log of each end's scale): sums over the segmentations of every prefix.

    p: probabilities by piece id and model, with a last row of zeros for id -1. Each end is scaled to 1 at most, so no
    word is too long.
    """
    rows, ends, most = ids.shape
    alpha = np.zeros((rows, ends, p.shape[1]))
    log = np.zeros((rows, ends, p.shape[1]))
    alpha[:, 0] = 1
    for e in range(1, ends):
        k = min(most, e)
        back = np.arange(e - 1, e - k - 1, -1)
        shift = log[:, back] - log[:, e - 1 : e]
        parts = alpha[:, back] * np.exp(np.minimum(shift, 700)) * p[ids[:, e, :k]]
        s = parts.sum(1)
        scale = np.maximum(s, 1e-300)
        alpha[:, e] = s / scale
        log[:, e] = log[:, e - 1] + np.log(scale)
    return alpha, log


def word_scores(words: list[str], p: np.ndarray, path: str) -> np.ndarray:
    """log probability of each marked word under each model."""
    out = np.empty((len(words), p.shape[1]))
    for part in by_length(words):
        ids = lattice([words[i] for i in part], path)
        _, log = forward(ids, p)
        out[part] = log[:, -1]
    return out


def by_length(words: list[str], cells: int = 1 << 18):
    """Indices of words of one length, few enough at once that their lattices stay small."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for n, those in groups.items():
        step = max(1, cells // (n * 16))
        for a in range(0, len(those), step):
            yield np.array(those[a : a + step])


def expected(words: list[str], counts: np.ndarray, p: np.ndarray, model: np.ndarray, path: str) -> np.ndarray:
    """Expected uses of each piece id in segmentations of the words, by model; word i belongs to model[i] and counts counts[i] times.

    Sums are kept as logarithms, so no word is too long.
    """
    out = np.zeros(p.shape)
    for rows in by_length(words):
        ids = lattice([words[i] for i in rows], path)
        m = model[rows]
        own = p[ids, m[:, None, None]]  # word, end, k
        n, ends, most = ids.shape
        a, b = np.zeros((n, ends)), np.zeros((n, ends))
        for e in range(1, ends):
            k = min(most, e)
            before = a[:, e - k : e][:, ::-1]
            top = before.max(1, keepdims=True)
            a[:, e] = top[:, 0] + np.log(np.maximum((np.exp(before - top) * own[:, e, :k]).sum(1), 1e-300))
        for s in range(ends - 2, -1, -1):
            k = min(most, ends - 1 - s)
            after = b[:, s + 1 : s + k + 1]
            top = after.max(1, keepdims=True)
            steps = own[:, s + np.arange(1, k + 1), np.arange(k)]
            b[:, s] = top[:, 0] + np.log(np.maximum((np.exp(after - top) * steps).sum(1), 1e-300))
        for e in range(1, ends):
            k = min(most, e)
            use = np.exp(np.minimum(a[:, e - k : e][:, ::-1] + b[:, e : e + 1] - a[:, -1:], 700)) * own[:, e, :k] * counts[rows][:, None]
            there = ids[:, e, :k] >= 0
            np.add.at(out, (ids[:, e, :k][there], np.broadcast_to(m[:, None], use.shape)[there]), use[there])
    return out


class Model:
    def __init__(self, langs: list[str], p: np.ndarray, prior: np.ndarray, path: str):
        self.langs, self.p, self.prior, self.path = langs, p, prior, path

    def __reduce__(self):
        return Model, (self.langs, self.p, self.prior, self.path)

    @functools.cached_property
    def memo(self) -> dict[str, int]:
        return {}

    @functools.cached_property
    def rows(self) -> list[np.ndarray]:
        """Log probabilities of the memo's words, one row each."""
        return [np.empty((0, len(self.langs)))]

    def forget(self) -> None:
        self.memo.clear()
        self.rows[:] = [np.empty((0, len(self.langs)))]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Most probable language and its posterior probability; UNDETERMINED and 0 without a letter."""
        C.claim(self)
        split = [WORD.findall(t.lower()) if t else [] for t in texts]
        memo = self.memo
        if len(self.rows[0]) > C.MEMO:
            self.forget()
        words = list(chain.from_iterable(split))
        new = list({w for w in words if w not in memo})
        if new:
            memo.update(zip(new, range(len(self.rows[0]), len(self.rows[0]) + len(new)), strict=True))
            self.rows[:] = [np.concatenate([self.rows[0], word_scores([MARK + w for w in new], self.p, self.path)])]
        logs = self.rows[0][np.fromiter(map(memo.__getitem__, words), np.int64, len(words))]
        for w in [w for w in new if len(w) > C.MEMO_BYTES]:
            del memo[w]  # its row stays until the memo starts anew
        ends = np.cumsum([len(s) for s in split])
        sums = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(logs, 0)])
        total = sums[ends] - sums[ends - np.array([len(s) for s in split], np.int64)] + np.log(self.prior)
        top = total.max(1, keepdims=True)
        posterior = 1 / np.exp(total - top).sum(1)
        best = total.argmax(1)
        fine = np.array([any(c.isalpha() for w in s for c in w) for s in split], bool)
        langs = [self.langs[b] if ok else UNDETERMINED for b, ok in zip(best, fine, strict=True)]
        return langs, np.where(fine, posterior, 0.0)


def fit(labelled: DataFrame, max_rows: int = TRAIN_ROWS, rounds: int = ROUNDS, path: str | None = None) -> Model:
    """Learns from text and lang of the rows; those with a null in either are left out.

    Of each language a hash of the text draws about max_rows texts at most; equal ones of one language count once. The
    languages' shares are those of all labelled rows. Words are counted by language on the executors; each round, executors
    return expected counts by piece and language, whose size the vocabulary and the number of languages bound.
    """
    spark, where = labelled.sparkSession, path or default_vocabulary()
    C.small_batches(spark)
    rows = labelled.where("text is not null and lang is not null").select("text", "lang")
    there = C.written(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    share = there.select("lang", (F.lit(max_rows * float(1 << 40)) / F.col("n")).alias("_share"))
    drawn = F.pmod(F.xxhash64("text", F.lit(7)), F.lit(1 << 40)) < F.col("_share")
    rows = rows.join(F.broadcast(share), "lang").where(drawn).select("text", "lang").dropDuplicates()

    def counted(batches):
        for b in batches:
            found: dict[tuple[str, str], int] = {}
            for text, lang in zip(b["text"], b["lang"], strict=True):
                for w in WORD.findall(text.lower()):
                    found[lang, w] = found.get((lang, w), 0) + 1
            yield pd.DataFrame([(a, w, n) for (a, w), n in found.items()], columns=["lang", "word", "n"])

    per_lang = {r["lang"]: r["n"] for r in there.collect()}
    langs = sorted(per_lang) or [UNDETERMINED]
    prior = np.array([per_lang.get(a, 1) for a in langs], float)
    words = C.written(rows.mapInPandas(counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    size = len(vocabulary(where)[0]) + 1
    p = np.full((size + 1, len(langs)), 1.0 / size)
    p[-1] = 0
    place = {a: i for i, a in enumerate(langs)}

    def one_round(p: np.ndarray) -> np.ndarray:
        def use(batches):
            out = np.zeros(p.shape)
            for b in batches:
                model = np.array([place[a] for a in b["lang"]], np.int64)
                out += expected([MARK + w for w in b["word"]], b["n"].to_numpy(float), p, model, where)
            i, m = np.nonzero(out)
            yield pd.DataFrame({"i": i, "m": m, "n": out[i, m]})

        sums = words.mapInPandas(use, "i long, m long, n double").groupBy("i", "m").agg(F.sum("n").alias("n")).toPandas()
        c = np.full(p.shape, 0.01)
        c[-1] = 0
        c[sums["i"], sums["m"]] += sums["n"]
        return c / c.sum(0)

    for _ in range(rounds if per_lang else 0):
        p = one_round(p)
    # an unseen character must not decide for the language with the fewest texts
    p[0] = p[0].min()
    return Model(langs, p, prior / prior.sum(), where)


def predict(df: DataFrame, model: Model, text: str | Column = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds the predicted language and its posterior probability (0 to 1) to every row.

    Null, empty and letterless texts give 'und' and 0; of languages equally probable the first by name is taken. All rows
    and columns stay, equal texts get equal answers, but columns of the two names are replaced. An empty table stays one. Long
    texts are read whole.
    """
    C.small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # vocabulary times languages: a few MB

    def said(texts: pd.Series) -> pd.DataFrame:
        parts = [shared.value.predict(part) for part in C.slices(texts)]
        return pd.DataFrame({"lang": [x for langs, _ in parts for x in langs], "score": np.concatenate([s for _, s in parts])})

    made = F.pandas_udf(said, "lang string, score double")(F.col(text) if isinstance(text, str) else text)
    said_as = C.free_name("said", [*df.columns, lang, score])
    return df.withColumn(said_as, made).withColumns({lang: F.col(f"{said_as}.lang"), score: F.col(f"{said_as}.score")}).drop(said_as)


def held_out(doc_id: str = "doc_id") -> Column:
    return C.id_crc(doc_id) % 3 == 1


def language_of_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from labelled rows that are not held out."""
    model = fit(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

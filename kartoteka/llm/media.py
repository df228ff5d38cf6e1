"""Media columns: ISO base media containers, walked box by box without decoding payloads."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartoteka.llm import _common as C

#: Boxes whose body is a list of boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
#: Boxes nested deeper than this are an error, as no such file is meant to be read.
DEEPEST = 32
#: The bit of a fragment's sample flags that marks samples which cannot be decoded alone.
NOT_SYNC = 0x010000
UNIT, KEY_EVERY, CHUNK_UNITS, TIMESCALE = 64, 16, 64, 8000

PROBE = (
    "codec string, handler string, timescale long, duration_units long, duration_s double, n_samples long, "
    "n_keyframes long, keyframes array<struct<offset:long,length:long,time:long>>, error string"
)


def boxes(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(type, body start, body end) of the boxes in a range; a box that overruns its parent raises ValueError."""
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            raise ValueError(f"{end - start} stray bytes at {start}")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - body < 8:
                raise ValueError(f"box {kind!r} at {start} lacks its long size")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise ValueError(f"box {kind!r} at {start} overruns its parent")
        yield kind, body, start + size
        start += size


def tracks(data: bytes) -> list[dict[bytes, tuple[int, int]]]:
    """The leaf boxes of each track, by type."""
    found: list[dict[bytes, tuple[int, int]]] = []

    def walk(start: int, end: int, into: dict | None, depth: int = 0) -> None:
        for kind, a, b in boxes(data, start, end):
            if kind in CONTAINERS:
                if depth == DEEPEST:
                    raise ValueError(f"boxes are nested deeper than {DEEPEST}")
                inner = into
                if kind == b"trak":
                    found.append(inner := {})
                walk(a, b, inner, depth + 1)
            elif into is not None:
                into.setdefault(kind, (a, b))

    walk(0, len(data), None)
    return found


def sample_table(data: bytes, t: dict[bytes, tuple[int, int]]) -> dict[str, np.ndarray]:
    """Offset, length and decoding time of every sample, and the indices of the sync samples.

    Samples must lie in the file, unless it has no media data at all: then its ranges are those of another file.
    """

    def table(kind: bytes, header: int, fields: int, width: int = 4) -> np.ndarray:
        a, b = t[kind]
        (n,) = struct.unpack_from(">I", data, a + header - 4)
        if n * fields * width > b - a - header:
            raise ValueError(f"{kind!r} has {n} entries, which its box cannot hold")
        return np.frombuffer(data, f">u{width}", n * fields, a + header).astype(np.int64).reshape(n, fields)

    if b"stsz" in t:
        a, _ = t[b"stsz"]
        fixed, n = struct.unpack_from(">II", data, a + 4)
        if fixed * n > len(data):
            raise ValueError(f"{n} samples of {fixed} bytes, which the file cannot hold")
        sizes = np.full(n, fixed, np.int64) if fixed else table(b"stsz", 12, 1)[:, 0]
    else:  # compact sizes of 4, 8 or 16 bits
        a, b = t[b"stz2"]
        bits, n = data[a + 7], struct.unpack_from(">I", data, a + 8)[0]
        if bits not in (4, 8, 16) or (n * bits + 7) // 8 > b - a - 12:
            raise ValueError("stz2 cannot be read")
        if bits == 4:
            pairs = np.frombuffer(data, np.uint8, (n + 1) // 2, a + 12)
            sizes = np.stack([pairs >> 4, pairs & 15], 1).reshape(-1)[:n].astype(np.int64)
        else:
            sizes = np.frombuffer(data, f">u{bits // 8}", n, a + 12).astype(np.int64)
    chunks = table(b"co64", 8, 1, 8)[:, 0] if b"co64" in t else table(b"stco", 8, 1)[:, 0]
    runs = table(b"stsc", 8, 3)
    per_chunk = np.zeros(len(chunks), np.int64)
    for k, (first, per, _) in enumerate(runs):
        last = runs[k + 1, 0] - 1 if k + 1 < len(runs) else len(chunks)
        per_chunk[first - 1 : last] = per
    if per_chunk.sum() != len(sizes):
        raise ValueError(f"chunks hold {per_chunk.sum()} samples, sizes {len(sizes)}")
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(per_chunk) - per_chunk
    full = per_chunk > 0
    offsets = before + np.repeat(chunks[full] - before[first[full]], per_chunk[full]) if len(sizes) else before
    outside = len(sizes) and (offsets.min() < 0 or (offsets + sizes).max() > len(data))
    if outside and any(kind == b"mdat" for kind, *_ in boxes(data)):
        raise ValueError(f"samples from {offsets.min()} to {(offsets + sizes).max()} are not in the file")
    times = table(b"stts", 8, 2)
    # no more times than there are samples, whatever the table says
    counts = np.diff(np.minimum(np.cumsum(times[:, 0]), len(sizes)), prepend=0)
    if counts.sum() < len(sizes):
        raise ValueError(f"{counts.sum()} times for {len(sizes)} samples")
    deltas = np.repeat(times[:, 1], counts)
    sync = table(b"stss", 8, 1)[:, 0] - 1 if b"stss" in t else np.arange(len(sizes))
    return {"offset": offsets, "length": sizes, "time": np.cumsum(deltas) - deltas, "sync": sync[(sync >= 0) & (sync < len(sizes))]}


def fragments(data: bytes) -> dict[int, dict[str, np.ndarray]]:
    """The samples that movie fragments hold, by track id, in the form of sample_table, and `end`, when the last one ends.

    What a fragment leaves out is taken from its track's defaults; a track without a stated time goes on where it ended.
    """
    default: dict[int, tuple[int, int, int]] = {}
    runs: dict[int, list[tuple[np.ndarray, ...]]] = {}
    clock: dict[int, int] = {}
    start = total = 0
    for kind, a, b in boxes(data):
        if kind == b"moov":
            for k, c, d in boxes(data, a, b):
                for extends, e, _ in boxes(data, c, d) if k == b"mvex" else ():
                    if extends == b"trex":
                        track, _, *rest = struct.unpack_from(">5I", data, e + 4)
                        default[track] = tuple(rest)
        elif kind == b"moof":
            after = start
            for k, c, d in boxes(data, a, b):
                if k != b"traf":
                    continue
                inner = list(boxes(data, c, d))
                (head,) = [x for x in inner if x[0] == b"tfhd"]
                track, base, usual = _fragment_head(data, *head[1:], start, after, default)
                for what, e, f in inner:
                    if what == b"tfdt":
                        (clock[track],) = struct.unpack_from(">Q" if data[e] == 1 else ">I", data, e + 4)
                    elif what == b"trun":
                        total += struct.unpack_from(">I", data, e + 4)[0]
                        if total > len(data):
                            raise ValueError(f"fragments have {total} samples, which the file cannot hold")
                        offset, lengths, lasting, flags = _run(data, e, f, base, after, usual)
                        after = int(offset + lengths.sum())
                        if offset < 0 or after > len(data):
                            raise ValueError(f"a run from {offset} to {after} is not in the file")
                        time = clock.get(track, 0) + np.cumsum(lasting) - lasting
                        clock[track] = clock.get(track, 0) + int(lasting.sum())
                        runs.setdefault(track, []).append((offset + np.cumsum(lengths) - lengths, lengths, time, flags & NOT_SYNC == 0))
        start = b
    found = {}
    for track, of in runs.items():
        offset, length, time, sync = (np.concatenate(x) for x in zip(*of, strict=True))
        found[track] = {"offset": offset, "length": length, "time": time, "sync": np.flatnonzero(sync), "end": clock[track]}
    return found


def _fragment_head(data: bytes, at: int, end: int, moof: int, after: int, default: dict) -> tuple[int, int | None, list[int]]:
    """Track id, where offsets count from, and the usual duration, size and flags of a sample."""
    flags, track = struct.unpack_from(">II", data, at)
    usual = list(default.get(track, (0, 0, 0)))
    base = moof if flags & 0x020000 else after
    at += 8
    if flags & 0x01:
        (base,) = struct.unpack_from(">Q", data, at)
        at += 8
    at += 4 * bool(flags & 0x02)
    for k, bit in enumerate((0x08, 0x10, 0x20)):
        if flags & bit:
            (usual[k],) = struct.unpack_from(">I", data, at)
            at += 4
    if at > end:
        raise ValueError("tfhd is too short")
    return track, base, usual


def _run(data: bytes, at: int, end: int, base: int, after: int, usual: list[int]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Where a run of samples starts, and its samples' lengths, durations and flags."""
    flags, n = struct.unpack_from(">II", data, at)
    at += 8
    offset, first = after, None
    if flags & 0x01:
        offset = base + struct.unpack_from(">i", data, at)[0]
        at += 4
    if flags & 0x04:
        (first,) = struct.unpack_from(">I", data, at)
        at += 4
    columns = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
    if at > end or n * len(columns) * 4 > end - at:
        raise ValueError(f"trun has {n} entries, which its box cannot hold")
    table = np.frombuffer(data, ">u4", n * len(columns), at).astype(np.int64).reshape(n, len(columns))
    lasting, lengths, marks = (table[:, columns.index(bit)] if bit in columns else np.full(n, usual[k], np.int64) for k, bit in enumerate((0x100, 0x200, 0x400)))
    if first is not None and n:
        marks = np.concatenate([[first], marks[1:]])
    return offset, lengths, lasting, marks


def _samples(data: bytes, t: dict[bytes, tuple[int, int]], in_fragments: dict[int, dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """A track's samples by its tables, then those of its fragments."""
    sizes = t.get(b"stsz", t.get(b"stz2"))
    s = {k: np.zeros(0, np.int64) for k in ("offset", "length", "time", "sync")}
    if sizes and struct.unpack_from(">I", data, sizes[0] + 8)[0] and {b"stts", b"stsc"} <= t.keys():
        s = sample_table(data, t)
    more = None
    if in_fragments and b"tkhd" in t:
        a, _ = t[b"tkhd"]
        more = in_fragments.get(struct.unpack_from(">I", data, a + (20 if data[a] == 1 else 12))[0])
    if more:
        n = len(s["length"])
        s = {k: np.concatenate([s[k], more[k] + (n if k == "sync" else 0)]) for k in s} | {"end": more["end"]}
    return s


def probed(data: bytes | None) -> dict:
    """What PROBE has of the first video track with samples, or the first of any kind; damaged files give an error text.

    Samples in movie fragments follow those of the tables; the duration is then the time when the last of them ends.
    """
    empty = dict.fromkeys(["codec", "handler", "timescale", "duration_units", "duration_s", "n_samples", "n_keyframes", "keyframes", "error"])
    if data is None:
        return empty
    try:
        handler_of = lambda t: data[t[b"hdlr"][0] + 8 : t[b"hdlr"][0] + 12] if b"hdlr" in t else b""
        in_fragments = fragments(data)
        for t in sorted(tracks(data), key=lambda t: handler_of(t) != b"vide"):
            if not {b"mdhd", b"stsd"} <= t.keys():
                continue
            s = _samples(data, t, in_fragments)
            if not len(s["length"]):
                continue
            a, _ = t[b"mdhd"]
            scale, units = struct.unpack_from(">IQ" if data[a] == 1 else ">II", data, a + (20 if data[a] == 1 else 12))
            units = s.get("end", units)
            handler = handler_of(t).decode("latin-1") or None
            keys = [dict(zip(("offset", "length", "time"), map(int, x), strict=True)) for x in zip(*(s[c][s["sync"]] for c in ("offset", "length", "time")), strict=True)]
            return empty | {
                "codec": data[t[b"stsd"][0] + 12 : t[b"stsd"][0] + 16].decode("latin-1"), "handler": handler, "timescale": scale, "duration_units": units,
                "duration_s": units / scale if scale else None, "n_samples": len(s["length"]), "n_keyframes": len(keys), "keyframes": keys,
            }
        return empty | {"error": "no track with samples"}
    except (ValueError, KeyError, IndexError, OverflowError, struct.error) as e:
        return empty | {"error": f"{type(e).__name__}: {e}"}


def stored_bytes(data: bytes) -> bytes:
    """The first track's samples in order, by its sample table."""
    s = sample_table(data, tracks(data)[0])
    starts, ends = s["offset"], s["offset"] + s["length"]
    if not len(starts):
        return b""
    cut = np.flatnonzero(starts[1:] != ends[:-1]) + 1  # adjacent samples are read at once
    return b"".join(data[a:b] for a, b in zip(starts[np.r_[0, cut]].tolist(), ends[np.r_[cut - 1, len(ends) - 1]].tolist(), strict=True))


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def wrapped(payload: bytes) -> bytes:
    """A file whose one sound track holds the payload: units of 64 8-bit samples, every 16th a sync sample.

    No clock or random value is written, so equal payloads give equal files.
    """
    n, head = len(payload) // UNIT, struct.pack(">I", 0)
    if n * UNIT != len(payload):
        raise ValueError("the payload is not a multiple of 64 bytes")
    n_chunks = -(-n // CHUNK_UNITS)
    last = n - (n_chunks - 1) * CHUNK_UNITS
    runs = [(1, CHUNK_UNITS, 1)] * (n_chunks > 1) + [(n_chunks, last, 1)]
    if n_chunks > 1 and last == CHUNK_UNITS:
        runs = runs[:1]
    unity = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = _box(b"raw ", struct.pack(">6xH8xHHHHI", 1, 1, 8, 0, 0, TIMESCALE << 16))
    long_offsets = len(payload) + 4096 + 8 * n_chunks > 0xFFFFFFFF
    keys = np.arange(1, n + 1, KEY_EVERY, dtype=">u4")

    def moov(base: int) -> bytes:
        at = base + CHUNK_UNITS * UNIT * np.arange(n_chunks, dtype=np.int64)
        offsets = _box(b"co64", head, struct.pack(">I", n_chunks), at.astype(">u8").tobytes()) if long_offsets else _box(b"stco", head, struct.pack(">I", n_chunks), at.astype(">u4").tobytes())
        stbl = _box(
            b"stbl", _box(b"stsd", head, struct.pack(">I", 1), entry), _box(b"stts", head, struct.pack(">III", 1, n, UNIT)),
            _box(b"stsc", head, struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)), _box(b"stsz", head, struct.pack(">II", UNIT, n)),
            offsets, _box(b"stss", head, struct.pack(">I", len(keys)), keys.tobytes()),
        )
        minf = _box(b"minf", _box(b"smhd", head, bytes(4)), _box(b"dinf", _box(b"dref", head, struct.pack(">I", 1), _box(b"url ", struct.pack(">I", 1)))), stbl)
        mdia = _box(
            b"mdia", _box(b"mdhd", struct.pack(">B3xQQIQHH", 1, 0, 0, TIMESCALE, n * UNIT, 0x55C4, 0)),
            _box(b"hdlr", head, bytes(4), b"soun", bytes(12), b"bytes\0"), minf,
        )
        tkhd = _box(b"tkhd", struct.pack(">B3BQQIIQ8xhhh2x", 1, 0, 0, 7, 0, 0, 1, 0, n * UNIT, 0, 0, 0x100), unity, bytes(8))
        mvhd = _box(b"mvhd", struct.pack(">B3xQQIQIH10x", 1, 0, 0, TIMESCALE, n * UNIT, 0x10000, 0x100), unity, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    long_body = len(payload) + 16 > 0xFFFFFFFF
    mdat = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if long_body else struct.pack(">I4s", len(payload) + 8, b"mdat")
    size = len(moov(0))
    return b"".join([ftyp, moov(len(ftyp) + size + len(mdat)), mdat, payload])


def _probe(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([probed(None if x is None else bytes(x)) for x in content], columns=["codec", "handler", "timescale", "duration_units", "duration_s", "n_samples", "n_keyframes", "keyframes", "error"]).astype({c: "Int64" for c in ("timescale", "duration_units", "n_samples", "n_keyframes")})


def probe_media(df: DataFrame, content: str = "content", to: str = "media") -> DataFrame:
    """Adds a struct of codec, duration and keyframe byte ranges of the ISO media files in a binary column.

    A null file gives nulls; a damaged one an error text; a file without samples the error 'no track with samples'. An
    existing column of the name `to` is replaced; all others, repeated rows included, stay as they are. An empty table gives an
    empty one; a large file's tables are read whole, its payload is not.
    """
    return df.withColumn(to, F.pandas_udf(_probe, PROBE)(F.col(content)))


STORED = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _stored(text: str | None) -> tuple:
    raw = (text or "").encode()
    media = wrapped(raw + bytes(-len(raw) % UNIT if raw else UNIT))
    back, p = stored_bytes(media), probed(media)
    spans = np.array([[k["offset"], k["length"]] for k in p["keyframes"]], "<u8")
    feature = f"codec={p['codec'].strip()};handler={p['handler']};duration={p['duration_units']}/{p['timescale']};samples={p['n_samples']};keyframes={p['n_keyframes']};spans={zlib.crc32(spans.tobytes()):08x}"
    return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature


def stored_features(text: pd.Series) -> pd.DataFrame:
    """Stores each text's bytes in a media file, reads them back by its sample table and describes the file; null as empty."""
    return pd.DataFrame([_stored(t) for t in text], columns=[c.split()[0] for c in STORED.split(", ")])


def with_features(df: DataFrame, text: str | Column = "text") -> DataFrame:
    """doc_id and stored_features of its text; row by row, so repeated rows stay, equal texts get equal values, an empty table none.

    A null text is empty; a long one is stored whole.
    """
    C.small_batches(df.sparkSession)
    return df.select("doc_id", F.pandas_udf(stored_features, STORED)(F.col(text) if isinstance(text, str) else text).alias("m")).select("doc_id", "m.*")

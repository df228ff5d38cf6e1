"""ISO containers: exact round trips, damaged counts, two tracks, fragments."""

import hashlib
import struct
import zlib

import pytest

from kartoteka.llm import media


@pytest.mark.parametrize("n", [1, 63, 64, 65, 64 * 64, 64 * 64 * 3 + 5, 300_000])
def test_round_trip(n):
    raw = bytes(i * 31 % 256 for i in range(n))
    payload = raw + bytes(-n % 64)
    data = media.wrapped(payload)
    assert media.stored_bytes(data) == payload
    p = media.probed(data)
    assert p["error"] is None and p["n_samples"] == len(payload) // 64 and p["n_keyframes"] == -(-p["n_samples"] // 16)
    for k in p["keyframes"]:
        assert data[k["offset"] : k["offset"] + k["length"]] == payload[k["time"] : k["time"] + 64]


def changed(kind: bytes, at: int, value: int) -> bytes:
    data = bytearray(media.wrapped(bytes(6400)))
    struct.pack_into(">I", data, data.index(kind) + 4 + at, value)
    return bytes(data)


@pytest.mark.parametrize(("kind", "at"), [(b"stts", 8), (b"stts", 4), (b"stsz", 8), (b"stsc", 4), (b"stco", 4), (b"stss", 4), (b"stsc", 12)])
def test_huge_counts_are_errors_not_allocations(kind, at):
    p = media.probed(changed(kind, at, 0x7FFFFFFF))
    assert p["error"] or kind == b"stts" and p["n_samples"] == 100


def test_damaged_and_fragmented():
    data = media.wrapped(bytes(640))
    for cut in range(0, len(data) - 640, 7):
        assert media.probed(data[:cut])["error"]
    assert media.probed(data + struct.pack(">I4s", 8, b"moof"))["n_samples"] == 10
    nested = b""
    for _ in range(40):
        nested = struct.pack(">I4s", len(nested) + 8, b"udta") + nested
    assert "deeper" in media.probed(nested)["error"]
    assert media.probed(None)["error"] is None and media.probed(b"")["error"]


@pytest.mark.parametrize("to", [0x7FFFFFFF, 0xFFFFFFFF, -64])
def test_ranges_outside_the_file_are_errors(to):
    data = bytearray(media.wrapped(bytes(64 * 10)))
    where = data.index(b"stco") + 12
    (base,) = struct.unpack_from(">I", data, where)
    assert media.probed(bytes(data))["error"] is None
    struct.pack_into(">I", data, where, to if to > 0 else base - to)  # or one sample too far
    assert "not in the file" in media.probed(bytes(data))["error"]
    cut = media.wrapped(bytes(64 * 10))[:-1]
    assert media.probed(cut)["error"]


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def fragmented(n_table: int = 0) -> bytes:
    """A file with n_table samples in tables, and two fragments of 3 and 2 samples: sizes of their own, then the usual one."""
    data = bytearray(media.wrapped(bytes(64 * 10)))
    if not n_table:
        for kind in (b"stsz", b"stts", b"stsc", b"stco", b"stss"):  # empty tables, as muxers write them
            struct.pack_into(">I", data, data.index(kind) + (12 if kind == b"stsz" else 8), 0)
    mvex = box(b"mvex", box(b"trex", struct.pack(">6I", 0, 1, 1, 20, 7, 0x010000)))
    at = data.index(b"moov") - 4
    size = struct.unpack_from(">I", data, at)[0]
    data[at + size : at + size] = mvex
    struct.pack_into(">I", data, at, size + len(mvex))
    if n_table:  # the payload moved
        where = data.index(b"stco") + 12
        struct.pack_into(">I", data, where, struct.unpack_from(">I", data, where)[0] + len(mvex))
    head = box(b"tfhd", struct.pack(">II", 0x020000, 1))
    for times, run, payload in (
        ([box(b"tfdt", struct.pack(">II", 0, 1000))], lambda to: box(b"trun", struct.pack(">IIiI", 0x205, 3, to, 0), struct.pack(">3I", 5, 6, 8)), b"aaaaabbbbbbcccccccc"),
        ([], lambda to: box(b"trun", struct.pack(">IIi", 0x001, 2, to)), b"dddddddeeeeeee"),
    ):
        moof = lambda to: box(b"moof", box(b"mfhd", bytes(8)), box(b"traf", head, *times, run(to)))  # noqa: B023, E731
        data += moof(len(moof(0)) + 8) + box(b"mdat", payload)
    return bytes(data)


def test_fragments():
    data = fragmented()
    p = media.probed(data)
    assert (p["error"], p["n_samples"], p["duration_units"], p["n_keyframes"]) == (None, 5, 1100, 1)
    s = media.fragments(data)[1]
    got = [data[a : a + n] for a, n in zip(s["offset"], s["length"], strict=True)]
    assert got == [b"aaaaa", b"bbbbbb", b"cccccccc", b"ddddddd", b"eeeeeee"] and s["time"].tolist() == [1000, 1020, 1040, 1060, 1080]
    assert p["keyframes"] == [{"offset": int(s["offset"][0]), "length": 5, "time": 1000}]
    both = media.probed(fragmented(10))
    assert (both["error"], both["n_samples"], both["n_keyframes"]) == (None, 15, 2)


@pytest.mark.parametrize("n", [6, 0x7FFFFFFF])
def test_damaged_fragments(n):
    data = bytearray(fragmented())
    struct.pack_into(">I", data, data.index(b"trun") + 8, n)  # more samples than the run lists
    assert media.probed(bytes(data))["error"]
    last = bytearray(fragmented())
    struct.pack_into(">I", last, last.rindex(b"trun") + 8, n)  # samples of the usual size beyond the file
    assert media.probed(bytes(last))["error"]
    for cut in range(data.index(b"moof"), len(data)):
        media.probed(bytes(data[:cut]))


def test_compact_sizes():
    data = bytearray(media.wrapped(bytes(64 * 3)))
    at = data.index(b"stsz")
    data[at : at + 4] = b"stz2"
    struct.pack_into(">II", data, at + 8, 8, 0)
    assert media.probed(bytes(data))["error"] == "no track with samples"
    old = struct.unpack_from(">I", data, at - 4)[0]
    sizes = box(b"stz2", struct.pack(">III", 0, 8, 3), bytes([64, 64, 64]))
    grown = len(sizes) - old
    data[at - 4 : at - 4 + old] = sizes
    for kind in (b"moov", b"trak", b"mdia", b"minf", b"stbl"):
        k = data.index(kind) - 4
        struct.pack_into(">I", data, k, struct.unpack_from(">I", data, k)[0] + grown)
    p = media.probed(bytes(data))
    assert (p["error"], p["n_samples"]) == (None, 3)


def test_video_comes_before_sound():
    sound = media.wrapped(bytes(640))
    video = sound.replace(b"soun", b"vide").replace(b"raw ", b"avc1")
    a, b = (x[x.index(b"trak") - 4 :][: struct.unpack_from(">I", x, x.index(b"trak") - 4)[0]] for x in (sound, video))
    both = struct.pack(">I4s", 8 + len(a) + len(b), b"moov") + a + b
    assert (media.probed(both)["codec"], media.probed(both)["handler"]) == ("avc1", "vide")


def test_features(spark):
    rows = [(1, "x" * 130, 0), (2, None, 0), (3, "", 0), (None, "x" * 130, 0)]
    got = media.with_features(spark.createDataFrame(rows, "doc_id long, text string, m int")).collect()
    r = {x.doc_id: x for x in got}
    padded = b"x" * 130 + bytes(62)
    assert (r[1].n_bytes, r[1].payload_bytes, r[1].payload_sha256, r[1].tail_crc32) == (130, 192, hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert r[2][1:] == r[3][1:] and r[2].payload_bytes == 64 and r[1][1:] == r[None][1:]
    assert media.with_features(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    damaged = spark.createDataFrame([(1, b"no box", "kept")], "id long, content binary, media string")
    (d,) = media.probe_media(damaged).collect()
    assert d.media.error and d.id == 1

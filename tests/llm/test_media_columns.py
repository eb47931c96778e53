import hashlib
import random
import struct
import zlib

import pytest

from spanloom.llm import media_columns as M


def test_round_trip_and_cues():
    rng = random.Random(1)
    for n in (0, 1, 575, 576, 577, 576 * 24, 576 * 25, 576 * 24 * 16 + 5, 700_001):
        payload = M.payload_of(rng.randbytes(n))
        assert len(payload) % 576 == 0 and len(payload) >= 576
        blob = M.mux(payload)
        got = M.parse(blob)
        assert b"".join(blob[s:e] for _, _, s, e in got["packets"]) == payload
        assert [c[2] for c in got["cues"]] == got["clusters"]
        assert got["tracks"] == {1: "A_PCM/INT/LIT"}
        assert got["packets"][0][1] == 0


@pytest.mark.parametrize("kind", [M.XIPH, M.FIXED, M.EBML_LACING])
def test_lacing(kind):
    rng = random.Random(kind)
    for _ in range(50):
        n = rng.randint(2, 9)
        sizes = [rng.choice([1, 200, 255, 256, 600, 70_000]) for _ in range(n)] if kind != M.FIXED else [rng.randint(1, 300)] * n
        frames = [rng.randbytes(k) for k in sizes]
        body = M.block(3, -5, frames, kind)
        track, offset, ranges = M.frame_ranges(body, 0, len(body))
        assert (track, offset, [body[a:b] for a, b in ranges]) == (3, -5, frames)


def test_unknown_sizes_and_block_groups():
    cluster = b"\x1f\x43\xb6\x75\xff" + M.number(M.TIMESTAMP, 70) + M.element(M.BLOCK_GROUP, M.element(M.BLOCK, M.block(1, 2, [b"abc"])))
    blob = M._HEAD + b"\x18\x53\x80\x67\x01\xff\xff\xff\xff\xff\xff\xff" + M._TRACK + cluster + cluster
    got = M.parse(blob)
    assert [(t, blob[s:e]) for _, t, s, e in got["packets"]] == [(72, b"abc")] * 2 and len(got["clusters"]) == 2
    with pytest.raises(ValueError):
        M.parse(b"RIFF0000")


def test_query_columns(spark):
    texts = [None, "", "é" * 400, "x" * 100_000, "same", "same"]
    docs = spark.createDataFrame([(i if i else None, t, "m") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    out = M.features(M.store(docs)).collect()
    for r, t in zip(sorted(out, key=lambda r: r.doc_id or 0), texts):
        payload = M.payload_of((t or "").encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert out[4][1:] == out[5][1:]
    table = M.packets(M.store(docs))
    assert table.count() == sum(len(M.payload_of((t or "").encode())) // 576 for t in texts)
    assert M.features(M.store(docs.limit(0))).count() == 0
    broken = spark.createDataFrame([(1, b"junk", 0), (2, None, 0), (3, M.mux(b"x" * 576)[:-3], 0)], "doc_id long, media binary, n_bytes long")
    assert all(r.error and r.packet is None for r in M.packets(broken).collect()) and M.packets(broken).count() == 3
    assert all(r.error and r.feature is None for r in M.features(broken).collect())


def elements(data, at, end):
    """A second reader, for files without unknown sizes: (id, start, body start, body end), masters before their children."""
    while at < end:
        begin, width = at, 8 - data[at].bit_length() + 1
        code, at = data[at : at + width], at + width
        width = 8 - data[at].bit_length() + 1
        size = int.from_bytes(data[at : at + width], "big") & ((1 << 7 * width) - 1)
        at += width
        yield code.hex(), begin, at, at + size
        if code.hex() in ("18538067", "114d9b74", "4dbb", "1f43b675", "1c53bb6b", "bb", "b7", "1549a966"):
            yield from elements(data, at, at + size)
        at += size


def test_stored_form_by_a_second_reader(spark):
    texts = ["", "short", "é" * 3000, "long text " * 60_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    files = {r.doc_id: bytes(r.media) for r in M.store(docs).collect()}
    rows = {r.doc_id: r for r in M.features(M.store(docs)).collect()}
    for i, text in enumerate(texts):
        data, payload = files[i], b""
        all_of = list(elements(data, 0, len(data)))
        base = next(b for code, _, b, _ in all_of if code == "18538067")
        starts = {begin - base: code for code, begin, _, _ in all_of}
        clusters = [begin for code, begin, _, _ in all_of if code == "1f43b675"]
        cues = [int.from_bytes(data[b:e], "big") + base for code, _, b, e in all_of if code == "f1"]
        seeks = [data[b:e].hex() for code, _, b, e in all_of if code == "53ab"]
        at = [int.from_bytes(data[b:e], "big") for code, _, b, e in all_of if code == "53ac"]
        assert cues == clusters and [starts[x] for x in at] == seeks == ["1549a966", "1654ae6b", "1c53bb6b"]
        n, times, now = 0, [], 0
        for code, _, b, e in all_of:
            if code == "e7":
                now = int.from_bytes(data[b:e], "big")
            if code == "a3":
                laced = data[b + 3] & 6
                payload += data[b + 4 + bool(laced) : e]
                n += data[b + 4] + 1 if laced else 1
                times.append(now + int.from_bytes(data[b + 1 : b + 3], "big", signed=True))
        assert payload == M.payload_of(text.encode())
        duration = next(struct.unpack(">d", data[b:e])[0] for code, _, b, e in all_of if code == "4489")
        assert duration == n * 72
        shares = [1000 * sum(lo <= x < lo + 32 for x in payload) // len(payload) for lo in range(0, 256, 32)] if len(payload) < 20_000 else None
        r = rows[i]
        assert (r.media_bytes, r.media_sha256) == (len(data), hashlib.sha256(data).hexdigest())
        head, _, tail = r.feature.partition(";h")
        assert head == f"p{n};c{len(clusters)};q{len(cues)};t{times[-1]}" and shares in (None, [int(x) for x in tail.split(",")])


def test_cut_files_raise_only_value_errors():
    rng = random.Random(8)
    whole = M.mux(M.payload_of(b"some text " * 300))
    laced = M._HEAD + M.element(M.SEGMENT, M._TRACK + M.element(M.CLUSTER, M.number(M.TIMESTAMP, 1) + M.element(M.SIMPLE_BLOCK, M.block(1, 0, [b"a" * 300, b"b", b"c" * 9], M.EBML_LACING)) + M.element(M.SIMPLE_BLOCK, M.block(1, 0, [b"a" * 300, b"b"], M.XIPH))))
    for blob in (whole, laced):
        for _ in range(400):
            bad = bytearray(blob[: rng.randint(0, len(blob))])
            for _ in range(rng.randint(0, 3)):
                if bad:
                    bad[rng.randrange(min(len(bad), 200))] = rng.choice([0, 1, 127, 128, 255])
            try:
                M.parse(bytes(bad))
            except ValueError:
                pass

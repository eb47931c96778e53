"""Media columns: Matroska files in a binary column, parsed into a packet table.

`parse` walks the elements of a file: variable-length ids and sizes (also the unknown size), the segment's
tracks, clusters with their timestamps, simple blocks and block groups with all four lacings, and the cue
index. A packet is one frame: track, timestamp, byte range in the file. `mux` writes 8-bit mono PCM as laced
simple blocks with cues, so that what is stored can be read back byte for byte.

Both work on one file at a time inside Arrow batches; no file is larger than its text and its block headers.

Defined cases: a null or empty text is one frame of padding; null ids and repeated rows keep their rows; a very
long text is one file with many clusters; further columns are not read. Bytes that are no whole Matroska file
raise ValueError in `parse`; in `packets` and `features` such a file, or a null, is one row with `error` and nulls.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import common as C

#: Fixed values of the format: element ids.
EBML, SEGMENT, INFO, TIMESTAMP_SCALE, TRACKS, TRACK_ENTRY = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x2AD7B1, 0x1654AE6B, 0xAE
TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
EBML_VERSION, EBML_READ, MAX_ID, MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
DURATION, MUXING_APP, WRITING_APP, SEEK_HEAD, SEEK, SEEK_ID, SEEK_POSITION = 0x4489, 0x4D80, 0x5741, 0x114D9B74, 0x4DBB, 0x53AB, 0x53AC
_MASTER = {SEGMENT, SEEK_HEAD, SEEK, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS}
_TOP = {SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

FRAME, PAD, RATE, FRAMES_IN_BLOCK, BLOCKS_IN_CLUSTER = 576, 255, 8000, 24, 16
FRAME_MS = FRAME * 1000 // RATE


def size_bytes(n: int, width: int = 0) -> bytes:
    """A size as a variable-length integer: a marker bit after width - 1 zero bits, then the value."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(code: int, body: bytes) -> bytes:
    return code.to_bytes((code.bit_length() + 7) // 8, "big") + size_bytes(len(body)) + body


def number(code: int, n: int) -> bytes:
    return element(code, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], kind: int) -> bytes:
    """What stands before the frames of a laced block: their number less one, then all sizes but the last."""
    sizes = [len(f) for f in frames]
    head = bytes([len(frames) - 1])
    if kind == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == EBML_LACING:
        head += size_bytes(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            width = next(w for w in range(1, 9) if abs(b - a) < 1 << 7 * w - 1)
            head += size_bytes(b - a + (1 << 7 * width - 1) - 1, width)
    return head


def block(track: int, offset: int, frames: list[bytes], kind: int = FIXED) -> bytes:
    kind = kind if len(frames) > 1 else NO_LACING
    head = size_bytes(track) + offset.to_bytes(2, "big", signed=True) + bytes([0x80 | kind << 1])
    return head + (lace(frames, kind) if kind else b"") + b"".join(frames)


_HEAD = element(EBML, number(EBML_VERSION, 1) + number(EBML_READ, 1) + number(MAX_ID, 4) + number(MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + number(DOC_VERSION, 4) + number(DOC_READ, 2))
_TRACK = element(TRACKS, element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + element(AUDIO, element(SAMPLING, np.array([RATE], ">f8").tobytes()) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))))


def info(ms: int) -> bytes:
    return element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, np.array([ms], ">f8").tobytes()) + element(MUXING_APP, b"spanloom") + element(WRITING_APP, b"spanloom"))


def seek_head(places: list[tuple[int, int]]) -> bytes:
    """Where the top elements (id, byte in the segment) begin; always of one size for one number of places."""
    return element(SEEK_HEAD, b"".join(element(SEEK, element(SEEK_ID, code.to_bytes(4, "big")) + element(SEEK_POSITION, at.to_bytes(8, "big"))) for code, at in places))


_SEEK_SIZE = len(seek_head([(INFO, 0), (TRACKS, 0), (CUES, 0)]))


def mux(payload: bytes) -> bytes:
    """A file whose one track holds the payload, FRAME samples a packet. len(payload): a positive multiple of FRAME."""
    about, cues = info(len(payload) // FRAME * FRAME_MS), []
    body, at = [about, _TRACK], _SEEK_SIZE + len(about) + len(_TRACK)
    in_cluster = FRAME * FRAMES_IN_BLOCK * BLOCKS_IN_CLUSTER
    for c in range(0, len(payload), in_cluster):
        time = c // FRAME * FRAME_MS
        parts = [number(TIMESTAMP, time)]
        for b in range(c, min(c + in_cluster, len(payload)), FRAME * FRAMES_IN_BLOCK):
            piece = payload[b : min(b + FRAME * FRAMES_IN_BLOCK, c + in_cluster)]
            head = size_bytes(1) + ((b - c) // FRAME * FRAME_MS).to_bytes(2, "big", signed=True)
            n = len(piece) // FRAME
            head += b"\x80" if n == 1 else bytes([0x80 | FIXED << 1, n - 1])
            parts.append(element(SIMPLE_BLOCK, head + piece))
        cluster = element(CLUSTER, b"".join(parts))
        cues.append(element(CUE_POINT, number(CUE_TIME, time) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    head = seek_head([(INFO, _SEEK_SIZE), (TRACKS, _SEEK_SIZE + len(about)), (CUES, at)])
    return _HEAD + element(SEGMENT, head + b"".join(body) + element(CUES, b"".join(cues)))


def varint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int | None, int]:
    """(value, end) of a variable-length integer; None for the unknown size (all value bits set)."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length integer at byte {at}")
    width = 9 - data[at].bit_length()
    end = at + width
    if end > len(data):
        raise ValueError(f"cut off at byte {at}")
    value = int.from_bytes(data[at:end], "big")
    if keep_marker:
        return value, end
    value &= (1 << 7 * width) - 1
    return (None if value == (1 << 7 * width) - 1 else value), end


def frame_ranges(data: bytes, at: int, end: int) -> tuple[int, int, list[tuple[int, int]]]:
    """(track, time offset, byte ranges of the frames) of a block's body."""
    track, p = varint(data, at)
    if track is None or p + 3 > end:
        raise ValueError(f"block at byte {at} has no head")
    offset = int.from_bytes(data[p : p + 2], "big", signed=True)
    kind = data[p + 2] >> 1 & 3
    p += 3
    if kind == NO_LACING:
        return track, offset, [(p, end)]
    if p >= end:
        raise ValueError(f"block at byte {at} has no lacing")
    n, p = data[p] + 1, p + 1
    if kind == FIXED:
        if (end - p) % n:
            raise ValueError(f"{end - p} bytes in {n} frames of one size")
        step = (end - p) // n
        return track, offset, [(p + k * step, p + (k + 1) * step) for k in range(n)]
    sizes: list[int] = []
    for k in range(n - 1):
        if kind == XIPH:
            size = 0
            while p < end and data[p] == 255:
                size, p = size + 255, p + 1
            if p >= end:
                raise ValueError(f"lacing of the block at byte {at} is cut off")
            size, p = size + data[p], p + 1
        else:
            q = p
            value, p = varint(data, p)
            if value is None:
                if not k:
                    raise ValueError(f"a frame of unknown size in the block at byte {at}")
                value = (1 << 7 * (p - q)) - 1
            size = value if not k else sizes[-1] + value - (1 << 7 * (p - q) - 1) + 1
        sizes.append(size)
    sizes.append(end - p - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("frames run over their block")
    out = []
    for size in sizes:
        out.append((p, p + size))
        p += size
    return track, offset, out


def parse(data: bytes) -> dict:
    """packets (track, timestamp in the file's units, start, end), tracks (number to codec), cues (time, track, byte), seek (id, byte), scale."""
    found = {"packets": [], "tracks": {}, "cues": [], "seek": [], "scale": 1_000_000, "clusters": []}
    code, p = varint(data, 0, True)
    if code != EBML:
        raise ValueError("no EBML header")
    state = {"time": 0, "base": 0, "track": 0, "cue": [0, 0, 0], "seek": 0}

    def walk(at: int, end: int, parent: int) -> int:
        while at < end:
            code, p = varint(data, at, True)
            size, p = varint(data, p)
            if parent == CLUSTER and code in _TOP:  # a cluster of unknown size ends where the next top element begins
                return at
            stop = end if size is None else p + size
            if stop > end:
                raise ValueError(f"element at byte {at} runs over its parent")
            if code in _MASTER:
                if code == SEGMENT:
                    state["base"] = p
                elif code == CLUSTER:
                    found["clusters"].append(at)
                after = walk(p, stop, code)
                stop = after if size is None else stop
                if code == CUE_POINT:
                    found["cues"].append(tuple(state["cue"]))
            elif code in (SIMPLE_BLOCK, BLOCK):
                track, offset, ranges = frame_ranges(data, p, stop)
                found["packets"] += [(track, state["time"] + offset, a, b) for a, b in ranges]
            elif code == CODEC_ID:
                found["tracks"][state["track"]] = data[p:stop].decode("ascii", "replace")
            elif code == SEEK_ID:
                state["seek"] = int.from_bytes(data[p:stop], "big")
            elif code == SEEK_POSITION:
                found["seek"].append((state["seek"], int.from_bytes(data[p:stop], "big") + state["base"]))
            elif code in (TIMESTAMP, TRACK_NUMBER, CUE_TIME, CUE_TRACK, CUE_CLUSTER, TIMESTAMP_SCALE):
                value = int.from_bytes(data[p:stop], "big")
                if code == TIMESTAMP:
                    state["time"] = value
                elif code == TRACK_NUMBER:
                    state["track"] = value
                elif code == TIMESTAMP_SCALE:
                    found["scale"] = value
                else:
                    state["cue"][(CUE_TIME, CUE_TRACK, CUE_CLUSTER).index(code)] = value + (state["base"] if code == CUE_CLUSTER else 0)
            at = stop
        return at

    walk(0, len(data), 0)
    return found


def payload_of(text: bytes) -> bytes:
    return text + bytes([PAD]) * (FRAME - len(text) % FRAME if len(text) % FRAME or not text else 0)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the file `media` that holds each whole text."""

    def run(batches):
        for b in batches:
            for lo, hi, data, at in C.chunks(b.column("text")):
                raw = data.tobytes()
                files = [mux(payload_of(raw[s:e])) for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[lo:hi], pa.array(np.diff(at), pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


PACKETS = "doc_id long, packet long, track long, timestamp_ms double, start long, length long, error string"


def packets(media: DataFrame) -> DataFrame:
    """The packet table of (doc_id, media): a row for each packet, and one with `error` for a file that cannot be parsed."""

    def run(batches):
        for b in batches:
            rows = []
            for i, blob in zip(b.column("doc_id").to_pylist(), b.column("media").to_pylist()):
                try:
                    got = parse(blob or b"")
                    rows += [(i, k, track, time * got["scale"] / 1e6, s, e - s, None) for k, (track, time, s, e) in enumerate(got["packets"])]
                except ValueError as error:
                    rows.append((i, None, None, None, None, None, str(error)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 7, kinds)], names=[n.split()[0] for n in PACKETS.split(", ")])

    return media.select(F.col("doc_id").cast("long").alias("doc_id"), "media").mapInArrow(run, PACKETS)


def feature(found: dict, payload: bytes) -> str:
    """Packets, clusters, cues that point at a cluster, last timestamp, and a coarse picture of the samples: the share of each octant of values in permille."""
    top = np.bincount(np.frombuffer(payload, np.uint8) >> 5, minlength=8) * 1000 // max(1, len(payload))
    good = sum(c[2] in set(found["clusters"]) for c in found["cues"])
    last = found["packets"][-1][1] if found["packets"] else 0
    return f"p{len(found['packets'])};c{len(found['clusters'])};q{good};t{last};h" + ",".join(map(str, top))


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def read_back(blob: bytes | None) -> tuple:
    """The columns of FEATURES after n_bytes, from the stored bytes alone."""
    stored = (None, None) if blob is None else (len(blob), hashlib.sha256(blob).hexdigest())
    try:
        found = parse(blob or b"")
    except ValueError as error:
        return None, None, None, *stored, None, str(error)
    payload = b"".join([blob[s:e] for _, _, s, e in found["packets"]])
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), *stored, feature(found, payload), None


def features(media: DataFrame) -> DataFrame:
    """What the stored bytes say: payload read back by packet ranges, digests, feature."""

    def run(batches):
        for b in batches:
            cols = list(zip(*map(read_back, b.column("media").to_pylist()))) or [()] * 7
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[n.split()[0] for n in FEATURES.split(", ")])

    return media.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_bytes").cast("long").alias("n_bytes"), "media").mapInArrow(run, FEATURES)


def op8(spark, sf_dir: str) -> DataFrame:
    return features(store(C.read(spark, sf_dir, "documents")))

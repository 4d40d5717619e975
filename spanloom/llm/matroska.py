"""Matroska files as a column: bytes stored as 8-bit samples, read back as packet tables.

A file has an EBML head and one segment: information, one audio track of 8-bit PCM, clusters
of laced blocks, and cues. The parser takes any file of that kind: elements of unknown size,
all four kinds of lacing, block groups, several tracks.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import text_of, written

#: Bytes of a packet; the payload is padded to a multiple of it.
PACKET = 576
PAD = b"\xff"
RATE = 8000
#: Packets in a block, blocks in a cluster (its blocks' times have to fit 16 bits).
LACED, BLOCKS = 8, 32
#: Element ids of the format.
EBML, VERSION, READ_VERSION, MAX_ID, MAX_SIZE, DOCTYPE, DOC_VERSION, DOC_READ = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, SCALE, DURATION, MUXER, WRITER = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, ENTRY, NUMBER, UID, TYPE, LACING, CODEC, DEFAULT_DURATION, AUDIO, FREQUENCY, CHANNELS, DEPTH = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE, GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, POINT, CUE_TIME, POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Elements that may end a cluster of unknown size.
TOP = {SEGMENT, INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}


class MatroskaError(ValueError):
    """The bytes are no such file."""


def size_of(n: int, width: int | None = None) -> bytes:
    """n as a variable-length size, in `width` bytes or as few as hold it."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(kind: int, *content: bytes) -> bytes:
    return b"".join((kind.to_bytes((kind.bit_length() + 7) // 8, "big"), size_of(sum(map(len, content))), *content))


def number(kind: int, n: int) -> bytes:
    return element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def encode(payload: bytes) -> bytes:
    """payload, whole packets, as a file of one track."""
    ms = PACKET * 1000 // RATE
    packets = len(payload) // PACKET
    head = element(EBML, number(VERSION, 1), number(READ_VERSION, 1), number(MAX_ID, 4), number(MAX_SIZE, 8), element(DOCTYPE, b"matroska"), number(DOC_VERSION, 4), number(DOC_READ, 2))
    info = element(INFO, number(SCALE, 1_000_000), element(DURATION, struct.pack(">d", packets * ms)), element(MUXER, b"spanloom"), element(WRITER, b"spanloom"))
    audio = element(AUDIO, element(FREQUENCY, struct.pack(">d", RATE)), number(CHANNELS, 1), number(DEPTH, 8))
    tracks = element(TRACKS, element(ENTRY, number(NUMBER, 1), number(UID, 1), number(TYPE, 2), number(LACING, 1), element(CODEC, b"A_PCM/INT/LIT"), number(DEFAULT_DURATION, ms * 1_000_000), audio))
    parts, cues, at = [info, tracks], [], len(info) + len(tracks)
    for first in range(0, packets, LACED * BLOCKS):
        blocks = [number(TIMESTAMP, first * ms)]
        for k in range(first, min(packets, first + LACED * BLOCKS), LACED):
            laced = min(LACED, packets - k)
            flags = 0x80 | (0x04 if laced > 1 else 0)
            lace = bytes([laced - 1]) if laced > 1 else b""
            blocks.append(element(SIMPLE, b"\x81" + struct.pack(">hB", (k - first) * ms, flags) + lace, payload[k * PACKET : (k + laced) * PACKET]))
        cues.append(element(POINT, number(CUE_TIME, first * ms), element(POSITIONS, number(CUE_TRACK, 1), number(CUE_CLUSTER, at))))
        parts.append(element(CLUSTER, *blocks))
        at += len(parts[-1])
    return head + element(SEGMENT, *parts, element(CUES, *cues))


def vint(data: bytes, at: int, keep: bool) -> tuple[int, int]:
    """A variable-length number and where it ends; keep leaves the length mark in. All ones: -1."""
    if at >= len(data) or not data[at]:
        raise MatroskaError(f"no number at {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise MatroskaError(f"cut off at {at}")
    n = int.from_bytes(data[at : at + width], "big")
    if keep:
        return n, at + width
    n &= (1 << 7 * width) - 1
    return (-1 if n == (1 << 7 * width) - 1 else n), at + width


def elements(data: bytes, at: int, end: int, inside: int = 0) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of the contents of each element from `at`; a cluster or segment may be open-ended."""
    while at < end:
        kind, start = vint(data, at, True)
        size, start = vint(data, start, False)
        if size < 0:
            if kind not in (SEGMENT, CLUSTER):
                raise MatroskaError("an element of unknown size")
            stop = end
            if kind == CLUSTER:
                stop = start
                while stop < end:
                    inner, body = vint(data, stop, True)
                    if inner in TOP:
                        break
                    length, body = vint(data, body, False)
                    stop = body + length
        else:
            stop = start + size
        if stop > end:
            raise MatroskaError(f"the element at {at} ends beyond its parent")
        yield kind, start, stop
        at = stop


def unlace(data: bytes, at: int, end: int, flags: int) -> list[tuple[int, int]]:
    """(offset, length) of the packets of a block."""
    how = flags & 0x06
    if not how:
        return [(at, end - at)]
    n, at = data[at] + 1, at + 1
    if how == 0x04:
        size, rest = divmod(end - at, n)
        if rest:
            raise MatroskaError("a fixed lace doesn't come out even")
        return [(at + i * size, size) for i in range(n)]
    sizes: list[int] = []
    for i in range(n - 1):
        if how == 0x02:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        else:
            width = 9 - data[at].bit_length() if data[at] else 9
            size, at = vint(data, at, False)
            if i:
                size = sizes[-1] + size - ((1 << 7 * width - 1) - 1)
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise MatroskaError("a lace is longer than its block")
    found = []
    for size in sizes:
        found.append((at, size))
        at += size
    return found


def parse(data: bytes) -> dict:
    """tracks: number -> codec, ms of a packet; packets: (track, ms, key, offset, length); cues: (ms, track, cluster's offset)."""
    of = lambda a, b: int.from_bytes(data[a:b], "big")
    top = list(elements(data, 0, len(data)))
    if not top or top[0][0] != EBML or not any(k == SEGMENT for k, _, _ in top):
        raise MatroskaError("no EBML head or no segment")
    out: dict = {"tracks": {}, "packets": [], "cues": [], "clusters": [], "scale": 1_000_000}
    for _, base, stop in (x for x in top if x[0] == SEGMENT):
        for kind, a, b in elements(data, base, stop):
            if kind == INFO:
                out["scale"] = next((of(*x[1:]) for x in elements(data, a, b) if x[0] == SCALE), out["scale"])
            elif kind == TRACKS:
                for _, c, d in (x for x in elements(data, a, b) if x[0] == ENTRY):
                    f = {k: (s, e) for k, s, e in elements(data, c, d)}
                    if NUMBER not in f or CODEC not in f:
                        raise MatroskaError("a track without number or codec")
                    out["tracks"][of(*f[NUMBER])] = (data[slice(*f[CODEC])].decode(), of(*f[DEFAULT_DURATION]) / 1e6 if DEFAULT_DURATION in f else 0)
            elif kind == CLUSTER:
                time = 0
                out["clusters"].append(a)
                for inner, c, d in elements(data, a, b):
                    if inner == TIMESTAMP:
                        time = of(c, d)
                    blocks = [(c, d)] if inner == SIMPLE else [x[1:] for x in elements(data, c, d) if x[0] == BLOCK] if inner == GROUP else []
                    for s, e in blocks:
                        track, s = vint(data, s, False)
                        shift, flags = struct.unpack_from(">hB", data, s)
                        step = out["tracks"].get(track, ("", 0))[1]
                        for i, (at, size) in enumerate(unlace(data, s + 3, e, flags)):
                            out["packets"].append((track, (time + shift) * out["scale"] / 1e6 + i * step, bool(flags & 0x80) or inner == GROUP, at, size))
            elif kind == CUES:
                for _, c, d in (x for x in elements(data, a, b) if x[0] == POINT):
                    f = {k: (s, e) for k, s, e in elements(data, c, d)}
                    g = {k: (s, e) for k, s, e in elements(data, *f[POSITIONS])}
                    out["cues"].append((of(*f[CUE_TIME]), of(*g[CUE_TRACK]), base + of(*g[CUE_CLUSTER])))
    for _, _, at in out["cues"]:
        if at >= len(data) or vint(data, at, True)[0] != CLUSTER:
            raise MatroskaError("a cue points at no cluster")
    return out


def padded(text: str) -> tuple[bytes, int]:
    raw = text.encode()
    return raw + PAD * (-len(raw) % PACKET if raw else PACKET), len(raw)


def feature(parsed: dict, payload: bytes) -> str:
    """Packets, clusters, end in ms, mean and deviation of the samples, and their shares by sixteenth."""
    samples = np.frombuffer(payload, np.uint8)
    counts = np.bincount(samples, minlength=256)
    n = max(1, samples.size)
    mean = float(counts @ np.arange(256)) / n
    spread = (max(0.0, float(counts @ (np.arange(256) ** 2)) / n - mean * mean)) ** 0.5
    shares = (counts.reshape(16, 16).sum(1) * 255 // n).astype(np.uint8).tobytes().hex()
    last = parsed["packets"][-1] if parsed["packets"] else (0, 0)
    return f"{len(parsed['packets'])}:{len(parsed['clusters'])}:{last[1]:.0f}:{mean:.3f}:{spread:.3f}:{shares}"


def media_column(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: every whole text (null: empty) as a Matroska file. No shuffle."""

    def stored(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, len(ids), 256):
                made = [padded(t) for t in texts.slice(at, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([ids.slice(at, 256), pa.array([n for _, n in made], pa.int64()), pa.array([encode(p) for p, _ in made], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text")).mapInArrow(stored, "doc_id long, n_bytes long, media binary")


def packets(media: DataFrame) -> DataFrame:
    """doc_id, packet, track, ms, keyframe, offset, length: the packet table of each file, a row for each packet.

    A null file has none; a file that is no Matroska raises. Repeated rows give repeated tables,
    an empty table none; other columns are ignored.
    """

    def rows(batches):
        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = parse(data)["packets"]
                cols = list(zip(*found, strict=True)) or [()] * 5
                types = (pa.int32(), pa.float64(), pa.bool_(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(found), pa.int64()), pa.array(range(len(found)), pa.int32()), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", "packet", "track", "ms", "keyframe", "offset", "length"])

    return media.where("media is not null").select("doc_id", "media").mapInArrow(rows, "doc_id long, packet int, track int, ms double, keyframe boolean, offset long, length long")


def features(media: DataFrame) -> DataFrame:
    """What the stored bytes give when read: lengths, digests and the feature of each file.

    media has doc_id, n_bytes and media, as media_column gives it, never null. A file is read
    whole, one at a time, whatever its length; equal files give equal values, repeated rows
    repeated rows, an empty table none; other columns are ignored.
    """
    names = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def read(batches):
        for batch in batches:
            ids, sizes, files = batch.columns
            rows = []
            for data in files:
                data = data.as_py()
                parsed = parse(data)
                view = memoryview(data)
                payload = b"".join(view[a : a + n] for _, _, _, a, n in parsed["packets"])
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(parsed, payload)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([ids, sizes, *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], [n.split()[0] for n in names.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, names)


def round_trip(docs: DataFrame) -> DataFrame:
    """Store the media column as a table in the shared folder, read it again, compute features.

    A null text is empty: one packet of padding. Repeated rows give repeated rows; an empty table
    gives an empty one; other columns of docs, whatever their names, are ignored.
    """
    return features(written(media_column(docs), "media"))

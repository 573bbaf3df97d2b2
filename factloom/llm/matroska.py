"""Matroska: a packet table from EBML bytes, and a writer for lossless 8-bit PCM tracks.

The parser walks variable-length elements (unknown sizes included), clusters, simple blocks and block groups with no, Xiph,
fixed-size or EBML lacing, and cues, and yields a row for every frame: track, time, byte range, key flag, lacing. The writer
stores bytes as unsigned 8-bit PCM in clusters whose blocks cycle through the four lacings, with cues for each cluster.
Truncated or foreign bytes give the packets before the damage; null or empty bytes give none.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format: element identifiers.
EBML, SEGMENT, INFO, SCALE, TRACKS, ENTRY = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x2AD7B1, 0x1654AE6B, 0xAE
NUMBER, UID, TYPE, CODEC, AUDIO, RATE, CHANNELS, DEPTH = 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIME, SIMPLE, GROUP, BLOCK, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, POINT, CUE_TIME, POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOCTYPE, DURATION, LANGUAGE = 0x4282, 0x4489, 0x22B59C
LACINGS = ("none", "xiph", "fixed", "ebml")
#: Samples of a frame, frames of a laced block, blocks of a cluster; 8000 samples a second, one tick a millisecond.
FRAME, LACED, CLUSTERED, HERTZ = 1024, 4, 4, 8000


@dataclass
class Media:
    """What a file holds: tracks as (number, type, codec), packets as (track, ticks, offset, size, key, lacing), cues as (ticks, track, cluster offset)."""

    scale: int = 1_000_000
    doctype: str = ""
    tracks: list = field(default_factory=list)
    packets: list = field(default_factory=list)
    cues: list = field(default_factory=list)
    clusters: list = field(default_factory=list)


def _vint(raw: bytes, at: int, marker: bool) -> tuple[int, int]:
    """(value, bytes used) of a variable-length integer; the value keeps its marker bit for identifiers, and is -1 for an unknown size."""
    n = 9 - raw[at].bit_length()
    if n > 8 or at + n > len(raw):
        raise ValueError("bad length")
    value = int.from_bytes(raw[at : at + n], "big")
    if marker:
        return value, n
    value &= (1 << 7 * n) - 1
    return (-1 if value == (1 << 7 * n) - 1 else value), n


def _elements(raw: bytes, at: int, end: int, inside: frozenset = frozenset()) -> Iterator[tuple[int, int, int]]:
    """(identifier, start, end) of the children; an element of unknown size ends where one of ``inside`` or the parent ends."""
    while at < end:
        name, n = _vint(raw, at, True)
        size, m = _vint(raw, at + n, False)
        start = at + n + m
        if size < 0:
            stop = start
            while stop < end:
                child, k = _vint(raw, stop, True)
                if child in inside:
                    break
                length, j = _vint(raw, stop + k, False)
                stop = end if length < 0 else stop + k + j + length
        else:
            stop = start + size
        yield name, start, min(stop, end)
        at = stop


def _number(raw: bytes, a: int, b: int) -> int:
    return int.from_bytes(raw[a:b], "big")


def _frames(raw: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """(offset, size) of the frames of a block whose lace header, if any, starts at ``at``."""
    if lacing == 0:
        return [(at, end - at)]
    count = raw[at] + 1
    at += 1
    sizes: list[int] = []
    if lacing == 2:
        sizes = [(end - at) // count] * count
    elif lacing == 1:
        for _ in range(count - 1):
            size = 0
            while raw[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + raw[at])
            at += 1
    else:
        for i in range(count - 1):
            value, n = _vint(raw, at, False)
            sizes.append(value if i == 0 else sizes[-1] + value - ((1 << 7 * n - 1) - 1))
            at += n
    if lacing != 2:
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("bad lace")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def parse(raw: bytes) -> Media:
    """Everything that the bytes hold up to their end or the first damage."""
    media = Media()
    try:
        _parse(raw, media)
    except (ValueError, IndexError):
        pass
    return media


def _block(raw: bytes, a: int, b: int, time: int, key: bool | None, media: Media) -> None:
    track, n = _vint(raw, a, False)
    shift, flags = struct.unpack_from(">hB", raw, a + n)
    lacing = flags >> 1 & 3
    for offset, size in _frames(raw, a + n + 3, b, lacing):
        media.packets.append((track, time + shift, offset, size, bool(flags & 128) if key is None else key, LACINGS[lacing]))


def _parse(raw: bytes, media: Media) -> None:
    tops = frozenset((CLUSTER, CUES, TRACKS, INFO))
    for name, a, b in _elements(raw, 0, len(raw)):
        if name == EBML:
            media.doctype = next((raw[x:y].decode("ascii", "replace") for k, x, y in _elements(raw, a, b) if k == DOCTYPE), "")
        if name != SEGMENT:
            continue
        for part, c, d in _elements(raw, a, b, tops):
            if part == INFO:
                media.scale = next((_number(raw, x, y) for k, x, y in _elements(raw, c, d) if k == SCALE), media.scale)
            elif part == TRACKS:
                for k, x, y in _elements(raw, c, d):
                    if k == ENTRY:
                        own = {e: (p, q) for e, p, q in _elements(raw, x, y)}
                        media.tracks.append((_number(raw, *own.get(NUMBER, (0, 0))), _number(raw, *own.get(TYPE, (0, 0))), raw[slice(*own.get(CODEC, (0, 0)))].decode("ascii", "replace")))
            elif part == CLUSTER:
                media.clusters.append(c - a)
                time = 0
                for k, x, y in _elements(raw, c, d, tops):
                    if k == TIME:
                        time = _number(raw, x, y)
                    elif k == SIMPLE:
                        _block(raw, x, y, time, None, media)
                    elif k == GROUP:
                        own = list(_elements(raw, x, y))
                        key = all(e != REFERENCE for e, _, _ in own)
                        for e, p, q in own:
                            if e == BLOCK:
                                _block(raw, p, q, time, key, media)
            elif part == CUES:
                for k, x, y in _elements(raw, c, d):
                    if k == POINT:
                        own = {e: (p, q) for e, p, q in _elements(raw, x, y)}
                        spot = {e: _number(raw, p, q) for e, p, q in _elements(raw, *own.get(POSITIONS, (0, 0)))}
                        media.cues.append((_number(raw, *own.get(CUE_TIME, (0, 0))), spot.get(CUE_TRACK, 0), spot.get(CUE_CLUSTER, 0)))


def _size(n: int, width: int = 0) -> bytes:
    width = width or max(1, -(-(n + 2).bit_length() // 7))
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _element(name: int, body: bytes) -> bytes:
    return name.to_bytes(-(-name.bit_length() // 8), "big") + _size(len(body)) + body


def _uint(name: int, value: int, width: int = 0) -> bytes:
    return _element(name, value.to_bytes(width or max(1, -(-value.bit_length() // 8)), "big"))


def _lace(frames: list[bytes], lacing: int) -> bytes:
    if lacing == 0:
        return frames[0]
    head = bytes([len(frames) - 1])
    if lacing == 1:
        head += b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
    elif lacing == 3:
        head += _size(len(frames[0]))
        for a, b in zip(frames, frames[1:-1]):
            diff = len(b) - len(a)
            width = next(w for w in range(1, 9) if abs(diff) < (1 << 7 * w - 1) - 1)
            head += _size(diff + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def write(payload: bytes) -> bytes:
    """A Matroska file with one mono PCM track of 8-bit samples whose frames, in order, are ``payload``."""
    head = _element(EBML, _element(DOCTYPE, b"matroska"))
    audio = _element(AUDIO, _element(RATE, struct.pack(">d", HERTZ)) + _uint(CHANNELS, 1) + _uint(DEPTH, 8))
    parts = [_element(INFO, _uint(SCALE, 1_000_000) + _element(DURATION, struct.pack(">d", len(payload) * 1000 / HERTZ)))]
    parts.append(_element(TRACKS, _element(ENTRY, _uint(NUMBER, 1) + _uint(UID, 1) + _uint(TYPE, 2) + _element(CODEC, b"A_PCM/INT/LIT") + audio)))
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    blocks, i = [], 0
    while i < len(frames):
        lacing = len(blocks) % 4
        take = frames[i : i + (LACED if lacing else 1)]
        if lacing == 2 and len(take[-1]) != len(take[0]):
            lacing = 3  # a short last frame can't be of fixed size
        blocks.append((i, take, lacing if len(take) > 1 else 0))
        i += len(take)
    place, cues = sum(map(len, parts)), []
    for c in range(0, len(blocks), CLUSTERED):
        some = blocks[c : c + CLUSTERED]
        begin = some[0][0] * FRAME * 1000 // HERTZ
        body = [_uint(TIME, begin)]
        for first, take, lacing in some:
            block = _size(1) + struct.pack(">h", first * FRAME * 1000 // HERTZ - begin)
            if lacing == 3:
                body.append(_element(GROUP, _element(BLOCK, block + bytes([lacing << 1]) + _lace(take, lacing))))
            else:
                body.append(_element(SIMPLE, block + bytes([0x80 | lacing << 1]) + _lace(take, lacing)))
        parts.append(_element(CLUSTER, b"".join(body)))
        cues.append(_element(POINT, _uint(CUE_TIME, begin) + _element(POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, place))))
        place += len(parts[-1])
    parts.append(_element(CUES, b"".join(cues)))
    return head + _element(SEGMENT, b"".join(parts))


PACKETS = "track long, time_ns long, offset long, size long, is_key boolean, lacing string"


def packet_table(files: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """A row for every frame of the Matroska bytes in ``content``: the key and PACKETS. A laced block's frames share its time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, raw in zip(batch.column(0), batch.column(1)):
                media = parse(raw.as_py() or b"")
                for i in range(0, len(media.packets), 10_000):
                    rows = media.packets[i : i + 10_000]
                    cols = [pa.array([k.as_py()] * len(rows), k.type), *(pa.array(c) for c in zip(*((t, at * media.scale, o, s, f, x) for t, at, o, s, f, x in rows)))]
                    yield pa.RecordBatch.from_arrays(cols, ["file", "track", "time_ns", "offset", "size", "is_key", "lacing"])

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, content).mapInArrow(run, f"file {kind}, {PACKETS}").withColumnRenamed("file", key)


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, content): every text as UTF-8, padded with zero bytes to a positive multiple of 64, in a Matroska file. Null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([write(padded(x)) for x in part.column(1).to_pylist()], pa.binary())], ["file", "content"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"file {kind}, content binary").withColumnRenamed("file", key)


def padded(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def digest(raw: bytes, n: int) -> tuple:
    """The values of a stored file: sizes and digests of the payload read back and of the file, and features of its packet table."""
    media = parse(raw)
    payload = b"".join(raw[o : o + s] for _, _, o, s, _, _ in media.packets)
    last = media.packets[-1] if media.packets else (0, 0, 0, 0, False, "none")
    laced = [sum(p[5] == x for p in media.packets) for x in LACINGS]
    feature = f"tracks={len(media.tracks)};clusters={len(media.clusters)};cues={len(media.cues)};packets={len(media.packets)};keys={sum(p[4] for p in media.packets)};" + ";".join(f"{x}={c}" for x, c in zip(LACINGS, laced)) + f";last_ns={last[1] * media.scale};first_byte={media.packets[0][2] if media.packets else 0};last_byte={last[2] + last[3]};mean={sum(payload) / max(1, len(payload)):.4f}"
    return n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), feature


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every text of documents stored as Matroska, read back by way of its packet table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in DIGEST.split(", ")]
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                rows.append(digest(write(padded(text)), len(text.encode())))
            cols = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, DIGEST)

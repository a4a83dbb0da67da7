"""Media columns in Matroska: texts' bytes as 8-bit PCM in clusters of laced blocks, and a parser to packet tables.

:func:`mux` writes one mono track of unsigned 8-bit samples at 8 kHz, which keeps any byte as it is. :func:`parse` reads
any file of EBML elements: identifiers and sizes of variable length, unknown sizes, clusters with simple blocks and
block groups, frames without lacing or with Xiph, fixed-size or EBML lacing, and cues. Its packets carry track, time
in milliseconds, byte range, key flag and lacing.

Defined results: a null text has an empty payload, like an empty one; equal texts give equal files; repeated rows are
treated alike; an empty table gives an empty result. A file cut short, or with a size that leads out of its
parent, raises ``ValueError`` in :func:`parse`; :func:`packet_table` gives such a row, and a null, no packets.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element identifiers of the format (fixed values).
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH, DEFAULT_DURATION = 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP_LEVEL = {0x114D9B74, INFO, TRACKS, CLUSTER, CUES, 0x1941A469, 0x1043A770, 0x1254C367}
LACINGS = ("none", "xiph", "fixed", "ebml")

UNIT, FRAMES, BLOCKS, RATE = 192, 8, 32, 8000


@dataclass(frozen=True)
class Packet:
    track: int
    time_ms: float
    start: int
    size: int
    key: bool
    lacing: str


@dataclass
class Media:
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[Packet] = field(default_factory=list)
    cues: list[tuple[int, float, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    duration_ms: float = 0.0


def _size(n: int) -> bytes:
    width = 1
    while n >= (1 << 7 * width) - 1:
        width += 1
    return ((1 << 7 * width) | n).to_bytes(width, "big")


def _element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def _uint(ident: int, n: int) -> bytes:
    return _element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _laced(frames: list[bytes], lacing: int) -> bytes:
    """Head and frames of a block's data in one of the four lacings."""
    if lacing == 0:
        return frames[0]
    head = bytes([len(frames) - 1])
    if lacing == 1:
        head += b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
    elif lacing == 3:
        head += _size(len(frames[0]))
        for a, b in zip(frames, frames[1:-1], strict=False):
            step, width = len(b) - len(a), 1
            while not -(1 << 7 * width - 1) < step < (1 << 7 * width - 1):
                width += 1
            head += ((1 << 7 * width) | (step + (1 << 7 * width - 1) - 1)).to_bytes(width, "big")
    return head + b"".join(frames)


@lru_cache(maxsize=1)
def _prologue() -> tuple[bytes, bytes]:
    head = _element(EBML, _uint(EBML_VERSION, 1) + _uint(EBML_READ_VERSION, 1) + _uint(EBML_MAX_ID, 4) + _uint(EBML_MAX_SIZE, 8) + _element(DOC_TYPE, b"matroska") + _uint(DOC_TYPE_VERSION, 4) + _uint(DOC_TYPE_READ_VERSION, 2))
    audio = _element(AUDIO, _element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))
    entry = _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _uint(FLAG_LACING, 1) + _element(CODEC_ID, b"A_PCM/INT/LIT") + audio
    return head, _element(TRACKS, _element(TRACK_ENTRY, entry))


def mux(payload: bytes) -> bytes:
    """A file that holds ``payload``, whose length is a positive multiple of :data:`UNIT`, in turn with each lacing."""
    per_ms = RATE // 1000
    head, tracks = _prologue()
    info = _element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + _element(DURATION, struct.pack(">d", len(payload) / per_ms)) + _element(MUXING_APP, b"heddle") + _element(WRITING_APP, b"heddle"))
    parts, cues, at = [info, tracks], [], len(info) + len(tracks)
    step, span = UNIT * FRAMES, UNIT * FRAMES * BLOCKS
    for begin in range(0, len(payload), span):
        body = [_uint(TIMESTAMP, begin // per_ms)]
        for i, first in enumerate(range(begin, min(begin + span, len(payload)), step)):
            data = payload[first : first + step]
            lacing = 0 if len(data) == UNIT else (2, 3, 1)[i % 3]
            # Pairs of frames share 2 * UNIT bytes evenly, or as 5 to 7 where sizes can differ.
            small = UNIT if lacing in (0, 2) or len(data) // UNIT % 2 else UNIT * 5 // 6
            sizes = [small, 2 * UNIT - small] * (len(data) // UNIT // 2) + [UNIT] * (len(data) // UNIT % 2)
            frames, k = [], 0
            for n in sizes:
                frames.append(data[k : k + n])
                k += n
            body.append(_element(SIMPLE_BLOCK, b"\x81" + ((first - begin) // per_ms).to_bytes(2, "big") + bytes([0x80 | lacing << 1]) + _laced(frames, lacing)))
        cluster = _element(CLUSTER, b"".join(body))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, begin // per_ms) + _element(CUE_TRACK_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER_POSITION, at))))
        parts.append(cluster)
        at += len(cluster)
    return head + _element(SEGMENT, b"".join(parts) + _element(CUES, b"".join(cues)))


def _vint(data: bytes, at: int, end: int, keep_marker: bool) -> tuple[int, int, int]:
    """Value, its width and the place after it."""
    if at >= end or data[at] == 0:
        raise ValueError(f"no variable-length integer at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise ValueError(f"the integer at byte {at} is cut short")
    n = int.from_bytes(data[at : at + width], "big")
    return (n if keep_marker else n & ((1 << 7 * width) - 1)), width, at + width


def _children(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """Identifier, begin, body and end of each element; one of unknown size ends before a top-level element or with its parent."""
    while at < end:
        begin = at
        ident, _, at = _vint(data, at, end, True)
        n, width, at = _vint(data, at, end, False)
        if n == (1 << 7 * width) - 1:
            last = _unknown_end(data, at, end, ident)
        else:
            last = at + n
        if last > end:
            raise ValueError(f"the element at byte {begin} leads out of its parent")
        yield ident, begin, at, last
        at = last


def _unknown_end(data: bytes, at: int, end: int, ident: int) -> int:
    if ident == SEGMENT:
        return end
    while at < end:
        begin = at
        child, _, at = _vint(data, at, end, True)
        if child in TOP_LEVEL:
            return begin
        n, _, at = _vint(data, at, end, False)
        at += n
    return end


def _frame_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    if lacing == 0:
        return [end - at], at
    if at >= end:
        raise ValueError("a laced block is cut short")
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == 1:
        for _ in range(count - 1):
            n = 0
            while True:
                if at >= end:
                    raise ValueError("a Xiph lace is cut short")
                n += data[at]
                at += 1
                if data[at - 1] != 255:
                    break
            sizes.append(n)
    elif lacing == 3:
        for i in range(count - 1):
            n, width, at = _vint(data, at, end, False)
            sizes.append(n if i == 0 else sizes[-1] + n - ((1 << 7 * width - 1) - 1))
    else:
        if (end - at) % count:
            raise ValueError("frames of a fixed-size lace differ")
        return [(end - at) // count] * count, at
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("a lace holds more than its block")
    return sizes, at


def parse(data: bytes) -> Media:
    """Tracks, packets in file order, cues and cluster places of a file."""
    out, scale = Media(), 1_000_000
    top = list(_children(data, 0, len(data)))
    if not top or top[0][0] != EBML:
        raise ValueError("no EBML header")
    for ident, _, body, last in top:
        if ident != SEGMENT:
            continue
        segment = body
        for ident, begin, body, last in _children(data, segment, last):  # noqa: B020
            if ident == INFO:
                for k, _, a, b in _children(data, body, last):
                    if k == TIMESTAMP_SCALE:
                        scale = int.from_bytes(data[a:b], "big")
                    elif k == DURATION:
                        out.duration_ms = struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0] * scale / 1e6
            elif ident == TRACKS:
                for k, _, a, b in _children(data, body, last):
                    if k == TRACK_ENTRY:
                        _track(data, a, b, out)
            elif ident == CLUSTER:
                out.clusters.append(begin - segment)
                _cluster(data, body, last, scale, out)
            elif ident == CUES:
                for k, _, a, b in _children(data, body, last):
                    if k == CUE_POINT:
                        _cue(data, a, b, scale, out)
    return out


def _track(data: bytes, at: int, end: int, out: Media) -> None:
    got: dict = {"rate": 8000.0, "channels": 1, "bits": 0, "codec": "", "type": 0, "frame_ms": 0.0}
    number = 0
    for k, _, a, b in _children(data, at, end):
        if k == TRACK_NUMBER:
            number = int.from_bytes(data[a:b], "big")
        elif k == TRACK_TYPE:
            got["type"] = int.from_bytes(data[a:b], "big")
        elif k == CODEC_ID:
            got["codec"] = data[a:b].rstrip(b"\0").decode("ascii", "replace")
        elif k == DEFAULT_DURATION:
            got["frame_ms"] = int.from_bytes(data[a:b], "big") / 1e6
        elif k == AUDIO:
            for k2, _, c, d in _children(data, a, b):
                if k2 == SAMPLING_FREQUENCY:
                    got["rate"] = struct.unpack(">d" if d - c == 8 else ">f", data[c:d])[0]
                elif k2 in (CHANNELS, BIT_DEPTH):
                    got["channels" if k2 == CHANNELS else "bits"] = int.from_bytes(data[c:d], "big")
    out.tracks[number] = got


def _cluster(data: bytes, at: int, end: int, scale: int, out: Media) -> None:
    time = 0
    for k, _, a, b in _children(data, at, end):
        if k == TIMESTAMP:
            time = int.from_bytes(data[a:b], "big")
        elif k == SIMPLE_BLOCK:
            _block(data, a, b, time, scale, out, True, None)
        elif k == BLOCK_GROUP:
            inner = list(_children(data, a, b))
            lasts = next((int.from_bytes(data[c:d], "big") for x, _, c, d in inner if x == BLOCK_DURATION), None)
            for x, _, c, d in inner:
                if x == BLOCK:
                    _block(data, c, d, time, scale, out, False, lasts)


def _block(data: bytes, at: int, end: int, time: int, scale: int, out: Media, simple: bool, lasts: int | None) -> None:
    track, _, at = _vint(data, at, end, False)
    if at + 3 > end:
        raise ValueError("a block is cut short")
    (offset,), flags = struct.unpack(">h", data[at : at + 2]), data[at + 2]
    lacing = flags >> 1 & 3
    sizes, at = _frame_sizes(data, at + 3, end, lacing)
    when = (time + offset) * scale / 1e6
    about = out.tracks.get(track, {})
    per_ms = about.get("rate", 0) * about.get("channels", 1) * about.get("bits", 0) / 8000 if about.get("codec", "").startswith("A_PCM") else 0
    for n in sizes:
        out.packets.append(Packet(track, when, at, n, simple and bool(flags & 0x80), LACINGS[lacing]))
        when += n / per_ms if per_ms else lasts * scale / 1e6 / len(sizes) if lasts else about.get("frame_ms", 0)
        at += n


def _cue(data: bytes, at: int, end: int, scale: int, out: Media) -> None:
    time = 0
    for k, _, a, b in _children(data, at, end):
        if k == CUE_TIME:
            time = int.from_bytes(data[a:b], "big")
        elif k == CUE_TRACK_POSITIONS:
            got = {x: int.from_bytes(data[c:d], "big") for x, _, c, d in _children(data, a, b)}
            out.cues.append((got.get(CUE_TRACK, 0), time * scale / 1e6, got.get(CUE_CLUSTER_POSITION, 0)))


def padded(text: str | None) -> tuple[bytes, int]:
    """A text's bytes, with spaces up to a positive multiple of :data:`UNIT`, and their number before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b" "), len(raw)


def store(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key, ``n_bytes`` and ``media``, the file that holds the text's bytes."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 500):
                pdf = whole.iloc[at : at + 500]
                got = [padded(t) for t in pdf["_text"]]
                yield pd.DataFrame({"_key": pdf["_key"], "n_bytes": [n for _, n in got], "media": [mux(p) for p, _ in got]})

    return docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInPandas(run, f"_key {kind}, n_bytes long, media binary").withColumnRenamed("_key", key)


def packet_table(media: DataFrame, *, key: str = "doc_id", column: str = "media") -> DataFrame:
    """One row a packet: the key, ``packet`` (its number), ``track``, ``time_ms``, ``start``, ``size``, ``key_frame``, ``lacing``."""
    kind = media.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, data in zip(pdf["_key"], pdf["_media"], strict=True):
                try:
                    got = parse(data).packets if data is not None else []
                except ValueError:
                    got = []
                yield pd.DataFrame({"_key": pd.Series([k] * len(got), dtype=pdf["_key"].dtype), "packet": range(len(got)), "track": [p.track for p in got], "time_ms": [p.time_ms for p in got], "start": [p.start for p in got], "size": [p.size for p in got], "key_frame": [p.key for p in got], "lacing": [p.lacing for p in got]})

    schema = f"_key {kind}, packet long, track long, time_ms double, start long, size long, key_frame boolean, lacing string"
    return media.select(F.col(key).alias("_key"), F.col(column).alias("_media")).mapInPandas(run, schema).withColumnRenamed("_key", key)


def describe(data: bytes) -> tuple[bytes, str]:
    """The payload read back through the packets' byte ranges, and a file's features as one string."""
    m = parse(data)
    laced = {k: 0 for k in LACINGS}
    for p in m.packets:
        laced[p.lacing] += 1
    hit = sum(c[2] in set(m.clusters) for c in m.cues)
    feature = f"tracks={len(m.tracks)};packets={len(m.packets)};clusters={len(m.clusters)};cues={hit};ms={m.duration_ms:g};" + ",".join(f"{k}={laced[k]}" for k in LACINGS)
    return b"".join([data[p.start : p.start + p.size] for p in m.packets]), feature


def digests(stored: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """What the stored files hold, read back through the parser."""
    kind = stored.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, n, data in zip(pdf["_key"], pdf["n_bytes"], pdf["media"], strict=True):
                payload, feature = describe(data)
                rows.append((k, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            yield pd.DataFrame(rows, columns=["_key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = f"_key {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.withColumnRenamed(key, "_key").mapInPandas(run, schema).withColumnRenamed("_key", key)

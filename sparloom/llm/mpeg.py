"""MPEG audio columns: frames found again by resynchronising, tags, variable-bitrate tables, checksums, exact durations, seek offsets.

encode() stores bytes as the ancillary data of silent layer III frames (the side
information says that no main data follow), so that any bytes come back exactly;
parse() reads any stream of MPEG-1, -2 or -2.5 frames of layers I to III.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import as_bytes, column, out_batch, slices, stage

# Fixed values of the MPEG audio standards: kbit/s by (MPEG-1, layer), Hz by version, samples of a frame.
_BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
#: Bytes after a free-format header in which the next one is looked for.
FREE_BYTES = 1 << 14
_VERSIONS = {3: "1", 2: "2", 0: "2.5"}


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    protected: bool
    kbps: int
    rate: int
    mono: bool
    size: int
    samples: int
    side: int  # bytes of side information (layer III)


def header(word: bytes, free: int = 0) -> Header | None:
    """A frame's header, or None if these four bytes are none; free: the size without padding of free-format frames, which are none without it."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer = word[1] >> 3 & 3, 4 - (word[1] >> 1 & 3)
    bitrate, rate = word[2] >> 4, word[2] >> 2 & 3
    if version == 1 or layer == 4 or bitrate == 15 or (bitrate == 0 and not free) or rate == 3 or word[3] & 3 == 2:
        return None
    one, kbps, hz = version == 3, _BITRATES[version == 3, layer][bitrate], _RATES[version][rate]
    samples = 384 if layer == 1 else 576 if layer == 3 and not one else 1152
    pad = word[2] >> 1 & 1
    size = (12 * kbps * 1000 // hz + pad) * 4 if layer == 1 else samples // 8 * kbps * 1000 // hz + pad
    if bitrate == 0:
        size = free + pad * (4 if layer == 1 else 1)
        kbps = round(free * 8 * hz / samples / 1000)
    mono = word[3] >> 6 == 3
    side = ((17 if mono else 32) if one else (9 if mono else 17)) if layer == 3 else 0
    return Header(version, layer, not word[1] & 1, kbps, hz, mono, size, samples, side)


@dataclass
class Stream:
    tags: dict[str, str] = field(default_factory=dict)
    headers: list[Header] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)
    vbr: str | None = None  # Xing, Info or VBRI
    vbr_frames: int | None = None
    vbr_bytes: int | None = None
    toc: bytes | None = None  # Xing's, or VBRI's in the same form
    skipped: int = 0  # bytes that belong to no frame or tag


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _id3v2(data: bytes, tags: dict[str, str]) -> int:
    """Reads text frames of a leading ID3v2 tag; where the audio may begin."""
    if len(data) < 10 or data[:3] != b"ID3" or max(data[6:10]) > 127:
        return 0
    end, at = min(len(data), 10 + _syncsafe(data[6:10])), 10
    while at + 10 <= end and data[at : at + 4].isalnum():
        size = _syncsafe(data[at + 4 : at + 8]) if data[3] >= 4 else int.from_bytes(data[at + 4 : at + 8])
        name, body = data[at : at + 4].decode("latin-1"), data[at + 10 : min(end, at + 10 + size)]
        if name[0] == "T" and body:
            text = body[1:].decode({1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1"), "replace").rstrip("\0")
            key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
            tags[key] = value
        at += 10 + size
    return end + (10 if data[5] & 0x10 else 0)


def _tail(data: bytes, start: int, tags: dict[str, str]) -> int:
    """Reads trailing ID3v1 and APE tags; where the audio ends at the latest."""
    end = len(data)
    if end - start >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        for key, lo, hi in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
            if value := data[end + lo : end + hi].split(b"\0")[0].decode("latin-1").strip():
                tags.setdefault(key, value)
    if end - start >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        size, items, flags = struct.unpack("<III", data[end - 20 : end - 8])
        begin = max(start, end - size)
        at = begin
        for _ in range(items):
            if at + 8 >= end - 32 or (stop := data.find(b"\0", at + 8, end)) < 0:
                break
            n = int.from_bytes(data[at : at + 4], "little")
            tags[data[at + 8 : stop].decode("latin-1")] = data[stop + 1 : stop + 1 + n].decode("utf-8", "replace")
            at = stop + 1 + n
        end = max(start, begin - (32 if flags >> 31 else 0))
    return end


def _free_size(data: bytes, at: int, end: int) -> int:
    """The size without padding of the free-format frames that begin at `at`: the first distance at which two more frames of the kind, or the audio's end, follow; else 0."""
    word = data[at : at + 4]
    if len(word) < 4 or word[2] >> 4 or header(word, 1) is None:
        return 0
    slot = 4 if header(word, 1).layer == 1 else 1
    same = lambda p: p == end or (data[p : p + 2] == word[:2] and p + 4 <= end and (data[p + 2] ^ word[2]) & 0xFC == 0)
    p = data.find(word[:2], at + 24, min(end, at + FREE_BYTES))
    while p >= 0:
        size = p - at - (word[2] >> 1 & 1) * slot
        if p + 4 <= end and same(p) and same(p + size + (data[p + 2] >> 1 & 1) * slot):
            return size
        p = data.find(word[:2], p + 1, min(end, at + FREE_BYTES))
    return 0


_SYNC = re.compile(b"\xff[\xe0-\xff]")


def parse(data: bytes) -> Stream:
    """All frames. A frame counts if its header is sound and another of its kind, or the audio's end, follows it; else the search goes on at the next sync word."""
    out = Stream()
    at = _id3v2(data, out.tags)
    end = _tail(data, at, out.tags)
    known: dict[bytes, Header | None] = {}
    kind, free = None, 0
    while at + 4 <= end:
        word = data[at : at + 4]
        if not free and word[0] == 0xFF and word[2] < 0x10 and kind is None and (free := _free_size(data, at, end)):
            known.clear()
        if word not in known:
            known[word] = header(word, free)
        h = known[word]
        if h is not None and at + h.size <= end and (kind is None or kind == (h.version, h.layer, h.rate)):
            follows = data[at + h.size : at + h.size + 4]
            if follows not in known:
                known[follows] = header(follows, free)
            n = known[follows]
            if at + h.size == end or (n is not None and (n.version, n.layer, n.rate) == (h.version, h.layer, h.rate)):
                kind = (h.version, h.layer, h.rate)
                if not out.headers and out.vbr is None and _vbr(data[at : at + h.size], h, out):
                    pass  # the table's frame isn't audio
                else:
                    out.headers.append(h)
                    out.offsets.append(at)
                at += h.size
                continue
        found = _SYNC.search(data, at + 1, end)
        after = found.start() if found else end
        out.skipped += after - at
        at = after
    out.skipped += max(0, end - at)
    return out


def _vbr(frame: bytes, h: Header, out: Stream) -> bool:
    at = 4 + 2 * h.protected + h.side
    if frame[at : at + 4] in (b"Xing", b"Info") and len(frame) >= at + 8:
        out.vbr = frame[at : at + 4].decode()
        flags, at = int.from_bytes(frame[at + 4 : at + 8]), at + 8
        if flags & 1:
            out.vbr_frames, at = int.from_bytes(frame[at : at + 4]), at + 4
        if flags & 2:
            out.vbr_bytes, at = int.from_bytes(frame[at : at + 4]), at + 4
        if flags & 4:
            out.toc = frame[at : at + 100]
        return True
    if frame[36:40] == b"VBRI" and len(frame) >= 54:
        out.vbr, out.vbr_bytes, out.vbr_frames = "VBRI", int.from_bytes(frame[46:50]), int.from_bytes(frame[50:54])
        entries, scale, width = (int.from_bytes(frame[i : i + 2]) for i in (54, 56, 58))
        if entries and 1 <= width <= 4 and len(frame) >= 62 + entries * width:
            steps = np.array([int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width]) * scale for i in range(entries)], np.float64)
            ends = np.concatenate([[0], np.cumsum(steps)])
            at = np.interp(np.arange(100) * entries / 100, np.arange(entries + 1), ends)
            out.toc = bytes(np.minimum(255, at * 256 // max(ends[-1], 1)).astype(np.uint8))
        return True
    return False


def _crc_table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        x = np.where(x & 0x8000, x << 1 ^ 0x8005, x << 1) & 0xFFFF
    return x


_CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """The standard's CRC-16 of each row of bytes."""
    crc = np.full(len(rows), 0xFFFF, np.uint32)
    for k in range(rows.shape[1]):
        crc = (crc << 8 & 0xFFFF) ^ _CRC[crc >> 8 ^ rows[:, k]]
    return crc


def _allocation_bits(h: Header) -> list[int]:
    """Bits of each subband's allocation in layer II, by the standards' tables."""
    each = h.kbps / (1 if h.mono else 2)
    if h.version != 3:
        return [4] * 4 + [3] * 7 + [2] * 19
    if each <= 48:
        return [4] * 2 + [3] * (10 if h.rate == 32000 else 6)
    return [4] * 11 + [3] * 12 + [2] * (4 if h.rate == 48000 or each <= 80 else 7)


def _covered_bits(frame: bytes, h: Header) -> int:
    """Bits after the checksum that it covers in layers I and II: allocations, and layer II's scale factor selections."""
    channels = 1 if h.mono else 2
    bound = 4 * (frame[3] >> 4 & 3) + 4 if frame[3] >> 6 == 1 else 32
    if h.layer == 1:
        return 4 * (32 if h.mono else 32 + bound)
    bits, at, selections = int.from_bytes(frame[6:54].ljust(48, b"\0")), 0, 0
    for band, n in enumerate(_allocation_bits(h)):
        for _ in range(channels if band < bound else 1):
            used = bits >> 384 - at - n & (1 << n) - 1
            selections += 2 * bool(used) * (channels if band >= bound else 1)
            at += n
    return at + selections


def _crc_bits(data: bytes, n: int) -> int:
    """The CRC-16 of data's first n bits."""
    crc = int(crc16(np.frombuffer(data[: n // 8], np.uint8)[None])[0])
    for k in range(n // 8 * 8, n):
        high = crc >> 15 ^ data[k // 8] >> 7 - k % 8 & 1
        crc = crc << 1 & 0xFFFF ^ (0x8005 if high else 0)
    return crc


def verify(items: list[tuple[bytes, Stream]]) -> list[tuple[int, int]]:
    """(sound, unsound) checksums of each stream's protected frames, those of layer III of all streams at once."""
    out = np.zeros((len(items), 2), np.int64)
    groups: dict[int, list[tuple[int, bytes, int]]] = {}
    for i, (data, s) in enumerate(items):
        for h, at in zip(s.headers, s.offsets):
            if h.protected and h.layer < 3:
                frame = data[at : at + h.size]
                n = _covered_bits(frame, h)
                covered = frame[2:4] + frame[6:]
                out[i, int(len(covered) * 8 < n + 16 or _crc_bits(covered, n + 16) != int.from_bytes(frame[4:6]))] += 1
            elif h.protected:
                covered = data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side]
                groups.setdefault(h.side, []).append((i, covered, data[at + 4] << 8 | data[at + 5]))
    for side, frames in groups.items():
        crc = crc16(np.frombuffer(b"".join(f[1] for f in frames), np.uint8).reshape(-1, side + 2))
        good = crc == np.array([f[2] for f in frames], np.uint32)
        owner = np.array([f[0] for f in frames])
        out[:, 0] += np.bincount(owner[good], minlength=len(items))
        out[:, 1] += np.bincount(owner[~good], minlength=len(items))
    return [tuple(x) for x in out.tolist()]


# The encoder's frames: MPEG-1 layer III, 32 kHz, stereo, protected; sizes by bitrate index without padding.
_SIDE = 32
_HEADS = [bytes((0xFF, 0xFA, k << 4 | 2 << 2, 0x00)) for k in range(1, 15)]
_SIZES = [header(h).size for h in _HEADS]
_STARTS = [h + int(c).to_bytes(2) + bytes(_SIDE) for h, c in zip(_HEADS, crc16(np.array([list(h[2:4]) + [0] * _SIDE for h in _HEADS], np.uint8)))]
_BODY = _SIZES[-1] - len(_STARTS[-1])
#: Empty APE and ID3v1 tags, so that no payload byte stands where a reader looks for one.
_TRAILER = b"APETAGEX" + struct.pack("<IIII", 2000, 32, 0, 0) + bytes(8) + b"TAG" + bytes(125)


def encode(payload: bytes) -> bytes:
    """An ID3v2 tag with the payload's length, a Xing frame, and frames whose ancillary data are the payload; the last frame takes the lowest bitrate that holds the rest. Empty tags end it."""
    text = b"\0payload_bytes\0" + str(len(payload)).encode()
    frame = b"TXXX" + len(text).to_bytes(4) + b"\0\0" + text  # short enough for its syncsafe size to be a plain one
    tag = b"ID3\x04\0\0" + len(frame).to_bytes(4) + frame
    full, rest = divmod(len(payload), _BODY)
    parts = [_STARTS[-1] + payload[i * _BODY : (i + 1) * _BODY] for i in range(full)]
    if rest:
        k = next(i for i, s in enumerate(_SIZES) if s - len(_STARTS[i]) >= rest)
        parts.append(_STARTS[k] + payload[full * _BODY :] + bytes(_SIZES[k] - len(_STARTS[k]) - rest))
    audio = b"".join(parts)
    total = len(audio)
    toc = bytes(min(255, (i * len(parts) // 100) * len(parts[0]) * 256 // total) for i in range(100)) if parts else bytes(100)
    xing = b"Xing" + (7).to_bytes(4) + len(parts).to_bytes(4) + total.to_bytes(4) + toc
    k = next(i for i, s in enumerate(_SIZES) if s >= len(_STARTS[i]) + len(xing))
    return tag + _STARTS[k] + xing + bytes(_SIZES[k] - len(_STARTS[k]) - len(xing)) + audio + _TRAILER


def decode(data: bytes, s: Stream) -> bytes:
    """The payload that encode() stored."""
    body = b"".join(data[at + 6 + h.side : at + h.size] for h, at in zip(s.headers, s.offsets))
    n = int(s.tags["payload_bytes"])
    if n > len(body):
        raise ValueError(f"{len(body)} of {n} payload bytes found")
    return body[:n]


def to_media(docs: DataFrame, text_col: str = "text", media_col: str = "media", block: int = 64) -> DataFrame:
    """docs with n_bytes and media (binary) in place of the text: its UTF-8, zero-filled to a positive multiple of `block`. Null is empty."""
    carry = [c for c in docs.columns if c not in (text_col, media_col, "n_bytes")]

    def run(batches):
        for batch in slices(batches, text_col):
            texts = as_bytes(batch, text_col)
            stored = [encode(t + bytes(-len(t) % block if t else block)) for t in texts]
            yield out_batch(batch, carry, {"n_bytes": pa.array([len(t) for t in texts], pa.int64()), media_col: pa.array(stored, pa.binary())})

    return docs.mapInArrow(run, T.StructType([docs.schema[c] for c in carry] + [T.StructField("n_bytes", T.LongType()), T.StructField(media_col, T.BinaryType())]))


_FEATURES = pa.schema([
    ("tags", pa.map_(pa.string(), pa.string())), ("version", pa.string()), ("layer", pa.int32()), ("rate", pa.int32()), ("channels", pa.int32()), ("frames", pa.int64()), ("samples", pa.int64()),
    ("seconds", pa.float64()), ("vbr", pa.string()), ("vbr_frames", pa.int64()), ("toc", pa.binary()), ("crc_good", pa.int64()), ("crc_bad", pa.int64()), ("skipped", pa.int64()), ("offsets", pa.list_(pa.int64())),
])
FEATURES_DDL = "tags map<string,string>, version string, layer int, rate int, channels int, frames long, samples long, seconds double, vbr string, vbr_frames long, toc binary, crc_good long, crc_bad long, skipped long, offsets array<long>"


def features(data: list[bytes]) -> tuple[list[Stream], pa.RecordBatch]:
    streams = [parse(d) for d in data]
    rows = []
    for s, (good, bad) in zip(streams, verify(list(zip(data, streams)))):
        h = s.headers[0] if s.headers else None
        samples = sum(x.samples for x in s.headers)
        rows.append({
            "tags": list(s.tags.items()), "version": h and _VERSIONS[h.version], "layer": h and h.layer, "rate": h and h.rate, "channels": h and 2 - h.mono, "frames": len(s.headers), "samples": samples,
            "seconds": samples / h.rate if h else 0.0, "vbr": s.vbr, "vbr_frames": s.vbr_frames, "toc": s.toc, "crc_good": good, "crc_bad": bad, "skipped": s.skipped, "offsets": s.offsets,
        })
    return streams, pa.RecordBatch.from_pylist(rows, _FEATURES)


def media_features(media: DataFrame, media_col: str = "media") -> DataFrame:
    """media with FEATURES_DDL's columns in place of the bytes: exact durations are samples / rate, offsets are the frames' first bytes.

    Null or unrecognisable bytes: no frames, null version. Input columns of these names are replaced.
    """
    carry = [c for c in media.columns if c not in (media_col, *_FEATURES.names)]
    schema = T.StructType([media.schema[c] for c in carry] + T.StructType.fromDDL(FEATURES_DDL).fields)

    def run(batches):
        for batch in slices(batches, media_col):
            _, found = features([x or b"" for x in column(batch, media_col).to_pylist()])
            yield out_batch(batch, carry, dict(zip(_FEATURES.names, found.columns)))

    return media.mapInArrow(run, schema)


def _digest(media: DataFrame, media_col: str = "media") -> DataFrame:
    """Reads stored media back: payload digests and a line of features for each row."""
    out = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    carry = [c for c in media.columns if c != media_col]

    def run(batches):
        for batch in slices(batches, media_col):
            data = column(batch, media_col).to_pylist()
            streams, found = features(data)
            payloads = [decode(d, s) for d, s in zip(data, streams)]
            lines = [
                f"mpeg{r['version']}-l{r['layer']};{r['rate']}Hz;ch={r['channels']};frames={r['frames']};samples={r['samples']};vbr={r['vbr']}:{r['vbr_frames']};crc={r['crc_good']}/{r['crc_bad']};skipped={r['skipped']};seek={hashlib.sha256(','.join(map(str, r['offsets'])).encode()).hexdigest()[:16]}"
                for r in found.to_pylist()
            ]
            values = ([len(p) for p in payloads], [hashlib.sha256(p).hexdigest() for p in payloads], [zlib.crc32(p[-64:]) for p in payloads], [len(d) for d in data], [hashlib.sha256(d).hexdigest() for d in data], lines)
            yield out_batch(batch, carry, {n: pa.array(v, t) for (n, t), v in zip(out, values)})

    schema = T.StructType([media.schema[c] for c in carry] + T.StructType.fromDDL("payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").fields)
    return media.mapInArrow(run, schema)


def op2_mpeg_audio(spark, sf_dir: str) -> DataFrame:
    """Every text of documents stored as an MPEG stream, read back, with its checksums and features; see to_media().

    Null and empty texts are 64 bytes of padding. Repeated rows: one row each, with
    equal values; a null doc_id is carried. Empty table: no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return _digest(stage(to_media(docs)))

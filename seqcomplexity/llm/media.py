"""MPEG audio columns: store bytes losslessly as audio frames, and scan such streams frame by frame.

A stream is ``[ID3v2 tag] [Xing frame] [data frames] [ID3v1 tag]``. Data frames are MPEG-1 Layer III, mono, 32 kHz,
with checksum and all-zero side information, so that players hear silence; the stored bytes are the frames'
ancillary data. Full frames run at 320 kbit/s and the last at the lowest rate that holds the rest, so the stream
is of variable bitrate and carries a Xing table.

The scanner takes any MPEG-1, 2 or 2.5 stream of Layers I to III. It skips tags, resynchronises on damaged or foreign
bytes (a header counts only if another consistent header, a tag or the end follows its frame), reads Xing, Info and VBRI
tables, verifies checksums where the protected bits have a fixed length (Layers I and III), and returns exact durations in
samples and the offset of every frame.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, utf8

# Fixed values of the MPEG audio standards: kbit/s by index from 1, samples a second of version 1.
_RATES_V1 = {
    1: (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    2: (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    3: (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
}
_RATES_V2 = {
    1: (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    2: (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    3: (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_HERTZ = (44100, 48000, 32000)

_UNIT = 64
_SIDE = 17
_HEAD = 4 + 2 + _SIDE
_FULL = 14  # index of 320 kbit/s


class Frame(NamedTuple):
    version: int  # 1, 2, or 3 for 2.5
    layer: int
    protected: bool
    kbps: int
    hertz: int
    length: int
    samples: int
    mono: bool
    side: int  # bytes of side information in Layer III
    checked: int  # bytes after the checksum that it covers; -1 if their number isn't fixed


@lru_cache(maxsize=4096)
def frame_header(head: bytes) -> Frame | None:
    """Decode four bytes, or None if they are no header of a frame with a known length."""
    if len(head) < 4 or head[0] != 0xFF or head[1] & 0xE0 != 0xE0:
        return None
    version = {3: 1, 2: 2, 0: 3}.get(head[1] >> 3 & 3)
    layer = {3: 1, 2: 2, 1: 3}.get(head[1] >> 1 & 3)
    rate, freq, pad = head[2] >> 4, head[2] >> 2 & 3, head[2] >> 1 & 1
    if not version or not layer or not 0 < rate < 15 or freq == 3 or head[3] & 3 == 2:
        return None
    kbps = (_RATES_V1 if version == 1 else _RATES_V2)[layer][rate - 1]
    hertz = _HERTZ[freq] >> (version - 1)
    mode = head[3] >> 6
    samples = 384 if layer == 1 else 576 if layer == 3 and version > 1 else 1152
    length = (12 * kbps * 1000 // hertz + pad) * 4 if layer == 1 else samples // 8 * kbps * 1000 // hertz + pad
    side = 0 if layer < 3 else ((17 if mode == 3 else 32) if version == 1 else (9 if mode == 3 else 17))
    bound = 32 if mode != 1 else 4 * ((head[3] >> 4 & 3) + 1)
    checked = side if layer == 3 else -1 if layer == 2 else 16 if mode == 3 else (bound * 2 + 32 - bound) // 2
    return Frame(version, layer, not head[1] & 1, kbps, hertz, length, samples, mode == 3, side, checked)


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        crc = byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
        table.append(crc)
    return table


_CRC = _crc_table()


@lru_cache(maxsize=65536)
def frame_checksum(covered: bytes) -> int:
    crc = 0xFFFF
    for b in covered:
        crc = (crc << 8 & 0xFF00) ^ _CRC[crc >> 8 ^ b]
    return crc


def _prefix(rate: int) -> bytes:
    """Header, checksum and side information of our frames at a rate."""
    head = bytes([0xFF, 0xFA, rate << 4 | 2 << 2, 0xC0])
    return head + struct.pack(">H", frame_checksum(head[2:] + bytes(_SIDE))) + bytes(_SIDE)


_PREFIX = [b""] + [_prefix(rate) for rate in range(1, 15)]
_SIZE = [0] + [frame_header(p[:4]).length for p in _PREFIX[1:]]


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _text_frame(key: str, value: str) -> bytes:
    body = b"\x03" + key.encode() + b"\0" + value.encode()
    return b"TXXX" + _synchsafe(len(body)) + b"\0\0" + body


def padded(raw: bytes) -> bytes:
    """``raw`` with zeros up to a positive multiple of 64."""
    return raw + bytes(-len(raw) % _UNIT or (0 if raw else _UNIT))


def encode_audio(raw: bytes) -> bytes:
    """Store bytes as an audio stream; equal bytes give equal streams."""
    payload = padded(raw)
    room = _SIZE[_FULL] - _HEAD
    full, rest = divmod(len(payload), room)
    frames = np.zeros((full, _SIZE[_FULL]), np.uint8)
    frames[:, :_HEAD] = np.frombuffer(_PREFIX[_FULL], np.uint8)
    frames[:, _HEAD:] = np.frombuffer(payload, np.uint8, full * room).reshape(full, room)
    last = b""
    if rest:
        rate = next(r for r in range(1, 15) if _SIZE[r] - _HEAD >= rest)
        last = (_PREFIX[rate] + payload[full * room:]).ljust(_SIZE[rate], b"\0")
    count, music = full + bool(rest), full * _SIZE[_FULL] + len(last)
    starts = np.arange(count, dtype=np.int64) * _SIZE[_FULL]
    xing_rate = 5  # 64 kbit/s, 288 bytes
    total = music + _SIZE[xing_rate]
    toc = np.minimum(255, (starts[np.arange(100) * count // 100] + _SIZE[xing_rate]) * 256 // total).astype(np.uint8).tobytes()
    xing = (_PREFIX[xing_rate] + b"Xing" + struct.pack(">III", 7, count, total & 0xFFFFFFFF) + toc).ljust(_SIZE[xing_rate], b"\0")
    tag = _text_frame("text_bytes", str(len(raw))) + _text_frame("payload_bytes", str(len(payload))) + _text_frame("payload_crc32", f"{zlib.crc32(payload):08x}")
    head = b"ID3\x04\0\0" + _synchsafe(len(tag)) + tag
    return b"".join([head, xing, frames.tobytes(), last, b"TAG" + b"stored bytes".ljust(124, b"\0") + b"\xff"])


def _tags(blob: bytes) -> tuple[int, int, dict[str, str]]:
    """Start and end of the audio between tags, and user text frames of the first ID3v2 tag."""
    start, end, found = 0, len(blob), {}
    while blob[start:start + 3] == b"ID3" and len(blob) - start >= 10:
        size = 0
        for b in blob[start + 6:start + 10]:
            size = size << 7 | b & 0x7F
        at, stop = start + 10, min(start + 10 + size, end)
        while at + 10 <= stop and blob[at:at + 4].isalnum():
            raw = blob[at + 4:at + 8]
            n = int.from_bytes(raw) if blob[start + 3] < 4 else raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3]
            if blob[at:at + 4] == b"TXXX" and blob[at + 10:at + 11] == b"\x03":
                key, _, value = blob[at + 11:at + 10 + n].partition(b"\0")
                found.setdefault(key.decode("utf-8", "replace"), value.decode("utf-8", "replace"))
            at += 10 + n
        start = stop if blob[start + 5] & 0x10 == 0 else min(stop + 10, end)
    if end - start >= 128 and blob[end - 128:end - 125] == b"TAG":
        end -= 128
    return start, end, found


def _table(blob: bytes, at: int, frame: Frame) -> dict | None:
    """The variable-bitrate table in a frame: kind, frames, bytes and 100 seek points as parts of 256 (Xing) or bytes (VBRI)."""
    body = at + 4 + 2 * frame.protected + frame.side
    if frame.layer == 3 and blob[body:body + 4] in (b"Xing", b"Info") and body + 120 <= at + frame.length:
        flags = int.from_bytes(blob[body + 4:body + 8])
        out, p = {"kind": blob[body:body + 4].decode(), "frames": None, "bytes": None, "toc": []}, body + 8
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name], p = int.from_bytes(blob[p:p + 4]), p + 4
        if flags & 4:
            out["toc"] = list(blob[p:p + 100])
        return out
    body = at + 36
    if blob[body:body + 4] == b"VBRI" and body + 26 <= at + frame.length:
        size, frames, entries, scale, width = struct.unpack(">IIHHH", blob[body + 10:body + 24])
        toc = [int.from_bytes(blob[body + 26 + i * width:body + 26 + (i + 1) * width]) * scale for i in range(entries)]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": toc}
    return None


def scan_audio(blob: bytes) -> dict:
    """Everything the scanner finds in one stream; bytes without frames give zeros and empty lists."""
    start, end, tags = _tags(blob)
    at, offsets, frames, lost, resyncs, wrong, table = start, [], [], 0, 0, 0, None

    def follows(p: int, frame: Frame) -> bool:
        q = p + frame.length
        if q >= end:
            return q == end
        other = frame_header(blob[q:q + 4])
        return other is not None and (other.version, other.layer, other.hertz) == (frame.version, frame.layer, frame.hertz)

    known = None
    while at + 4 <= end:
        frame = frame_header(blob[at:at + 4])
        fits = frame is not None and at + frame.length <= end and (known is None or (frame.version, frame.layer, frame.hertz) == known)
        if not fits or not (known and not lost_here(blob, at, offsets, frames) or follows(at, frame)):
            resyncs += 1
            seek = at + 1
            while (seek := blob.find(b"\xff", seek, end)) >= 0:
                frame = frame_header(blob[seek:seek + 4])
                if frame is not None and (known is None or (frame.version, frame.layer, frame.hertz) == known) and follows(seek, frame):
                    break
                seek += 1
            if seek < 0:
                break
            lost += seek - at
            at = seek
        known = (frame.version, frame.layer, frame.hertz)
        if frame.protected and frame.checked >= 0:
            wrong += int.from_bytes(blob[at + 4:at + 6]) != frame_checksum(blob[at + 2:at + 4] + blob[at + 6:at + 6 + frame.checked])
        if table is None and not frames and (table := _table(blob, at, frame)):
            at += frame.length
            continue
        offsets.append(at)
        frames.append(frame)
        at += frame.length
    lost += max(0, end - at)
    hertz = frames[0].hertz if frames else 0
    return {"tags": tags, "table": table, "offsets": offsets, "frames": frames, "samples": sum(f.samples for f in frames), "hertz": hertz, "lost_bytes": lost, "resyncs": resyncs, "crc_errors": wrong}


def lost_here(blob: bytes, at: int, offsets: list[int], frames: list[Frame]) -> bool:
    """Whether the frame at ``at`` doesn't follow straight on the one before."""
    return not offsets or offsets[-1] + frames[-1].length != at


def stored_payload(blob: bytes, found: dict) -> bytes:
    """The bytes that ``encode_audio`` stored, with their zeros, from a scanned stream."""
    raw = b"".join([blob[o + 4 + 2 * f.protected + f.side:o + f.length] for o, f in zip(found["offsets"], found["frames"])])
    size = found["tags"].get("payload_bytes", "")
    return raw[:int(size)] if size.isdigit() else raw


_MEDIA = "doc_id long, n_bytes long, media binary"
_SCANNED = "doc_id long, n_bytes long, media binary, payload binary, n_frames long, sample_rate int, duration_samples long, duration_seconds double, average_kbps double, vbr_kind string, vbr_frames long, vbr_bytes long, vbr_toc array<int>, crc_errors long, resyncs long, lost_bytes long, frame_offsets array<long>, payload_intact boolean"


def store_audio(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: every whole text as UTF-8, zero-padded to a positive multiple of 64 bytes, as an audio stream.

    A null text is the empty text (64 zero bytes stored); a null id stays null; repeated rows are stored each;
    other columns are ignored whatever their names; an empty table gives an empty table. No shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for a, b in chunks(np.array([len(v) for v in texts.to_pylist()], np.int64)):
                raws = texts.slice(a, b - a).to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(r) for r in raws], pa.int64()), pa.array([encode_audio(r) for r in raws], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text")).mapInArrow(run, _MEDIA)


def read_audio(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Scan every stream of a column; see ``scan_audio``. ``payload`` is what ``store_audio`` stored (else all ancillary data), and
    ``payload_intact`` whether it has the stored checksum (null if there is none). A null stream is an empty one. No shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _SCANNED.split(", ")]
        for batch in batches:
            blobs = batch.column(1).cast(pa.binary())
            for a, b in chunks(np.array([len(v) for v in blobs.to_pylist()], np.int64)):
                rows: list[tuple] = []
                for doc, blob in zip(batch.column(0).slice(a, b - a).to_pylist(), blobs.slice(a, b - a).to_pylist()):
                    found = scan_audio(blob)
                    payload, tags, table = stored_payload(blob, found), found["tags"], found["table"] or {}
                    crc, seconds = tags.get("payload_crc32"), found["samples"] / found["hertz"] if found["hertz"] else 0.0
                    size = sum(f.length for f in found["frames"])
                    rows.append((
                        doc, int(tags["text_bytes"]) if tags.get("text_bytes", "").isdigit() else None, blob, payload, len(found["frames"]), found["hertz"], found["samples"], seconds,
                        size * 8 / 1000 / seconds if seconds else 0.0, table.get("kind"), table.get("frames"), table.get("bytes"), table.get("toc"), found["crc_errors"], found["resyncs"], found["lost_bytes"], found["offsets"],
                        None if crc is None else f"{zlib.crc32(payload):08x}" == crc,
                    ))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names)

    rows = media.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(media_col), F.lit(b"")).alias("media"))
    return rows.mapInArrow(run, _SCANNED)


_TYPES = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.bool_()]


def feature() -> Column:
    """A scanned stream's exact duration, table, checks and seek offsets as one string."""
    return F.format_string(
        "mp3 frames=%d hertz=%d samples=%d vbr=%s/%d/%d crc_errors=%d resyncs=%d lost=%d intact=%s seek=%s",
        "n_frames", "sample_rate", "duration_samples", "vbr_kind", "vbr_frames", "vbr_bytes", "crc_errors", "resyncs", "lost_bytes", "payload_intact",
        F.substring(F.sha2(F.array_join(F.col("frame_offsets").cast("array<string>"), ",").cast("binary"), 256), 1, 16),
    )

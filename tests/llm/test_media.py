import hashlib
import random
import zlib

import pytest
from pyspark.sql import Row

from seqcomplexity.llm import media


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 121, 128, 1416, 1417, 1418, 5000, 100_000])
def test_round_trip(n):
    raw = random.Random(n).randbytes(n)
    blob = media.encode_audio(raw)
    found = media.scan_audio(blob)
    assert media.stored_payload(blob, found) == media.padded(raw)
    assert len(media.padded(raw)) % 64 == 0 and len(media.padded(raw)) >= 64
    assert found["resyncs"] == found["crc_errors"] == found["lost_bytes"] == 0
    assert found["table"]["frames"] == len(found["frames"]) and found["samples"] == 1152 * len(found["frames"])


def test_resync_and_checksums():
    raw = random.Random(1).randbytes(20_000)
    blob = media.encode_audio(raw)
    clean = media.scan_audio(blob)
    cut = clean["offsets"][5]
    dirty = media.scan_audio(blob[:cut] + b"\xff\xfa\xe8\xc0 junk" + blob[cut:])
    assert dirty["resyncs"] == 1 and dirty["lost_bytes"] == 9 and len(dirty["frames"]) == len(clean["frames"])
    broken = bytearray(blob)
    broken[cut + 7] ^= 1
    assert media.scan_audio(bytes(broken))["crc_errors"] == 1


def test_headers():
    f = media.frame_header(bytes([0xFF, 0xFB, 0x90, 0x00]))
    assert (f.kbps, f.hertz, f.length, f.samples, f.protected) == (128, 44100, 417, 1152, False)
    f = media.frame_header(bytes([0xFF, 0xF3, 0x80, 0xC0]))
    assert (f.version, f.layer, f.kbps, f.hertz, f.length, f.samples) == (2, 3, 64, 22050, 208, 576)
    f = media.frame_header(bytes([0xFF, 0xFF, 0x10, 0x00]))
    assert (f.layer, f.kbps, f.length, f.samples) == (1, 32, 32, 384)
    assert media.frame_header(b"\xff\xfb\xf0\x00") is None and media.frame_header(b"ab") is None


@pytest.mark.parametrize("blob", [b"", b"\xff", b"\xff" * 500, b"ID3", b"TAG" + bytes(125), b"\xff\xfb\x90\x00"])
def test_garbage(blob):
    assert media.scan_audio(blob)["frames"] == []


def test_dataframe(spark):
    texts = ["", None, "a", "é" * 64, "x" * 64, "same", "same", "long " * 50_000]
    docs = spark.createDataFrame([Row(doc_id=i, text=t, media=1, n_bytes="clash") for i, t in enumerate(texts)])
    rows = media.read_audio(media.store_audio(docs)).withColumn("feature", media.feature()).orderBy("doc_id").collect()
    assert len(rows) == len(texts)
    for row, t in zip(rows, texts):
        raw = (t or "").encode()
        assert row.n_bytes == len(raw) and bytes(row.payload) == media.padded(raw) and row.payload_intact and row.crc_errors == 0
        assert zlib.crc32(bytes(row.payload)) == zlib.crc32(media.padded(raw))
    assert rows[5].feature == rows[6].feature and rows[5].media == rows[6].media
    assert hashlib.sha256(rows[0].media).digest() == hashlib.sha256(rows[1].media).digest()
    assert media.read_audio(media.store_audio(docs.limit(0))).count() == 0

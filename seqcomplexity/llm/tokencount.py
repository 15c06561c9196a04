"""Token counts by separator scan.

A token file is a flat run of little-endian unsigned 16- or 32-bit ids, documents end to end, each closed by an end-of-document
id; it has no index. The scan cuts files into blocks wherever they fall, finds the separators of a block with one vectorised
comparison, and stitches documents that cross blocks with a prefix scan: the last separator before a block (a running
maximum) and the separators before it (a running sum) tell what its first document is and where it began.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import chunks, delete_at_exit, drop_folder, drop_materialized, materialize, shared_dir, utf8

#: Bytes of a block.
BLOCK_BYTES = 1 << 22
#: A file is closed after so many bytes.
FILE_BYTES = 1 << 28
END = 50256
_PIECE_CHARS = 200_000
_CUT = regex.compile(r"(?<=\S) ")


@lru_cache(maxsize=2)
def _encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _ids(encoding: tiktoken.Encoding, text: str) -> Iterator[list[int]]:
    """Ids of a text; long ones piece by piece, cut before spaces that no word spans."""
    at = 0
    while at < len(text):
        cut = _CUT.search(text, at + _PIECE_CHARS) if len(text) - at > 2 * _PIECE_CHARS else None
        part = text[at:cut.start()] if cut else text[at:]
        at += len(part)
        yield encoding.encode_ordinary(part)


def write_token_files(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text into flat uint16 token files in a shared folder, and return ``file, ordinal, doc_id``: which document stands where.

    Each task writes files of its own, of new names, and only those of tasks that succeeded are returned, so a retried or lost
    task leaves at most a stray file. A null text is empty: its document is a lone separator. Ordinary text never gives the
    separator id, whatever it holds. The order of the files is that of the scan; nothing is shuffled. Without ``folder``, the files
    lie in the shared folder until the application ends.
    """
    if folder is None:
        folder = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
        delete_at_exit(docs.sparkSession, folder)
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, out, name, ordinal = _encoding(path), None, "", 0
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for a, b in chunks(np.array([len(t) for t in texts.to_pylist()], np.int64)):
                if out is not None and out.tell() >= FILE_BYTES:
                    out.close()
                    out = None
                if out is None:
                    name, ordinal = f"{uuid.uuid4().hex}.u16", 0
                    out = fs.open_output_stream(f"{root}/{name}")
                for text in texts.slice(a, b - a).to_pylist():
                    for ids in _ids(encoding, text.decode("utf-8", "replace")):
                        out.write(np.array(ids, "<u2").tobytes())
                    out.write(np.array([END], "<u2").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"] * (b - a)), pa.array(np.arange(ordinal, ordinal + b - a)), batch.column(0).slice(a, b - a)], ["file", "ordinal", "doc_id"])
                ordinal += b - a
        if out is not None:
            out.close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))
    return materialize(rows.mapInArrow(run, "file string, ordinal long, doc_id long"), "token-manifest")


def scan_token_files(spark: SparkSession, files: DataFrame, end: int = END, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``file, ordinal, start, n_tokens, closed`` for every document of the files in column ``file`` (URIs).

    ``start`` counts tokens from the file's begin, ``n_tokens`` is without the separator. Tokens after the last separator are a
    document that isn't ``closed``; after a separator at the file's end there is none. Two separators in a row enclose an
    empty document; an empty file has no documents; bytes that make no whole token at a file's end are ignored. A file
    named twice is read once. Blocks are read by range from any file system that pyarrow opens by URI.
    """
    if width not in (2, 4) or block_bytes % width:
        raise ValueError("ids are of 2 or 4 bytes, and blocks hold whole ids")
    kind = np.dtype(f"<u{width}")

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [f for f in batch.column(0).to_pylist() if f is not None]
            sizes = []
            for name in names:
                fs, path = pafs.FileSystem.from_uri(name)
                sizes.append(fs.get_file_info(path).size // width * width)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["file", "bytes"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, block, size in zip(*(c.to_pylist() for c in batch.columns)):
                fs, path = pafs.FileSystem.from_uri(name)
                with fs.open_input_file(path) as f:
                    f.seek(block * block_bytes)
                    ids = np.frombuffer(f.read(min(block_bytes, size - block * block_bytes)), kind)
                found = np.flatnonzero(ids == end) + block * (block_bytes // width)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block], pa.int64()), pa.array([size // width], pa.int64()), pa.array([found], pa.list_(pa.int64()))], ["file", "block", "tokens", "ends"])

    sized = files.select("file").distinct().mapInArrow(lengths, "file string, bytes long").where("bytes > 0")
    blocks = sized.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / block_bytes))).alias("block"), "bytes")
    scanned = materialize(blocks.repartition(F.col("file"), F.col("block")).mapInArrow(scan, "file string, block long, tokens long, ends array<long>"), "separators")

    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    stitched = scanned.select("file", "block", "tokens", F.size("ends").alias("n"), F.expr("try_element_at(ends, -1)").alias("last"))
    stitched = stitched.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("previous"))
    documents = scanned.join(stitched, ["file", "block"]).select("file", "first", "previous", "ends", F.posexplode("ends").alias("i", "at"))
    begin = F.when(F.col("i") == 0, F.col("previous")).otherwise(F.expr("ends[i - 1]")) + 1
    closed = documents.select("file", (F.col("first") + F.col("i")).alias("ordinal"), begin.alias("start"), (F.col("at") - begin).alias("n_tokens"), F.lit(True).alias("closed"))
    tails = scanned.groupBy("file").agg(F.max("tokens").alias("tokens"), F.sum(F.size("ends")).alias("ordinal"), (F.coalesce(F.max(F.expr("try_element_at(ends, -1)")), F.lit(-1)) + 1).alias("start")).where("tokens > start")
    return closed.unionByName(tails.select("file", "ordinal", "start", (F.col("tokens") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed")))


def count_tokens(docs: DataFrame, block_bytes: int = BLOCK_BYTES, folder: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, start, ordinal`` of every row: its tokens, counted by a scan of the token files that its text was written to.

    The files stay if ``folder`` is given; else they go when they have been scanned."""
    spark, own = docs.sparkSession, None
    if folder is None:
        own = folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
        delete_at_exit(spark, own)
    written = write_token_files(docs, folder)
    counted = materialize(scan_token_files(spark, written, block_bytes=block_bytes), "token-counts")
    out = materialize(written.join(counted, ["file", "ordinal"]).select("doc_id", "n_tokens", "start", "ordinal"), "token-totals")
    drop_materialized(written, counted)
    if own:
        drop_folder(spark, own)
    return out

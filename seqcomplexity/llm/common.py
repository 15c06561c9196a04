"""Shared plumbing of the training-data operators: shared storage, lineage cuts, components, Arrow helpers."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []
#: Target size of one unit of Python work, in bytes of text.
CHUNK_BYTES = 1 << 19
#: Links that one task joins in memory (32 MB of ids); more are joined in rounds over all tasks.
FEW_LINKS = 1 << 21
#: Bytes of an Arrow batch on its way to Python; a larger row goes alone.
BATCH_BYTES = 1 << 22
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a local master, whose driver is its one executor, may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="seqcomplexity-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Let Hadoop delete a path when the application ends, if nothing does before."""
    fs, found = _file_system(spark, path)
    fs.deleteOnExit(found)


def drop_folder(spark: SparkSession, path: str) -> None:
    fs, found = _file_system(spark, path)
    fs.delete(found, True)


def small_batches(spark: SparkSession) -> None:
    """Let batches to Python be of about ``BATCH_BYTES`` in this session from here on, unless it has a setting of its own.

    Left to its default, Spark gathers 10,000 rows or 64 MB, which each running task then holds in its JVM outside the heap, and its worker again."""
    if spark.conf.get(_BATCH_SETTING, None) is None:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def give_back() -> None:
    """Return free memory of this process to the system: Arrow's pool, and what the C library (if it is glibc) keeps of freed arrays."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``; when a task ends, its worker, which Spark keeps for later ones, gives free memory back."""
    def freeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return freeing


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends at replicated files, not at an executor's disk.

    The files go with ``drop_materialized``, or else when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    delete_at_exit(spark, path)
    small_batches(spark)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.materialized_path = path
    return out


def drop_materialized(*tables: DataFrame | None) -> None:
    """Delete the files behind tables that ``materialize`` made and nothing reads any more; others and None are passed over."""
    for df in tables:
        if path := getattr(df, "materialized_path", None):
            drop_folder(df.sparkSession, path)


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find on links held in memory: the sorted ids, and for each the place of the smallest id that links reach."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[:len(u)], at[len(u):]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (low == high).all():
            return nodes, root
        np.minimum.at(root, high, low)
        while (further := root[root]).tobytes() != root.tobytes():
            root = further


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From links ``node, f`` of a partition, each node with the smallest that they reach; the smallest stands with itself."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if held:
        nodes, root = forest(*(np.concatenate(c) for c in zip(*held)))
        for at in range(0, len(nodes), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[at:at + (1 << 16)]), pa.array(nodes[root[at:at + (1 << 16)]])], ["node", "f"])


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 60) -> DataFrame:
    """Distributed union-find: tasks join the links they hold to trees, and pointers across tasks are halved until nothing changes.

    ``edges`` holds undirected links between long ids. Returns ``(node, component)`` with ``component`` the smallest id
    reachable, for every id that has a link. Links with a null end and self links are ignored; no links give an empty table.

    A round joins the links of each task by union-find in memory, brings a node's pointers together (one from a task at most, so a
    node with a large part of all links meets in no single task), keeps the least, links the others to it, and points each
    node at its pointer's pointer. In that join one side has unique keys and both come straight from a shuffle, so adaptive
    execution splits large partitions. No round parts what links join: a node stays joined to smaller ones, and these to theirs.
    Up to ``FEW_LINKS`` links need no rounds: one task joins them. ``edges`` is read twice, so it had better be a written table.
    """
    ends = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).where("u <> v")
    links, point = ends.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("f")), None
    if edges.count() <= FEW_LINKS:
        point = materialize(links.repartition(1).mapInArrow(lean(_trees), "node long, f long"), "pointers")
        return _named(point)
    for _ in range(max_rounds):
        near = links.mapInArrow(lean(_trees), "node long, f long").groupBy("node").agg(F.min("f").alias("least"), F.collect_set("f").alias("all"))
        own = F.array(F.struct("node", F.col("least").alias("f"), F.lit(False).alias("open")))
        others = F.transform(F.filter("all", lambda f: (f != F.col("least")) & (f != F.col("node"))), lambda f: F.struct(f.alias("node"), F.col("least").alias("f"), F.lit(True).alias("open")))
        trees = materialize(near.select(F.inline(F.concat(own, others))), "trees")
        further = trees.where("not open").select(F.col("node").alias("f"), F.col("f").alias("g"))
        after = trees.join(further, "f").select("node", F.col("g").alias("f"), (F.col("open") | (F.col("f") != F.col("g"))).alias("open"))
        after = materialize(after, "pointers")
        drop_materialized(point, trees)
        point, links = after, after.select("node", "f")
        if after.where("open").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return _named(point)


def _named(point: DataFrame) -> DataFrame:
    out = point.select("node", F.col("f").alias("component"))
    out.materialized_path = point.materialized_path
    return out


def drawn_rows(rows: DataFrame, draw: Column, wanted: int, count: int, order: list[str]) -> DataFrame:
    """About ``wanted`` of ``count`` rows by a 64-bit hash that is even over them, ``2 * wanted`` at most: those of the smallest hashes.

    All rows, if there are no more. Rows of one hash are drawn together or not, as far as the bound allows, so where few
    rows differ, those of the smallest hashes are taken up to ``wanted``, whatever the share."""
    if count <= wanted:
        return rows
    drawn = rows.withColumn("_draw", F.shiftrightunsigned(draw, 1))
    share = drawn.where(F.col("_draw") < int((1 << 63) * (wanted / count))).orderBy("_draw", *order).limit(2 * wanted)
    return (share if len(share.select("_draw").take(1 + wanted // 4)) > wanted // 4 else drawn.orderBy("_draw", *order).limit(wanted)).drop("_draw")


def utf8(column: str) -> Column:
    """A text column for Python: null is the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def chunks(sizes: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Cut rows of these sizes into runs of about ``limit`` bytes; a larger row stands alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array without nulls, end to end, and its len + 1 offsets."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * M1
    x = x ^ (x >> np.uint64(27))
    x = x * M2
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2 ** 64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (BASE, pow(BASE, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def bloom_filter(ids: DataFrame, count: int, native: bool = False) -> np.ndarray:
    """A Bloom filter over the long column ``doc_id``: 16 bits an id, 128 kB to 32 MB, built by page; for ``bloom_hits``, or else for ``bloom_expression``."""
    bits = 1 << min(28, max(20, (16 * max(count, 1) - 1).bit_length()))
    page = 1 << 19

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            known = batch.column(0).drop_null().to_numpy()
            for spot in [known] if native else _spots(known, bits):
                np.bitwise_or.at(seen, spot >> 3, (1 << (spot & 7)).astype(np.uint8))
        parts = [(i, seen[i * page // 8:(i + 1) * page // 8]) for i in range(bits // page)]
        parts = [(i, p.tobytes()) for i, p in parts if p.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int64()), pa.array([p for _, p in parts], pa.binary())], ["page", "bits"])

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        parts = np.bitwise_or.reduce([np.frombuffer(p, np.uint8) for p in table.column("bits").to_pylist()])
        return pa.table({"page": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([parts.tobytes()], pa.binary())})

    out = np.zeros(bits // 8, np.uint8)
    if native:
        ids = ids.where("doc_id is not null").select(F.explode(F.array(*[F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(seed)), F.lit(bits)) for seed in range(3)])).alias("doc_id"))
    for i, part in ids.select("doc_id").mapInArrow(lean(local), "page long, bits binary").groupBy("page").applyInArrow(merge, "page long, bits binary").collect():
        out[i * page // 8:(i + 1) * page // 8] = np.frombuffer(part, np.uint8)
    return out


def _spots(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    h = mix(ids.astype(np.int64).view(np.uint64) + np.uint64(BASE))
    return [((h >> np.uint64(s)) & np.uint64(bits - 1)).astype(np.int64) for s in (0, 17, 35)]


def bloom_hits(ids: pa.Array, bits: np.ndarray) -> np.ndarray:
    """Which long ids may be in the filter; null is not."""
    spots = _spots(ids.fill_null(0).to_numpy(zero_copy_only=False), len(bits) * 8)
    return np.logical_and.reduce([bits[s >> 3] >> (s & 7).astype(np.uint8) & 1 > 0 for s in spots]) & ids.is_valid().to_numpy(zero_copy_only=False)


def bloom_expression(bits: Column, size: int, column: Column) -> Column:
    """``bloom_hits`` as a column of built-in functions, given the filter of ``size`` bits as a binary column; null for a null id."""
    out = None
    for seed in range(3):
        spot = F.pmod(F.xxhash64(column, F.lit(seed)), F.lit(size))
        byte = F.conv(F.hex(F.substring(bits, (F.shiftright(spot, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        bit = F.call_function("shiftright", byte, spot.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1)) == 1
        out = bit if out is None else out & bit
    return out


def sifted(docs: DataFrame, touched: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """``docs`` in two parts by a Bloom filter over the column ``doc_id`` of ``touched``: rows whose id surely isn't there (or is null), and the rest.

    The rows don't leave the JVM; the filter reaches them as a scalar subquery."""
    bits = bloom_filter(touched, count, native=True)
    held = docs.sparkSession.createDataFrame([(bytearray(bits.tobytes()),)], "bits binary")
    hit = F.coalesce(bloom_expression(held.scalar(), len(bits) * 8, F.col("doc_id").cast("long")), F.lit(False))
    return docs.where(~hit), docs.where(hit)


def runs(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[pa.Table]:
    """Regroup sorted batches so that rows that agree in the first columns (integers) stand in one table."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in range(columns)], 1)
        new = np.flatnonzero((keys != keys[-1]).any(1))
        cut = int(new[-1]) + 1 if len(new) else 0
        if held and (cut or last != tuple(keys[-1])):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
        last = tuple(keys[-1])
    if held:
        yield pa.Table.from_batches(held)

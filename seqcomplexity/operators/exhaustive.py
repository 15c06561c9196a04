"""LZ76 over all binary strings of a length: ranges split by Spark, parsed bit-parallel, summed with partial aggregation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import kernels

#: The largest lengths for counts (a row for each string) and for distributions.
COUNTS_LIMIT, DISTRIBUTION_LIMIT = 24, 30


def _length(length: int, limit: int) -> int:
    if not isinstance(length, int) or isinstance(length, bool) or not 1 <= length <= limit:
        raise ValueError(f"the length must be an integer from 1 to {limit}")
    return length


def exhaustive_counts(spark: SparkSession, length: int) -> DataFrame:
    """``idx, bits, phrases`` for every binary string of ``length``; ``idx`` is ``bits`` read big-endian."""
    size = 1 << _length(length, COUNTS_LIMIT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = kernels.lz76_counts_of_bits(batch.column(0).to_numpy(), length)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts.astype(np.int32))], ["idx", "phrases"])

    counts = spark.range(size).toDF("idx").mapInArrow(run, "idx long, phrases int")
    return counts.select("idx", F.lpad(F.bin("idx"), length, "0").alias("bits"), "phrases")


def exhaustive_counts_by_level(spark: SparkSession, length: int) -> DataFrame:
    """``exhaustive_counts`` with built-in functions only: every level appends both symbols and advances the parsing state, so prefixes are parsed once."""
    rows = spark.range(1).select(F.lit("").alias("bits"), F.lit(1).alias("start"), F.lit(0).alias("closed"))
    for level in range(1, _length(length, COUNTS_LIMIT) + 1):
        rows = rows.select(F.explode(F.array(F.concat("bits", F.lit("0")), F.concat("bits", F.lit("1")))).alias("bits"), "start", "closed")
        still = F.instr(F.col("bits").substr(F.lit(1), F.lit(level - 1)), F.expr("substring(bits, start)")) > 0
        rows = rows.select("bits", F.when(still, F.col("start")).otherwise(level + 1).alias("start"), F.when(still, F.col("closed")).otherwise(F.col("closed") + 1).alias("closed"))
        if level == 10 and length > 12:
            rows = rows.repartition(spark.sparkContext.defaultParallelism * 2, "bits")
    phrases = F.col("closed") + F.when(F.col("start") <= length, 1).otherwise(0)
    return rows.select(F.conv("bits", 2, 10).cast("long").alias("idx"), "bits", phrases.cast("int").alias("phrases"))


def exhaustive_distribution(spark: SparkSession, length: int, max_complexity: int | None = None) -> DataFrame:
    """``complexity, n_strings``: how many binary strings of ``length`` have so many phrases, dense from 0; the last of ``max_complexity`` bins holds the rest.

    Swapping the symbols doesn't change a parsing, so strings that start with 0 are counted twice."""
    half = 1 << (_length(length, DISTRIBUTION_LIMIT) - 1)
    bins = length + 5 if max_complexity is None else max_complexity
    if not isinstance(bins, int) or bins <= 0:
        raise ValueError("max_complexity must be a positive integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(bins, np.int64)
        for batch in batches:
            total += np.bincount(np.minimum(kernels.lz76_counts_of_bits(batch.column(0).to_numpy(), length), bins - 1), minlength=bins)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(2 * total[found])], ["complexity", "n_strings"])

    parts = max(1, min(half >> 12, 64 * spark.sparkContext.defaultParallelism))
    counted = spark.range(0, half, 1, parts).mapInArrow(run, "complexity int, n_strings long").groupBy("complexity").agg(F.sum("n_strings").alias("n_strings"))
    dense = spark.range(bins).select(F.col("id").cast("int").alias("complexity"))
    return dense.join(counted, "complexity", "left").select("complexity", F.coalesce("n_strings", F.lit(0)).cast("long").alias("n_strings"))


def histogram(counts: DataFrame, max_complexity: int, column: str = "phrases") -> DataFrame:
    """``complexity, n_strings`` of a count column, binned and densified like ``exhaustive_distribution``."""
    binned = counts.groupBy(F.least(F.col(column), F.lit(max_complexity - 1)).cast("int").alias("complexity")).agg(F.count("*").alias("n_strings"))
    dense = counts.sparkSession.range(max_complexity).select(F.col("id").cast("int").alias("complexity"))
    return dense.join(binned, "complexity", "left").select("complexity", F.coalesce("n_strings", F.lit(0)).cast("long").alias("n_strings"))

"""Where strings come from, and where results go."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRINGS = T.StructType([T.StructField("string_id", T.LongType(), False), T.StructField("s", T.StringType())])
BENCH = T.StructType([T.StructField("n_strings", T.LongType()), T.StructField("string_length", T.IntegerType()), T.StructField("n_threads", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in ("regular_time", "symmetric_time", "strings_per_second", "symmetric_strings_per_second", "speedup_regular", "speedup_symmetric")]])
FORMATS = ("parquet", "csv", "json", "orc", "text")


def from_strings(spark: SparkSession, strings: Iterable[str | None]) -> DataFrame:
    """``string_id, s`` of an in-memory list, with the list's positions as ids."""
    rows = list(enumerate(strings))
    for _, s in rows:
        if s is not None and not isinstance(s, str):
            raise TypeError("strings are expected")
    return spark.createDataFrame(rows, STRINGS)


def from_pairs(spark: SparkSession, xs: Iterable[str | None], ys: Iterable[str | None]) -> DataFrame:
    """``pair_id, x, y`` of two lists of one length."""
    xs, ys = list(xs), list(ys)
    if len(xs) != len(ys):
        raise ValueError("the lists differ in length")
    return spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(zip(xs, ys))], "pair_id long, x string, y string")


def read_strings(spark: SparkSession, path: str, column: str = "value", format: str = "parquet", **options: str) -> DataFrame:
    """One string column of files; only this column is read."""
    if format not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    return spark.read.format(format).options(**options).load(path).select(F.col(column).alias("s"))


def write_results(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists") -> None:
    if format not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    writer = df.write.mode(mode).format(format)
    (writer.option("header", "true") if format == "csv" else writer).save(path)


def read_bench(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark rows from a CSV file with a header."""
    return spark.read.schema(BENCH).option("header", "true").csv(path)

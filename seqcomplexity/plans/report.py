"""Reports over benchmark rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_speedups(rows: DataFrame) -> DataFrame:
    """Rates and speedups against one thread of the same configuration, from ``n_strings, string_length, n_threads, regular_time, symmetric_time``."""
    same = W.partitionBy("n_strings", "string_length")
    base = lambda c: F.max(F.when(F.col("n_threads") == 1, F.col(c))).over(same)
    return rows.select(
        "n_strings", "string_length", "n_threads", "regular_time", "symmetric_time",
        (F.col("n_strings") / F.col("regular_time")).alias("strings_per_second"), (F.col("n_strings") / F.col("symmetric_time")).alias("symmetric_strings_per_second"),
        (base("regular_time") / F.col("regular_time")).alias("speedup_regular"), (base("symmetric_time") / F.col("symmetric_time")).alias("speedup_symmetric"),
    )


def best_by_configuration(rows: DataFrame) -> DataFrame:
    """For each configuration the best speedup with its threads, and the best rates."""
    return rows.groupBy("n_strings", "string_length").agg(
        F.max("speedup_regular").alias("best_speedup"), F.max_by("n_threads", "speedup_regular").alias("best_threads"),
        F.max("strings_per_second").alias("best_rate"), F.max("symmetric_strings_per_second").alias("best_symmetric_rate"),
    )

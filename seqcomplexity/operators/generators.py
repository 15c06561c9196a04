"""Random strings, by seed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _draw(method: str, *parts: Column | str) -> Column:
    """A non-negative integer from a hash of the parts: ``xxhash64``, or ``md5`` (slower), which other engines have, too."""
    if method == "md5":
        return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")
    if method != "xxhash64":
        raise ValueError("method must be 'xxhash64' or 'md5'")
    return F.shiftrightunsigned(F.xxhash64(*parts), 16)


def random_string(length: int | Column, alphabet: Sequence[str] = ("0", "1"), seed: int = 0, key: Column | str = "id", method: str = "xxhash64") -> Column:
    """A random string for each row: symbol i follows from a hash of (seed, key, i), so a retried task gives the same string."""
    if isinstance(length, int) and length <= 0:
        return F.lit("")
    if not len(alphabet):
        raise ValueError("the alphabet is empty")
    key = F.col(key) if isinstance(key, str) else key
    size = F.lit(length) if isinstance(length, int) else length
    symbols = F.array(*[F.lit(a) for a in alphabet])
    pick = lambda i: F.element_at(symbols, (F.pmod(_draw(method, F.lit(seed), key, i), F.lit(len(alphabet))) + 1).cast("int"))
    return F.when(size > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), pick), "")).otherwise("")


def random_strings(spark: SparkSession, count: int, length: int, alphabet: Sequence[str] = ("0", "1"), seed: int = 0, max_length: int | None = None, method: str = "xxhash64") -> DataFrame:
    """``string_id, s``: ``count`` random strings of ``length`` (or of a length from ``length`` to ``max_length``)."""
    size = length if max_length is None else (F.pmod(_draw(method, F.lit(seed + 1), "id"), F.lit(max_length - length + 1)) + length).cast("int")
    return spark.range(max(0, count)).select(F.col("id").alias("string_id"), random_string(size, alphabet, seed, "id", method).alias("s"))

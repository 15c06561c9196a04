"""Substring search, substrings, phrases and block counts as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import measures


def contains_pattern(text: Column | str, pattern: Column | str) -> Column:
    """Whether a pattern occurs in a text; the empty pattern always does."""
    text, pattern = (F.col(c) if isinstance(c, str) else c for c in (text, pattern))
    return F.contains(text, pattern)


def find_patterns(texts: DataFrame, patterns: DataFrame, key: str, text: str = "text", pattern: str = "pattern") -> DataFrame:
    """``patterns`` joined to their texts by ``key``, with ``found``."""
    return patterns.join(texts.select(key, text), key).withColumn("found", contains_pattern(text, pattern)).drop(text)


def find_so_far(rows: DataFrame, key: str, symbol: str, order: list[str], pattern: str) -> DataFrame:
    """``rows`` with ``found``: whether ``pattern`` occurs in what the key's symbols spell up to and with the row.

    The symbols of a key are joined once; a pattern is found from the row on at which its first occurrence ends. A null pattern
    gives null, the empty one true; a null symbol adds nothing."""
    at = [F.col(c) for c in order]
    spelled = rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*at, F.coalesce(F.col(symbol), F.lit("")).alias("_s")))), lambda r: r["_s"]), "").alias("_text"))
    size = F.sum(F.char_length(F.coalesce(F.col(symbol), F.lit("")))).over(Window.partitionBy(key).orderBy(*at).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first = F.call_function("instr", F.col("_text"), F.col(pattern))
    found = F.when(F.char_length(pattern) == 0, True).otherwise((first > 0) & (first - 1 + F.char_length(pattern) <= F.col("_size")))
    return rows.withColumn("_size", size).join(spelled, key).withColumn("found", F.when(F.col(pattern).isNotNull(), found)).drop("_size", "_text")


def with_terminator(text: Column | str, terminator: str = "$") -> Column:
    if len(terminator) != 1:
        raise ValueError("the terminator must be one symbol")
    return F.concat(F.col(text) if isinstance(text, str) else text, F.lit(terminator))


def distinct_substrings(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, substring``: every distinct substring, with the empty one. Quadratic in the text's length by definition.

    Starts are spread before ends are made, so that one long text is the work of many tasks."""
    starts = texts.select(key, F.col(text).alias("_t"), F.explode(F.sequence(F.lit(0), F.char_length(text))).alias("_i"))
    ends = starts.select(key, "_t", "_i", F.explode(F.when(F.col("_i") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), F.char_length("_t") - F.col("_i") + 1))).alias("_n"))
    return ends.select(key, F.col("_t").substr(F.col("_i"), F.col("_n")).alias("substring")).distinct()


def lz76_phrase_rows(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, pos, phrase``: the LZ76 phrases, one row each, from position 0."""
    return texts.select(key, F.posexplode(measures.lz76_dictionary(text)).alias("pos", "phrase"))


def lz78_phrase_rows(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    return texts.select(key, F.posexplode(measures.lz78_dictionary(text)).alias("pos", "phrase"))


def block_counts(texts: DataFrame, key: str, k: int, text: str = "text") -> DataFrame:
    """``key, block, n``: overlapping windows of ``k`` symbols and their counts, with built-in functions only."""
    if k <= 0:
        raise ValueError("the block size must be a positive integer")
    # The text is split once, into an array bound to a name, as substrings of a text are found by walking it from its start.
    windows = lambda a: F.transform(F.sequence(F.lit(1), F.size(a) - k + 1), lambda i: F.array_join(F.slice(a, i, k), ""))
    rows = texts.where(F.char_length(text) >= k).select(key, F.explode(F.transform(F.array(F.split(text, "")), windows)[0]).alias("block"))
    return rows.groupBy(key, "block").agg(F.count("*").alias("n"))


def block_entropy_relational(texts: DataFrame, key: str, k: int, text: str = "text") -> DataFrame:
    """``key, entropy`` from ``block_counts``: for pipelines that want no Python on the executors. Keys must be unique."""
    n = F.col("n").cast("double")
    sums = block_counts(texts, key, k, text).groupBy(key).agg((F.log2(F.sum("n")) - F.sum(n * F.log2(n)) / F.sum("n")).alias("entropy"))
    return texts.select(key).join(sums, key, "left").select(key, F.coalesce("entropy", F.lit(0.0)).alias("entropy"))


def conditional_pairs(x: DataFrame, y: DataFrame, key: str, algorithm: str = "lz76", x_col: str = "x", y_col: str = "y", empty: str = "zero", check: bool = True) -> DataFrame:
    """``key, conditional``: y given x for tables paired by key. With ``check``, a key that stands in one table only fails the query."""
    left, right = x.select(key, F.col(x_col), F.lit(True).alias("_x")), y.select(key, F.col(y_col), F.lit(True).alias("_y"))
    pairs = left.join(right, key, "full" if check else "inner")
    if check:
        lone = F.raise_error(F.concat(F.lit("both sides must have the same keys; no partner for "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
        pairs = pairs.where(F.when(F.col("_x") & F.col("_y"), F.lit(True)).otherwise(lone.cast("boolean")))
    return pairs.select(key, measures.process_conditional(x_col, y_col, algorithm, empty).alias("conditional"))

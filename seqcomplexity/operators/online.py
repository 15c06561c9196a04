"""Online LZ76 over symbols that arrive as rows: the batch form."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..kernels import lz76_starts


def symbol_strings(rows: DataFrame, key: str, symbol: str, order: list[str]) -> DataFrame:
    """``key, s``: the symbols of each key joined in order. A key's string is one value, as its parsing is one chain."""
    at = [F.col(c) for c in order]
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*at, F.col(symbol).alias("_symbol")))).alias("_rows")).select(key, F.array_join(F.transform("_rows", lambda r: r["_symbol"]), "").alias("s"))


def lz76_trace(strings: DataFrame, key: str, text: str = "s") -> DataFrame:
    """``key, pos, symbol, completed, n_phrases``: what an online parser says after every symbol (positions from 0).

    ``completed`` tells that the symbol closes a phrase; an open word counts one in ``n_phrases``. Phrases of a parsing are
    those of its prefixes but for the last, so one parsing gives all rows. A string still open at its end is not completed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, s in enumerate(batch.column(1).to_pylist()):
                if not s:
                    continue
                starts = [*lz76_starts(s), len(s)]
                done, count = [False] * len(s), [0] * len(s)
                for k, (a, b) in enumerate(zip(starts[:-1], starts[1:])):
                    count[a:b] = [k + 1] * (b - a)
                    done[b - 1] = b < len(s) or s.find(s[a:b], 0, b - 1) < 0
                keys = batch.column(0).take(pa.array([i] * len(s)))
                yield pa.RecordBatch.from_arrays([keys, pa.array(range(len(s)), pa.int64()), pa.array(list(s)), pa.array(done), pa.array(count, pa.int32())], [key, "pos", "symbol", "completed", "n_phrases"])

    rows = strings.select(key, text)
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, pos long, symbol string, completed boolean, n_phrases int")


def lz76_trace_symbols(rows: DataFrame, key: str, symbol: str, order: list[str], initial_text: str = "") -> DataFrame:
    """``key, segment, pos, symbol, completed, n_phrases``: the trace of symbols that arrive as rows, the batch form of the streaming operator.

    A null symbol resets the key: a new segment (from 0) begins with an empty text. ``initial_text`` is what every key has seen
    before its first symbol; it has no rows of its own, and positions count it."""
    resets = F.sum(F.when(F.col(symbol).isNull(), 1).otherwise(0)).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    parts = rows.withColumn("_segment", resets.cast("long")).where(F.col(symbol).isNotNull()).withColumn("_part", F.struct(F.col(key).alias("key"), F.col("_segment").alias("segment")))
    texts = symbol_strings(parts, "_part", symbol, order).withColumn("s", F.when(F.col("_part.segment") == 0, F.concat(F.lit(initial_text), "s")).otherwise(F.col("s")))
    new = (F.col("_part.segment") > 0) | (F.col("pos") >= len(initial_text))
    return lz76_trace(texts, "_part").where(new).select(F.col("_part.key").alias(key), F.col("_part.segment").alias("segment"), "pos", "symbol", "completed", "n_phrases")

"""Measures as column functions: they take and return columns, so that they compose with any DataFrame.

Null in, null out. Symbols are code points; ``unit="utf8_prefix"`` counts bytes instead, the first ``char_length`` ones. An
empty string counts as ``"0"`` in complexities and entropies, and has no phrases in ``lz76_phrases`` and the dictionaries.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .. import kernels

ALGORITHMS = ("lz76", "lz78")
UNITS = ("codepoint", "utf8_prefix")


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def _values(array: pa.Array) -> list[str | None]:
    return array.to_pylist()


def _masked(values: np.ndarray, source: list, kind: pa.DataType) -> pa.Array:
    return pa.array(values, kind, mask=np.array([s is None for s in source], bool))


def _or_zero(s: str | None) -> str:
    return s or "0"


def _lz76(strings: list[str]) -> np.ndarray:
    return kernels.lz76_counts(strings) * np.log2(np.array([max(1, len(s)) for s in strings], np.float64))


def _lz78(strings: list[str]) -> np.ndarray:
    return np.array([kernels.lz78_count(s) for s in strings], np.float64)


def _reversed(strings: list[str]) -> list[str]:
    return [s[::-1] for s in strings]


def _measure(of: Callable[[list[str]], np.ndarray], column: Column | str, unit: str = "codepoint") -> Column:
    """A double column from a function over a batch of non-empty strings."""
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")

    @arrow_udf(T.DoubleType())
    def measure(array: pa.Array) -> pa.Array:
        source = _values(array)
        strings = [_or_zero(s) for s in source]
        if unit == "utf8_prefix":  # each byte becomes a symbol of its own
            strings = [s.encode()[: len(s)].decode("latin-1") for s in strings]
        return _masked(of(strings), source, pa.float64())

    return measure(_col(column))


def lz76(column: Column | str, unit: str = "codepoint") -> Column:
    """LZ76 complexity: the number of phrases times log2 of the length."""
    return _measure(_lz76, column, unit)


def lz76_symmetric(column: Column | str, unit: str = "codepoint") -> Column:
    """The mean LZ76 complexity of a string and its reversal."""
    return _measure(lambda s: (_lz76(s) + _lz76(_reversed(s))) / 2, column, unit)


def lz78(column: Column | str, unit: str = "codepoint") -> Column:
    """The number of LZ78 phrases."""
    return _measure(_lz78, column, unit)


def lz78_symmetric(column: Column | str, unit: str = "codepoint") -> Column:
    return _measure(lambda s: (_lz78(s) + _lz78(_reversed(s))) / 2, column, unit)


def block_entropy(column: Column | str, k: int = 1, unit: str = "codepoint") -> Column:
    """Shannon entropy in bits of the overlapping windows of ``k`` symbols; 0 where the string is shorter."""
    if not isinstance(k, int) or isinstance(k, bool) or k <= 0:
        raise ValueError("the block size must be a positive integer")
    return _measure(lambda s: np.array([kernels.block_entropy(x, k) for x in s], np.float64), column, unit)


def block_entropy_symmetric(column: Column | str, k: int = 1, unit: str = "codepoint") -> Column:
    """Equal to ``block_entropy``: reversal permutes the windows."""
    return block_entropy(column, k, unit)


def lz78_mutual(column: Column | str) -> Column:
    """How much of a string's two halves LZ78 shares: ``(c(left) + c(right) - c(whole)) / (2 c(whole)) * ln n``; 0 below two symbols."""
    def one(s: str) -> float:
        if len(s) < 2:
            return 0.0
        whole, half = kernels.lz78_count(s), len(s) // 2
        return (kernels.lz78_count(s[:half]) + kernels.lz78_count(s[half:]) - whole) / (2 * whole) * math.log(len(s))

    return _measure(lambda strings: np.array([one(s) for s in strings], np.float64), column)


def _conditional(of: Callable[[list[str]], np.ndarray], x: Column | str, y: Column | str, empty: str) -> Column:
    if empty not in ("zero", "identity"):
        raise ValueError("empty must be 'zero' or 'identity'")

    @arrow_udf(T.DoubleType())
    def conditional(xs: pa.Array, ys: pa.Array) -> pa.Array:
        left, right = _values(xs), _values(ys)
        gone = [None if a is None or b is None else a for a, b in zip(left, right)]
        if empty == "zero":
            a, b = [_or_zero(s) for s in left], [_or_zero(s) for s in right]
            out = of([p + q for p, q in zip(a, b)]) - of(a)
        else:
            a, b = [s or "" for s in left], [s or "" for s in right]
            none = np.array([not s for s in a], bool)
            out = np.where([not s for s in b], 0.0, of([p + q or "0" for p, q in zip(a, b)]) - np.where(none, 0.0, of([s or "0" for s in a])))
        return _masked(out, gone, pa.float64())

    return conditional(_col(x), _col(y))


def conditional_lz76(x: Column | str, y: Column | str, empty: str = "zero") -> Column:
    """LZ76 complexity of ``y`` given ``x``: that of ``x`` followed by ``y`` less that of ``x``.

    ``empty="zero"`` takes an empty string as ``"0"``; ``"identity"`` gives y's own complexity for an empty x and 0 for an empty y."""
    return _conditional(_lz76, x, y, empty)


def conditional_lz78(x: Column | str, y: Column | str, empty: str = "zero") -> Column:
    return _conditional(_lz78, x, y, empty)


def lz76_phrases(column: Column | str) -> Column:
    """The number of LZ76 phrases; 0 for an empty string."""
    @arrow_udf(T.IntegerType())
    def phrases(array: pa.Array) -> pa.Array:
        source = _values(array)
        return _masked(kernels.lz76_counts(source).astype(np.int32), source, pa.int32())

    return phrases(_col(column))


def lz76_dictionary(column: Column | str) -> Column:
    """The LZ76 phrases in order; joined they give the string."""
    @arrow_udf(T.ArrayType(T.StringType()))
    def dictionary(array: pa.Array) -> pa.Array:
        return pa.array([None if s is None else kernels.lz76_phrases(s) for s in _values(array)], pa.list_(pa.string()))

    return dictionary(_col(column))


def lz78_dictionary(column: Column | str) -> Column:
    """The LZ78 phrases in order."""
    @arrow_udf(T.ArrayType(T.StringType()))
    def dictionary(array: pa.Array) -> pa.Array:
        return pa.array([None if s is None else kernels.lz78_phrases(s) for s in _values(array)], pa.list_(pa.string()))

    return dictionary(_col(column))


def complexity_profile(column: Column | str, blocks: tuple[int, ...] = (1, 2, 3)) -> Column:
    """All measures of a string in one struct, for one trip of the text to Python."""
    fields = ["lz76", "lz76_symmetric", "lz78", "lz78_symmetric", *[f"entropy_{k}" for k in blocks]]

    @arrow_udf(T.StructType([T.StructField(f, T.DoubleType()) for f in fields]))
    def profile(array: pa.Array) -> pa.Array:
        source = _values(array)
        s = [_or_zero(x) for x in source]
        back = _reversed(s)
        a, c = _lz76(s), _lz78(s)
        out = [a, (a + _lz76(back)) / 2, c, (c + _lz78(back)) / 2, *[np.array([kernels.block_entropy(x, k) for x in s], np.float64) for k in blocks]]
        return pa.StructArray.from_arrays([pa.array(x, pa.float64()) for x in out], fields, mask=pa.array([x is None for x in source], pa.bool_()))

    return profile(_col(column))


def process_strings(column: Column | str, algorithm: str = "lz76", symmetric: bool = False) -> Column:
    """The measure named: ``lz76`` or ``lz78``, plain or symmetric."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"algorithm must be one of {ALGORITHMS}")
    return {("lz76", False): lz76, ("lz76", True): lz76_symmetric, ("lz78", False): lz78, ("lz78", True): lz78_symmetric}[algorithm, bool(symmetric)](column)


def process_conditional(x: Column | str, y: Column | str, algorithm: str = "lz76", empty: str = "zero") -> Column:
    if algorithm not in ALGORITHMS:
        raise ValueError(f"algorithm must be one of {ALGORITHMS}")
    return (conditional_lz76 if algorithm == "lz76" else conditional_lz78)(x, y, empty)


def lz76_phrases_expression(column: Column | str) -> Column:
    """``lz76_phrases`` as a fold over built-in functions, with no Python on the executors; for short strings."""
    s = _col(column)
    begin = F.struct(F.lit(1).alias("start"), F.lit(0).alias("phrases"))

    def step(state: Column, j: Column) -> Column:
        word, history = s.substr(state["start"], j - state["start"] + 1), s.substr(F.lit(1), j - 1)
        still = F.instr(history, word) > 0
        return F.struct(F.when(still, state["start"]).otherwise(j + 1).cast("int").alias("start"), F.when(still, state["phrases"]).otherwise(state["phrases"] + 1).cast("int").alias("phrases"))

    end = F.aggregate(F.sequence(F.lit(1), F.char_length(s)), begin, step, lambda state: state["phrases"] + F.when(state["start"] <= F.char_length(s), 1).otherwise(0))
    return F.when(F.char_length(s) == 0, F.lit(0)).otherwise(end)


def register(spark: SparkSession) -> None:
    """Make the measures SQL functions: ``seq_lz76(s)``, ``seq_lz78(s)``, ``seq_conditional_lz76(x, y)`` and so on."""
    strings = {"seq_lz76": _lz76, "seq_lz76_symmetric": lambda s: (_lz76(s) + _lz76(_reversed(s))) / 2, "seq_lz78": _lz78, "seq_lz78_symmetric": lambda s: (_lz78(s) + _lz78(_reversed(s))) / 2}
    for name, of in strings.items():
        def measure(array: pa.Array, of: Callable = of) -> pa.Array:
            source = _values(array)
            return _masked(of([_or_zero(s) for s in source]), source, pa.float64())

        spark.udf.register(name, arrow_udf(_one(measure), T.DoubleType()))

    @arrow_udf(T.DoubleType())
    def entropy(array: pa.Array, size: pa.Array) -> pa.Array:
        source = _values(array)
        return _masked(np.array([kernels.block_entropy(_or_zero(s), k or 0) for s, k in zip(source, size.to_pylist())], np.float64), source, pa.float64())

    @arrow_udf(T.IntegerType())
    def phrases(array: pa.Array) -> pa.Array:
        source = _values(array)
        return _masked(kernels.lz76_counts(source).astype(np.int32), source, pa.int32())

    @arrow_udf(T.ArrayType(T.StringType()))
    def dictionary(array: pa.Array) -> pa.Array:
        return pa.array([None if s is None else kernels.lz76_phrases(s) for s in _values(array)], pa.list_(pa.string()))

    spark.udf.register("seq_block_entropy", entropy)
    spark.udf.register("seq_lz76_phrases", phrases)
    spark.udf.register("seq_lz76_dictionary", dictionary)
    for name, of in (("seq_conditional_lz76", _lz76), ("seq_conditional_lz78", _lz78)):
        def conditional(xs: pa.Array, ys: pa.Array, of: Callable = of) -> pa.Array:
            left, right = _values(xs), _values(ys)
            a = [_or_zero(s) for s in left]
            out = of([p + _or_zero(q) for p, q in zip(a, right)]) - of(a)
            return _masked(out, [None if p is None or q is None else p for p, q in zip(left, right)], pa.float64())

        spark.udf.register(name, arrow_udf(_two(conditional), T.DoubleType()))


def _one(of: Callable) -> Callable:
    def call(array: pa.Array) -> pa.Array:
        return of(array)

    return call


def _two(of: Callable) -> Callable:
    def call(x: pa.Array, y: pa.Array) -> pa.Array:
        return of(x, y)

    return call

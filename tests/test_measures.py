import math
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from seqcomplexity import kernels
from seqcomplexity.functions import measures as M

# string: LZ76 phrases, C76, symmetric C76, LZ78 phrases, symmetric c78, H1, H2, H3
GOLDEN = {
    "0": ("0", 0.0, 0.0, "0", 1, 0, 0, 0),
    "0101010101": ("0,1,01010101", 9.965784, 9.965784, "0,1,01,010,10,1", 6, 1, 0.991076, 1),
    "000111000111": ("0,001,110,00111", 14.33985, 14.33985, "0,00,1,11,000,111", 6, 1, 1.823068, 2.521928),
    "0100101011": ("0,1,00,101,011", 16.60964, 14.948676, "0,1,00,10,101,1", 6, 1, 1.752715, 2.155639),
    "abcde": ("a,b,c,d,e", 11.60964, 11.60964, "a,b,c,d,e", 5, 2.321928, 2, 1.584963),
    "aaaaa": ("a,aaaa", 4.643856, 4.643856, "a,aa,aa", 3, 0, 0, 0),
    "banana": ("b,a,n,ana", 10.33985, 9.047369, "b,a,n,an,a", 4.5, 1.459148, 1.521928, 1.5),
    "bananaabandana$": ("b,a,n,anaa,band,ana$", 23.441344, 27.348234, "b,a,n,an,aa,ba,nd,ana,$", 9, 1.930125, 2.753434, 3.180833),
    "01010010001": ("0,1,0100,1000,1", 17.297158, 17.297158, "0,1,01,00,10,001", 6, 0.94566, 1.570951, 2.19716),
    "abac": ("a,b,ac", 6, 7, "a,b,ac", 3.5, 1.5, 1.584963, 1),
    "randomstring": ("r,a,n,d,o,m,s,t,ri,ng", 35.849625, 37.642106, "r,a,n,d,o,m,s,t,ri,ng", 10.5, 3.251629, 3.459432, 3.321928),
}


def plain(s):
    i = count = 0
    while i < len(s):
        n = 1
        while i + n <= len(s) and s[i:i + n] in s[:i + n - 1]:
            n += 1
        count, i = count + 1, i + n
    return count


def test_golden(spark):
    df = spark.createDataFrame([Row(s=s) for s in GOLDEN])
    rows = df.select("s", M.lz76_dictionary("s"), M.lz76("s"), M.lz76_symmetric("s"), M.lz78_dictionary("s"), M.lz78_symmetric("s"), *[M.block_entropy("s", k) for k in (1, 2, 3)]).collect()
    for s, phrases, c76, sym, words, sym78, *h in rows:
        expected = GOLDEN[s]
        assert ",".join(phrases) == expected[0] and ",".join(words) == expected[3]
        assert [round(x, 6) for x in (c76, sym, sym78, *h)] == [pytest.approx(x, abs=2e-6) for x in (expected[1], expected[2], *expected[4:])]


def test_conditional_golden(spark):
    pairs = {("000", "000111"): (6.33985, 3), ("111", "111000"): (6.33985, 3), ("00000", "11111"): (5.321928, 3), ("ababab", "abacaba"): (7.046871, 3), ("cat", "dog"): (10.754888, 3), ("", "nonempty"): (25.3594, 7), ("10101", "01010"): (3.0, 2)}
    df = spark.createDataFrame([Row(x=x, y=y) for x, y in pairs])
    for r in df.select("x", "y", M.conditional_lz76("x", "y").alias("a"), M.conditional_lz78("x", "y").alias("b"), M.conditional_lz78("x", "y", empty="identity").alias("c")).collect():
        assert (r.a, r.b) == pytest.approx(pairs[r.x, r.y], abs=1e-5)
        assert r.c == (kernels.lz78_count(r.y) if not r.x else r.b)


def test_mutual(spark):
    assert spark.range(1).select(M.lz78_mutual(F.lit("0100101011ababababab"))).first()[0] == pytest.approx(0.13617, abs=1e-5)


def test_kernels_agree_on_random_strings():
    rng = random.Random(4)
    strings = ["".join(rng.choice(["01", "abcé中\U0001f600", "a"][i % 3]) for _ in range(rng.choice([0, 1, 2, 7, 30, 63, 64, 65, 127, 128, 129, 255, 256, 257, 300]))) for i in range(600)]
    assert kernels.lz76_counts([*strings, None]).tolist() == [*map(plain, strings), 0]
    for s in strings:
        assert "".join(kernels.lz76_phrases(s)) == "".join(kernels.lz78_phrases(s)) == s
        assert kernels.lz78_count(s) == len(kernels.lz78_phrases(s)) and plain(s) <= len(s)
        assert kernels.block_entropy(s, 2) == pytest.approx(kernels.block_entropy(s[::-1], 2), abs=1e-9)


def test_edges(spark):
    rows = [None, "", "a", "e\u0301", "\u00e9", "\U0001f600a", "a\0b\0", "x" * 1000]
    df = spark.createDataFrame([Row(i=i, s=s) for i, s in enumerate(rows)], "i int, s string").orderBy("i")
    got = df.select("s", M.lz76_phrases("s").alias("n"), M.lz76("s").alias("c"), M.lz78("s").alias("d"), M.block_entropy("s", 5).alias("h"), M.lz76_dictionary("s").alias("w"), M.lz76("s", "utf8_prefix").alias("u"), M.complexity_profile("s").alias("p")).collect()
    assert tuple(got[0])[1:] == (None,) * 7
    assert (got[1].n, got[1].c, got[1].d, got[1].h, got[1].w) == (0, 0.0, 1.0, 0.0, [])
    assert [r.n for r in got[2:]] == [1, 2, 1, 2, 4, 2]
    assert got[3].u == 2.0 and got[4].u == 0.0 and got[7].p.lz76 == got[7].c


def test_arguments(spark):
    for call in (lambda: M.process_strings("s", "lz77"), lambda: M.process_conditional("x", "y", "no"), lambda: M.block_entropy("s", 0), lambda: M.block_entropy("s", -1), lambda: M.lz76("s", "bytes"), lambda: M.conditional_lz76("x", "y", "drop")):
        with pytest.raises(ValueError):
            call()
    assert spark.range(1).select(M.process_strings(F.lit("banana"), "lz78", True)).first()[0] == 4.5


def test_expression_equals_kernel(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([Row(s="".join(rng.choices("01a", k=rng.randint(0, 40)))) for _ in range(200)] + [Row(s=None)])
    assert all(r[0] == r[1] for r in df.select(M.lz76_phrases("s"), M.lz76_phrases_expression("s")).collect())


def test_sql_functions(spark):
    M.register(spark)
    row = spark.sql("SELECT seq_lz76('banana') a, seq_lz76_symmetric('banana') b, seq_lz78('banana') c, seq_lz78_symmetric('banana') d, seq_block_entropy('banana', 2) e, seq_lz76_phrases('banana') f, seq_lz76_dictionary('banana') g, seq_conditional_lz76('cat', 'dog') h").first()
    assert [round(x, 5) for x in row[:5]] == [10.33985, 9.04737, 5.0, 4.5, 1.52193]
    assert row.f == 4 and row.g == ["b", "a", "n", "ana"] and math.isclose(row.h, 10.754888, abs_tol=1e-5)

import itertools
import random
import time

import pytest
from pyspark.sql import Row

from seqcomplexity import kernels
from seqcomplexity.operators import exhaustive, generators, online, search
from seqcomplexity.plans import report
from seqcomplexity.sources import strings
from seqcomplexity.streaming.online import OnlineLZ76, find_online, lz76_online

DISTRIBUTIONS = {1: {1: 2}, 2: {2: 4}, 3: {2: 4, 3: 4}, 4: {2: 4, 3: 12}, 5: {2: 4, 3: 20, 4: 8}, 8: {2: 4, 3: 60, 4: 152, 5: 40}, 10: {2: 4, 3: 96, 4: 476, 5: 432, 6: 16}, 16: {2: 4, 3: 252, 4: 4284, 5: 23280, 6: 31836, 7: 5872, 8: 8}}


def test_exhaustive_counts(spark):
    rows = exhaustive.exhaustive_counts(spark, 4).orderBy("idx").collect()
    assert [r.phrases for r in rows] == [2, 2, 3, 3, 3, 3, 3, 3, 3, 3, 3, 3, 3, 3, 2, 2] and rows[5].bits == "0101"
    for length in (1, 9):
        a, b = (sorted(map(tuple, f(spark, length).collect())) for f in (exhaustive.exhaustive_counts, exhaustive.exhaustive_counts_by_level))
        assert a == b and all(n == kernels.lz76_count(bits) and int(bits, 2) == i for i, bits, n in a)


@pytest.mark.parametrize("length", DISTRIBUTIONS)
def test_distribution(spark, length):
    rows = {r.complexity: r.n_strings for r in exhaustive.exhaustive_distribution(spark, length).collect()}
    assert len(rows) == length + 5 and {k: v for k, v in rows.items() if v} == DISTRIBUTIONS[length]


def test_distribution_overflow_and_limits(spark):
    assert [r.n_strings for r in exhaustive.exhaustive_distribution(spark, 10, 4).orderBy("complexity").collect()] == [0, 0, 4, 1020]
    for call in (lambda: exhaustive.exhaustive_counts(spark, 25), lambda: exhaustive.exhaustive_counts(spark, 0), lambda: exhaustive.exhaustive_distribution(spark, 31), lambda: exhaustive.exhaustive_distribution(spark, 5, 0)):
        with pytest.raises(ValueError):
            call()


def test_search(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choices("01", k=rng.randint(0, 12))) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "text_id long, text string")
    found = {}
    for r in search.distinct_substrings(df, "text_id").collect():
        found.setdefault(r.text_id, []).append(r.substring)
    for i, t in enumerate(texts):
        assert sorted(found[i]) == sorted({""} | {t[a:b] for a, b in itertools.combinations(range(len(t) + 1), 2)})
    patterns = spark.createDataFrame([(i, p) for i in range(30) for p in ("", "01", "x", texts[i], texts[i] + "0")], "text_id long, pattern string")
    assert all(r.found == (r.pattern in texts[r.text_id]) for r in search.find_patterns(df, patterns, "text_id").collect())
    demo = {p: p in "bananaba$" for p in ("ban", "ana", "nana", "apple", "bana", "a$", "banana%", "")}
    rows = spark.createDataFrame([("bananaba", p) for p in demo], "t string, p string")
    assert {r.p: r.f for r in rows.select("p", search.contains_pattern(search.with_terminator("t"), "p").alias("f")).collect()} == demo


def test_block_entropy_relational(spark):
    df = spark.createDataFrame([(0, ""), (1, "a"), (2, "banana"), (3, "01" * 50)], "k long, text string")
    for k in (1, 2, 3):
        got = {r.k: r.entropy for r in search.block_entropy_relational(df, "k", k).collect()}
        assert got == {r.k: pytest.approx(kernels.block_entropy(r.text, k), abs=1e-9) for r in df.collect()}


def test_conditional_pairs(spark):
    x = spark.createDataFrame([(1, "cat"), (2, "0")], "k long, x string")
    y = spark.createDataFrame([(1, "dog"), (2, "nonempty")], "k long, y string")
    assert {r.k: round(r.conditional, 4) for r in search.conditional_pairs(x, y, "k").collect()} == {1: 10.7549, 2: 25.3594}
    with pytest.raises(Exception, match="same keys"):
        search.conditional_pairs(x, y.limit(1), "k").collect()
    assert search.conditional_pairs(x, y.limit(1), "k", check=False).count() == 1


def test_random_strings(spark):
    a = generators.random_strings(spark, 500, 20, "ab", 1, 50).collect()
    assert a == generators.random_strings(spark, 500, 20, "ab", 1, 50).collect()
    assert {len(r.s) for r in a} == set(range(20, 51)) and set("".join(r.s for r in a)) == {"a", "b"}
    share = sum(r.s.count("a") for r in a) / sum(len(r.s) for r in a)
    assert 0.45 < share < 0.55 and len({r.s for r in a}) == 500
    assert {r.s for r in generators.random_strings(spark, 3, 0).collect()} == {""} and generators.random_strings(spark, 0, 5).count() == 0
    with pytest.raises(ValueError):
        generators.random_string(5, [])


def online_rows(s):
    parser, out = OnlineLZ76(), []
    for i, c in enumerate(s):
        done = parser.add(c)
        assert parser.n_phrases == kernels.lz76_count(s[:i + 1]) and parser.dictionary() == kernels.lz76_phrases(s[:i + 1])
        out.append((i, c, done, parser.n_phrases))
    return out


def test_online_and_trace(spark):
    rng = random.Random(8)
    texts = ["banana", "bananaba$", "0101010101", "abac", "bananaabandana$", "aaaa", ""] + ["".join(rng.choices("01", k=40)) for _ in range(10)]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, s string")
    got = {}
    for r in online.lz76_trace(df, "k").collect():
        got.setdefault(r.k, []).append((r.pos, r.symbol, r.completed, r.n_phrases))
    for i, s in enumerate(texts):
        assert sorted(got.get(i, [])) == online_rows(s)
    parser = OnlineLZ76.of("banana")
    parser.reset()
    assert parser.n_phrases == 0 and [parser.add(c) for c in "aba"] == [True, True, False]
    for bad in ("", "ab"):
        with pytest.raises(ValueError):
            parser.add(bad)
    with pytest.raises(TypeError):
        parser.add(1)


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    texts = {k: "".join(rng.choices("01", k=30)) for k in "pq"}
    rows = [(k, i, c) for k, s in texts.items() for i, c in enumerate(s)]
    for part in range(3):
        chunk = [r for r in rows if r[1] // 10 == part] + ([("p", 2, "0")] if part else [])
        rng.shuffle(chunk)
        spark.createDataFrame(chunk, "k string, at long, c string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, at long, c string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = lz76_online(stream, "k", "c", "at").writeStream.format("memory").queryName("online_test").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {}
    for r in spark.table("online_test").collect():
        got.setdefault(r.key, []).append((r.pos, r.symbol, r.completed, r.n_phrases))
    assert {k: sorted(v) for k, v in got.items()} == {k: online_rows(s) for k, s in texts.items()}
    assert max(r.late for r in spark.table("online_test").where("key = 'p'").collect()) >= 1


def run_stream(spark, tmp_path, name, schema, batches, make):
    """What a streaming operator gives over micro-batches of rows."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        time.sleep(0.01)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).collect()


def test_stream_start_reset_and_null_order(spark, tmp_path):
    """A stream that starts from a text, is reset by a null symbol, and meets null and repeated orders, equals the batch trace."""
    schema = "k string, at long, c string"
    batches = [[("p", 1, "a"), ("p", 2, "b"), ("p", None, "x")], [("p", 3, None), ("p", 4, "a"), ("p", 4, "z"), ("p", 2, "z")], [("p", 2**53 + 1, "a"), ("p", 2**53, "b")]]
    got = run_stream(spark, tmp_path, "online_reset", schema, batches, lambda s: lz76_online(s, "k", "c", "at", initial_text="ab"))
    rows = spark.createDataFrame([("p", 1, "a"), ("p", 2, "b"), ("p", 3, None), ("p", 4, "a"), ("p", 5, "b"), ("p", 6, "a")], schema)
    want = online.lz76_trace_symbols(rows, "k", "c", ["at"], "ab").orderBy("segment", "pos").collect()
    assert [(r.pos, r.symbol, r.completed, r.n_phrases) for r in sorted(got, key=lambda r: (r.late, r.pos))] == [(r.pos, r.symbol, r.completed, r.n_phrases) for r in want]
    assert max(r.late for r in got) == 3
    assert [r.text for r in sorted(got, key=lambda r: r.pos) if r.late == 1] == ["a", "ab"]


def test_find_over_a_growing_text(spark, tmp_path):
    batches = [[("p", 1, "b", "ab"), ("p", 2, "a", "ba"), ("q", 1, None, "")], [("p", 4, "n", "aban"), ("p", 3, "n", "ban"), ("p", None, "b", "x"), ("q", 2, "x", "xa")], [("p", 5, None, "nn"), ("p", 6, "c", None), ("p", 7, None, "nnc")]]
    rows = run_stream(spark, tmp_path, "find_test", "k string, at long, c string, p string", batches, lambda s: find_online(s, "k", "c", "at", "p", "a"))
    assert sorted((r.key, r["at"], r.found, r.text_len) for r in rows) == [("p", 1, True, 2), ("p", 2, True, 3), ("p", 3, True, 4), ("p", 4, True, 5), ("p", 5, True, 5), ("p", 7, True, 6), ("q", 1, True, 1), ("q", 2, False, 2)]
    batch = spark.createDataFrame([("p", i, c, p) for i, (c, p) in enumerate([("b", "ba"), ("a", "ba"), (None, "nab"), ("n", None), ("a", "ana"), ("n", "")])], "k string, at long, c string, p string")
    assert [r.found for r in search.find_so_far(batch, "k", "c", ["at"], "p").orderBy("at").collect()] == [False, True, False, None, True, True]


def test_linear_time(spark):
    """Twice the length takes about twice the time: block counts of a long text, and the online parser."""
    took = []
    for n in (150_000, 300_000):
        df = spark.createDataFrame([(1, "é1" * (n // 2))], "k long, text string")
        search.block_counts(df, "k", 3).collect()
        begin = time.perf_counter()
        assert {r.block: r.n for r in search.block_counts(df, "k", 3).collect()} == {"é1é": n // 2 - 1, "1é1": n // 2 - 1}
        took.append(time.perf_counter() - begin)
    assert took[1] < 2.5 * took[0] + 0.5
    took = []
    for n in (100_000, 200_000):
        begin = time.perf_counter()
        parser = OnlineLZ76.of("ab" * (n // 2))
        took.append(time.perf_counter() - begin)
        assert parser.n_phrases == 3
    assert took[1] < 2.5 * took[0] + 0.1


def test_sources_and_report(spark, tmp_path):
    df = strings.from_strings(spark, ["", None, "ab"])
    assert [tuple(r) for r in df.orderBy("string_id").collect()] == [(0, ""), (1, None), (2, "ab")]
    with pytest.raises(TypeError):
        strings.from_strings(spark, [1])
    with pytest.raises(ValueError):
        strings.from_pairs(spark, ["a"], [])
    for kind in ("parquet", "json", "csv", "orc"):
        strings.write_results(df, str(tmp_path / kind), kind)
        options = {"header": "true"} if kind == "csv" else {}
        assert strings.read_strings(spark, str(tmp_path / kind), "s", kind, **options).where("s = 'ab'").count() == 1
    with pytest.raises(ValueError):
        strings.read_strings(spark, "x", format="exe")
    bench = spark.createDataFrame([(100, 10, 1, 4.0, 8.0), (100, 10, 4, 1.0, 4.0)], "n_strings long, string_length int, n_threads int, regular_time double, symmetric_time double")
    rows = report.with_speedups(bench)
    strings.write_results(rows, str(tmp_path / "bench"), "csv")
    back = strings.read_bench(spark, str(tmp_path / "bench"))
    assert back.count() == 2
    assert report.best_by_configuration(back).select("best_speedup", "best_threads", "best_rate").first() == Row(4.0, 4, 100.0)

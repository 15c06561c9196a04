"""Registered queries, each over whole tables and whole texts, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import measures as M
from ..operators import exhaustive, generators, online, search
from ..sources import strings
from . import report, sql

Query = Callable[[SparkSession, str], DataFrame]

#: The texts that measures run over: table, key, string.
TEXTS = {"docs": ("documents", "doc_id", "text"), "parts": ("part", "p_partkey", "p_name"), "customers": ("customer", "c_custkey", "c_name"), "urls": ("pages", "page_id", "url"), "benchmark": ("benchmark", "item_id", "text"), "nations": ("nation", "n_nationkey", "n_name")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal few scan partitions out over the cores before a heavy measure; a scan that is split enough isn't shuffled."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    files = len(df.inputFiles())
    return df if files >= cores else df.repartition(cores * 4)


def r6(value: Column, name: str) -> Column:
    return (F.round(value, 6) + F.lit(0.0)).alias(name)


def _source(texts: str) -> str:
    name, key, text = TEXTS[texts]
    return f"SELECT {key} AS id, {text} AS s FROM {name}"


def _over(texts: str, make: Callable[[str], Column], name: str) -> Query:
    where, key, text = TEXTS[texts]
    return lambda spark, sf_dir: spread(table(spark, sf_dir, where).select(key, text)).select(key, r6(make(text), name))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LZ76 complexity of whole documents, averaged by language."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    rows = docs.select("lang", M.lz76("text").alias("lz76"), F.char_length("text").alias("n"))
    return rows.groupBy("lang").agg(F.count("*").alias("n_docs"), r6(F.avg("lz76"), "avg_lz76"), r6(F.avg(F.col("lz76") / F.greatest("n", F.lit(1))), "avg_density"))


_MEASURES: dict[str, tuple[str, Callable[[str], Column], str]] = {
    # query: texts, column, DuckDB SQL (empty: none, too slow there)
    "lz76_docs": ("docs", M.lz76, sql.measure(_source("docs"), "doc_id", "lz76", "lz76")),
    "lz76_symmetric_docs": ("docs", M.lz76_symmetric, sql.measure(_source("docs"), "doc_id", "lz76_symmetric", "lz76", True)),
    "lz78_docs": ("docs", M.lz78, sql.measure(_source("docs"), "doc_id", "lz78", "lz78")),
    "lz78_symmetric_docs": ("docs", M.lz78_symmetric, ""),
    "lz76_parts": ("parts", M.lz76, sql.measure(_source("parts"), "p_partkey", "lz76", "lz76")),
    "lz76_symmetric_urls": ("urls", M.lz76_symmetric, sql.measure(_source("urls"), "page_id", "lz76_symmetric", "lz76", True)),
    "lz78_customers": ("customers", M.lz78, sql.measure(_source("customers"), "c_custkey", "lz78", "lz78")),
    "lz78_symmetric_benchmark": ("benchmark", M.lz78_symmetric, sql.measure(_source("benchmark"), "item_id", "lz78_symmetric", "lz78", True)),
    **{f"block_entropy_k{k}_docs": ("docs", lambda c, k=k: M.block_entropy(c, k), sql.block_entropy(_source("docs"), "doc_id", "entropy", k)) for k in (1, 2, 3)},
    "block_entropy_symmetric_k2_docs": ("docs", lambda c: M.block_entropy_symmetric(c, 2), sql.block_entropy(_source("docs"), "doc_id", "entropy", 2)),
}


def _value(name: str) -> str:
    return "entropy" if "entropy" in name else name.rsplit("_", 1)[0]


def _mutual_sql(texts: str, key: str) -> str:
    src = _source(texts)
    left, right = f"SELECT id, substring(s, 1, length(s) // 2) AS s FROM ({src})", f"SELECT id, substring(s, length(s) // 2 + 1) AS s FROM ({src})"
    return (
        f"WITH RECURSIVE {sql.lz78(src, '_w')}, {sql.lz78(left, '_l')}, {sql.lz78(right, '_r')} SELECT w.id AS {key}, "
        "round(CASE WHEN w.n < 2 THEN 0 ELSE (l.phrases + r.phrases - w.phrases) / (2.0 * w.phrases) * ln(w.n) END, 6) + 0.0 AS lz78_mutual FROM c78_w w JOIN c78_l l USING (id) JOIN c78_r r USING (id)"
    )


def lz76_phrases_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", M.lz76_phrases("text").alias("phrases"))


def lz76_phrases_expression_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", M.lz76_phrases_expression("p_name").alias("phrases"))


def lz76_dictionary_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.lz76_phrase_rows(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id")


def lz76_dictionary_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.lz76_phrase_rows(table(spark, sf_dir, "benchmark"), "item_id")


def lz78_dictionary_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.lz78_phrase_rows(table(spark, sf_dir, "benchmark"), "item_id")


def lz78_mutual_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", r6(M.lz78_mutual("text"), "lz78_mutual"))


def lz78_mutual_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", r6(M.lz78_mutual("text"), "lz78_mutual"))


def _conditional_turns(algorithm: str) -> Query:
    """Every turn of a conversation given the one before."""
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
        pairs = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("x")).join(turns.withColumnRenamed("text", "y"), ["conv_id", "turn"])
        return spread(pairs).select((F.col("conv_id") * 1000000 + F.col("turn")).alias("turn_key"), r6(M.process_conditional("x", "y", algorithm), "conditional"))

    return query


_TURN_PAIRS = "SELECT b.conv_id * 1000000 + b.turn AS id, a.text AS x, b.text AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn"


def conditional_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's market segment given the name: two tables' strings paired by key, with the check for lone keys."""
    rows = table(spark, sf_dir, "customer")
    return search.conditional_pairs(rows.select("c_custkey", F.col("c_name").alias("x")), rows.select("c_custkey", F.col("c_mktsegment").alias("y")), "c_custkey").select("c_custkey", r6(F.col("conditional"), "conditional"))


def block_entropy_relational_k2_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.block_entropy_relational(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", 2).select("doc_id", r6(F.col("entropy"), "entropy"))


def block_counts_k2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.block_counts(table(spark, sf_dir, "pages").select("page_id", "url"), "page_id", 2, "url")


def complexity_profile_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", M.complexity_profile("text").alias("p"))
    return rows.select("doc_id", *[r6(F.col(f"p.{c}"), c) for c in ("lz76", "lz76_symmetric", "lz78", "lz78_symmetric", "entropy_1", "entropy_2", "entropy_3")])


def utf8_prefix_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", r6(M.lz76("text", "utf8_prefix"), "lz76_bytes"), r6(M.block_entropy("text", 1, "utf8_prefix"), "entropy_bytes"))


def exhaustive_counts_l10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exhaustive.exhaustive_counts(spark, 10)


def exhaustive_counts_by_level_l12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exhaustive.exhaustive_counts_by_level(spark, 12)


def exhaustive_distribution_l16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exhaustive.exhaustive_distribution(spark, 16)


def exhaustive_distribution_l10_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exhaustive.exhaustive_distribution(spark, 10, 4)


def histogram_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many part names have so many LZ76 phrases."""
    return exhaustive.histogram(table(spark, sf_dir, "part").select(M.lz76_phrases("p_name").alias("phrases")), 12)


def pattern_find_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document holds the benchmark item that its id is dealt."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    size = items.agg(F.count("*").alias("size"))
    dealt = docs.select("doc_id", "text").join(F.broadcast(size)).withColumn("item_id", F.pmod("doc_id", "size"))
    return dealt.join(items.select("item_id", F.col("text").alias("pattern")), "item_id").select("doc_id", "item_id", search.contains_pattern("text", "pattern").alias("found"))


def distinct_substrings_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.distinct_substrings(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey", "n_name")


def with_terminator_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ended = table(spark, sf_dir, "part").select("p_partkey", search.with_terminator("p_name").alias("s"))
    return ended.select("p_partkey", F.char_length("s").alias("text_len"), F.contains("s", F.lit("a$")).alias("ends_in_a"))


def _event_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.substring("event_type", 1, 1).alias("letter"))
    return online.symbol_strings(events, "user_id", "letter", ["ts", "event_id"])


def online_trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return online.lz76_trace(_event_strings(spark, sf_dir), "user_id")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.substring("event_type", 1, 1).alias("letter"))


def online_trace_initial_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The online parsing of each user's events after a text seen before."""
    return online.lz76_trace_symbols(_events(spark, sf_dir), "user_id", "letter", ["ts", "event_id"], "cvcp").drop("segment")


def online_trace_reset_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The online parsing of each user's events, reset by every event whose id is divisible by 7."""
    rows = _events(spark, sf_dir).withColumn("letter", F.when(F.col("event_id") % 7 != 0, F.col("letter")))
    return online.lz76_trace_symbols(rows, "user_id", "letter", ["ts", "event_id"])


def growing_find_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether, up to each event, the user has had two events of its kind in a row."""
    rows = _events(spark, sf_dir).withColumn("pattern", F.repeat("letter", F.lit(2)))
    return search.find_so_far(rows, "user_id", "letter", ["ts", "event_id"], "pattern").select("event_id", "user_id", "pattern", "found")


def process_strings_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measure named by its algorithm and symmetry."""
    named = [r6(M.process_strings("p_name", a, s), f"{a}_{'symmetric' if s else 'plain'}") for a in M.ALGORITHMS for s in (False, True)]
    return table(spark, sf_dir, "part").select("p_partkey", *named)


def conditional_identity_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments given names, each empty now and then, by the rule of identity."""
    x = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name"))
    y = F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", r6(M.conditional_lz76(x, y, "identity"), "lz76"), r6(M.conditional_lz78(x, y, "identity"), "lz78"))


def exhaustive_counts_by_level_l13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exhaustive.exhaustive_counts_by_level(spark, 13)


def shared_patterns_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set operations on phrases: LZ76 phrases of parts that are also LZ78 phrases, but no part's first word."""
    rows = table(spark, sf_dir, "part")
    lz76 = rows.select(F.explode(M.lz76_dictionary("p_name")).alias("phrase"))
    lz78 = rows.select(F.explode(M.lz78_dictionary("p_name")).alias("phrase"))
    return lz76.intersect(lz78).exceptAll(rows.select(F.substring_index("p_name", " ", 1).alias("phrase")).distinct())


def event_sequence_lz76(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_strings(spark, sf_dir).select("user_id", F.char_length("s").alias("n_events"), r6(M.lz76("s"), "lz76"))


def order_flags_lz76(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LZ76 phrases of each order's return flags, in line order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    return online.symbol_strings(lines, "l_orderkey", "l_returnflag", ["l_linenumber", "l_partkey"]).select("l_orderkey", M.lz76_phrases("s").alias("phrases"))


def complexity_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("lang", "source", "text")).withColumn("phrases", M.lz76_phrases("text"))
    return docs.rollup("lang", "source").agg(F.count("*").alias("n_docs"), F.sum("phrases").alias("phrases"), F.max("phrases").alias("most"))


def least_complex_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 documents with the fewest LZ76 phrases a symbol."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", r6(M.lz76_phrases("text") / F.greatest(F.char_length("text"), F.lit(1)), "density"))
    return docs.orderBy("density", "doc_id").limit(20)


def complexity_by_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", M.lz76_phrases("text").alias("phrases"))
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("quality", "toxic").agg(F.count("*").alias("n_docs"), F.sum("phrases").alias("phrases"))


def sql_functions_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered SQL functions in a query."""
    M.register(spark)
    table(spark, sf_dir, "part").createOrReplaceTempView("seq_parts")
    return spark.sql("SELECT p_partkey, round(seq_lz76(p_name), 6) + 0.0 AS lz76, round(seq_block_entropy(p_name, 2), 6) + 0.0 AS entropy, seq_lz76_phrases(p_name) AS phrases FROM seq_parts")


def random_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.random_strings(spark, 1000, 10, ("0", "1"), 7, 50, "md5").select("string_id", "s", M.lz76_phrases("s").alias("phrases"))


_BENCH = [(10000, 10, 1, 0.4, 0.6), (10000, 10, 8, 0.1, 0.2), (10000, 100, 1, 5.0, 10.0), (10000, 100, 8, 1.0, 2.0)]


def bench_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(_BENCH, "n_strings long, string_length int, n_threads int, regular_time double, symmetric_time double")
    best = report.best_by_configuration(report.with_speedups(rows))
    return best.select("n_strings", "string_length", "best_threads", *[r6(F.col(c), c) for c in ("best_speedup", "best_rate", "best_symmetric_rate")])


def in_memory_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = strings.from_pairs(spark, ["000", "111", "cat", "", "10101"], ["000111", "111000", "dog", "nonempty", "01010"])
    return pairs.select("pair_id", r6(M.conditional_lz76("x", "y"), "lz76"), r6(M.conditional_lz78("x", "y"), "lz78"))



def queries() -> dict[str, Query]:
    found: dict[str, Query] = {name: _over(texts, make, _value(name)) for name, (texts, make, _) in _MEASURES.items()}
    plain = (
        lz76_phrases_docs, lz76_phrases_expression_parts, lz76_dictionary_docs, lz76_dictionary_benchmark, lz78_dictionary_benchmark, lz78_mutual_benchmark, lz78_mutual_docs, conditional_customers, block_entropy_relational_k2_docs, block_counts_k2_urls,
        complexity_profile_docs, utf8_prefix_docs, exhaustive_counts_l10, exhaustive_counts_by_level_l12, exhaustive_distribution_l16, exhaustive_distribution_l10_overflow, histogram_parts, pattern_find_docs, distinct_substrings_nations, with_terminator_parts,
        online_trace_initial_events, online_trace_reset_events, growing_find_events, process_strings_parts, conditional_identity_customers, exhaustive_counts_by_level_l13, shared_patterns_parts,
        online_trace_events, event_sequence_lz76, order_flags_lz76, complexity_by_lang, least_complex_topk, complexity_by_quality, sql_functions_parts, random_ensemble, bench_report, in_memory_pairs,
    )
    found |= {f.__name__: f for f in plain}
    found |= {"lz76_conditional_turns": _conditional_turns("lz76"), "lz78_conditional_turns": _conditional_turns("lz78"), "flagship_lz76_by_lang": flagship}
    return found


_PAIRS = "SELECT * FROM (VALUES (0, '000', '000111'), (1, '111', '111000'), (2, 'cat', 'dog'), (3, '', 'nonempty'), (4, '10101', '01010')) v(id, x, y)"
_DIGITS = "CAST('0x' || md5(concat_ws(':', {}))[1:8] AS BIGINT)"
_ENSEMBLE = f"SELECT id, (SELECT string_agg(CASE {_DIGITS.format('7, id, i')} % 2 WHEN 0 THEN '0' ELSE '1' END, '' ORDER BY i) FROM range(1, 51) r(i) WHERE i <= 10 + {_DIGITS.format('8, id')} % 41) AS s FROM range(1000) t(id)"
_RESETS = "SELECT user_id * 100000 + segment AS id, string_agg(letter, '' ORDER BY ts, event_id) AS s FROM (SELECT *, event_type[1:1] AS letter, CAST(sum(CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS segment FROM events) WHERE event_id % 7 <> 0 GROUP BY ALL"
_EMPTIES = "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS x, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END AS y FROM customer"
_FLAGS = "SELECT l_orderkey AS id, string_agg(l_returnflag, '' ORDER BY l_linenumber, l_partkey, l_returnflag) AS s FROM lineitem GROUP BY l_orderkey"


def oracle_sql() -> dict[str, str]:
    docs, events = _source("docs"), "SELECT user_id AS id, string_agg(event_type[1:1], '' ORDER BY ts, event_id) AS s FROM events GROUP BY user_id"
    parts = f"WITH RECURSIVE {sql.lz76(_source('parts'))}"
    found = {name: text for name, (_, _, text) in _MEASURES.items() if text}
    d76 = f"WITH RECURSIVE {sql.lz76(docs)}"
    phrase_rows = "SELECT id AS item_id, CAST(row_number() OVER (PARTITION BY id ORDER BY start) - 1 AS INTEGER) AS pos, substring(s, start, size) AS phrase"
    found |= {
        "lz76_phrases_docs": f"{d76} SELECT id AS doc_id, CAST(phrases AS INTEGER) AS phrases FROM c76",
        "lz76_phrases_expression_parts": f"{parts} SELECT id AS p_partkey, CAST(phrases AS INTEGER) AS phrases FROM c76",
        "lz76_dictionary_benchmark": f"WITH RECURSIVE {sql.lz76(_source('benchmark'))}, p AS (SELECT id, start, max(j) AS last FROM run JOIN src USING (id) WHERE j <= length(s) GROUP BY ALL) {phrase_rows} FROM (SELECT id, start, last - start + 1 AS size, s FROM p JOIN src USING (id))",
        "lz78_dictionary_benchmark": f"WITH RECURSIVE {sql.lz78(_source('benchmark'))}, w AS (SELECT id, CASE WHEN open IS NULL THEN known ELSE list_append(known, open) END AS words FROM c78) SELECT id AS item_id, CAST(unnest(range(len(words))) AS INTEGER) AS pos, unnest(words) AS phrase FROM w",
        "lz78_mutual_benchmark": _mutual_sql("benchmark", "item_id"),
        "lz76_conditional_turns": sql.conditional(_TURN_PAIRS, "turn_key", "conditional", "lz76"),
        "lz78_conditional_turns": sql.conditional(_TURN_PAIRS, "turn_key", "conditional", "lz78"),
        "conditional_customers": sql.conditional("SELECT c_custkey AS id, c_name AS x, c_mktsegment AS y FROM customer", "c_custkey", "conditional", "lz76"),
        "block_entropy_relational_k2_docs": sql.block_entropy(docs, "doc_id", "entropy", 2),
        "block_counts_k2_urls": f"SELECT id AS page_id, block, n FROM ({sql.block_counts(_source('urls'), 2)})",
        "exhaustive_counts_l10": f"WITH RECURSIVE {sql.exhaustive(10)} SELECT row_number() OVER (ORDER BY bits) - 1 AS idx, bits, phrases FROM counts",
        "exhaustive_counts_by_level_l12": f"WITH RECURSIVE {sql.exhaustive(12)} SELECT row_number() OVER (ORDER BY bits) - 1 AS idx, bits, phrases FROM counts",
        "exhaustive_distribution_l16": sql.distribution(16, 21),
        "exhaustive_distribution_l10_overflow": sql.distribution(10, 4),
        "histogram_parts": f"{parts} SELECT CAST(b.i AS INTEGER) AS complexity, count(phrases) AS n_strings FROM range(12) b(i) LEFT JOIN c76 ON least(phrases, 11) = b.i GROUP BY b.i",
        "pattern_find_docs": "SELECT doc_id, item_id, contains(d.text, b.text) AS found FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)",
        "distinct_substrings_nations": "SELECT DISTINCT n_nationkey, substring(n_name, i, n) AS substring FROM (SELECT *, unnest(range(0, length(n_name) - i + 2)) AS n FROM (SELECT n_nationkey, n_name, unnest(range(1, length(n_name) + 1)) AS i FROM nation))",
        "with_terminator_parts": "SELECT p_partkey, CAST(length(p_name || '$') AS INTEGER) AS text_len, contains(p_name || '$', 'a$') AS ends_in_a FROM part",
        "online_trace_events": f"""WITH RECURSIVE {sql.lz76(events)} SELECT a.id AS user_id, CAST(a.j - 1 AS BIGINT) AS pos, substring(s, a.j, 1) AS symbol, b.closed > a.closed AS completed, CAST(b.closed + CASE WHEN b.start <= a.j THEN 1 ELSE 0 END AS INTEGER) AS n_phrases
          FROM run a JOIN run b ON a.id = b.id AND b.j = a.j + 1 JOIN src ON src.id = a.id""",
        "event_sequence_lz76": f"WITH RECURSIVE {sql.lz76(events)} SELECT id AS user_id, CAST(n AS INTEGER) AS n_events, round(phrases * log2(n), 6) + 0.0 AS lz76 FROM c76",
        "order_flags_lz76": f"WITH RECURSIVE {sql.lz76(_FLAGS)} SELECT id AS l_orderkey, CAST(phrases AS INTEGER) AS phrases FROM c76",
        "complexity_by_lang": f"{d76} SELECT lang, source, count(*) AS n_docs, CAST(sum(phrases) AS BIGINT) AS phrases, CAST(max(phrases) AS INTEGER) AS most FROM c76 JOIN documents ON id = doc_id GROUP BY ROLLUP (lang, source)",
        "least_complex_topk": f"{d76} SELECT id AS doc_id, round(phrases / greatest(n, 1), 6) + 0.0 AS density FROM c76 ORDER BY density, doc_id LIMIT 20",
        "complexity_by_quality": f"{d76} SELECT quality, toxic, count(*) AS n_docs, CAST(sum(phrases) AS BIGINT) AS phrases FROM c76 JOIN labels ON id = doc_id GROUP BY ALL",
        "sql_functions_parts": f"{parts}, e AS ({sql.block_entropy(_source('parts'), 'id', 'entropy', 2)}) SELECT id AS p_partkey, round(phrases * log2(n), 6) + 0.0 AS lz76, entropy, CAST(phrases AS INTEGER) AS phrases FROM c76 JOIN e USING (id)",
        "flagship_lz76_by_lang": f"{d76} SELECT lang, count(*) AS n_docs, round(avg(phrases * log2(n)), 6) + 0.0 AS avg_lz76, round(avg(phrases * log2(n) / greatest(n, 1)), 6) + 0.0 AS avg_density FROM c76 JOIN documents ON id = doc_id GROUP BY lang",
        "bench_report": f"SELECT n_strings, string_length, arg_max(n_threads, speedup) AS best_threads, round(max(speedup), 6) + 0.0 AS best_speedup, round(max(n_strings / regular_time), 6) + 0.0 AS best_rate, round(max(n_strings / symmetric_time), 6) + 0.0 AS best_symmetric_rate FROM (SELECT *, max(CASE WHEN n_threads = 1 THEN regular_time END) OVER (PARTITION BY n_strings, string_length) / regular_time AS speedup FROM (SELECT CAST(a AS BIGINT) AS n_strings, b AS string_length, c AS n_threads, CAST(d AS DOUBLE) AS regular_time, CAST(e AS DOUBLE) AS symmetric_time FROM (VALUES {', '.join(map(str, _BENCH))}) v(a, b, c, d, e))) GROUP BY ALL",
        "in_memory_pairs": f"SELECT CAST(pair_id AS BIGINT) AS pair_id, lz76, lz78 FROM ({sql.conditional(_PAIRS, 'pair_id', 'lz76', 'lz76')}) JOIN ({sql.conditional(_PAIRS, 'pair_id', 'lz78', 'lz78')}) USING (pair_id)",
        "random_ensemble": f"WITH RECURSIVE {sql.lz76(_ENSEMBLE)} SELECT CAST(id AS BIGINT) AS string_id, s, CAST(phrases AS INTEGER) AS phrases FROM c76 JOIN src USING (id)",
        "online_trace_initial_events": f"""WITH RECURSIVE {sql.lz76(f"SELECT id, 'cvcp' || s AS s FROM ({events})")} SELECT a.id AS user_id, CAST(a.j - 1 AS BIGINT) AS pos, substring(s, a.j, 1) AS symbol, b.closed > a.closed AS completed, CAST(b.closed + CASE WHEN b.start <= a.j THEN 1 ELSE 0 END AS INTEGER) AS n_phrases
          FROM run a JOIN run b ON a.id = b.id AND b.j = a.j + 1 JOIN src ON src.id = a.id WHERE a.j > 4""",
        "online_trace_reset_events": f"""WITH RECURSIVE {sql.lz76(_RESETS)} SELECT a.id // 100000 AS user_id, a.id % 100000 AS segment, CAST(a.j - 1 AS BIGINT) AS pos, substring(s, a.j, 1) AS symbol, b.closed > a.closed AS completed, CAST(b.closed + CASE WHEN b.start <= a.j THEN 1 ELSE 0 END AS INTEGER) AS n_phrases
          FROM run a JOIN run b ON a.id = b.id AND b.j = a.j + 1 JOIN src ON src.id = a.id""",
        "growing_find_events": "SELECT event_id, user_id, pattern, contains(spelled, pattern) AS found FROM (SELECT event_id, user_id, repeat(event_type[1:1], 2) AS pattern, string_agg(event_type[1:1], '') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spelled FROM events)",
        "process_strings_parts": "SELECT * FROM " + " JOIN ".join(f"({sql.measure(_source('parts'), 'p_partkey', f'{a}_{n}', a, n == 'symmetric')}) {a}{n}" + ("" if (a, n) == ("lz76", "plain") else " USING (p_partkey)") for a in M.ALGORITHMS for n in ("plain", "symmetric")),
        "conditional_identity_customers": f"SELECT * FROM ({sql.conditional_identity(_EMPTIES, 'c_custkey', 'lz76', 'lz76')}) JOIN ({sql.conditional_identity(_EMPTIES, 'c_custkey', 'lz78', 'lz78')}) USING (c_custkey)",
        "exhaustive_counts_by_level_l13": f"WITH RECURSIVE {sql.exhaustive(13)} SELECT row_number() OVER (ORDER BY bits) - 1 AS idx, bits, phrases FROM counts",
        "shared_patterns_parts": f"""WITH RECURSIVE {sql.lz76(_source('parts'))}, {sql.lz78(_source('parts'))}, a AS (SELECT id, start, max(j) AS last FROM run JOIN src USING (id) WHERE j <= length(s) GROUP BY ALL), w AS (SELECT CASE WHEN open IS NULL THEN known ELSE list_append(known, open) END AS words FROM c78)
          SELECT substring(s, start, last - start + 1) AS phrase FROM a JOIN src USING (id) INTERSECT SELECT unnest(words) FROM w EXCEPT SELECT split_part(p_name, ' ', 1) FROM part""",
    }
    return found

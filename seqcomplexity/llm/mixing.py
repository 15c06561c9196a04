"""Mixing sources to target weights by temperature.

Each source's share of the tokens is raised to an exponent and normalised. The exponent is bisected between 0 (uniform) and 1 (the
natural shares) to the largest entropy that no source's repetition forbids: the mix meets a target entropy (a fraction of the
uniform one), or, if that repeats some source too often, the smallest exponent within the repetition limit. Weights become
budgets of tokens, and budgets are realised as block permutations: a source's documents are dealt into blocks, every
epoch visits all blocks in an order of its own, and the last epoch stops within one block where the budget ends.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Tokens of a block, about: what one window task sorts.
BLOCK_TOKENS = 1 << 17
TARGET_ENTROPY, MAX_EPOCHS = 0.999, 2.0
#: Steps of the bisection; the exponent is then rounded to six places.
STEPS = 50
#: Parts of an epoch's order of blocks.
STRETCHES = 256


def _entropy(weights: list[float]) -> float:
    return -math.fsum(w * math.log(w) for w in weights if w > 0)


def temperature_weights(sizes: dict, alpha: float) -> dict:
    """Normalised shares to the power ``alpha``; sources without tokens get none."""
    whole = sum(sizes.values())
    raised = {s: (n / whole) ** alpha if n > 0 else 0.0 for s, n in sizes.items()}
    norm = math.fsum(raised.values())
    return {s: x / norm if norm else 0.0 for s, x in raised.items()}


def epochs_of(sizes: dict, alpha: float) -> dict:
    """Passes over each source when the budget is the least that passes over every source at least once."""
    weights = temperature_weights(sizes, alpha)
    budget = max((n / weights[s] for s, n in sizes.items() if n > 0), default=0.0)
    return {s: budget * weights[s] / n for s, n in sizes.items() if n > 0}


def bisect_exponent(sizes: dict, target_entropy: float = TARGET_ENTROPY, max_epochs: float = MAX_EPOCHS) -> float:
    """The largest exponent whose entropy reaches ``target_entropy`` of the uniform one, or the smallest within ``max_epochs``, if that is larger."""
    live = [n for n in sizes.values() if n > 0]
    if len(live) < 2 or min(live) == max(live):
        return 1.0
    goal = target_entropy * math.log(len(live))

    def largest(holds) -> float:
        low, high = 0.0, 1.0
        if holds(high):
            return high
        for _ in range(STEPS):
            middle = (low + high) / 2
            low, high = (middle, high) if holds(middle) else (low, middle)
        return low

    by_entropy = largest(lambda a: _entropy(list(temperature_weights(sizes, a).values())) >= goal)
    by_repeats = 1.0 - largest(lambda b: max(epochs_of(sizes, 1.0 - b).values()) <= max_epochs)
    return math.ceil(max(by_entropy, by_repeats) * 1e6 - 1e-4) / 1e6


def _fraction(*parts: Column | str) -> Column:
    """A number from 0 to 2 ** 32 - 1 from an MD5 over the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string") if isinstance(p, Column) else F.col(p).cast("string"), F.lit("null")) for p in parts])), 1, 8), 16, 10).cast("long")


def mix_plan(docs: DataFrame, tokens: Column | str, target_entropy: float = TARGET_ENTROPY, max_epochs: float = MAX_EPOCHS, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The mix as rows ``doc_id, copy, source, n_tokens, epoch, epoch_block, block, place, position``: a document each time it is visited.

    The budget is the least that passes over every source at least once, so nothing is dropped, and sources of smaller shares are
    repeated up to ``max_epochs`` times. ``epoch_block`` is the place of the block in its epoch, ``place`` that of the document in the
    block. A null source is a source of its own; a negative or null token count is 0, and documents without tokens stand once
    in the first epoch. Rows that repeat id, source and count are counted first and told apart by ``copy`` (from 1). Other columns
    are ignored; an empty table gives an empty table.

    No task sees a whole source: blocks follow from a hash of document and copy, and an epoch's order of blocks, which follows from
    a hash too, is summed in ``STRETCHES`` parts of its range first and then within each.
    """
    n = tokens if isinstance(tokens, Column) else F.col(tokens)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.greatest(F.coalesce(n.cast("long"), F.lit(0)), F.lit(0)).alias("n_tokens"))
    rows = rows.groupBy("doc_id", "source", "n_tokens").agg(F.count("*").alias("copies"))
    totals = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("n")).collect()}
    alpha = bisect_exponent(totals, target_entropy, max_epochs)
    passes = epochs_of(totals, alpha)
    spark = docs.sparkSession
    # Source statistics: one row for each source.
    budgets = spark.createDataFrame([(s, t, max(1, math.ceil(t / block_tokens)), max(t, math.floor(passes.get(s, 1.0) * t + 1e-6))) for s, t in totals.items()], "s string, total long, blocks long, budget long")

    each = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    each = each.join(budgets, F.col("source").eqNullSafe(F.col("s"))).withColumn("block", F.pmod(_fraction(F.lit("block"), "source", "doc_id", "copy"), "blocks"))
    blocks = each.groupBy("source", "block", "total", "budget").agg(F.sum("n_tokens").alias("block_tokens"))
    # Full epochs take every block; the last epoch's blocks are taken in its order until the rest of the budget is spent.
    full = F.when(F.col("total") > 0, F.floor(F.col("budget") / F.greatest("total", F.lit(1)))).otherwise(1)
    rest = F.when(F.col("total") > 0, F.col("budget") % F.greatest("total", F.lit(1))).otherwise(0)
    blocks = blocks.withColumn("full", full.cast("int")).withColumn("rest", rest.cast("long")).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("full") - F.when(F.col("rest") > 0, 0).otherwise(1))))
    blocks = blocks.withColumn("draw", _fraction(F.lit("order"), "source", "epoch", "block")).withColumn("stretch", F.floor(F.col("draw") * STRETCHES / (1 << 32)))
    parts = blocks.groupBy("source", "epoch", "stretch").agg(F.sum("block_tokens").alias("part_tokens"), F.count("*").alias("part_blocks"))
    ahead = W.partitionBy("source", "epoch").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(F.col("source").alias("s"), F.col("epoch").alias("e"), F.col("stretch").alias("r"), F.coalesce(F.sum("part_tokens").over(ahead), F.lit(0)).alias("part_start"), F.coalesce(F.sum("part_blocks").over(ahead), F.lit(0)).alias("part_first"))
    within = W.partitionBy("source", "epoch", "stretch").orderBy("draw", "block")
    blocks = blocks.withColumn("nth", F.row_number().over(within) - 1).withColumn("prior", F.coalesce(F.sum("block_tokens").over(within.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    blocks = blocks.join(parts, F.col("source").eqNullSafe(F.col("s")) & (F.col("epoch") == F.col("e")) & (F.col("stretch") == F.col("r")))
    blocks = blocks.withColumn("epoch_block", (F.col("part_first") + F.col("nth")).cast("int")).withColumn("before", F.col("part_start") + F.col("prior"))
    blocks = blocks.where((F.col("epoch") < F.col("full")) | (F.col("before") < F.col("rest"))).select(F.col("source").alias("of"), F.col("block").alias("b"), "epoch", "epoch_block", "before", "full", "rest", "total", "budget")

    visits = each.select("doc_id", "copy", "source", "n_tokens", "block").join(blocks, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("b")))
    in_block = W.partitionBy("source", "block", "epoch").orderBy(_fraction(F.lit("place"), "source", "epoch", "doc_id", "copy"), "doc_id", "copy", "n_tokens")
    visits = visits.withColumn("place", F.row_number().over(in_block) - 1).withColumn("spent", F.col("before") + F.coalesce(F.sum("n_tokens").over(in_block.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = (F.col("epoch") < F.col("full")) | (F.col("spent") + F.col("n_tokens") <= F.col("rest")) & (F.col("n_tokens") > 0)
    # Where the visit stands in its source's budget, from 0 to 1: in this order the sources are mixed at every point as in the whole.
    position = F.when(F.col("budget") > 0, (F.col("epoch") * F.col("total") + F.col("before")) / F.col("budget")).otherwise(0.0)
    return visits.where(inside).select("doc_id", "copy", "source", "n_tokens", "epoch", "epoch_block", F.col("block").cast("long").alias("block"), "place", position.alias("position"))


def word_tokens(text: str = "text") -> Column:
    """Tokens of a text for weighing: runs of characters without white space."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


MIX = ("mix_epoch", "mix_epoch_block", "mix_block", "mix_place", "mix_position")


def mix_documents(docs: DataFrame, target_entropy: float = TARGET_ENTROPY, max_epochs: float = MAX_EPOCHS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``docs`` as the mix visits them: a row for each visit, with ``mix_epoch, mix_epoch_block, mix_block, mix_place, mix_position``.

    Partitions follow each other in order of position (0 to 1, the part of its source's budget that comes before a block), and rows
    stand block by block within them, in each block by place: written out, the table holds the mix in its order. Every row is
    visited at least once. Columns of these names are replaced; a null source is one of its own, null and empty texts have no
    tokens and stand once; rows that repeat id, source and token count are numbered by their texts and visited each; an empty
    table gives an empty table."""
    docs = docs.drop(*MIX)
    rows = docs.withColumn("_tokens", word_tokens())
    plan = mix_plan(rows, "_tokens", target_entropy, max_epochs, block_tokens)
    plan = plan.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("n_tokens").alias("_n"), F.col("copy").alias("_copy"), *[F.col(c[4:]).alias(c) for c in MIX])
    # Only rows that repeat id, source and count need numbers.
    same = ("_rid", "_rsource", "_tokens")
    rows = rows.withColumn("_rid", F.col("doc_id").cast("long")).withColumn("_rsource", F.col("source").cast("string"))
    repeated = rows.groupBy(*same).agg(F.count("*").alias("_rows")).where("_rows > 1").select(F.col("_rid").alias("_ri"), F.col("_rsource").alias("_rs"), F.col("_tokens").alias("_rt"))
    is_repeated = F.col("_rid").eqNullSafe(F.col("_ri")) & F.col("_rsource").eqNullSafe(F.col("_rs")) & (F.col("_tokens") == F.col("_rt"))
    if repeated.isEmpty():
        numbered = rows.withColumn("_nth", F.lit(1))
    else:
        number = F.row_number().over(W.partitionBy(*same).orderBy(F.xxhash64("text")))
        numbered = rows.join(repeated, is_repeated, "left_anti").withColumn("_nth", F.lit(1)).unionByName(rows.join(repeated, is_repeated, "left_semi").withColumn("_nth", number))
    here = F.col("_rid").eqNullSafe(F.col("_id")) & F.col("_rsource").eqNullSafe(F.col("_source")) & (F.col("_tokens") == F.col("_n")) & (F.col("_nth") == F.col("_copy"))
    visits = numbered.join(plan, here)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ("mix_position", "_source", "mix_epoch", "mix_epoch_block", "mix_place")
    ordered = visits.repartitionById(parts, F.least(F.floor(F.col("mix_position") * parts), F.lit(parts - 1)).cast("int")).sortWithinPartitions(*order)
    return ordered.select(*docs.columns, *MIX)


_HASH = "CAST('0x' || md5(concat_ws(':', {}))[1:8] AS BIGINT)"
_H = "(-list_sum(list_transform(list_transform(p, lambda x: pow(x, {a}) / list_sum(list_transform(p, lambda y: pow(y, {a})))), lambda w: w * ln(w))))"
# Passes over source i: its weight over its size, times the largest size over weight.
_E = "(list_max(list_transform(p, lambda x: pow(x, {a} - 1))) * list_max(list_transform(p, lambda x: pow(x, 1 - ({a})))))"
ORACLE = rf"""
WITH RECURSIVE t AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
r AS (SELECT doc_id, source, n_tokens, count(*) AS copies FROM t GROUP BY ALL),
z AS (SELECT source, CAST(sum(n_tokens * copies) AS BIGINT) AS total FROM r GROUP BY source),
s AS MATERIALIZED (SELECT list(total / whole ORDER BY source) AS p, {TARGET_ENTROPY} * ln(count(*)) AS goal FROM (SELECT source, total, sum(total) OVER () AS whole FROM z) WHERE total > 0),
e(step, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
  SELECT step + 1, CASE WHEN {_H.format(a='(lo + hi) / 2')} >= goal THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {_H.format(a='(lo + hi) / 2')} >= goal THEN hi ELSE (lo + hi) / 2 END FROM e, s WHERE step < {STEPS}
), m(step, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
  SELECT step + 1, CASE WHEN {_E.format(a='(1 - (lo + hi) / 2)')} <= {MAX_EPOCHS} THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {_E.format(a='(1 - (lo + hi) / 2)')} <= {MAX_EPOCHS} THEN hi ELSE (lo + hi) / 2 END FROM m, s WHERE step < {STEPS}
), a AS MATERIALIZED (
  SELECT ceil(greatest(CASE WHEN {_H.format(a='1.0')} >= goal THEN 1.0 ELSE (SELECT lo FROM e WHERE step = {STEPS}) END, 1.0 - CASE WHEN {_E.format(a='0.0')} <= {MAX_EPOCHS} THEN 1.0 ELSE (SELECT lo FROM m WHERE step = {STEPS}) END) * 1e6 - 1e-4) / 1e6 AS alpha, p FROM s
), u AS (
  SELECT source, total, CAST(greatest(1, ceil(total / {BLOCK_TOKENS})) AS BIGINT) AS blocks,
    CASE WHEN total > 0 THEN greatest(total, CAST(floor(pow(total / (SELECT sum(total) FROM z), alpha - 1) * list_max(list_transform(p, lambda x: pow(x, 1 - alpha))) * total + 1e-6) AS BIGINT)) ELSE 0 END AS budget FROM z, a
), c AS (SELECT doc_id, source, n_tokens, unnest(range(1, copies + 1)) AS copy FROM r),
d AS (SELECT c.*, total, budget, {_HASH.format("'block', coalesce(c.source, 'null'), coalesce(CAST(doc_id AS VARCHAR), 'null'), copy")} % blocks AS block FROM c JOIN u ON c.source IS NOT DISTINCT FROM u.source),
b AS (SELECT source, block, total, budget, sum(n_tokens) AS tokens, CASE WHEN total > 0 THEN budget // total ELSE 1 END AS full_epochs, CASE WHEN total > 0 THEN budget % total ELSE 0 END AS rest FROM d GROUP BY source, block, total, budget),
f AS (SELECT *, unnest(range(0, full_epochs + CASE WHEN rest > 0 THEN 1 ELSE 0 END)) AS epoch FROM b),
g AS (
  SELECT *, row_number() OVER o - 1 AS epoch_block, coalesce(sum(tokens) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM f WINDOW o AS (PARTITION BY source, epoch ORDER BY {_HASH.format("'order', coalesce(source, 'null'), epoch, block")}, block)
), v AS (
  SELECT d.doc_id, d.copy, d.source, d.n_tokens, g.epoch, g.epoch_block, d.block, g.full_epochs, g.rest, g.total, g.budget, g.before, row_number() OVER o - 1 AS place, g.before + coalesce(sum(d.n_tokens) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source AND d.block = g.block WHERE g.epoch < g.full_epochs OR g.before < g.rest
  WINDOW o AS (PARTITION BY d.source, d.block, g.epoch ORDER BY {_HASH.format("'place', coalesce(d.source, 'null'), g.epoch, coalesce(CAST(d.doc_id AS VARCHAR), 'null'), d.copy")}, d.doc_id, d.copy, d.n_tokens)
)
SELECT doc_id, CAST(copy AS INTEGER) AS copy, source, n_tokens, CAST(epoch AS INTEGER) AS epoch, CAST(epoch_block AS INTEGER) AS epoch_block, CAST(block AS BIGINT) AS block, CAST(place AS INTEGER) AS place,
  CASE WHEN budget > 0 THEN (epoch * total + before) / budget ELSE 0 END::DOUBLE AS position
FROM v WHERE epoch < full_epochs OR spent + n_tokens <= rest AND n_tokens > 0
"""

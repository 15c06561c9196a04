"""Approximate nearest neighbours by additive quantisation.

A vector, scaled to length one, is approximated by a sum of one entry from each of ``BOOKS`` full-dimensional codebooks. The
codebooks are fitted on residuals, one after the other, on a bounded sample; a beam search keeps the best ``BEAM`` partial sums
while it encodes every vector. Codes are stored with the norm of the sum, so that the inner product of a query with the
approximation, over that norm, needs only a table of the query's products with all entries. The best ``RERANK`` candidates of
each query by this score, of all rows, are ranked by their exact cosine.

The codes decide: vectors themselves meet queries only in the reranking. Codes are dealt into blocks and queries into tiles by a
hash; every tile meets every block, and what a block returns for a query are its best codes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drawn_rows, materialize, runs

BOOKS, ENTRIES, BEAM = 24, 256, 4
#: Vectors that the codebooks are fitted on, about (twice as many at most), drawn by a hash; every row is indexed.
FIT_ROWS = 8192
#: Candidates of a query, of all rows, that are ranked exactly.
RERANK = 100
#: Codes of a block (a thirty-second of all rows within these bounds), and queries of a tile.
BLOCK, LARGEST_BLOCK, TILE = 4096, 1 << 16, 2048
#: Queries scored at once.
_AT_ONCE = 64


def _kmeans(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    if not len(points):
        return np.zeros((k, points.shape[1]), np.float32)
    centres = points[rng.choice(len(points), k, replace=len(points) < k)].copy()
    for _ in range(rounds):
        near = _closest(points, centres)
        counts, order = np.bincount(near, minlength=k), np.argsort(near, kind="stable")
        some = np.flatnonzero(counts)
        sums = np.zeros_like(centres)
        sums[some] = np.add.reduceat(points[order], (np.cumsum(counts) - counts)[some], 0)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], points[rng.choice(len(points), k)]).astype(np.float32)
    return centres


def _closest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(points @ centres.T - 0.5 * (centres**2).sum(1), 1)


@dataclass
class AdditiveQuantizer:
    books: np.ndarray  # [book, entry, dimension], 32-bit

    @staticmethod
    def fit(vectors: np.ndarray, books: int = BOOKS, entries: int = ENTRIES, seed: int = 0) -> AdditiveQuantizer:
        """Codebooks by k-means, each on the residuals that the nearest entries of the earlier ones leave."""
        rng, fitted, rest = np.random.default_rng(seed), [], vectors.astype(np.float32)
        for _ in range(books):
            fitted.append(_kmeans(rest, entries, rng))
            if len(rest):
                rest = rest - fitted[-1][_closest(rest, fitted[-1])]
        return AdditiveQuantizer(np.stack(fitted))

    def encode(self, vectors: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes of each vector by beam search: all one-entry extensions of the kept partial sums compete, book by book."""
        out = np.zeros((len(vectors), len(self.books)), np.uint8)
        sizes = (self.books**2).sum(2)
        for at in range(0, len(vectors), 512):
            rest = vectors[at:at + 512].astype(np.float32)[:, None, :]
            n = len(rest)
            rows = np.arange(n)[:, None]
            codes = np.zeros((n, 1, 0), np.uint8)
            for book, size in zip(self.books, sizes):
                cost = rest @ book.T
                cost *= -2
                cost += (rest**2).sum(2)[:, :, None]
                cost += size
                width = min(beam, cost.shape[1] * cost.shape[2])
                best = np.argpartition(cost.reshape(n, -1), width - 1, 1)[:, :width]
                source, entry = best // len(book), best % len(book)
                codes = np.concatenate([codes[rows, source], entry[:, :, None].astype(np.uint8)], 2)
                rest = rest[rows, source] - book[entry]
            out[at:at + n] = codes[np.arange(n), np.argmin((rest**2).sum(2), 1)]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.books[np.arange(len(self.books)), codes].sum(1)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """[query, book, entry]: inner products with every entry."""
        return np.einsum("qd,bed->qbe", queries, self.books)


def best_codes(tables: np.ndarray, codes: np.ndarray, norms: np.ndarray, barred: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query (a row of ``tables``) the indexes of the ``keep`` best codes and their scores, ties to the first; ``barred`` pairs and missing ones score -inf."""
    score = np.zeros((len(tables), len(codes)), np.float32)
    for b in range(codes.shape[1]):
        score += tables[:, b, :][:, codes[:, b]]
    score /= norms
    score[barred] = -np.inf
    if keep >= len(codes):
        found = np.argsort(-score, 1, kind="stable")
    else:
        least = np.partition(score, len(codes) - keep, 1)[:, len(codes) - keep]
        found = np.empty((len(tables), keep), np.int64)
        for i in range(len(tables)):
            over = np.flatnonzero(score[i] > least[i])
            found[i] = np.concatenate([over, np.flatnonzero(score[i] == least[i])[:keep - len(over)]])
    return found, np.take_along_axis(score, found, 1)


def nearest_neighbours(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", fit_rows: int = FIT_ROWS, rerank: int = RERANK) -> DataFrame:
    """``query_id, rank, vec_id, score`` and ``aq_score``: for each vector whose id is divisible by ``every``, its ``k`` nearest others by cosine.

    Nearest first, ties to the smaller id; all candidates, if there are fewer. Vectors that are null, empty, zero, or hold null or
    non-finite components take no part, nor do those of another dimension than the most frequent (the smaller, if tied) or
    with a null id. Ids are taken as unique keys of candidates: rows that repeat an id and a vector count once, and a query is
    never its own neighbour. Scores are of the original components, in double precision. Other columns are ignored; an empty
    table gives an empty table.

    A block keeps more of its codes for a query than its share of ``rerank`` by six standard deviations and eight, as blocks are
    dealt by a hash; the best of all blocks are then the best of all rows.
    """
    spark = vectors.sparkSession
    wide = vectors.schema[vector_col].dataType.elementType.simpleString() != "float"
    number = np.dtype("<f8" if wide else "<f4")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>" if wide else "array<float>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    sizes = sorted(rows.groupBy(F.size("v").alias("d")).count().collect(), key=lambda r: (-r["count"], r["d"]))
    schema = "query_id long, rank int, vec_id long, score double, aq_score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    dimension, count = sizes[0]["d"], sizes[0]["count"]
    rows = rows.where(F.size("v") == dimension).withColumn("name", F.xxhash64("v"))

    def units(v: np.ndarray) -> np.ndarray:
        v = v / np.abs(v).max(1, keepdims=True)  # lest squares over- or underflow
        return (v / np.sqrt((v * v).sum(1))[:, None]).astype(np.float32)

    sample = drawn_rows(rows, F.xxhash64("vec_id", "name"), fit_rows, count, ["vec_id", "name"]).select("vec_id", "name", "v").toArrow()
    fit = np.array(sample["v"].combine_chunks().flatten().to_numpy(), np.float64).reshape(-1, dimension)
    quantizer = spark.sparkContext.broadcast(AdditiveQuantizer.fit(units(fit[np.lexsort((sample["name"].to_numpy(), sample["vec_id"].to_numpy()))])))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column(1).flatten().to_numpy().reshape(-1, dimension)
            codes = quantizer.value.encode(units(v.astype(np.float64)))
            norms = np.linalg.norm(quantizer.value.decode(codes).astype(np.float64), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x.tobytes() for x in v.astype(number)], pa.binary()), pa.array([x.tobytes() for x in codes], pa.binary()), pa.array(np.maximum(norms, 1e-12))], ["vec_id", "name", "raw", "codes", "norm"])

    index = materialize(rows.select("vec_id", "v", "name").mapInArrow(encode, "vec_id long, name long, raw binary, codes binary, norm double"), "aq-index")
    codes = index.groupBy("vec_id", "name").agg(F.first("codes").alias("codes"), F.first("norm").alias("norm"))
    asked = index.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id", "name").agg(F.first("raw").alias("raw"))
    queries = asked.count()
    blocks = -(-count // min(LARGEST_BLOCK, max(BLOCK, count // 32)))
    tiles = max(1, -(-queries // TILE))
    keep = min(rerank, math.ceil(rerank / blocks + 6 * math.sqrt(rerank / blocks) + 8))
    dealt = lambda name, parts: F.pmod(F.xxhash64("vec_id", "name", F.lit(name)), F.lit(parts)).cast("int")
    spread = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    candidates = codes.select("vec_id", "name", "codes", "norm", F.lit(None).cast("binary").alias("raw"), dealt("block", blocks).alias("block"), spread(tiles).alias("tile"))
    asks = asked.select("vec_id", "name", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("norm"), "raw", dealt("tile", tiles).alias("tile"), spread(blocks).alias("block"))

    def search(key: tuple, table: pa.Table) -> pa.Table:
        is_query = table["raw"].is_valid()
        held, asking = table.filter(pc.invert(is_query)), table.filter(is_query)
        held = held.take(pc.sort_indices(held, [("vec_id", "ascending"), ("name", "ascending")]))
        ids, names, norms = (held[c].to_numpy() for c in ("vec_id", "name", "norm"))
        packed = np.frombuffer(b"".join(held["codes"].to_pylist()), np.uint8).reshape(len(ids), -1)
        query_ids, query_names = asking["vec_id"].to_numpy(), asking["name"].to_numpy()
        out: list[list] = [[], [], [], [], []]
        for at in range(0, len(query_ids) if len(ids) else 0, _AT_ONCE):
            q = units(np.frombuffer(b"".join(asking["raw"].slice(at, _AT_ONCE).to_pylist()), number).reshape(-1, dimension).astype(np.float64))
            own = query_ids[at:at + _AT_ONCE]
            found, score = best_codes(quantizer.value.tables(q), packed, norms.astype(np.float32), own[:, None] == ids, keep)
            real = np.isfinite(score)
            who = np.repeat(np.arange(len(q)), real.sum(1))
            for column, value in zip(out, (own[who], query_names[at:at + _AT_ONCE][who], ids[found[real]], names[found[real]], score[real])):
                column.append(value)
        kinds = (np.int64, np.int64, np.int64, np.int64, np.float64)
        return pa.table([np.concatenate(c).astype(t) if c else np.zeros(0, t) for c, t in zip(out, kinds)], ["query_id", "query_name", "vec_id", "name", "aq_score"])

    found = candidates.unionByName(asks).groupBy("block", "tile").applyInArrow(search, "query_id long, query_name long, vec_id long, name long, aq_score double")
    nearest = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("aq_score")).alias("far"), "vec_id", "name"))), 1, rerank)
    best = found.groupBy("query_id", "query_name").agg(nearest.alias("best")).select("query_id", "query_name", F.explode("best").alias("c"))
    best = materialize(best.select("query_id", "query_name", "c.vec_id", "c.name", (-F.col("c.far")).alias("aq_score")), "aq-best")
    raws = index.groupBy("vec_id", "name").agg(F.first("raw").alias("raw"))
    near = best.join(raws, ["vec_id", "name"]).select("query_id", "query_name", F.lit(True).alias("found"), "vec_id", "aq_score", "raw")
    own = asked.select(F.col("vec_id").alias("query_id"), F.col("name").alias("query_name"), F.lit(False).alias("found"), "vec_id", F.lit(0.0).alias("aq_score"), "raw")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, 2):
            asker, named = table["query_id"].to_numpy(), table["query_name"].to_numpy()
            is_found, ids, rough = (table[c].to_numpy() for c in ("found", "vec_id", "aq_score"))
            raw = np.frombuffer(b"".join(table["raw"].to_pylist()), number).reshape(-1, dimension).astype(np.float64)
            new = np.concatenate([[True], (asker[1:] != asker[:-1]) | (named[1:] != named[:-1])])
            query = raw[np.flatnonzero(new)][np.cumsum(new) - 1]  # a query's own row comes first
            score = cosines(raw, query)
            order = np.lexsort((ids, -score, asker))
            order = order[is_found[order]]
            yield pa.RecordBatch.from_arrays([pa.array(c[order]) for c in (asker, ids, score, rough)], ["query_id", "vec_id", "score", "aq_score"])

    ranked = near.unionByName(own).repartition("query_id", "query_name").sortWithinPartitions("query_id", "query_name", "found").mapInArrow(rank, "query_id long, vec_id long, score double, aq_score double")
    once = ranked.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.max("aq_score").alias("aq_score"))
    first = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id", "score", "aq_score"))), 1, k)
    listed = once.groupBy("query_id").agg(first.alias("top")).select("query_id", F.posexplode("top").alias("place", "n"))
    return listed.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("n.vec_id").alias("vec_id"), F.col("n.score").alias("score"), F.col("n.aq_score").alias("aq_score"))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of rows, in double precision; rows whose squares would over- or underflow are scaled by powers of two first, which is exact."""
    def fit(v: np.ndarray) -> np.ndarray:
        most = np.abs(v).max(1)
        odd = (most > 1e150) | (most < 1e-150)
        return v if not odd.any() else v * np.where(odd, np.exp2(-np.floor(np.log2(most))), 1.0)[:, None]

    x, y = fit(x), fit(y)
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))

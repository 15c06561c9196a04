"""N-gram Jaccard join with count-vector R-trees.

A document's set holds the hashes of its distinct word n-grams. The hashes fall into ``GROUPS`` groups; the counts by
group are a point, and the summed coordinate minima of two points bound the overlap of their sets from above. Points that
can meet at all are brought together by the prefix principle: in one global order of n-grams, two sets of the wanted
similarity share an n-gram among the first few of each (``n - ceil(t * n) + 1``). The order puts n-grams counted often last,
so frequent passages bring nothing together. Within each such bucket an R-tree over the points finds the pairs whose
bound suffices, and the survivors are verified on the sets themselves.

No link between different sets is lost, yet nothing lists all pairs of a large group. In rounds, each set names the partner of
the largest bound in another family, and families merge, until no pair across families passes the bound. Then every family is
verified by itself: its texts meet tile by tile, and only links that join what wasn't joined come out. Equal sets are one node
from the start. A group too large for one tile is first compared with a few of its members, in parts; what they join needs no
further comparison within, so a large group of near copies costs in proportion to its members, and only tiles of different
components meet.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BASE, M1, M2, bloom_filter, bloom_hits, chunks, connected_components, drop_materialized, flat_bytes, lean, materialize, mix, powers, runs, sifted, utf8

GROUPS = 64
#: Points of an R-tree page, and children of an inner node.
PAGE = 16
#: Members of a bucket in one tile; n-grams of more documents are dealt out as groups of several tiles from the start.
TILE = 2048
#: Members of a family in one tile, for count vectors and for texts.
FINE_TILE, FAMILY_TILE = 512, 256
#: N-grams of all sets of a tile, on the average: fewer members share a tile where sets are large.
TILE_GRAMS = 1 << 22
#: Members that a group of several tiles is compared with first, and how often.
PIVOTS, PIVOT_ROUNDS = 8, 2
#: In a group that is verified, a member that so many sets hold is rare: its pairs are listed.
RARE = 16
#: Every round at least halves the families that others are near to.
MAX_ROUNDS = 40
#: N-grams whose counts steer the order: a bound on what is broadcast (16 bytes each).
ORDERED_LAST = 1 << 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of documents laid end to end: runs of bytes other than white space (space, 9 to 13)."""
    space = _SPACE[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(~space & (np.concatenate([[True], space[:-1]])[:len(raw)] | first[:-1]))
    ends = np.flatnonzero(~space & (np.concatenate([space[1:], [True]])[:len(raw)] | first[1:])) + 1
    return starts, ends


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, with A to Z lowered, and the number of each document's first word (and of the end)."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    starts, ends = word_bounds(raw, offsets)
    power, inverse = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts]), np.searchsorted(starts, offsets)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """For each document the sorted hashes of its distinct n-grams; with fewer words the whole sequence is one, without words none."""
    hashes, at = word_hashes(raw, offsets)
    if len(hashes) >= words:
        grams = np.zeros(len(hashes) - words + 1, np.uint64)
        for i in range(words):
            grams = (grams + hashes[i:i + len(grams)]) * M2 + np.uint64(i + 1)
        grams = mix(grams)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(grams[a:b - words + 1]))
        elif b > a:
            one = np.zeros(1, np.uint64)
            for i in range(a, b):
                one = (one + hashes[i:i + 1]) * M1 + np.uint64(b - a)
            out.append(mix(one))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """Ids and sets of the documents, chunk by chunk, from batches of ``doc_id, text``."""
    for batch in batches:
        raw, offsets = flat_bytes(batch.column(1))
        for a, b in chunks(np.diff(offsets)):
            yield batch.column(0).slice(a, b - a), shingle_sets(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], words)


def _node(one: np.ndarray) -> int:
    """A set's 64-bit name."""
    total = np.uint64((int(one.sum(dtype=np.uint64)) + len(one) * BASE) % (1 << 64))
    return int(mix(np.array([total ^ np.bitwise_xor.reduce(mix(one + np.uint64(7)))], np.uint64)).view(np.int64)[0])


def frequent_grams(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of n-grams that stand in many documents, with the logarithm of their counts.

    Every document is counted. A batch reports the n-grams that at least four and a thousandth of its documents hold,
    which bounds the report by a thousand times the mean set; the sums only steer an order, so what is missed or cut
    at ``ORDERED_LAST`` costs time and no link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [s for _, sets in _sets(iter([batch]), words) for s in sets]
            grams, counts = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
            often = counts >= max(4, batch.num_rows // 1000)
            yield pa.RecordBatch.from_arrays([pa.array(grams[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], ["gram", "n"])

    counted = rows.mapInArrow(lean(run), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "gram").limit(ORDERED_LAST).toArrow()
    grams = top["gram"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(grams)
    return grams[order], np.log2(np.maximum(top["n"].to_numpy().astype(np.float64), 1)).astype(np.uint64)[order]


class CountRTree:
    """A packed R-tree over count vectors. Nodes keep coordinate maxima and the range of set sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        half = points[:, : points.shape[1] // 2].sum(1)
        self.order = np.lexsort((half, sizes))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = []
        high, small, large = self.points, self.sizes, self.sizes
        while len(high) > PAGE:
            cuts = np.arange(0, len(high), PAGE)
            high, small, large = np.maximum.reduceat(high, cuts), np.minimum.reduceat(small, cuts), np.maximum.reduceat(large, cuts)
            self.levels.append((high, small, large))

    def query(self, point: np.ndarray, size: int, num: int, den: int) -> np.ndarray:
        """Indexes of the points whose overlap with ``point`` may reach the similarity num / den."""
        at = np.arange(len(self.levels[-1][0]) if self.levels else len(self.points))
        for level in range(len(self.levels), -1, -1):
            high, small, large = self.levels[level - 1] if level else (self.points, self.sizes, self.sizes)
            fits = (large[at] * den >= num * size) & (small[at] * num <= den * size)
            at = at[fits]
            bound = np.minimum(high[at], point).sum(1)
            at = at[bound * (num + den) >= num * (size + small[at])]
            if level:
                at = (at[:, None] * PAGE + np.arange(PAGE)).ravel()
                at = at[at < (len(self.levels[level - 2][0]) if level > 1 else len(self.points))]
        return self.order[at]


def members_of(tile: int):
    """From rows ``key, n, node`` in order, the distinct members of keys with several: ``key, n, node, tile``, where ``tile`` counts runs of so many members."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, before = np.zeros((0, 3), np.int64), 0  # rows of the last key, and how many of its members went out

        def out(rows: np.ndarray, before: int) -> pa.RecordBatch:
            new = np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]])
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(rows)))
            place = np.arange(len(rows)) - np.repeat(starts, sizes)
            place[:sizes[0]] += before
            keep = np.repeat((sizes > 1) | ((starts == 0) & (before > 0)), sizes)
            return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (rows[:, 0].copy(), rows[:, 1].copy(), rows[:, 2].copy(), place // tile)], ["key", "n", "node", "tile"])

        for batch in batches:
            rows = np.concatenate([left, np.stack([c.to_numpy() for c in batch.columns], 1)])
            if not len(rows):
                continue
            rows = rows[np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)])]
            cut = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
            if cut:
                yield out(rows[:cut], before)
                before = 0
            left = rows[cut:]
            if len(left) > 100_000:  # one more stays, to tell repeated rows
                yield out(left[:-1], before or 1) if before == 0 else out(left[:-1], before)
                before += len(left) - 1
                left = left[-1:]
        if len(left):
            yield out(left, before)

    return run


def _small_pairs(starts: np.ndarray, lengths: np.ndarray, component: np.ndarray, size: np.ndarray, points: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows across components that pass the bound, with the bound, in many trees of a single page, all of a size at once."""
    for m in np.unique(lengths).tolist():
        own = starts[lengths == m]
        i, j = np.triu_indices(m, 1)
        step = max(1, 20_000 // max(1, len(i)))
        for at in range(0, len(own) if m > 1 else 0, step):
            x, y = (own[at:at + step, None] + i).ravel(), (own[at:at + step, None] + j).ravel()
            ok = (component[x] != component[y]) & (size[x] * den >= size[y] * num) & (size[y] * den >= size[x] * num)
            x, y = x[ok], y[ok]
            bound = np.minimum(points[x], points[y]).sum(1)
            ok = bound * (num + den) >= num * (size[x] + size[y])
            yield x[ok], y[ok], bound[ok]


def pack_counts(counts: np.ndarray) -> bytes:
    """A count vector in 16-bit numbers, or in 32-bit ones where a count asks for them."""
    return counts.astype("<u2" if counts.max(initial=0) < 1 << 16 else "<u4").tobytes()


def unpack_counts(packed: list[bytes]) -> np.ndarray:
    """Count vectors over ``GROUPS`` groups, one a row."""
    if all(len(x) == 2 * GROUPS for x in packed):
        return np.frombuffer(b"".join(packed), "<u2").reshape(-1, GROUPS).astype(np.int64)
    return np.stack([np.frombuffer(x, "<u2" if len(x) == 2 * GROUPS else "<u4") for x in packed]).astype(np.int64)


def _nearest(num: int, den: int):
    """From rows ``key, node, family, n, points`` in order of key: for every member of a bucket the partner of another family with the
    largest bound, as ``key, node, partner, score``. Members without a partner go."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, 1):
            points = unpack_counts(table.column(4).to_pylist())
            key, node, family, size = (table.column(c).to_numpy() for c in range(4))
            cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            starts, lengths = cuts[:-1], np.diff(cuts)
            leaf = lengths <= PAGE
            found = [(np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([s, s])) for x, y, s in _small_pairs(starts[leaf], lengths[leaf], family, size, points, num, den)]
            for s, m in zip(starts[~leaf].tolist(), lengths[~leaf].tolist()):
                if (family[s:s + m] == family[s]).all():
                    continue
                tree = CountRTree(points[s:s + m], size[s:s + m])
                for i in range(s, s + m):
                    hit = s + tree.query(points[i], size[i], num, den)
                    hit = hit[family[hit] != family[i]]
                    if len(hit):
                        bound = np.minimum(points[hit], points[i]).sum(1)
                        # Similarity by the bound, not the bound alone, lest large sets attract.
                        best = np.argmax(bound / (size[hit] + size[i] - bound))
                        found.append((np.array([i]), hit[best:best + 1], bound[best:best + 1]))
            x, y, bound = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
            score = bound / np.maximum(1, size[x] + size[y] - bound)
            order = np.lexsort((node[y], score, x))
            x, y, score = x[order], y[order], score[order]
            last = np.concatenate([x[1:] != x[:-1], [True]]) if len(x) else np.zeros(0, bool)
            x, y, score = x[last], y[last], score[last]
            yield pa.RecordBatch.from_arrays([pa.array(key[x]), pa.array(node[x]), pa.array(node[y]), pa.array(score)], ["key", "node", "partner", "score"])

    return run


def fine_counts(one: np.ndarray) -> bytes:
    """A set's count vector over groups in proportion to its size, deflated; halves of a vector add up to that over half the groups."""
    groups = 1 << int(np.clip((len(one) // 2).bit_length(), 6, 12))
    return zlib.compress(np.bincount((one >> np.uint64(20)).astype(np.int64) & (groups - 1), minlength=groups).astype("<u4").tobytes(), 1)


def fine_points(packed: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(zlib.decompress(x), "<u4") for x in packed]


def coarse_points(packed: list[bytes]) -> list[np.ndarray]:
    return list(unpack_counts(packed))


def rare_overlaps(sets: list[np.ndarray], often: int = RARE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How overlaps split by what stands in more than ``often`` sets of the list and what is rarer: for each set its number of frequent
    members, and the pairs ``i, j`` (i > j, in order) that share rare members, with how many. An overlap is at most the
    lesser number of frequent members, and the shared rare ones."""
    whole, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(whole, kind="stable")
    whole, of = whole[order], of[order]
    starts = np.flatnonzero(np.concatenate([[True], whole[1:] != whole[:-1]]))
    lengths = np.diff(np.append(starts, len(whole)))
    frequent = np.bincount(of[np.repeat(lengths > often, lengths)], minlength=len(sets))
    pairs = [np.zeros(0, np.int64)]
    for m in range(2, often + 1):
        i, j = np.triu_indices(m, 1)
        own = starts[lengths == m][:, None]
        pairs.append((of[own + j] * len(sets) + of[own + i]).ravel())
    pairs, shared = np.unique(np.concatenate(pairs), return_counts=True)
    return frequent, pairs // len(sets), pairs % len(sets), shared


def _joins(nodes: list[int], size: np.ndarray, own: np.ndarray, part: np.ndarray, points: np.ndarray | None, sets: list[np.ndarray] | None, num: int, den: int, rare: tuple | None = None) -> Iterator[tuple[int, int]]:
    """Links that join a group as far as similarities (with ``sets``) or else bounds do; pairs of one part or joined already are passed over.

    With ``rare``, which ``rare_overlaps`` gives, pairs that it rules out cost no look at points."""
    most, x, y, shared = (size, *[np.zeros(0, np.int64)] * 3) if rare is None else rare
    cuts = np.searchsorted(x, np.arange(len(nodes) + 1)).tolist()
    _, first, of = np.unique(part, return_index=True, return_inverse=True)
    root = first[of]
    # Over few groups a tree prunes; over many, a scan of what isn't joined yet is cheaper.
    tree = CountRTree(points.astype(np.int64), size) if points is not None and points.shape[1] <= GROUPS and len(nodes) > 4 * PAGE else None
    for i in range(1, len(nodes)):
        if tree is not None:
            near = np.sort(tree.query(points[i], size[i], num, den))
            near = near[near < i]
            near = near[(root[near] != root[i]) & (own[near] | own[i])]
            bound = np.minimum(points[near], points[i]).sum(1, dtype=np.int64)
        else:
            bound = np.minimum(most[:i], most[i])
            bound[y[cuts[i]:cuts[i + 1]]] += shared[cuts[i]:cuts[i + 1]]
            near = np.flatnonzero((root[:i] != root[i]) & (own[:i] | own[i]) & (np.minimum(size[:i], size[i]) * (num + den) >= num * (size[:i] + size[i])) & (bound * (num + den) >= num * (size[:i] + size[i])))
            if points is not None and len(near):
                bound = np.minimum(points[near], points[i]).sum(1, dtype=np.int64)
                keep = bound * (num + den) >= num * (size[near] + size[i])
                near, bound = near[keep], bound[keep]
        if points is not None and len(near):
            near = near[np.argsort(-(bound / np.maximum(1, size[near] + size[i] - bound)), kind="stable")]
        for j in near.tolist():
            if root[j] == root[i]:
                continue
            if sets is not None and not _similar(sets[i], sets[j], num, den):
                continue
            root[root == root[i]] = root[j]
            yield nodes[i], nodes[j]


def _similar(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether two sorted sets, not empty, reach the similarity num / den."""
    spot = np.searchsorted(y, x)
    spot[spot == len(y)] = 0
    met = int((y[spot] == x).sum())
    return den * met >= num * (len(x) + len(y) - met)


def _folded(vectors: list[np.ndarray]) -> np.ndarray:
    """Count vectors over as many groups as the shortest has."""
    least = min(len(v) for v in vectors)
    return _narrow(np.stack([v if len(v) == least else v.reshape(-1, least).sum(0, dtype=np.uint32) for v in vectors]))


def _narrow(points: np.ndarray) -> np.ndarray:
    """Count vectors in 16-bit numbers, or in 32-bit ones where a count asks for them."""
    return points.astype(np.uint16 if points.max(initial=0) < 1 << 16 else np.uint32)


def family_links(unpack: Callable[[list[bytes]], list[np.ndarray]], num: int, den: int, exact: bool = True):
    """From rows ``family, low, high, node, n, own, part, packed`` in order of (family, low, high), links ``a, b`` within each group.

    ``unpack`` turns packed bytes to sorted hashes of sets (``exact``) or count vectors. Pairs of which no member is ``own`` are
    another group's, members of a ``part`` are joined already; all others are bounded by count vectors, unless links found so far
    join them, and then verified on the sets, if there are any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, 3):
            family, low, high = (table.column(c).to_numpy() for c in range(3))
            bounds = np.flatnonzero(np.concatenate([[True], (family[1:] != family[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]), [True]])).tolist()
            nodes, size, own, part, packed = table.column(3).to_pylist(), table.column(4).to_numpy(), table.column(5).to_numpy(), table.column(6).to_numpy(), table.column(7)
            found: list[tuple[int, int]] = []
            held: list[np.ndarray] = []
            done = offset = 0
            for a, b in chunks(np.array([len(x) for x in packed.to_pylist()]) * 4):
                held += unpack(packed.slice(a, b - a).to_pylist())
                while done + 1 < len(bounds) and bounds[done + 1] <= b:
                    s, e = bounds[done], bounds[done + 1]
                    group = held[s - offset:e - offset]
                    if e - s > 1:
                        points = rare = None
                        if not exact:
                            points = _folded(group)
                        elif e - s > 2:
                            # Far copies of a text hold much that few others do: but for it, they are too small to be near to anything.
                            rare = rare_overlaps(group) if e - s > 4 * PAGE else None
                            groups = 1 << int(np.clip((int(size[s:e].max()) // 2).bit_length(), 6, 11))
                            points = _narrow(np.stack([np.bincount((x >> np.uint64(20)).astype(np.int64) & (groups - 1), minlength=groups) for x in group]))
                        found += _joins(nodes[s:e], size[s:e], own[s:e], part[s:e], points, group if exact else None, num, den, rare)
                    done += 1
                if bounds[done] > offset:
                    held, offset = held[bounds[done] - offset:], bounds[done]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return run


def pivot_links(unpack: Callable[[list[bytes]], list[np.ndarray]], num: int, den: int, exact: bool = True):
    """From rows ``family, salt, pivot, node, n, packed`` in order of (family, salt), links ``family, a, b`` of members with the pivots that came along."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, 2):
            family, salt, chosen = (table.column(c).to_numpy() for c in range(3))
            bounds = np.flatnonzero(np.concatenate([[True], (family[1:] != family[:-1]) | (salt[1:] != salt[:-1]), [True]])).tolist()
            node, size, packed = table.column(3).to_numpy(), table.column(4).to_numpy(), table.column(5)
            found: list[tuple[int, int, int]] = []
            for s, e in zip(bounds[:-1], bounds[1:]):
                heads = s + np.flatnonzero(chosen[s:e])
                rest = s + np.flatnonzero(~chosen[s:e])
                pivots = unpack(packed.take(pa.array(heads)).to_pylist())
                for a, b in chunks(np.array([len(packed[i].as_py()) for i in rest.tolist()], np.int64) * 4):
                    for i, one in zip(rest[a:b].tolist(), unpack(packed.take(pa.array(rest[a:b])).to_pylist())):
                        for h, other in zip(heads.tolist(), pivots):
                            if node[h] == node[i]:
                                found.append((family[i], node[i], node[h]))
                                continue
                            if size[i] * den < size[h] * num or size[h] * den < size[i] * num:
                                continue
                            if exact:
                                met = _similar(one, other, num, den)
                            else:
                                bound = int(np.minimum(*_folded([one, other])).sum(dtype=np.int64))
                                met = bound * (num + den) >= num * (int(size[i]) + int(size[h]))
                            if met:
                                found.append((family[i], node[i], node[h]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(3)], ["family", "a", "b"])

    return run


def join_families(families: DataFrame, packed: DataFrame, tile: int, unpack: Callable, num: int, den: int, exact: bool = True) -> DataFrame:
    """``a, b``: links that join the members of each family (``node, family``) as far as their similarities do, given ``node, n, packed``.

    A family falls into classes of sizes so wide that similar sets stand in one or two neighbours: a class meets itself and the
    class below. A class of several tiles is compared with ``PIVOTS`` of its members first; then its tiles meet pair by pair,
    but for those of one component."""
    width = math.log(den / num) * 1.000001
    level = F.floor(F.log(F.greatest(F.col("n"), F.lit(1)).cast("double")) / width)
    placed = families.join(packed.select("node", "n"), "node").withColumn("level", level)
    placed = placed.select("node", "n", "family", F.explode(F.array(F.struct(F.col("level").alias("at"), F.lit(True).alias("own")), F.struct((F.col("level") + 1).alias("at"), F.lit(False).alias("own")))).alias("group"))
    placed = materialize(placed.select("node", "n", "group.own", F.xxhash64("family", "group.at").alias("family")), "placed")
    tiles = lambda count, grams: (F.floor(F.greatest((F.col(count) - 1) / tile, F.col(grams) / TILE_GRAMS)) + 1).cast("long")
    sizes = placed.groupBy("family").agg(F.count("*").alias("m"), F.sum("n").alias("grams"), F.max("own").alias("some")).where("m > 1 and some")
    sizes = materialize(sizes.select("family", tiles("m", "grams").alias("tiles")), "sizes")
    zero = F.lit(0).cast("long")
    dealt = placed.join(sizes.where("tiles = 1"), "family").select("family", zero.alias("low"), zero.alias("high"), "node", "n", "own", F.col("node").alias("part"))
    found, scratch = [], []
    if not sizes.where("tiles > 1").isEmpty():
        crowd = materialize(placed.join(sizes.where("tiles > 1"), "family").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("tiles"))), "crowd")
        left = crowd
        for k in range(PIVOT_ROUNDS):
            drawn = [F.min(F.struct(F.xxhash64("node", F.lit(PIVOTS * k + i)), "node"))["node"] for i in range(PIVOTS)]
            pivots = left.groupBy("family", "tiles").agg(F.array_distinct(F.array(*drawn)).alias("nodes")).select("family", "tiles", F.explode("nodes").alias("node"))
            pivots = pivots.join(packed.select("node", "n", "packed"), "node").withColumn("salt", F.explode(F.sequence(zero, F.col("tiles") - 1)))
            members = crowd.select("family", "salt", F.lit(False).alias("pivot"), "node").join(packed.select("node", "n", "packed"), "node")
            rows = members.select("family", "salt", "pivot", "node", "n", "packed").unionByName(pivots.select("family", "salt", F.lit(True).alias("pivot"), "node", "n", "packed"))
            rows = rows.repartition("family", "salt").sortWithinPartitions("family", "salt")
            found.append(materialize(rows.mapInArrow(lean(pivot_links(unpack, num, den, exact)), "family long, a long, b long"), "pivots"))
            left = left.join(found[-1].select("family", F.col("a").alias("node")).distinct(), ["family", "node"], "left_anti")
            if k + 1 == PIVOT_ROUNDS or left.isEmpty():
                break
        links = found[0]
        for more in found[1:]:
            links = links.unionByName(more)
        parts = connected_components(links, "a", "b")
        scratch = [crowd, parts]
        crowd = crowd.join(parts.withColumnRenamed("component", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
        # Components of more than half a tile have tiles of their own, the others share some.
        counted = crowd.groupBy("family", "part").agg(F.count("*").alias("m"), F.sum("n").alias("grams"))
        counted = counted.withColumn("slot", F.when((F.col("m") * 2 > tile) | (F.col("grams") * 2 > TILE_GRAMS), F.col("part").cast("string")).otherwise("rest"))
        slots = counted.groupBy("family", "slot").agg(F.sum("m").alias("m"), F.sum("grams").alias("grams"), F.count("*").alias("parts")).withColumn("own_tiles", tiles("m", "grams"))
        whole = slots.groupBy("family").agg(F.sum("parts").alias("parts"), F.array_sort(F.collect_list(F.struct("slot", "own_tiles"))).alias("slots")).where("parts > 1")
        whole = materialize(whole.select("family", F.flatten(F.transform("slots", lambda x: F.transform(F.sequence(zero, x["own_tiles"] - 1), lambda i: F.struct(x["slot"].alias("slot"), i.alias("nth"), x["own_tiles"].alias("of"))))).alias("tiles")), "slots")
        scratch.append(whole)
        spread = crowd.drop("tiles").join(whole, "family").join(counted.select("family", "part", "slot"), ["family", "part"])
        spread = spread.select("family", "node", "n", "own", "part", "slot", "tiles", F.explode(F.filter(F.transform("tiles", lambda t, i: F.struct(t["slot"].alias("slot"), i.cast("long").alias("at"), (t["nth"] == F.pmod(F.xxhash64("node"), t["of"])).alias("hit"))), lambda t: (t["slot"] == F.col("slot")) & t["hit"])).alias("mine"))
        spread = spread.withColumn("with", F.explode(F.filter(F.transform("tiles", lambda t, i: F.struct(t["slot"].alias("slot"), i.cast("long").alias("at"))), lambda t: (t["slot"] != F.col("slot")) | (F.col("slot") == "rest"))))
        dealt = dealt.unionByName(spread.select("family", F.least("mine.at", "with.at").alias("low"), F.greatest("mine.at", "with.at").alias("high"), "node", "n", "own", "part"))
    dealt = dealt.join(packed.select("node", "packed"), "node").select("family", "low", "high", "node", "n", "own", "part", "packed")
    out = dealt.repartition("family", "low", "high").sortWithinPartitions("family", "low", "high").mapInArrow(lean(family_links(unpack, num, den, exact)), "a long, b long")
    for more in found:
        out = out.unionByName(more.select("a", "b"))
    out = materialize(out, "joined")
    drop_materialized(placed, sizes, *scratch, *found)
    return out


def _texts(nodes: DataFrame, rows: DataFrame, points: DataFrame, words: int) -> DataFrame:
    """``node, n, fine, packed``: for each set its size, its fine count vector and one text that has it, deflated.

    The texts are read again: a Bloom filter over their ids passes them, their sets' names tell exactly."""
    chosen = materialize(points.join(nodes, "node", "left_semi").select("node", "doc_id"), "chosen")
    bloom = rows.sparkSession.sparkContext.broadcast(bloom_filter(chosen, chosen.count()))

    def regain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bloom.value
        for batch in batches:
            wanted = bloom_hits(batch.column(0), bits) | batch.column(0).is_null().to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(wanted))
            texts = batch.column(1).cast(pa.binary())
            at = 0
            for ids, sets in _sets(iter([batch]), words):
                packed = [zlib.compress(t, 1) for t in texts.slice(at, len(sets)).to_pylist()]
                at += len(sets)
                yield pa.RecordBatch.from_arrays([ids, pa.array([_node(s) if len(s) else None for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([fine_counts(s) for s in sets], pa.binary()), pa.array(packed, pa.binary())], ["doc_id", "node", "n", "fine", "packed"])

    again = rows.mapInArrow(lean(regain), "doc_id long, node long, n long, fine binary, packed binary").alias("r")
    same = (F.col("r.node") == F.col("c.node")) & F.col("r.doc_id").eqNullSafe(F.col("c.doc_id"))
    out = materialize(again.join(chosen.hint("shuffle_hash").alias("c"), same, "left_semi").dropDuplicates(["node"]).select("node", "n", "fine", "packed"), "texts")
    drop_materialized(chosen)
    return out


def _families(edges: DataFrame) -> DataFrame:
    """``node, family`` of what links ``a, b`` connect."""
    found = connected_components(edges, "a", "b")
    out = found.withColumnRenamed("component", "family")
    out.materialized_path = found.materialized_path
    return out


def jaccard_components(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, set_id`` for every row: documents linked by a Jaccard similarity of ``num / den`` or more.

    ``component_id`` is the smallest id reachable by links. A document with fewer than ``words`` words is one n-gram;
    null, empty and blank texts have an empty set, link with nothing and are their own component. Repeated rows and ids
    are each returned (``set_id`` tells different sets apart); a row with a null id takes part, and its component is null if no other id is reachable. Other
    columns are ignored; an empty table gives an empty table. Sets are kept as 64-bit hashes.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))
    last, weight = frequent_grams(rows, words)
    steer = docs.sparkSession.sparkContext.broadcast((last, weight))
    crowded = int(math.log2(TILE)) + 1  # the rank from which an n-gram's documents are a group of several tiles

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, weight = steer.value
        seen: set[int] = set()  # copies within this partition bring nothing new
        for ids, sets in _sets(batches, words):
            nodes, sizes, keys, hot, points = [], [], [], [], []
            for one in sets:
                n = len(one)
                node = _node(one) if n else None
                nodes.append(node)
                sizes.append(n)
                if not n or node in seen:
                    for column in (keys, hot, points):
                        column.append(None)
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(node)
                size = n - -(-num * n // den) + 1
                spot = np.searchsorted(last, one)
                spot[spot == len(last)] = 0
                rank = np.where(last[spot] == one, weight[spot] + np.uint64(1), np.uint64(0)) if len(last) else np.zeros(n, np.uint64)
                first = np.lexsort((one, rank))[:size]
                chosen, often = one[first].view(np.int64), rank[first] >= crowded
                keys.append(chosen[~often])
                hot.append(chosen[often])
                points.append(pack_counts(np.bincount((one >> np.uint64(40)).astype(np.int64) % GROUPS, minlength=GROUPS)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(hot, pa.list_(pa.int64())), pa.array(points, pa.binary())], ["doc_id", "n", "node", "keys", "hot", "points"])

    described = materialize(rows.mapInArrow(lean(describe), "doc_id long, n long, node long, keys array<long>, hot array<long>, points binary"), "shingles")
    keyed = described.where("keys is not null").select(F.explode("keys").alias("key"), "n", "node")
    members = materialize(keyed.repartition("key").sortWithinPartitions("key", "n", "node").mapInArrow(lean(members_of(TILE)), "key long, n long, node long, tile long"), "members")
    # Buckets of several tiles: n-grams known to stand in many documents, and any that turn out to.
    large = materialize(members.where("tile > 0").select("key").distinct(), "large")
    groups = described.where("size(hot) > 0").select("node", F.explode("hot").alias("family"))
    if not large.isEmpty():
        groups = groups.unionByName(members.join(large, "key").select("node", F.col("key").alias("family")))
        members = materialize(members.join(large, "key", "left_anti"), "members")
    groups = materialize(groups.distinct(), "groups")
    shared = members.select("node").union(groups.select("node")).distinct()
    points = described.where("keys is not null").join(shared, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("points").alias("points"))
    points = materialize(points, "points")
    sets = materialize(described.select("doc_id", "n", "node"), "sets")
    drop_materialized(described)

    # Families: each round, every set names its nearest partner by the bound in another family, until none has one.
    found, families, nearest = [], None, None
    if not groups.isEmpty():
        found.append(join_families(groups, points.select("node", "n", F.col("points").alias("packed")), FINE_TILE, coarse_points, num, den, exact=False))
        families = _families(found[0])
    bucketed, members = members, members.select("key", "node")
    for _ in range(MAX_ROUNDS):
        at = members if families is None else members.join(families, "node", "left")
        at = at.join(points.select("node", "n", "points"), "node").withColumn("family", F.col("node") if families is None else F.coalesce("family", "node"))
        dealt = at.select("key", "node", "family", "n", "points").repartition("key").sortWithinPartitions("key")
        before, nearest = nearest, materialize(dealt.mapInArrow(lean(_nearest(num, den)), "key long, node long, partner long, score double"), "nearest")
        drop_materialized(before)
        new = nearest.groupBy("node").agg(F.max_by("partner", F.struct("score", "partner")).alias("partner"))
        new = materialize(new.select(F.least("node", "partner").alias("a"), F.greatest("node", "partner").alias("b")).distinct(), "near")
        if new.isEmpty():
            break
        found.append(new)
        edges = found[0]
        for more in found[1:]:
            edges = edges.unionByName(more)
        drop_materialized(families)
        families = _families(edges)
        members = nearest.select("key", "node")
    else:
        raise RuntimeError("families did not settle")
    drop_materialized(bucketed, nearest, large, groups, *found)

    # Links stand within families. Fine count vectors split them first; then their texts meet, as far as links found don't join them.
    if not found:
        first = sets.where("false").select("node", F.col("node").alias("component"))
    else:
        def unpack(packed: list[bytes]) -> list[np.ndarray]:
            raw = [zlib.decompress(x) for x in packed]
            return shingle_sets(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), words)

        texts = _texts(families.select("node"), rows, points, words)
        closer = join_families(families, texts.select("node", "n", F.col("fine").alias("packed")), FINE_TILE, fine_points, num, den, exact=False)
        split = _families(closer)
        joined = join_families(split, texts.select("node", "n", "packed"), FAMILY_TILE, unpack, num, den)
        first = connected_components(joined, "a", "b")
        drop_materialized(texts, families, closer, split, joined)
    drop_materialized(points)
    nodes = sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    nodes = nodes.join(first, "node", "left").withColumn("whole", F.coalesce("component", "node")).drop("component")
    grouped = nodes.groupBy("whole").agg(F.min("least").alias("component_id"), F.sum("rows").alias("rows")).where("rows > 1")
    names = nodes.select("node", "whole").join(grouped, "whole").select("node", "component_id")
    out = sets.select("doc_id", F.col("n").alias("n_shingles"), "node").join(names, "node", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.col("node").alias("set_id"))


def keep_one(docs: DataFrame, components: DataFrame, words: int = 5) -> DataFrame:
    """One row of ``docs`` for each component of ``jaccard_components(docs, words)``: that of the smallest id. Rows with a null id stay.

    Ids that repeat are told apart by their rows' sets. A Bloom filter lets rows that surely stay pass without a shuffle."""
    per_id = components.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), F.max(F.col("doc_id") != F.col("component_id")).alias("goes"))
    touched = materialize(per_id.where("rows > 1 or goes").select("doc_id", (F.col("rows") > 1).alias("repeats")), "touched")
    count = touched.count()
    if not count:
        return docs
    clear, met = sifted(docs, touched, count)
    marked = met.join(touched.select(F.col("doc_id").alias("touched_id"), "repeats"), met["doc_id"] == F.col("touched_id"), "left")
    out = clear.unionByName(marked.where("touched_id is null").select(*docs.columns))
    if touched.where("repeats").isEmpty():
        return out

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).fill_null("")
            for _, sets in _sets(iter([pa.RecordBatch.from_arrays([texts, texts], ["doc_id", "text"])]), words):
                part, batch = batch.slice(0, len(sets)), batch.slice(len(sets))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([_node(s) if len(s) else None for s in sets], pa.int64())], [*part.schema.names, "set_of_row"])

    repeated = marked.where("repeats").select(*docs.columns)
    schema = T.StructType([*docs.schema.fields, T.StructField("set_of_row", T.LongType())])
    kept = components.where("doc_id = component_id").select(F.col("doc_id").alias("kept_id"), "set_id").distinct()
    named = repeated.mapInArrow(lean(name), schema)
    named = named.join(kept, (named["doc_id"] == F.col("kept_id")) & F.col("set_of_row").eqNullSafe(F.col("set_id")), "left_semi")
    return out.unionByName(named.dropDuplicates(["doc_id"]).select(*docs.columns))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents
), g AS (
  SELECT doc_id, CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 4 THEN [array_to_string(t, ' ')]
    ELSE list_distinct(list_transform(range(1, len(t) - 2), lambda i: array_to_string(t[i:i + 3], ' '))) END AS s FROM w
), e AS (SELECT doc_id, len(s) AS n, md5_number(unnest(s)) AS h FROM g),
p AS (
  SELECT a.doc_id AS u, b.doc_id AS v, a.n + b.n AS total, count(*) AS met FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id AND a.n * 100 >= b.n * 85 AND b.n * 100 >= a.n * 85
  GROUP BY ALL
), l AS (SELECT u, v FROM p WHERE 100 * met >= 85 * (total - met)),
b AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT u AS node, u AS reached FROM b UNION SELECT r.node, b.v FROM r JOIN b ON r.reached = b.u),
c AS (SELECT node, min(reached) AS component_id FROM r GROUP BY node)
SELECT g.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(least(c.component_id, g.doc_id), g.doc_id) AS component_id FROM g LEFT JOIN c ON g.doc_id = c.node
"""

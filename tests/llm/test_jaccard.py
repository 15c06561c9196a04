import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row

from seqcomplexity.llm import jaccard


def brute(rows, words, num, den):
    """Sets by plain Python, all pairs, and a plain union-find."""
    sets = []
    for _, text in rows:
        found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(found[i:i + words]) for i in range(len(found) - words + 1)} if len(found) >= words else {tuple(found)} if found else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
            parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((doc, len(sets[i]), least.get(find(i))) for i, (doc, _) in enumerate(rows)), key=str)


def variants(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 4)))
    base = [[word() for _ in range(rng.choice([3, 5, 8, 20, 60, 200]))] for _ in range(n // 8)]
    passage = [word() for _ in range(15)]
    rows = []
    for i in range(n):
        text = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            at = rng.randrange(len(text))
            text[at:at + rng.randint(0, 1)] = [word()] * rng.randint(0, 1)
        if rng.random() < 0.3:
            text += passage
        rows.append((i * 7 % n, rng.choice([" ", "\n", "\t "]).join(text).title() if rng.random() < 0.2 else " ".join(text)))
    return rows


@pytest.mark.parametrize("seed,words,num,den,tile", [(1, 4, 85, 100, 2048), (3, 2, 1, 2, 3)])
def test_against_brute_force(spark, monkeypatch, seed, words, num, den, tile):
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "FAMILY_TILE", min(tile, 256))
    monkeypatch.setattr(jaccard, "FINE_TILE", min(tile, 512))
    rows = variants(seed, 240) + [(1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "ONE"), (None, "one"), (1005, "one"), (1005, "one"), (1005, "other text of this id")]
    docs = spark.createDataFrame([Row(doc_id=d, text=t, n="clash", node=1, key=2) for d, t in rows], "doc_id long, text string, n string, node int, key int")
    components = jaccard.jaccard_components(docs, words, num, den)
    found = components.collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == brute(rows, words, num, den)
    kept = jaccard.keep_one(docs, components, words).collect()
    assert sorted({c for _, _, c in brute(rows, words, num, den)} - {None}) == sorted(r.doc_id for r in kept if r.doc_id is not None)
    assert sum(r.doc_id is None for r in kept) == 1


def test_long_text_and_empty_table(spark):
    rng = random.Random(5)
    long = " ".join(str(rng.randrange(10**6)) for _ in range(400_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, "x" * 3_000_000)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in jaccard.jaccard_components(docs).collect()} == {(1, 1), (2, 1), (3, 3)}
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0


def test_counts_over_16_bits():
    """Two sets of 5 million n-grams: group counts pass 65,535, and neither the tree nor the bounds nor the texts lose the link."""
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 1 << 63, 5_100_000).astype(np.uint64) * np.uint64(2))
    sets = [np.unique(np.concatenate([base, rng.integers(0, 1 << 63, 100_000).astype(np.uint64)])) for _ in range(2)]
    counts = [np.bincount((s >> np.uint64(40)).astype(np.int64) % jaccard.GROUPS, minlength=jaccard.GROUPS) for s in sets]
    assert min(len(s) for s in sets) > 5_000_000 and max(map(max, counts)) > 65_535
    packed = [jaccard.pack_counts(c) for c in counts]
    points = jaccard.unpack_counts([*packed, jaccard.pack_counts(np.ones(jaccard.GROUPS, np.int64))])
    assert [p.sum() for p in points] == [len(sets[0]), len(sets[1]), jaccard.GROUPS]
    size = np.array([len(s) for s in sets])
    assert sorted(jaccard.CountRTree(points[:2], size).query(points[0], size[0], 4, 5)) == [0, 1]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 1]), pa.array([10, 20]), pa.array([10, 20]), pa.array(size), pa.array(packed)], ["key", "node", "family", "n", "points"])
    assert sum((b["partner"].to_pylist() for b in jaccard._nearest(4, 5)(iter([batch]))), []) == [20, 10]
    for exact, unpack, rows in ((False, jaccard.fine_points, [jaccard.fine_counts(s) for s in sets]), (True, lambda raw: [np.frombuffer(r, np.uint64) for r in raw], [s.tobytes() for s in sets])):
        columns = [pa.array([1, 1]), pa.array([0, 0]), pa.array([0, 0]), pa.array([10, 20]), pa.array(size), pa.array([True, True]), pa.array([10, 20]), pa.array(rows, pa.binary())]
        batch = pa.RecordBatch.from_arrays(columns, ["family", "low", "high", "node", "n", "own", "part", "packed"])
        assert [(b["a"][0].as_py(), b["b"][0].as_py()) for b in jaccard.family_links(unpack, 4, 5, exact)(iter([batch]))] == [(20, 10)]


def test_large_group(spark, monkeypatch):
    """Groups of several tiles: near copies that their pivots join, two clusters that only a chain joins, and strangers with the same n-grams."""
    for name, value in (("TILE", 4), ("FINE_TILE", 4), ("FAMILY_TILE", 4)):
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    base = [word() for _ in range(100)]
    rows = []
    for i in range(60):
        text = list(base)
        for _ in range(rng.randint(0, 2)):
            text[rng.randrange(100)] = word()
        rows.append((i, " ".join(text)))
    step = list(base)
    for i in range(60, 90):  # each differs a little from the one before, so far ones differ much
        step[(i * 5) % 100] = word()
        rows.append((i, " ".join(step)))
    rows += [(i, " ".join(base[:40] + [word() for _ in range(60)])) for i in range(90, 110)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard.jaccard_components(docs, 5, 4, 5).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == brute(rows, 5, 4, 5)


def test_tree_loses_nothing():
    rng = np.random.default_rng(7)
    base = rng.poisson(3, (300, jaccard.GROUPS))
    points = np.maximum(0, np.concatenate([base, base + rng.integers(-1, 2, base.shape) * (rng.random(base.shape) < 0.1)]))
    sizes = points.sum(1)
    tree = jaccard.CountRTree(points, sizes)
    assert tree.levels
    for i in range(0, 600, 7):
        bound = np.minimum(points, points[i]).sum(1)
        need = (bound * 185 >= 85 * (sizes + sizes[i])) & (sizes * 100 >= 85 * sizes[i]) & (sizes * 85 <= 100 * sizes[i])
        assert sorted(tree.query(points[i], sizes[i], 85, 100)) == np.flatnonzero(need).tolist()


def test_rare_members_rule_out_far_copies():
    """Copies that each change a tenth of a text are too far from each other: no pair of them passes the bound, none that is near goes."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 600).astype(np.uint64)
    fresh = lambda n: rng.integers(0, 1 << 63, n).astype(np.uint64)
    pool = fresh(3000)
    far = [np.unique(np.concatenate([base[rng.permutation(600)[:510]], rng.choice(pool, 45), fresh(45)])) for _ in range(150)]
    near = [np.unique(np.concatenate([base[rng.permutation(600)[:580]], rng.choice(pool, 20)])) for _ in range(60)]
    sets = far + near + [np.unique(np.concatenate([x[:-9], fresh(9)])) for x in far[:10]]
    frequent, i, j, shared = jaccard.rare_overlaps(sets)
    listed = {(a, b): n for a, b, n in zip(i.tolist(), j.tolist(), shared.tolist())}
    assert (i > j).all() and len(listed) == len(i) and (np.diff(i) >= 0).all()
    passed = 0
    for a in range(len(sets)):
        for b in range(a):
            met = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            bound = min(frequent[a], frequent[b]) + listed.get((a, b), 0)
            assert met <= bound
            passed += bound * 9 >= 4 * (len(sets[a]) + len(sets[b])) and a < 150
    assert passed < 0.02 * 150 * 149 / 2
    size, n = np.array([len(x) for x in sets]), len(sets)
    points = np.stack([np.bincount((x >> np.uint64(20)).astype(np.int64) & 255, minlength=256) for x in sets])
    links = lambda rare: list(jaccard._joins(list(range(n)), size, np.ones(n, bool), np.arange(n), points, sets, 4, 5, rare))
    assert links((frequent, i, j, shared)) == links(None) != []

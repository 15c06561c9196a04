import random
import re
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from seqcomplexity.llm import bpe, common, quality, tokencount


def test_shared_folder_must_be_named_off_local_masters():
    context = lambda master: SimpleNamespace(master=master, getCheckpointDir=lambda: None)
    conf = SimpleNamespace(get=lambda key, default: default)
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://https://host"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            common.shared_dir(SimpleNamespace(conf=conf, sparkContext=context(master)))
    named = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: "hdfs:///tmp/"), sparkContext=context("yarn"))
    assert common.shared_dir(named) == "hdfs:///tmp"


def test_written_tables_are_deleted(spark):
    table = common.materialize(spark.range(5), "numbers")
    path = Path(table.materialized_path.removeprefix("file://").removeprefix("file:"))
    assert path.exists() and table.count() == 5
    common.drop_materialized(table, None, spark.range(1))
    assert not path.exists()


def test_token_files_are_deleted(spark):
    root = Path(common.shared_dir(spark).removeprefix("file://").removeprefix("file:"))
    before = set(root.glob("tokens-*"))
    assert tokencount.count_tokens(spark.createDataFrame([(1, "a b c")], "doc_id long, text string")).count() == 1
    assert set(root.glob("tokens-*")) == before


@pytest.mark.parametrize("operator", [lambda docs: common.materialize(docs.limit(1), "one"), lambda docs: quality.score_quality(docs.limit(1)), bpe.encode_documents])
def test_long_texts_reach_python_in_small_batches(spark, operator):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    docs = spark.range(2000, numPartitions=1).selectExpr("id as doc_id", "repeat(char(97 + id % 26), 10000) as text")
    spark.conf.unset(common._BATCH_SETTING)
    operator(docs)
    found = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
    assert sum(found) > 20_000_000 and max(found) < 1.5 * common.BATCH_BYTES
    spark.conf.set(common._BATCH_SETTING, "30000000")
    operator(docs)
    assert spark.conf.get(common._BATCH_SETTING) == "30000000"
    spark.conf.unset(common._BATCH_SETTING)


def _own_mb():
    return int(re.search(r"Pss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024


def test_worker_gives_memory_back_after_a_task():
    pins = []

    def run(batches):
        for batch in batches:
            held = [np.ones(12_000) for _ in range(2000)]
            pins.append(np.ones(12_000))  # above the rest, so that nothing goes back by itself
            yield batch
            del held

    batch = pa.RecordBatch.from_arrays([pa.array([1])], ["n"])
    before = _own_mb()
    during = [_own_mb() for _ in common.lean(run)(iter([batch]))]
    assert during[0] - before > 150 and _own_mb() - before < 40
    before = _own_mb()
    stopped = common.lean(run)(iter([batch, batch]))
    next(stopped)
    stopped.close()  # a task that is ended early
    assert _own_mb() - before < 40


def _least_reachable(links):
    near: dict[int, set[int]] = {}
    for a, b in links:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    found = {}
    for start in sorted(near):
        todo = [] if start in found else [start]
        while todo:
            x = todo.pop()
            if x not in found:
                found[x] = start
                todo += near[x]
    return found


def test_forest_names_the_smallest():
    nodes, root = common.forest(np.array([5, 9, -2, 7]), np.array([9, 7, -8, 7]))
    assert dict(zip(nodes.tolist(), nodes[root].tolist())) == {5: 5, 7: 5, 9: 5, -2: -8, -8: -8}


@pytest.mark.parametrize("kind", ["path", "shuffled path", "star", "random", "grid", "empty"])
def test_components_over_many_partitions(spark, kind):
    draw, n = random.Random(5), 400
    names = draw.sample(range(-(10**12), 10**12), n)
    if kind == "path":
        names = sorted(names)
    links = {
        "path": list(zip(names, names[1:])), "shuffled path": list(zip(names, names[1:])), "star": [(names[7], x) for x in names],
        "random": [(draw.choice(names), draw.choice(names)) for _ in range(n // 2)], "grid": [(names[i], names[i + d]) for i in range(n) for d in (1, 20) if i + d < n and (d > 1 or (i + 1) % 20)], "empty": [],
    }[kind]
    links += [(None, 3), (4, None), (None, None), (6, 6), *links[:3]]
    draw.shuffle(links)
    edges = spark.createDataFrame(links, "x long, y long").repartition(37)
    found = common.connected_components(edges, "x", "y").collect()
    assert len(found) == len({r.node for r in found})
    assert {r.node: r.component for r in found} == _least_reachable(links)


@pytest.mark.parametrize("few", [0, 1 << 21])
def test_few_links_need_no_rounds(spark, monkeypatch, few):
    """A long path: one task joins it without rounds, or else rounds over tasks do, with the same components."""
    monkeypatch.setattr(common, "FEW_LINKS", few)
    wrote, write = [], common.materialize
    monkeypatch.setattr(common, "materialize", lambda df, name: wrote.append(name) or write(df, name))
    names = random.Random(3).sample(range(-(10**12), 10**12), 300)
    links = [*zip(names, names[1:]), (None, 3), (6, 6)]
    found = common.connected_components(spark.createDataFrame(links, "x long, y long").repartition(23), "x", "y").collect()
    assert len(found) == 300 and {r.node: r.component for r in found} == _least_reachable(links)
    assert len(wrote) > 2 if not few else wrote == ["pointers"]

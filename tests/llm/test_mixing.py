import math

import pytest
from pyspark.sql import Row

from seqcomplexity.llm import mixing


def test_bisection_meets_its_goals():
    sizes = {"a": 1000, "b": 100, "c": 10, "none": 0}
    for goal in (0.6, 0.8, 0.95):
        alpha = mixing.bisect_exponent(sizes, goal, 1e9)
        entropy = mixing._entropy(list(mixing.temperature_weights(sizes, alpha).values())) / math.log(3)
        assert abs(entropy - goal) < 1e-4
    alpha = mixing.bisect_exponent(sizes, 1.0, 2.0)
    assert max(mixing.epochs_of(sizes, alpha).values()) == pytest.approx(2.0, abs=1e-4)
    assert min(mixing.epochs_of(sizes, alpha).values()) == pytest.approx(1.0)
    assert mixing.bisect_exponent({"a": 5}) == mixing.bisect_exponent({}) == 1.0


def rows():
    texts = [("w " * (i % 13)).strip() for i in range(400)]
    docs = [Row(doc_id=i, text=t, source="hot" if i < 330 else f"s{i % 4}", n_tokens="clash", block=1) for i, t in enumerate(texts)]
    docs += [Row(doc_id=7, text=texts[7], source="hot", n_tokens="x", block=1)] * 3
    docs += [Row(doc_id=None, text=None, source=None, n_tokens="x", block=1), Row(doc_id=None, text="one two", source=None, n_tokens="x", block=2), Row(doc_id=500, text="", source="empty", n_tokens=None, block=None)]
    return docs


@pytest.mark.parametrize("block", [20, 1 << 17])
def test_plan(spark, block):
    docs = rows()
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, n_tokens string, block int")
    plan = mixing.mix_plan(df, mixing.word_tokens(), 0.99, 3.0, block).collect()
    sizes = {}
    for d in docs:
        sizes[d.source] = sizes.get(d.source, 0) + len((d.text or "").split())
    passes = mixing.epochs_of(sizes, mixing.bisect_exponent(sizes, 0.99, 3.0))
    for source, size in sizes.items():
        own = [p for p in plan if p.source == source]
        spent = sum(p.n_tokens for p in own)
        assert size <= spent <= passes.get(source, 1) * size + 1e-3
        assert spent > passes.get(source, 1) * size - 13 or size == 0
        members = sorted((d.doc_id is None, d.doc_id or 0) for d in docs if d.source == source)
        for epoch in range(math.floor(passes.get(source, 1) + 1e-9)):
            assert sorted((p.doc_id is None, p.doc_id or 0) for p in own if p.epoch == epoch) == members
        orders = {e: [p.doc_id for p in sorted((p for p in own if p.epoch == e), key=lambda p: (p.epoch_block, p.place))] for e in (0, 1)}
        if len(members) > 20 and max(p.epoch for p in own) > 1:
            assert orders[0] != orders[1]
    mixed = mixing.mix_documents(df, 0.99, 3.0, block).collect()
    key = lambda p, *more: (str(p.doc_id), str(p.source), *more)
    assert sorted(key(p, p.mix_epoch, p.mix_epoch_block, p.mix_block, p.mix_place) for p in mixed) == sorted(key(p, p.epoch, p.epoch_block, p.block, p.place) for p in plan)
    # The rows stand in the order of the mix: positions rise, and blocks of a source stand together.
    assert [p.mix_position for p in mixed] == sorted(p.mix_position for p in mixed)
    hot = [(p.mix_epoch, p.mix_epoch_block, p.mix_place) for p in mixed if p.source == "hot"]
    assert hot == sorted(hot)
    assert sorted(str((d.doc_id, d.source, d.text)) for d in docs) == sorted(str((p.doc_id, p.source, p.text)) for p in mixed if p.mix_epoch == 0)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_plan(df, mixing.word_tokens()).count() == 0 and mixing.mix_documents(df).count() == 0

import pytest

import corpus_pipeline
from seqcomplexity.llm import bpe, jaccard, linededup, mixing, quality
from seqcomplexity.llm.common import connected_components, materialize


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf), "test-stage")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns and docs.dtypes == before.dtypes, name
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] <= sizes[4] == sizes[5]
    assert sizes[1] > 0.75 * sizes[0]
    codec = bpe.codec(bpe.tokenizer_path())
    kept = {(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()}
    assert {(r.doc_id, codec.decode(bytes(r.ids)).decode()) for r in docs.collect()} == kept


def test_edges(spark):
    rows = [(1, None, "en", None, None), (2, "", None, "s", 0), (None, "one line of text that is long enough to be kept. And more of it.", "en", "s", 1)] + [(i, f"document {i % 3} says something about the {i % 5} of it. We all know that it is so.\nshared line of every document", "en", "hot", 5) for i in range(3, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for source in (docs, docs.limit(0)):
        out = source
        for _, stage in corpus_pipeline.STAGES:
            out = materialize(stage(spark, out, "unused"), "test-edge")
        assert out.count() <= 2 * source.count()


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, j) for j in range(200, 260)] + [(7, 7), (None, 3), (-5, 300)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, **{j: 100 for j in range(200, 260)}, -5: -5, 300: -5}


@pytest.mark.parametrize("module", [jaccard, linededup, mixing, quality])
def test_documented(module):
    assert module.__doc__

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from seqcomplexity.llm import quality
from seqcomplexity.llm.common import flat_bytes

GOOD = "The cat sat on the mat and it was a fine day. We all went to the sea, and then by the river to an old inn. "


def stats(*texts):
    import pyarrow as pa

    return quality.statistics(*flat_bytes(pa.array([t.encode() for t in texts], pa.binary())))


def test_statistics_by_hand():
    s = stats("", "Aa bb bb ccc!", "X Y | | 12\n", "#$% é.", "bb")
    assert s["words"].tolist() == [0, 4, 5, 2, 1]
    assert s["repeated_share"].tolist() == [0, 0.25, 0.2, 0, 0]
    assert s["shouts_per_word"].tolist() == [0, 0.25, 0, 0, 0]
    assert s["bars_per_word"].tolist() == [0, 0, 0.4, 0, 0]
    assert s["short_share"].tolist() == [0, 0.75, 0.4, 0.5, 1]
    assert s["upper_share"].tolist() == [0, 1 / 9, 1, 0, 0]
    assert s["symbols_per_word"][3] == 1.5 and s["digit_share"][2] == 2 / 11


def test_label_model_recovers_planted_rates():
    rng = np.random.default_rng(1)
    n, k = 40_000, len(quality.HEURISTICS)
    truth = rng.random(n) < 0.8
    bad = np.array([h[1] == "bad" for h in quality.HEURISTICS])
    rate = np.where(bad, np.where(truth[:, None], 0.02, 0.45), np.where(truth[:, None], 0.9, 0.3))
    cast = (rng.random((n, k)) < rate).astype(np.int64)
    codes, counts = np.unique(quality.pattern_codes(cast), return_counts=True)
    model = quality.LabelModel.fit(codes, counts)
    assert abs(model.good - 0.8) < 0.02
    assert np.abs(model.rate[1] - np.where(bad, 0.02, 0.9)).max() < 0.03 and np.abs(model.rate[0] - np.where(bad, 0.45, 0.3)).max() < 0.04
    assert ((model.posterior(quality.pattern_codes(cast)) > 0.5) == truth).mean() > 0.97


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")
    rows = quality.score_quality(docs).join(labels, "doc_id").select("quality", "quality_keep").collect()
    clean = [r.quality_keep for r in rows if r.quality == 1]
    junk = [r.quality_keep for r in rows if r.quality == 0]
    assert np.mean(clean) >= 0.99 and np.mean(junk) <= 0.1


def test_mostly_junk_is_estimated():
    rng = np.random.default_rng(2)
    truth = rng.random(40_000) < 0.2
    bad = np.array([h[1] == "bad" for h in quality.HEURISTICS])
    rate = np.where(bad, np.where(truth[:, None], 0.02, 0.5), np.where(truth[:, None], 0.9, 0.2))
    codes, counts = np.unique(quality.pattern_codes((rng.random((40_000, len(bad))) < rate).astype(np.int64)), return_counts=True)
    assert abs(quality.LabelModel.fit(codes, counts).good - 0.2) < 0.03


def test_against_plain_em_and_plain_scorer():
    """The label model against expectation-maximisation over single documents, and the scorer against plain gradient descent."""
    rng = np.random.default_rng(6)
    k, says_bad = len(quality.HEURISTICS), [h[1] == "bad" for h in quality.HEURISTICS]
    found = rng.integers(0, 3, (400, k))
    codes, counts = np.unique(quality.pattern_codes(found), return_counts=True)
    model = quality.LabelModel.fit(codes, counts, 20)
    post = [0.05 if any(v == 1 and b for v, b in zip(row, says_bad)) else 0.95 for row in found.tolist()]
    for _ in range(20):
        rate = [[0.0] * k, [0.0] * k]
        for side in (0, 1):
            for h in range(k):
                weight = [p if side else 1 - p for p in post]
                cast = sum(w for w, row in zip(weight, found.tolist()) if row[h] == 1) + ((0.02 if side else 2.0) if says_bad[h] and not side or says_bad[h] else (2.0 if side else 0.5))
                asked = sum(w for w, row in zip(weight, found.tolist()) if row[h] < 2) + 4
                rate[side][h] = min(0.999, max(0.001, cast / asked))
        good = min(0.99, max(0.01, (sum(post) + 1) / (len(post) + 2)))
        post = []
        for row in found.tolist():
            odds = [good, 1 - good]
            for h, v in enumerate(row):
                if v < 2:
                    odds = [odds[0] * (rate[1][h] if v else 1 - rate[1][h]), odds[1] * (rate[0][h] if v else 1 - rate[0][h])]
            post.append(odds[0] / sum(odds))
    assert np.allclose(model.posterior(quality.pattern_codes(found)), post, atol=1e-6) and abs(model.good - good) < 1e-6
    rows, labels = rng.normal(size=(300, 5)), rng.random(300)
    fitted = quality.Scorer.fit(rows, labels, rounds=3000)
    w, bias = np.zeros(5), 0.0
    for _ in range(20_000):
        gap = 1 / (1 + np.exp(-(rows @ w + bias))) - labels
        w, bias = w - 0.05 * (rows.T @ gap / 300 + 1e-4 * w), bias - 0.05 * gap.mean()
    assert np.allclose(fitted.weights, w, atol=1e-4) and abs(fitted.bias - bias) < 1e-4


@pytest.mark.parametrize("ids", ["equal", "null", "repeated"])
def test_ids_that_repeat(spark, ids):
    """The sample is drawn by id and text, so equal, null and repeated ids still give a fitted scorer."""
    value = {"equal": F.lit(3), "null": F.lit(None), "repeated": F.col("doc_id") % 7}[ids].cast("long")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").withColumn("doc_id", value)
    model = quality.fit_quality(docs, fit_rows=512)
    scores = quality.score_quality(docs.limit(1000), model).agg(F.count_distinct("quality_score").alias("n"), F.avg(F.col("quality_keep").cast("int")).alias("kept")).first()
    assert scores.n > 500 and 0.5 < scores.kept < 0.99


def test_one_row_many_times(spark):
    docs = spark.createDataFrame([(3, GOOD)] * 3000, "doc_id long, text string")
    model = quality.fit_quality(docs, fit_rows=200)
    assert np.abs(model.scorer.weights).max() > 0


def test_edges(spark):
    texts = [None, "", " \n", GOOD * 3, GOOD * 3, GOOD.upper().replace(" ", "!! ") * 3, "word " * 200_000, "é" * 10]
    docs = spark.createDataFrame([Row(doc_id=i, text=t, quality_score="clash", extra=1) for i, t in enumerate(texts)], "doc_id long, text string, quality_score string, extra int")
    model = quality.fit_quality(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    rows = {r.doc_id: r for r in quality.score_quality(docs, model).collect()}
    assert len(rows) == 8 and rows[3].quality_keep and not rows[5].quality_keep and not rows[6].quality_keep
    assert rows[3].quality_score == rows[4].quality_score and rows[0].quality_score == rows[1].quality_score and rows[0].extra == 1
    assert quality.score_quality(docs).count() == 8
    assert quality.score_quality(docs.limit(0)).count() == 0

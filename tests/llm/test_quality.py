"""Quality classifier: vectors and pooling against plain loops, calibration, held-out accuracy, odd rows."""

import os

import numpy as np
import pytest

from tabcal.llm import quality as Q

SF = os.environ.get("TABCAL_QUALITY_SF", "/root/testdata/sf0.1")


def test_shapes():
    assert [Q.shape(w) for w in ("word", "Word", "WORD", "I", "12", "a1", "$$$", "!!", "B2b")] == ["a", "Aa", "AA", "A", "0", "a0", "$", "!", "A0a"]


def test_contexts_and_pooling_equal_plain_loops():
    texts = ["The cat, the CAT sat!!", "", None, "one", "a b c d e f a b c"]
    reader, index = Q.Reader(), Q.index_vectors()
    buckets, sizes, distinct = reader.read(texts)
    words = [Q._WORD.findall(t or "") for t in texts]
    assert sizes.tolist() == [len(w) for w in words] and distinct.tolist() == [len(set(w)) for w in words]
    want = np.zeros((Q.BUCKETS, Q.DIMS), dtype=np.int64)
    codes = [[reader.known[w] for w in ws] for ws in words]
    for ws in codes:
        for i, w in enumerate(ws):
            for j, o in enumerate(ws):
                if 0 < abs(i - j) <= Q.WINDOW:
                    v = index[o[0]].astype(np.int64) + index[o[1]]
                    for b in w:
                        want[b] += v if j > i else np.roll(v, 1)
    assert (Q.contexts(buckets, sizes, index) == want).all()
    vectors = np.random.default_rng(0).normal(size=(Q.BUCKETS, Q.DIMS))
    x = Q.pooled(buckets, sizes, distinct, vectors)
    for row, ws, raw in zip(x, codes, words, strict=True):
        mean = sum((vectors[a] + vectors[b] for a, b in ws), np.zeros(Q.DIMS)) / max(1, len(ws))
        assert np.allclose(row[:Q.DIMS], mean) and np.isclose(row[-2], np.log1p(len(ws))) and np.isclose(row[-1], len(set(raw)) / max(1, len(raw)))


def test_temperature_is_the_one_of_least_loss():
    rng = np.random.default_rng(3)
    true = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-true))).astype(float)
    assert 2.7 < Q.fit_temperature(3 * true, y) < 3.3
    grid = np.exp(np.linspace(np.log(0.25), np.log(16), 400))
    losses = [np.mean(np.logaddexp(0, 3 * true / t) - y * 3 * true / t) for t in grid]
    assert abs(np.log(Q.fit_temperature(3 * true, y)) - np.log(grid[int(np.argmin(losses))])) < 0.02


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")
def test_held_out_accuracy_and_calibration(spark):
    got = Q.op11_quality(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality IS NOT NULL")
    rows = got.where("held_out").join(labels, "doc_id").select("score", "predicted", "quality").collect()
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    right = sum(r["predicted"] == r["quality"] for r in rows) / len(rows)
    assert len(rows) > 300 and right > 0.97
    assert abs(sum(r["score"] for r in rows) - sum(r["quality"] for r in rows)) / len(rows) < 0.05


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, "good text here", 1), (1, "good text here", 2), (None, None, 3), (2, "", None), (3, "&&& $$$ " * 200_000, 5)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    constant = Q.learn_quality(docs, none)
    assert [r["score"] for r in Q.score_quality(docs, constant).collect()] == [0.5] * 5
    assert Q.score_quality(docs, constant).columns == ["doc_id", "text", "score", "predicted"]
    one = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (7, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert Q.learn_quality(docs, one).constant in (0.5, 1.0)
    ids = list(range(60))
    texts = spark.createDataFrame([(i, ("plain words of prose number " if i % 2 else "$$$ &&& *** ") * (1 + i % 5) + str(i)) for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in ids], "doc_id long, quality int, toxic int")
    model = Q.learn_quality(texts, labels)
    first = {r["doc_id"]: r["score"] for r in Q.score_quality(texts, model, keep=["doc_id"]).collect()}
    assert all((first[i] >= 0.3) == bool(i % 2) for i in ids)
    again = Q.score_quality(texts.repartition(7), Q.learn_quality(texts.repartition(3), labels.repartition(5)), keep=["doc_id"])
    assert all(abs(r["score"] - first[r["doc_id"]]) < 1e-9 for r in again.collect())
    scored = Q.score_quality(docs, model).collect()
    assert len(scored) == 5 and all(0 <= r["score"] <= 1 for r in scored)
    assert Q.score_quality(docs.limit(0), model).collect() == []

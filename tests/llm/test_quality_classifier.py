"""The quality classifier: its parts against brute force, and the whole on held-out labels and on odd rows."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from simplicia.llm import nb_svm
from simplicia.llm.kernel import words_of
from simplicia.llm.nb_svm import LabelledGrams, NbSvmRules
from simplicia.llm.shared import read

RULES = NbSvmRules(feature_bits=6)


def grams_of(texts):
    out = [[] for _ in texts]
    for w in words_of(pa.array(texts), lower=False):
        for of, f in zip(*nb_svm.gram_features(w, NbSvmRules())):
            out[w.first + of].append(int(f))
    return out


def test_grams_stay_inside_their_texts():
    texts = ["one two", "three", None, "", "one two three", "two one", "one  two", "x x x", "y y y"]
    found = grams_of(texts)
    assert all(f == sorted(set(f)) for f in found)
    assert found[0] == found[6] and found[2] == found[3] == []
    assert len(found[1]) == 2 and len(found[0]) == 5  # words, pairs and shapes, pairs of shapes
    assert set(found[0]) < set(found[4]) and set(found[0]) != set(found[5])
    # a repeated word has a shape of its own, whatever the word
    assert len(set(found[7]) & set(found[8])) == 5


@pytest.fixture(scope="module")
def texts():
    """Labelled texts with random features."""
    rng = np.random.default_rng(4)
    rows, good = [], rng.random(120) < 0.7
    for g in good:
        p = np.where(np.arange(64) < 32, 0.3 if g else 0.1, 0.15)
        rows.append(np.flatnonzero(rng.random(64) < p))
    rows[5] = np.zeros(0, np.int64)
    return LabelledGrams(np.concatenate([[0], np.cumsum([len(r) for r in rows])]), np.concatenate(rows), good, rng.random(120) < 0.2)


def test_log_count_ratio(texts):
    fitted = ~texts.shown
    ratio = nb_svm.log_count_ratio(texts, fitted, RULES)
    count = lambda f, g: sum(f in texts.of(i) for i in range(120) if fitted[i] and texts.good[i] == g)
    p, q = ([count(f, g) + 1 for f in range(64)] for g in (True, False))
    for f in range(64):
        assert math.isclose(ratio[f], math.log(p[f] / sum(p) / (q[f] / sum(q))) if p[f] + q[f] > 2 else 0.0, abs_tol=1e-12)


def test_dual_coordinate_descent_ends_at_the_least_loss(texts):
    """Primal and dual values meet, which only the best weights do; the weights follow from the dual variables."""
    fitted = np.ones(120, bool)
    ratio = nb_svm.log_count_ratio(texts, fitted, RULES)
    rules = NbSvmRules(feature_bits=6, most_epochs=5000, tolerance=1e-9)
    weight, bias, alpha = nb_svm.dual_coordinate_descent(texts, fitted, ratio, rules)
    x = np.zeros((120, 65))
    x[:, 64] = 1
    for i in range(120):
        r = ratio[texts.of(i)]
        x[i, texts.of(i)] = r / max(np.linalg.norm(r), 1e-9)
    y = np.where(texts.good, 1.0, -1.0)
    w = np.concatenate([weight, [bias]])
    assert np.allclose(w, x.T @ (alpha * y)) and (alpha >= 0).all() and (alpha <= rules.cost).all()
    primal = w @ w / 2 + rules.cost * np.maximum(0, 1 - y * (x @ w)).sum()
    dual = alpha.sum() - w @ w / 2
    assert abs(primal - dual) < 1e-6 * primal
    model = nb_svm.NbSvm(ratio, weight * ratio, bias, 1.0, 0.0)
    assert np.allclose(model.margins(np.repeat(np.arange(120), np.diff(texts.cut)), texts.feature, 120), x @ w)


def test_logistic_curve_is_the_likeliest():
    rng = np.random.default_rng(3)
    margin = rng.normal(size=300)
    good = rng.random(300) < 1 / (1 + np.exp(-(2 * margin + 1)))
    a, b = nb_svm.logistic_curve(margin, good)
    target = np.where(good, (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2))
    loss = lambda a, b: np.logaddexp(0, a * margin + b).sum() - target @ (a * margin + b) + 1e-4 * (a * a + b * b)
    assert all(loss(a, b) <= loss(a + d, b + e) + 1e-9 for d in (-0.01, 0, 0.01) for e in (-0.01, 0, 0.01))
    a, b = nb_svm.logistic_curve(np.array([-1.0, 1.0]), np.array([False, True]))
    assert 0 < a < 100 and abs(b) < 1


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_quality_on_held_out_labels(spark, sf):
    at = f"/root/testdata/{sf}"
    labels = read(spark, at, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = nb_svm.score_quality(read(spark, at, "documents"), read(spark, at, "labels")).join(labels, "doc_id").where("held_out AND quality IS NOT NULL").collect()
    good, bad = [r for r in rows if r["quality"]], [r for r in rows if not r["quality"]]
    kept, caught = sum(r["predicted"] for r in good), sum(not r["predicted"] for r in bad)
    order = sum((p["score"] > n["score"]) + 0.5 * (p["score"] == n["score"]) for p in good for n in bad) / (len(good) * len(bad))
    print(sf, "kept", kept, "of", len(good), "caught", caught, "of", len(bad), "area", order)
    assert kept >= 0.99 * len(good) and caught >= (0.9 if sf == "sf0.1" else 0.6) * len(bad) and order > 0.97


def test_quality_of_odd_rows(spark):
    text = lambda i: " ".join(f"{'junk|' if i % 3 == 0 else 'fine'}{(i * 7 + k) % 50}" for k in range(30))
    rows = [(i, text(i)) for i in range(300)] + [(1, text(1)), (1000, None), (1001, ""), (1002, " \t\n"), (None, text(4)), (1003, "fine1 " * 60_000), (1004, "é" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("score", "__quality", "quality", "label", "a.b", "value")})
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(300)] + [(1, 0), (2, None), (None, 0), (5000, 1)], "doc_id long, quality int").withColumn("text", F.lit("own"))
    found = nb_svm.score_quality(docs, labels)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    got = found.collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
        assert r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if r["doc_id"] is not None and r["doc_id"] < 300:
            assert r["predicted"] == (r["doc_id"] % 3 != 0)
    score = {r["doc_id"]: r["score"] for r in got}
    assert score[1000] == score[1001] == score[1002]
    kept = nb_svm.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in got)
    again = nb_svm.score_quality(docs.repartition(5), labels.repartition(3)).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, got), key=repr)
    assert nb_svm.score_quality(docs.where("false"), labels).count() == 0
    alike = {r["score"] for r in nb_svm.score_quality(docs, labels.where("false")).collect()}
    assert alike == {0.5}
    ones = labels.where("quality = 1 AND doc_id < 100")
    n = sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(100) if i % 3)
    (share,) = {r["score"] for r in nb_svm.score_quality(docs, ones).collect()}
    # the labelled row that repeats counts twice
    assert math.isclose(share, (n + 2) / (n + 3)) if zlib.crc32(b"1") % 5 else math.isclose(share, (n + 1) / (n + 2))

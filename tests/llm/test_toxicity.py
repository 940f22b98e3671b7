"""Held-out accuracy, odd rows, and gradients."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import queries, toxicity

from .fixtures import documents, empty

DIR = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")


def test_held_out(table):
    docs, labels = table
    model = toxicity.learn(docs, labels.where("doc_id % 5 <> 0"))
    got = toxicity.score(docs.select("doc_id", "text"), model).join(labels.where("doc_id % 5 = 0").select("doc_id", F.col("toxic").alias("label")), "doc_id").collect()
    bad, good = ([r for r in got if r["label"] == x] for x in (1, 0))
    assert sum(r["toxic"] for r in bad) >= 0.85 * len(bad)
    assert sum(r["toxic"] for r in good) <= 0.005 * len(good)
    assert all(0 <= r["severity"] <= 2 and r["toxic"] == (r["grade"] > 0) for r in got)
    assert np.mean([r["severity"] for r in bad]) > np.mean([r["severity"] for r in good]) + 1


def test_odd_rows(spark, table):
    docs = documents(spark)
    labels = table[1].limit(0)
    assert not any(r["toxic"] for r in toxicity.severities(docs, labels).collect())
    some = spark.createDataFrame([(3, 1, 1), (4, 1, 0), (None, 1, 1), (5, None, None), (5, 0, 7), (9, 1, 0), (3, 0, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.severities(docs, some)
    assert got.count() == docs.count() and got.columns == ["doc_id", "severity", "grade", "toxic"]
    assert toxicity.severities(empty(docs), some).count() == 0


def test_thresholds_are_ordered_and_weights_shared():
    rng = np.random.default_rng(1)
    grades = rng.integers(0, 4, 400)
    bounds = np.arange(401) * 2
    numbers = np.column_stack((np.full(400, 5), np.where(rng.random(400) < 0.2 + 0.2 * grades, 7, 9))).ravel().astype(np.int32)
    model = toxicity.fit(bounds, numbers, np.ones(800), grades, np.ones(400), least_z=0, least_texts=1)
    assert (np.diff(model.thresholds) > 0).all() and len(model.thresholds) == 3
    assert model.weights[7] > model.weights[9]
    p = model.at_least(np.array([-1.0, 0.0, 3.0]))
    assert (np.diff(p, axis=1) < 0).all() and (np.diff(p, axis=0) > 0).all()


def test_gradient_is_that_of_the_loss():
    """Against differences of the loss, which is written out anew here."""
    rng = np.random.default_rng(2)
    grades, share = rng.integers(0, 3, 50), rng.random(50)
    share /= share.sum()
    row_of, column, values = rng.integers(0, 50, 200), rng.integers(0, 8, 200), rng.random(200)
    w, gaps = rng.standard_normal(8), np.array([0.3, -0.2])

    def plain(x):
        total = 0.0
        thresholds = [x[8], x[8] + math.exp(x[9])]
        for i in range(50):
            s = sum(v * x[c] for r, c, v in zip(row_of, column, values, strict=True) if r == i)
            at_least = [1.0] + [1 / (1 + math.exp(t - s)) for t in thresholds] + [0.0]
            total -= share[i] * math.log(at_least[grades[i]] - at_least[grades[i] + 1])
        return total + 0.01 / 2 * sum(x[:8] ** 2)

    at = np.concatenate((w, gaps))
    value, gradient = toxicity.loss(w, gaps, row_of, column, values, grades, share, 0.01)
    assert math.isclose(value, plain(at), rel_tol=1e-9)
    for k in range(10):
        step = np.zeros(10)
        step[k] = 1e-5
        assert math.isclose(gradient[k], (plain(at + step) - plain(at - step)) / 2e-5, rel_tol=1e-4, abs_tol=1e-7)


def one_hash(word, front=0):
    words, _, fronts = toxicity.word_hashes(np.frombuffer(word, np.uint8), np.array([len(word)]), toxicity._BETWEEN, 6)
    return int(fronts[0] if front else words[0])


def test_query_against_a_plain_version(spark):
    """Every document's severity, from a model's weights and words told apart one by one."""
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.learn(docs, labels)
    got = {r["doc_id"]: r for r in queries.op8_toxicity(spark, d).collect()}
    assert len(got) == docs.count()
    for r in docs.collect():
        counts = Counter()
        for word in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (r["text"] or "").encode()):
            counts[one_hash(word) >> 46] += 1
            if len(word) >= 6:
                counts[int(toxicity.mixed(np.array([one_hash(word, 6) + 1], dtype=np.uint64))[0]) >> 46] += 1
        total = sum(counts.values())
        score = sum(model.weights[k] * math.sqrt(n) / total**0.25 for k, n in counts.items())
        at_least = [1 / (1 + math.exp(-max(-40, min(40, score - t)))) for t in model.thresholds]
        assert math.isclose(got[r["doc_id"]]["severity"], sum(at_least), rel_tol=1e-6, abs_tol=1e-9)
        assert got[r["doc_id"]]["grade"] == sum(p >= 0.5 for p in at_least)


def test_very_long_texts_and_copies(spark, table):
    """A text of megabytes, and texts that tie: equal texts get equal severities."""
    model = toxicity.learn(*table)
    insult = next(r["text"] for r in table[0].join(table[1].where("toxic = 1"), "doc_id").orderBy("doc_id").collect())
    docs = spark.createDataFrame([(1, "plain words " * 400_000), (2, "x" * 3_000_000), (3, insult), (4, insult), (3, insult)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["severity"]) for r in toxicity.score(docs, model).collect())
    assert len(got) == 5 and len({s for i, s in got if i > 2}) == 1 and all(0 <= s <= 2 for _, s in got)


def test_features_do_not_depend_on_slices():
    texts = [b"Idiot, idiot! you", b"", b"\xc3\xa9t\xc3\xa9 longerword", b"one"]
    whole = toxicity.features(texts)
    for i, t in enumerate(texts):
        alone = toxicity.features([t])
        assert (whole[1][whole[0][i] : whole[0][i + 1]] == alone[1]).all() and np.allclose(whole[2][whole[0][i] : whole[0][i + 1]], alone[2])

"""The law of rows, exactness, and the distribution of the counts."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from corvane.llm import sharding

from .fixtures import documents, empty


def test_matrix():
    for counts in ([5, 0, 7, 100], [1], [16] * 9, [3, 4]):
        m = sharding.communication_matrix(counts, 16, 1)
        assert [sum(r) for r in m] == counts
        columns = [sum(c) for c in zip(*m, strict=True)]
        assert max(columns) - min(columns) <= 1


def test_hypergeometric_distribution():
    rng = random.Random(1)
    n, good, bad, drawn = 20000, 12, 30, 9
    got = Counter(sharding.hypergeometric(rng, good, bad, drawn) for _ in range(n))
    other = Counter(sum(x < good for x in rng.sample(range(good + bad), drawn)) for _ in range(n))
    assert all(abs(got[k] - other[k]) < 5 * (other[k] + 30) ** 0.5 for k in range(10))
    big = [sharding.hypergeometric(rng, 10**11, 10**12, 10**6) for _ in range(300)]
    assert abs(sum(big) / 300 - 10**6 / 11) < 5 * (10**6 * 10 / 121 / 300) ** 0.5 and len(set(big)) > 100


def check(rows, docs):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((d["doc_id"], len((d["text"] or "").encode()) + 1, zlib.crc32((d["text"] or "").encode())) for d in docs)
    slots = defaultdict(list)
    for r in rows:
        assert r["law"] == "rows" and r["grown_shard"] is None and 0 <= r["shard"] < 16
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[s]) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1


def test_documents(spark):
    docs = documents(spark)
    check(sharding.shard_documents(docs).collect(), docs.collect())
    many = documents(spark, [f"text {i}" for i in range(999)], repeat=False).repartition(7)
    rows = sharding.shard_documents(many).collect()
    check(rows, many.collect())
    assert sharding.shard_documents(empty(docs)).count() == 0
    together = Counter((r["shard"], r["doc_id"] // 63) for r in rows)
    assert max(together.values()) < 20


def test_buckets(spark):
    from corvane.llm.common import materialize
    from pyspark.sql import functions as F

    rows = materialize(spark.range(5000, numPartitions=5).select("id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("rid")), "test-rows")
    got = sharding.shuffle_into_shards(rows, 4, 9, rows_per_bucket=100).collect()
    assert Counter(r["shard"] for r in got) == {s: 1250 for s in range(4)}
    assert {(r["shard"], r["slot"]) for r in got} == {(s, k) for s in range(4) for k in range(1250)}


def test_native(spark):
    plan = sharding.shard_documents(documents(spark))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize(("good", "bad", "drawn"), [(3, 4, 3), (10, 90, 20), (1000, 1, 500), (60, 40, 99), (5, 5, 10)])
def test_hypergeometric_law(good, bad, drawn):
    """Frequencies of draws against exact probabilities, and the mode's probability against whole-number arithmetic."""
    rng, n = random.Random(good), 20000
    seen = Counter(sharding.hypergeometric(rng, good, bad, drawn) for _ in range(n))
    assert min(seen) >= max(0, drawn - bad) and max(seen) <= min(good, drawn)
    for x in range(min(good, drawn) + 1):
        p = math.comb(good, x) * math.comb(bad, drawn - x) / math.comb(good + bad, drawn) if drawn - x <= bad else 0.0
        assert abs(seen[x] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 2 / n


def test_probabilities_stay_precise_for_large_counts():
    for n in (10**6, 10**8):
        x = n // 2 + 77
        exact = 1 / (2 * math.pi * x * (n - x) / n) ** 0.5  # the law's leading factor; what is left is of order one
        got = math.exp(sharding._log_binomial(x, n, 0.5, 0.5))
        want = exact * math.exp(-(2 * 77**2) / n + 1 / (12 * n) - 1 / (12 * x) - 1 / (12 * (n - x)))
        assert math.isclose(got, want, rel_tol=1e-9)
    rng = random.Random(3)
    draws = [sharding.hypergeometric(rng, 10**10, 10**10, 10**6) for _ in range(300)]
    assert abs(sum(draws) / 300 - 5 * 10**5) < 5 * 500 / math.sqrt(300)


def test_long_texts_and_many_partitions(spark):
    texts = ["x" * 3_000_000, "é" * 1000] + ["short"] * 20000
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(40)
    rows = sharding.shard_documents(docs).collect()
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(s) for s in slots.values()]
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts))) and max(sizes) - min(sizes) <= 1 and len(slots) == 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r["doc_id"]: r["size"] for r in rows if r["doc_id"] < 2} == {0: 3_000_001, 1: 2001}

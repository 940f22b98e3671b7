"""The join against brute force, and its parts against their bounds."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import jaccard, shingles

from .fixtures import documents, empty


def word_set(text, k):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, per_cent):
    """(doc_id, n, component) of each row; rows of (doc_id, text) with distinct ids."""
    sets = {i: word_set(t, k) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= per_cent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_copies(seed, n=500, lengths=(3, 5, 9, 12, 20, 60, 200, 400), sources=30):
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    base = [[rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.choice(lengths))] for _ in range(sources)]
    base += [passage + [rng.choice("klmnop") * rng.randint(1, 4) for _ in range(rng.randint(5, 90))] for _ in range(sources)]
    rows = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            words[rng.randrange(len(words))] = rng.choice(["x", "y", "Z"])
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize(("seed", "k", "per_cent"), [(1, 4, 85), (2, 5, 80), (3, 4, 60)])
def test_against_brute_force(spark, seed, k, per_cent):
    rows = near_copies(seed)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k, per_cent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, k, per_cent)


def test_sets_that_share_a_number(spark):
    """Numbers of 5 bits are shared by many sets; 64 bits more tell them apart, and the result is the same."""
    rows = near_copies(4, 200)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, bits=5).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, 4, 85)
    _, numbers = jaccard.numbered(spark.createDataFrame(rows, "doc_id long, text string"), 4, 5)
    assert len(numbers.conflicts) > 10


def test_frequent_keys_are_split(spark, monkeypatch):
    """A large group of near copies and many others: its buckets are dealt over parts, and no link is lost."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(120)]
    rows = near_copies(5, 250)
    for i in range(250, 700):
        own = list(words)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    plain = jaccard.frequent_keys
    made = []

    def eager(*a):
        made.append(plain(*a, share=1.0, least=30, part=16))
        return made[-1]

    monkeypatch.setattr(jaccard, "frequent_keys", eager)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 4, 85).collect()
    assert made[0].agg(F.max("parts")).first()[0] > 10
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, 4, 85)


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = jaccard.jaccard_components(docs, 4, 85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute([(r["doc_id"], r["text"]) for r in docs.collect()], 4, 85)


def test_odd_rows(spark):
    docs = documents(spark)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs, 4, 85).collect()), key=str)
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert len(got) == len(texts)
    assert (4, 1, 4) in got and (5, 1, 4) in got and (0, 0, 0) in got and (None, 1, None) in got and got.count((12, 1, 12)) == 2
    assert jaccard.jaccard_components(empty(docs)).count() == 0


def test_one_of_each(spark):
    docs = documents(spark, [None, "", "a b c d e f", "A b c d e f", "other text here", "other text here"]).unionByName(documents(spark, ["x y z"], repeat=False).withColumn("doc_id", F.lit(3).cast("long")))
    kept = sorted(((r["doc_id"], r["text"]) for r in jaccard.one_of_each(docs).collect()), key=str)
    want = [(0, None), (1, ""), (2, "a b c d e f"), (3, "again another text under a known id"), (3, "x y z"), (4, "other text here"), (None, "null id"), (None, None)]
    assert kept == sorted(want, key=str)
    assert jaccard.one_of_each(docs).columns == docs.columns
    assert jaccard.one_of_each(empty(docs)).count() == 0


def test_pairs_across_components(spark):
    """With no bound on each member's partners, all possible pairs come out, in whatever blocks; and none twice."""
    rng = np.random.default_rng(6)
    base = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
    rows = []
    for i in range(40):
        own = np.unique(np.concatenate((np.delete(base, rng.integers(0, 300, 12)), rng.integers(0, 1 << 63, 12, dtype=np.uint64))))
        rows.append((i, len(own), jaccard.parity_bits(own)))
    sketched = spark.createDataFrame(rows, "node long, n long, bits binary")
    df = spark.createDataFrame([(key, i, i // 4) for key in (1, 2) for i in range(40)] + [(3, i, i) for i in range(3)], "key long, node long, component long")
    none = spark.createDataFrame([], "node long, tried array<long>")

    def got(*more):
        found = jaccard.across_components(df.where("key < 3"), sketched, *more).collect()
        return sorted({(r["a"], r["b"]) for r in found if r["a"] is not None}), {r["key"] for r in found} - {None}

    every = [(i, j) for i in range(40) for j in range(i + 1, 40) if i // 4 != j // 4]
    assert got(none, 80, 99, 2048) == got(none, 80, 99, 7) == (every, {1, 2})
    assert 5 <= len(got(none, 80)[0]) <= 9
    tried = sketched.select("node", F.sequence(F.lit(0).cast("long"), F.lit(39).cast("long")).alias("tried"))
    assert got(tried, 80) == ([], set())


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(7)
    for _ in range(200):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 63, int(rng.integers(1, 30)), dtype=np.uint64))))
        x, y = (np.frombuffer(jaccard.parity_bits(s), np.uint8) for s in (a, b))
        assert jaccard.bits_apart(x, y) <= len(np.setxor1d(a, b))


def test_linking_sets_share_as_many_lanes_as_stated():
    rng, bands = np.random.default_rng(8), jaccard.Bands(85)
    for _ in range(600):
        n = int(rng.integers(7, 600))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        change = int(rng.integers(0, max(1, n // 12) + 1))
        b = np.unique(np.concatenate((a[rng.permutation(len(a))[change:]], rng.integers(0, 1 << 63, int(rng.integers(0, change + 1)), dtype=np.uint64))))
        common = len(np.intersect1d(a, b))
        if 100 * common >= 85 * (len(a) + len(b) - common) and len(np.setxor1d(a, b)):
            shared = set(jaccard.lane_keys(a, bands).tolist()) & set(jaccard.lane_keys(b, bands).tolist())
            assert any(sum(k & 255 == band for k in shared) >= bands.lanes(band)[3] for band in bands.of(len(a)))


def test_word_hashes_in_blocks():
    rng = random.Random(9)
    text = " ".join("".join(rng.choice("abc\xe9") for _ in range(rng.randint(1, 12))) for _ in range(2000)).encode()
    ends = np.array([700, len(text)])
    whole = shingles.word_hashes(np.frombuffer(text, np.uint8), ends)
    before, shingles._BLOCK = shingles._BLOCK, 64
    try:
        parts = shingles.word_hashes(np.frombuffer(text, np.uint8), ends)
    finally:
        shingles._BLOCK = before
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
    assert len(whole[0]) == len(text[:700].split()) + len(text[700:].split())

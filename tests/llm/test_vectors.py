"""Near duplicates and nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import ann, embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int"
ODD = [
    (1, [1.0, 0.0], 1),
    (2, [1.0, 0.001], 1),
    (None, [1.0, 0.0], 1),
    (4, None, 1),
    (5, [0.0, 0.0], 1),
    (6, [1.0, None], 1),
    (7, [float("nan"), 1.0], 1),
    (8, [1.0, 0.0], None),
    (9, [1.0], 1),
    (2, [1.0, 0.0], 1),
    (None, [5.0], 3),
    (10, [], 1),
    (11, [float("inf"), 0.0], 1),
    (12, [1e30, 1e30], 2),
    (13, [2e30, 2e30], 2),
]


def clustered(seed, n=400, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((40, dim))
    data = centres[rng.integers(0, 40, n)] + rng.choice([0.0, 0.1, 0.25, 0.4], n)[:, None] * rng.standard_normal((n, dim))
    return data.astype(np.float32), rng.integers(0, 3, n)


def brute(data, labels, threshold):
    u = data.astype(float) / np.linalg.norm(data.astype(float), axis=1, keepdims=True)
    links = (u @ u.T >= threshold) & (labels[:, None] == labels[None])
    np.fill_diagonal(links, False)
    part = np.arange(len(data))
    while True:
        new = np.minimum(part, np.where(links, part[None], len(data)).min(axis=1))
        if (new == part).all():
            return links.sum(axis=1), part
        part = new


def test_near_duplicates(spark):
    for block in (37, 2048):
        data, labels = clustered(1)
        df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(data, labels, strict=True))], SCHEMA).selectExpr("*", "1 AS rid", "2 AS own", "3 AS lo", "4 AS dim", "5 AS blocks")
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df, 0.93, block).collect()}
        n, part = brute(data, labels, 0.93)
        assert got == {i: (n[i], part[i], part[i] == i) for i in range(len(data))} and n.max() > 2


def test_near_duplicates_left_open(spark):
    """Many pairs within the error bounds of the threshold, and copies: decided from the vectors, pair by pair or, with
    a small bound on the pairs that a tile may leave open, tile by tile."""
    rng = np.random.default_rng(12)
    base = rng.standard_normal(24)
    side = rng.standard_normal((150, 24))
    side -= side @ base[:, None] / (base @ base) * base
    side *= np.linalg.norm(base) / np.linalg.norm(side, axis=1, keepdims=True)
    angle = np.arccos(0.93) + rng.uniform(-0.004, 0.004, 150)
    data = np.concatenate(([base], np.cos(angle)[:, None] * base + np.sin(angle)[:, None] * side)).astype(np.float32)
    data = np.concatenate((data, data[:40], data[:1].repeat(30, axis=0)))
    labels = np.ones(len(data), dtype=int)
    n, part = brute(data, labels, 0.93)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(data)], SCHEMA)
    for most_open in (1 << 15, 10):
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df, 0.93, 64, most_open).collect()}
        assert got == {i: (n[i], part[i]) for i in range(len(data))}


def test_near_duplicates_on_the_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    table = df.orderBy("vec_id").toPandas()
    n, part = brute(np.stack(table["embedding"].to_numpy()), table["label"].to_numpy(), 0.93)
    ids = table["vec_id"].to_numpy()
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df, 0.93, 100).collect()}
    assert got == {int(ids[i]): (n[i], int(ids[part[i]])) for i in range(len(ids))}


def test_near_duplicates_of_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    got = sorted((tuple(r) for r in embedding_dedup.near_duplicates(df, block=2).collect()), key=str)
    want = [(None, 3, 1, False), (1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (12, 1, 12, True), (13, 1, 12, False), (None, 0, None, True)] + [(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11)]
    assert got == sorted(want, key=str)
    assert embedding_dedup.near_duplicates(df.where("false")).count() == 0


def test_error_bounds_hold():
    rng = np.random.default_rng(2)
    a = embedding_dedup.Quantised(rng.standard_normal((300, 24)) * rng.choice([1e-30, 1, 1e20], 300)[:, None])
    near = (a.q @ a.q.T).astype(float) * (a.scale[:, None] * a.scale[None])
    bound = a.error[:, None] + (1 + a.error[:, None]) * a.error[None]
    assert (np.abs(a.unit @ a.unit.T - near) <= bound).all() and bound.max() < 0.1


def nearest(data, ids, query_rows, top):
    d = data.astype(float)
    out = {}
    for q in query_rows:
        s = (d * d[q]).sum(axis=1)
        out[int(ids[q])] = [int(ids[i]) for i in sorted((i for i in range(len(d)) if i != q), key=lambda i: (-s[i], ids[i]))[:top]]
    return out


def test_nearest_recall(spark):
    for data in (clustered(3, 3000)[0], np.random.default_rng(4).standard_normal((3000, 16)).astype(np.float32)):
        df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(data)], SCHEMA).selectExpr("*", "1 AS rid", "2 AS part", "3 AS ordering", "4 AS dim")
        got = {}
        for r in ann.nearest(df, F.col("vec_id") % 20 == 0, range_rows=128).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["vec_id"])
            assert np.isclose(r["score"], data[r["query_id"]].astype(float) @ data[r["vec_id"]].astype(float))
        want = nearest(data, np.arange(len(data)), range(0, 3000, 20), 20)
        assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
        assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.9


def spread(seed, n, dim=32):
    """Vectors as models give them: a falling spectrum, clusters, norms that differ."""
    rng = np.random.default_rng(seed)
    scales = np.arange(1, dim + 1) ** -1.2
    centres = rng.standard_normal((60, dim)) * scales * 3
    data = centres[rng.integers(0, 60, n)] + rng.standard_normal((n, dim)) * scales
    return (data * rng.uniform(0.5, 1.5, n)[:, None]).astype(np.float32)


def test_windows_prune_where_vectors_have_structure(spark):
    """With as many queries as make it worth its while, a query meets less than a quarter of the rows."""
    data = spread(8, 12000)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(data)], SCHEMA)
    rows = ann.searchable(df, F.col("vec_id") % 2 == 0)
    fitted = ann.calibrated(rows, 20, range_rows=64)
    assert fitted[32].share() < 0.25, fitted[32].share()
    got = {}
    for r in ann.search(rows, fitted, 20, 64, 50).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    asked = range(0, len(data), 50)
    assert len(got) == 6000
    want = nearest(data, np.arange(len(data)), asked, 20)
    assert np.mean([len(got[q] & set(want[q])) / 20 for q in asked]) >= 0.9


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_nearest_recall_on_the_tables(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0, top=20, range_rows=100).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    table = df.orderBy("vec_id").toPandas()
    want = nearest(np.stack(table["embedding"].to_numpy()), table["vec_id"].to_numpy(), np.flatnonzero(table["vec_id"] % 50 == 0), 20)
    assert got.keys() == want.keys()
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.9


def test_the_added_component_makes_products_distances():
    rng = np.random.default_rng(9)
    rows, queries = rng.standard_normal((200, 6)) * rng.uniform(0.1, 9, 200)[:, None], rng.standard_normal((30, 6))
    index = ann.fit(rows, 200, 1, (3,), 4, 50, 1)
    x, q = index.augmented(rows, False), index.augmented(queries, True)
    apart = ((q[:, None] - x[None]) ** 2).sum(axis=2)
    assert (np.argsort(apart, axis=1) == np.argsort(-(queries @ rows.T), axis=1)).all()


def test_many_queries_and_rows_of_one_key(spark):
    """Equal keys in numbers beyond the bounds of a task are dealt into parts, and nothing is lost."""
    df = spark.range(900).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), (F.col("id") % 3).cast("double")).alias("embedding"))
    got = ann.nearest(df, F.col("vec_id") % 2 == 0, top=4, range_rows=20, most_queries=7).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))).alias("l")).collect()
    best = [2, 5, 8, 11, 14]
    assert len(got) == 450
    for r in got:
        if r["query_id"] % 3:
            assert [x["vec_id"] for x in r["l"]] == [b for b in best if b != r["query_id"]][:4]


def test_nearest_is_exact_in_one_range(spark):
    data = np.repeat(clustered(5, 40)[0], 3, axis=0)
    ids = np.random.default_rng(6).permutation(120)
    df = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, data, strict=True)], SCHEMA)
    got = {}
    for r in ann.nearest(df, F.col("vec_id") < 30, top=7).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == nearest(data, ids, np.flatnonzero(ids < 30), 7)


def test_ties_of_different_vectors_go_to_the_smaller_id(spark):
    """Binary vectors, most of which tie with each other."""
    rng = np.random.default_rng(7)
    data = np.unique(rng.integers(0, 2, (600, 12)), axis=0).astype(np.float32)
    data = data[data.any(axis=1)]
    ids = rng.permutation(len(data))
    df = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, data, strict=True)], SCHEMA)
    got = {}
    for r in ann.nearest(df, F.col("vec_id") < 40, top=7).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == nearest(data, ids, np.flatnonzero(ids < 40), 7)


def test_ties_over_many_ranges(spark):
    """Binary vectors in many ranges, so that very many rows have equal scores: each query's rows come in order, ties
    by id, without repeats, and their scores are nearly always the best there are."""
    rng = np.random.default_rng(13)
    data = np.unique(rng.integers(0, 2, (2500, 12)), axis=0).astype(np.float32)
    data = data[data.any(axis=1)]
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(data)], SCHEMA)
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, top=10, range_rows=60).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    right = 0
    for q, rows in got.items():
        scores = np.delete(data @ data[q], q)
        assert len(rows) == 10 and rows == sorted(set(rows))
        right += sum(-s >= np.sort(scores)[-10] for s, _ in rows)
    assert len(got) == len(range(0, len(data), 20)) and right >= 0.9 * 10 * len(got)


def test_copies_split_a_range(spark):
    df = spark.range(600).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), (F.col("id") % 2).cast("double")).alias("embedding"))
    got = ann.nearest(df, F.col("vec_id") == 599, top=5, range_rows=50).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 3, 5, 7, 9]


def test_nearest_of_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    rows = ann.nearest(df, F.col("vec_id") == 1, top=9).orderBy("rank").collect()
    assert [r["vec_id"] for r in rows] == [13, 12, 2, 2, 8, None]
    assert ann.nearest(df.where("false"), F.col("vec_id") > 0).count() == 0


def test_hilbert_curve():
    side, dims = 8, 3
    cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    keys = ann.hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(side**dims))
    steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1)
    assert (steps == 1).all()

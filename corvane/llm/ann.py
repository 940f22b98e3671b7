"""Nearest neighbours by inner product, from windows of several shifted Hilbert orderings.

Inner products become distances by one more component: a row x of norm |x| gets sqrt(M^2 - |x|^2), M being the largest
norm of the sample, and a query, scaled to the norm M, gets 0; the row nearest to it is the one with the largest inner
product. Each ordering projects these vectors to a few dimensions, drawn from the principal components of a sample by
their share of the variance, shifts and quantises them and takes their Hilbert keys. Keys are dealt into ranges of
about equal numbers of rows; a query's window is the range of its own key and some to either side. The windows of all
orderings merge, and their rows are reranked by the exact inner product in double precision.

How many orderings, and how wide the windows, is calibrated against brute force: `asked` of the queries are compared
with all rows (in blocks, each task keeping the best of its own), which gives their true neighbours and how many ranges
away these lie in each ordering; those orderings, two at least, and that width are taken which give `recall` at the
least cost in inner products and rows moved. So windows are as narrow as the whole table's neighbours allow, not as a sample's. In many dimensions without
structure no ordering keeps neighbours together, and the windows come out wide; the result is then still right, at the
cost of a search of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_table
from .embedding_dedup import matrix, usable


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place of each row of cells (integers below 2^bits) on the Hilbert curve through that cube."""
    x = cells.T.astype(np.int64).copy()
    dims = len(x)
    # Undo the excess work of rotations and reflections, level by level, from the coarsest on.
    level = 1 << (bits - 1)
    while level > 1:
        below = level - 1
        for d in range(dims):
            high = (x[d] & level) != 0
            swap = np.where(high, 0, (x[0] ^ x[d]) & below)
            x[0] ^= np.where(high, below, swap)
            x[d] ^= swap
        level >>= 1
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        flip ^= np.where((x[-1] & level) != 0, level - 1, 0)
        level >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[d] >> b) & 1)
    return key


@dataclass
class Index:
    """What the orderings of vectors of one length need: scale and norm, projections, cell borders, range borders; and
    how many ranges a window has to either side."""

    scale: float
    norm: float
    turns: list[np.ndarray]
    borders: list[np.ndarray]
    ranges: list[np.ndarray]
    bits: int
    width: int = 0

    def augmented(self, vectors: np.ndarray, asks: bool) -> np.ndarray:
        """The vectors with the component that makes inner products distances, as rows or as queries."""
        x = np.clip(vectors / self.scale, -1e150, 1e150)
        square = (x * x).sum(axis=1)
        if asks:
            return np.column_stack((x * (self.norm / np.sqrt(np.where(square > 0, square, 1.0)))[:, None], np.zeros(len(x))))
        return np.column_stack((x, np.sqrt(np.maximum(self.norm**2 - square, 0.0))))

    def keys(self, points: np.ndarray, order: int) -> np.ndarray:
        low = points @ self.turns[order]
        cells = np.stack([np.searchsorted(self.borders[order][d], low[:, d]) for d in range(low.shape[1])], axis=1)
        return hilbert_keys(cells, self.bits)

    def places(self, vectors: np.ndarray, asks: bool) -> np.ndarray:
        """The range of each vector in each ordering."""
        points = self.augmented(vectors, asks)
        return np.stack([np.searchsorted(ranges, self.keys(points, k), side="right") for k, ranges in enumerate(self.ranges)], axis=1)

    def share(self, orderings: list[int] | None = None, width: int | None = None) -> float:
        """The rows that a query is compared with, as a share of all rows; a row counts in each ordering."""
        width = self.width if width is None else width
        return sum(min(1.0, (2 * width + 1) / (len(self.ranges[k]) + 1)) for k in (range(len(self.ranges)) if orderings is None else orderings))


def fit(sample: np.ndarray, rows: int, orders: int, dims: tuple[int, ...], bits: int, range_rows: int, seed: int) -> Index:
    """Orderings from a sample, for so many rows in all; not calibrated yet."""
    rng = np.random.default_rng(seed)
    scale = float(np.abs(sample).max())
    x = sample / scale
    index = Index(scale, float(np.sqrt((x * x).sum(axis=1).max())), [], [], [], bits)
    points = index.augmented(sample, False)
    variance, components = np.linalg.eigh(np.atleast_2d(np.cov(points.T, bias=True)))
    weights = np.sqrt(np.maximum(variance, 0.0))
    usable = max(1, int((weights > 1e-9 * max(weights.max(), 1e-300)).sum()))
    count = max(1, min(len(sample), -(-rows // range_rows)))
    for order in range(orders):
        draw = components @ (weights[:, None] * rng.standard_normal((len(weights), min(dims[order % len(dims)], usable))))
        turn, _ = np.linalg.qr(draw)
        index.turns.append(turn)
        low = points @ turn
        shift = rng.random()  # each ordering has its cells shifted by a part of a cell
        share = (np.arange(1, 1 << bits) - shift) / (1 << bits)
        index.borders.append(np.quantile(low, np.clip(share, 0, 1), axis=0).T.copy())
        index.ranges.append(np.unique(np.quantile(index.keys(points, order), np.arange(1, count) / count, method="nearest")))
    return index


#: About how many inner products take as long as moving a row to another task does.
MOVED = 200


def _calibrate(index: Index, apart: np.ndarray, recall: float, rows: int, queries: int) -> None:
    """Keep the orderings, two at least, and set the width that give the recall at the least cost: inner products, and
    rows and queries moved to the ranges. apart: for each true neighbour, how many ranges it lies away in each
    ordering. For each width orderings are taken greedily, the one that reaches most of the neighbours not reached yet
    first."""
    several, count = min(2, len(index.turns)), max(len(r) + 1 for r in index.ranges)
    widths = sorted({min(count, round(1.25**k) - 1) for k in range(200)})
    best = None
    for width in widths:
        near, taken, missed = apart <= width, [], np.ones(len(apart), dtype=bool)
        while len(taken) < near.shape[1] and (len(taken) < several or missed.mean() > 1 - recall if len(apart) else len(taken) < several):
            gain = (near & missed[:, None]).sum(axis=0)
            gain[taken] = -1
            taken.append(int(gain.argmax()))
            missed &= ~near[:, taken[-1]]
        if len(apart) and missed.mean() > 1 - recall:
            continue
        moved = rows * len(taken) + queries * sum(min(2 * width + 1, len(index.ranges[k]) + 1) for k in taken)
        cost = queries * rows * index.share(taken, width) + MOVED * moved
        if best is None or cost < best[0]:
            best = cost, taken, width
    _, taken, index.width = best
    index.turns, index.borders, index.ranges = ([of[k] for k in taken] for of in (index.turns, index.borders, index.ranges))


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of each vector length (column 0)."""
    for dim in sorted(set(batch.column(0).to_pylist())):
        yield dim, batch.filter(pa.array(batch.column(0).to_numpy() == dim))


def true_places(rows: DataFrame, fitted: dict[int, Index], asked: dict[int, tuple[np.ndarray, np.ndarray]], top: int) -> DataFrame:
    """dim, q, places (the ranges in each ordering) of the `top` rows nearest to each of the queries asked (their rid
    and vectors by dim), among all rows. A task keeps the best of its own rows, groups of tasks the best of theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for dim, part in _by_dim(batch):
                data, rid = matrix(part.column(2)), part.column(1).to_numpy()
                q_rid, q = asked[dim]
                scores = q @ data.T
                scores[q_rid[:, None] == rid[None, :]] = -np.inf
                where = fitted[dim].places(data, False)
                many = min(top, scores.shape[1])
                pick = np.argpartition(-scores, many - 1, axis=1)[:, :many]
                got = np.take_along_axis(scores, pick, 1), rid[pick], where[pick]
                if dim in best:
                    got = tuple(np.concatenate((x, y), axis=1) for x, y in zip(best[dim], got, strict=True))
                    pick = np.argsort(-got[0], axis=1, kind="stable")[:, :top]
                    got = np.take_along_axis(got[0], pick, 1), np.take_along_axis(got[1], pick, 1), np.take_along_axis(got[2], pick[:, :, None], 1)
                best[dim] = got
        for dim, (scores, rid, where) in best.items():
            queries, found = np.nonzero(np.isfinite(scores))
            places = pa.array(where[queries, found].tolist(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(queries), dim, np.int32)), pa.array(queries.astype(np.int32)), pa.array(scores[queries, found]), pa.array(rid[queries, found]), places], names=["dim", "q", "score", "rid", "places"])

    found = rows.select("dim", "rid", "embedding").mapInArrow(run, "dim int, q int, score double, rid long, places array<long>")
    for by in (["dim", "q", F.pmod(F.xxhash64("rid"), F.lit(64))], ["dim", "q"]):
        found = found.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "rid"))).where(F.col("_n") <= top).drop("_n")
    return found.select("dim", "q", "places")


def calibrated(rows: DataFrame, top: int = 20, orders: int = 16, dims: tuple[int, ...] = (2, 3, 4, 6), bits: int = 8, range_rows: int = 640, sample: int = 8192, asked: int = 256, recall: float = 0.95, seed: int = 11) -> dict[int, Index]:
    """An index for each vector length of rows (a written table: dim, rid, embedding, asks)."""
    counted = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("asks").alias("queries")).collect()  # a row per length
    totals = {r["dim"]: r["n"] for r in counted}
    queries_of = {r["dim"]: r["queries"] for r in counted}
    drawn = lambda of, many: of.withColumn("_h", F.xxhash64("rid", F.lit(seed))).withColumn("_n", F.row_number().over(Window.partitionBy("dim", F.spark_partition_id()).orderBy("_h"))).where(F.col("_n") <= many)
    some, queries = drawn(rows.select("dim", "embedding", "rid"), sample), drawn(rows.where("asks").select("dim", "embedding", "rid"), asked)
    fitted, tried = {}, {}
    for dim in sorted(totals):
        first = lambda of, many: of.where(F.col("dim") == dim).orderBy("_h", "rid").limit(many).select("rid", "embedding").toArrow()  # noqa: B023, E731
        fitted[dim] = fit(matrix(first(some, sample)["embedding"]), totals[dim], orders, dims, bits, range_rows, seed)
        got = first(queries, asked)
        tried[dim] = got["rid"].to_numpy(), matrix(got["embedding"]) if len(got) else np.empty((0, dim))
    single = all(not len(r) for i in fitted.values() for r in i.ranges)
    near = [] if single or not any(len(t[0]) for t in tried.values()) else true_places(rows, fitted, tried, top).collect()  # asked * top rows
    for dim, index in fitted.items():
        own = index.places(tried[dim][1], True) if len(tried[dim][0]) else None
        apart = [np.abs(np.array(r["places"]) - own[r["q"]]) for r in near if r["dim"] == dim]
        _calibrate(index, np.array(apart).reshape(len(apart), orders), recall, totals[dim], queries_of[dim])
    return fitted


def nearest(vectors: DataFrame, is_query, top: int = 20, range_rows: int = 640, most_queries: int = 8192, **fitting) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for the rows of vectors (vec_id, embedding) where is_query holds: the
    `top` rows found with the largest inner products, ties to the smaller vec_id; all rows, if there are fewer.

    Null, empty and zero vectors, and those with null or non-finite components, are neither queries nor found; nor
    are vectors of another length than the query's. The query's own row is left out, others with its vec_id are not;
    repeated rows are rows of their own. A null vec_id can be found and comes last among equals. Other columns play no
    part. Empty input, or no queries: no rows. `fitting` goes to calibrated(): the index is
    fitted on `sample` rows, and calibrated on `asked` queries.
    """
    rows = searchable(vectors, is_query)
    fitted = calibrated(rows, top, range_rows=range_rows, **fitting)
    return search(rows, fitted, top, range_rows, most_queries)


def searchable(vectors: DataFrame, is_query) -> DataFrame:
    """The vectors that take part, as a written table: vec_id, embedding, asks, rid, dim."""
    rows = vectors.select("vec_id", "embedding", F.coalesce(is_query, F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("rid"))
    return materialize(rows.where(usable("embedding")).withColumn("dim", F.size("embedding")), "ann-rows")


def search(rows: DataFrame, fitted: dict[int, Index], top: int, range_rows: int, most_queries: int) -> DataFrame:
    """What nearest gives, with an index."""
    spark = rows.sparkSession
    names = ["dim", "ordering", "range", "asked_range", "rid", "vec_id", "asks", "embedding"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in _by_dim(batch):
                data, index = matrix(part.column(4)), fitted[dim]
                where, at = (index.places(data, asks) for asks in (False, True))
                for order in range(len(index.turns)):
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(len(data), order, np.int32)), pa.array(where[:, order].astype(np.int64)), pa.array(at[:, order].astype(np.int64)), part.column(1), part.column(2), part.column(3), part.column(4)], names=names)

    kind = "array<float>" if rows.schema["embedding"].dataType.elementType.simpleString() == "float" else "array<double>"
    placed = rows.select("dim", "rid", "vec_id", "asks", "embedding").mapInArrow(place, f"dim int, ordering int, `range` long, asked_range long, rid long, vec_id long, asks boolean, embedding {kind}")
    placed = materialize(placed, "ann-placed")
    widths = small_table(spark, [{"dim": d, "width": i.width} for d, i in fitted.items()], "dim int, width bigint") if fitted else spark.createDataFrame([], "dim int, width long")
    by = ["dim", "ordering", "range"]
    window = F.explode(F.sequence(F.col("asked_range") - F.col("width"), F.col("asked_range") + F.col("width"))).alias("range")
    # Rows of a range that equal keys make large, and the queries that come to a range, are dealt into parts; each part
    # of rows meets each part of queries, so that a task holds a bounded number of both.
    coming = placed.where("asks").groupBy("dim", "ordering", "asked_range").agg(F.count("*").alias("n")).join(F.broadcast(widths), "dim").select("dim", "ordering", "n", window)
    coming = coming.groupBy(*by).agg(F.ceil(F.sum("n") / most_queries).cast("long").alias("turns"))
    parts = placed.groupBy(*by).agg(F.ceil(F.count("*") / (2 * range_rows)).cast("long").alias("parts")).join(coming, by)
    held = placed.join(parts, by).withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts"))).withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)))
    queries = placed.where("asks").join(F.broadcast(widths), "dim").select("dim", "ordering", "rid", "vec_id", "embedding", window)
    queries = queries.join(parts, by).withColumn("turn", F.pmod(F.xxhash64("rid", F.lit(1)), F.col("turns"))).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    by += ["part", "turn"]
    queries = queries.select(*[F.col(c).alias(f"q_{c}") for c in by], F.col("rid").alias("q_rid"), F.col("vec_id").alias("q_vec_id"), F.col("embedding").alias("q_embedding"))

    def rerank(some: pa.Table, there: pa.Table) -> pa.Table:
        return _best(some, there, top)

    held = held.select(*by, "rid", "vec_id", "embedding")
    found = queries.groupBy(*[f"q_{c}" for c in by]).cogroup(held.groupBy(*by)).applyInArrow(rerank, "query_rid long, query_id long, found array<struct<score:double, vec_id:bigint, rid:bigint>>")
    merge = lambda lists: _merged(lists, top)
    return found.groupBy("query_rid").applyInArrow(merge, "query_id long, rank int, vec_id long, score double")


def _merged(lists: pa.Table, top: int) -> pa.Table:
    """The best of a query's rows found in its windows, `top` at most from each: a row may be in several."""
    best = lists["found"].combine_chunks().flatten()
    rid, score = pc.struct_field(best, "rid").to_numpy(), pc.struct_field(best, "score").to_numpy()
    vec_id = pc.struct_field(best, "vec_id")
    ids = pc.fill_null(vec_id, 2**63 - 1).to_numpy()
    _, first = np.unique(rid, return_index=True)
    order = first[np.lexsort((rid[first], ids[first], -score[first]))][:top]
    asked = lists["query_id"][0].as_py()
    return pa.table({"query_id": pa.array([asked] * len(order), pa.int64()), "rank": pa.array(range(1, len(order) + 1), pa.int32()), "vec_id": vec_id.take(pa.array(order)), "score": score[order]})


_FOUND = pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64()), ("rid", pa.int64())]))


def _best(queries: pa.Table, there: pa.Table, top: int) -> pa.Table:
    """For each query the best rows of one range: (query_rid, query_id, found)."""
    out: list[tuple] = []
    if len(queries) and len(there):
        rid, ids = there["rid"].to_numpy(), pc.fill_null(there["vec_id"], 2**63 - 1).to_numpy()
        order = np.lexsort((rid, ids))
        rid, ids = rid[order], ids[order]
        data = matrix(there["embedding"])[order]
        # Equal vectors are multiplied once, so that they tie exactly, and the first of them by vec_id come out.
        kinds, kind_of = np.unique(data, axis=0, return_inverse=True)
        by_kind = np.argsort(kind_of, kind="stable")
        starts = np.searchsorted(kind_of[by_kind], np.arange(len(kinds) + 1))
        single = len(kinds) == len(data)
        # Each of two sums of products is off by no more than this share of sum |a| max |b|; four of them are between two scores.
        slack, largest = 4 * (data.shape[1] + 1) * np.finfo(data.dtype).eps, np.abs(data).max()
        asked, asked_rid, asked_id = matrix(queries["q_embedding"]), queries["q_rid"].to_numpy(), queries["q_vec_id"].to_pylist()
        for at in range(0, len(asked), 256):
            scores = asked[at : at + 256] @ kinds.T
            many = min(top + 1, len(kinds))
            if many < len(kinds):
                # All that may tie with the last one picked, or beat it when multiplied exactly, are reranked.
                least = np.partition(scores, len(kinds) - many, axis=1)[:, len(kinds) - many]
                error = slack * np.abs(asked[at : at + 256]).sum(axis=1) * largest
                picks = [np.flatnonzero(~(row < low)) for row, low in zip(scores, least - error, strict=True)]
            else:
                picks = [np.arange(len(kinds))] * len(scores)
            for q, chosen in enumerate(picks, start=at):
                rows = by_kind[starts[chosen]] if single else np.concatenate([by_kind[starts[c] : min(starts[c + 1], starts[c] + top + 1)] for c in chosen])
                rows = rows[rid[rows] != asked_rid[q]]
                exact = (data[rows] * asked[q]).sum(axis=1)
                keep = np.lexsort((rid[rows], ids[rows], -exact))[:top]
                out.append((int(asked_rid[q]), asked_id[q], [{"score": float(exact[k]), "vec_id": None if ids[rows[k]] == 2**63 - 1 else int(ids[rows[k]]), "rid": int(rid[rows[k]])} for k in keep]))
    a, b, c = zip(*out, strict=True) if out else ((), (), ())
    return pa.table({"query_rid": pa.array(a, pa.int64()), "query_id": pa.array(b, pa.int64()), "found": pa.array(c, _FOUND)})

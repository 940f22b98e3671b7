"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

Vectors of a group (equal label and length), equal ones as one, are dealt into blocks; each pair of blocks is a tile, a
task of bounded size. Unit vectors are quantised to int8, u = s q + e, with e known exactly enough to bound the error
of s_u s_w (q_u . q_w) by |e_u| + (1 + |e_u|) |e_w|. Tiles get codes, scales and bounds only. Pairs surely above the
threshold are links; pairs that the bounds leave open are computed from the original vectors in double precision,
fetched for these pairs, or, where a tile has very many of them, for the tile. A tile gives, for each vector, how many
links it has there and one link of a spanning forest, so that a group of k near copies never gives k * k rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import components

_SLACK = 1e-9  # for the rounding of the bounds themselves


def usable(c: str) -> Column:
    """A vector with a direction: not null or empty, all components finite, and not zero."""
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(c).isNotNull() & (F.size(c) > 0) & finite & F.exists(c, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


class Quantised:
    """Unit vectors as int8 with scales and error bounds."""

    def __init__(self, vectors: np.ndarray):
        shrunk = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # no overflow in the norm
        self.unit = shrunk / np.sqrt((shrunk * shrunk).sum(axis=1, keepdims=True))
        self.scale = np.abs(self.unit).max(axis=1) / 127
        q = np.rint(self.unit / self.scale[:, None])
        self.error = np.sqrt(((self.unit - q * self.scale[:, None]) ** 2).sum(axis=1)) + _SLACK
        # Products of int8 values are exact in single precision while their sum stays below 2^24.
        self.q = q.astype(np.float32 if vectors.shape[1] * 127 * 127 < 1 << 24 else np.float64)


    @staticmethod
    def of(codes: pa.Array, scale: np.ndarray, error: np.ndarray) -> Quantised:
        """From what travels: int8 codes, scales and errors; without the vectors themselves."""
        self = object.__new__(Quantised)
        raw = codes.to_pylist()
        width = len(raw[0]) if raw else 0
        self.q = np.frombuffer(b"".join(raw), dtype=np.int8).reshape(len(raw), width).astype(np.float32 if width * 127 * 127 < 1 << 24 else np.float64)
        self.scale, self.error, self.unit = scale, error, None
        return self


def tile_links(a: Quantised, b: Quantised, threshold: float, same: bool, rows: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Index pairs (i of a, j of b), some rows at a time, i < j if both are the same block: those whose cosine is surely
    the threshold or more (True), and those that the bounds leave open (False). With the vectors there, open ones are
    decided, and all that are named link."""
    for at in range(0, len(a.q), rows):
        upto = min(at + rows, len(a.q))
        error = a.error[at:upto, None]
        near = (a.q[at:upto] @ b.q.T).astype(np.float64) * (a.scale[at:upto, None] * b.scale[None, :])
        bound = error + (1 + error) * b.error[None, :]
        i, j = np.nonzero(near + bound >= threshold - _SLACK)
        sure = (near - bound)[i, j] >= threshold + _SLACK
        i += at
        if same:
            i, j, sure = i[i < j], j[i < j], sure[i < j]
        if a.unit is not None and b.unit is not None:
            for k in np.array_split(np.flatnonzero(~sure), max(1, int((~sure).sum()) >> 15)):
                sure[k] = (a.unit[i[k]] * b.unit[j[k]]).sum(axis=1) >= threshold
            i, j, sure = i[sure], j[sure], sure[sure]
        for kind in (True, False):
            if (sure == kind).any():
                yield i[sure == kind], j[sure == kind], kind


class Forest:
    """Components of a tile's links, by hooking and pointer jumping on arrays."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        while True:
            x, y = self.root[x], self.root[y]
            apart = x != y
            if not apart.any():
                return
            x, y = x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while (self.root != (up := self.root[self.root])).any():
                self.root = up


_FOUND = "rid long, links long, root long, a long, b long, grp long, lo long, hi long"


def _tile(exact: bool, threshold: float, most_open: int) -> Callable[[pa.Table], pa.Table]:
    """What a tile gives: for each vector with links there how many (copies counted) and the root of its tree; the pairs
    that the bounds leave open; or, where these are more than most_open, its own name to be done exactly."""

    def run(group: pa.Table) -> pa.Table:
        lo, hi = group["lo"][0].as_py(), group["hi"][0].as_py()
        rid, own = group["rid"].to_numpy(), group["own"].to_numpy()
        order = np.lexsort((rid, own))
        rid, own, copies = rid[order], own[order], group["copies"].to_numpy()[order]
        split = int(np.searchsorted(own, lo, side="right"))
        if exact:
            data = matrix(group["embedding"].combine_chunks().take(pa.array(order)))
            block = lambda x, y: Quantised(data[x:y])
        else:
            codes, scale, error = group["codes"].combine_chunks().take(pa.array(order)), group["scale"].to_numpy()[order], group["error"].to_numpy()[order]
            block = lambda x, y: Quantised.of(codes[x:y], scale[x:y], error[x:y])
        first = block(0, split)
        second = first if lo == hi else block(split, len(rid))
        shift = 0 if lo == hi else split
        forest, links = Forest(len(rid)), np.zeros(len(rid), dtype=np.int64)
        left, n_left = [], 0
        if len(first.q) and len(second.q):
            for i, j, sure in tile_links(first, second, threshold, lo == hi):
                j = j + shift
                if sure:
                    np.add.at(links, i, copies[j])
                    np.add.at(links, j, copies[i])
                    forest.add(i, j)
                elif (n_left := n_left + len(i)) <= most_open:
                    left.append((rid[i], rid[j]))
                else:
                    break
        none = lambda n: pa.nulls(n, pa.int64())
        if n_left > most_open:
            return pa.table({c: pa.array([v], pa.int64()) for c, v in zip(("rid", "links", "root", "a", "b", "grp", "lo", "hi"), (*[None] * 5, group["grp"][0].as_py(), lo, hi), strict=True)})
        at = np.flatnonzero(links)
        a, b = (np.concatenate([pair[k] for pair in left]) if left else np.empty(0, np.int64) for k in (0, 1))
        columns = [(rid[at], len(a)), (links[at], len(a)), (rid[forest.root[at]], len(a))]
        out = {c: pa.concat_arrays([pa.array(v), none(n)]) for c, (v, n) in zip(("rid", "links", "root"), columns, strict=True)}
        out |= {c: pa.concat_arrays([none(len(at)), pa.array(v)]) for c, v in (("a", a), ("b", b))}
        return pa.table(out | {c: none(len(at) + len(a)) for c in ("grp", "lo", "hi")})

    return run


def _quantised(vectors: DataFrame) -> DataFrame:
    """vectors (grp, rid, copies, own, blocks, embedding) with int8 codes, scale and error bound in place of embeddings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column(5)).to_numpy()
            for dim in sorted(set(sizes.tolist())):
                part = batch.filter(pa.array(sizes == dim))
                made = Quantised(matrix(part.column(5)))
                codes = made.q.astype(np.int8)
                yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(made.scale), pa.array(made.error)], names=["grp", "rid", "copies", "own", "blocks", "codes", "scale", "error"])

    return vectors.select("grp", "rid", "copies", "own", "blocks", "embedding").mapInArrow(run, "grp long, rid long, copies long, own long, blocks long, codes binary, scale double, error double")


def _linking(pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (a, b), those whose vectors link, by the vectors themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(len(batch), dtype=bool)
            sizes = pc.list_value_length(batch.column(2)).to_numpy()
            for dim in sorted(set(sizes.tolist())):
                at = np.flatnonzero(sizes == dim)
                x, y = (Quantised(matrix(batch.column(c).take(pa.array(at)))).unit for c in (2, 3))
                keep[at] = (x * y).sum(axis=1) >= threshold
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    left = vectors.select(F.col("rid").alias("a"), F.col("embedding").alias("x"))
    right = vectors.select(F.col("rid").alias("b"), F.col("embedding").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, block: int = 4096, most_open: int = 1 << 15) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of vectors (vec_id, embedding, label).

    Rows with equal non-null labels and vectors of equal length link at a cosine of threshold or more. Null, empty or
    zero vectors, and those with null or non-finite components, link with nothing and are their own component.
    component_id: the least vec_id reached; a null vec_id counts only where there is no other, and is kept if its
    component has none. Rows that repeat a vec_id are vectors of their own. Other columns play no part. Empty input: no
    rows.
    """
    rows = materialize(vectors.select("vec_id", "embedding", "label", F.monotonically_increasing_id().alias("rid")), "vectors")
    good = rows.where(usable("embedding") & F.col("label").isNotNull()).withColumn("dim", F.size("embedding"))
    # Equal vectors are compared once, as one with so many copies.
    kinds = good.groupBy("label", "dim", "embedding").agg(F.min("rid").alias("rid"), F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
    kinds = materialize(kinds, "kinds")
    blocks = kinds.groupBy("label", "dim").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks"))
    blocks = materialize(blocks.withColumn("grp", F.monotonically_increasing_id()), "groups")
    placed = kinds.join(blocks, ["label", "dim"]).withColumn("own", F.pmod(F.xxhash64("rid"), F.col("blocks")))
    # Codes travel, and not the vectors: a tile needs these only for pairs that the bounds leave open.
    coded = _quantised(placed).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tiles = coded.select("grp", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "rid", "copies", "own", "codes", "scale", "error")
    by = ["grp", "lo", "hi"]
    tagged = tiles.groupBy(*by).applyInArrow(_tile(False, threshold, most_open), _FOUND)
    found = materialize(tagged, "tile-links")
    sums, edges = [found.where("rid is not null").select("rid", "links")], [found.where("rid is not null").select(F.col("rid").alias("a"), F.col("root").alias("b"))]
    left = materialize(_linking(found.where("a is not null").select("a", "b"), kinds, threshold), "left-open")
    weights = kinds.select("rid", "copies")
    for x, y in (("a", "b"), ("b", "a")):
        sums.append(left.join(weights, F.col(y) == F.col("rid")).select(F.col(x).alias("rid"), F.col("copies").alias("links")))
    edges.append(left)
    again = found.where("lo is not null").select("grp", "lo", "hi")
    if not again.isEmpty():
        whole = placed.join(again, "grp").where("own = lo or own = hi").select(*by, "rid", "copies", "own", "embedding")
        exact = materialize(whole.groupBy(*by).applyInArrow(_tile(True, threshold, most_open), _FOUND), "exact-links")
        sums.append(exact.select("rid", "links"))
        edges.append(exact.select(F.col("rid").alias("a"), F.col("root").alias("b")))
    counts = reduce(DataFrame.unionByName, sums).groupBy("rid").agg(F.sum("links").alias("links"))
    parts = components(reduce(DataFrame.unionByName, edges)).withColumnRenamed("node", "rid")
    linked = kinds.join(counts, "rid", "left").join(parts, "rid", "left").where("copies > 1 or links is not null")
    linked = linked.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rid").alias("component"), "first_id")
    least = linked.groupBy("component").agg(F.min("first_id").alias("component_id"))
    linked = materialize(linked.join(least, "component").select("label", "embedding", "n_links", "component_id"), "linked").withColumn("_linked", F.lit(True))
    out = rows.select("vec_id", "label", "embedding").join(linked, ["label", "embedding"], "left")
    component = F.when(F.col("_linked"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))

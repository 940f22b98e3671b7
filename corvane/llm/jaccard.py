"""Exact Jaccard join on word shingles by parity sketches.

A set's sketch is a vector of bits in which each element flips one; so the sketches of two sets differ in at most as
many bits as the sets differ in elements. Sets that link differ in at most D elements, D by their sizes. Sketches are
cut into P lanes of equal width, in order of the hash, with P >= D + 1: at least P - D lanes of a linking pair agree
(pigeonhole), and documents are joined on their lanes. Lanes are so wide that flips hardly meet, and a lane is kept as
the XOR of its elements' 64-bit codes, which is linear like the lane itself. D and P hold for a band of sizes; a set
goes into its own band, and into the next if sets there can be near enough in size.

Lanes with few elements agree by chance or through common passages. P = D + e + s; a set with at most e sparse lanes
leaves them out: lanes that agree are sparse in both sets, so those of a link still share s full lanes. Sets with more
sparse lanes also join on these, among themselves. And as a link shares s lanes or more, each set leaves out the s - 1
of its lanes that most sets have (prefix filtering), which empties the buckets of common passages. No link is lost.

Pairs in a lane's bucket are not all emitted. First each member is verified with the bucket's least member only, and
components are formed. After that only pairs across components count: in rounds, each member names the members of
other components whose sketches are nearest, as far as sketches allow a link, and of these a bucket emits those that
join its components. Pairs found to link merge components; rounds end when no pair is left that might link and has not
been verified, so none is lost. Pairs whose sketches are too many bits apart are dropped before their sets are fetched.
Buckets of frequent keys, as a large group of near copies has for each of its lanes, are dealt over several tasks in
every step: each part has a least member of its own, and these are joined by the least of the bucket.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import compact, forget_broadcasts, fresh, materialize
from .components import components
from .shingles import mixed, shingle_sets

_U = np.uint64
_SLICE = 1 << 20


class Bands:
    """Bands of set sizes with their lanes, for a threshold in per cent."""

    def __init__(self, per_cent: int, widest: float = 1.6, largest: int = 1 << 40):
        self.per_cent = per_cent
        self.lows = [1]
        while self.lows[-1] <= largest:
            self.lows.append(max(self.lows[-1] + 1, int(self.lows[-1] * widest)))

    def band(self, n: int) -> int:
        return int(np.searchsorted(self.lows, n, side="right")) - 1

    def lanes(self, band: int) -> tuple[int, int, int, int]:
        """Lanes, sparse lanes allowed, the most elements of a sparse lane, and the least number of full lanes that
        the sets of a link share; no lanes where only equal sets link."""
        most = self.lows[band + 1] - 1
        d = 2 * most * (100 - self.per_cent) // (100 + self.per_cent)
        if not d:
            return 0, 0, 0, 0
        allowed, shared = 3 + -(-d * 6 // 100), 3 + -(-d * 30 // 100)
        return d + allowed + shared, allowed, 1 if d >= 16 else 0, shared

    def shared(self) -> list[int]:
        """That least number for each band."""
        return [self.lanes(b)[3] for b in range(len(self.lows) - 1)]

    def of(self, n: int) -> list[int]:
        """The bands that a set of n elements joins in."""
        own = self.band(n)
        return [own, own + 1] if 100 * n >= self.per_cent * self.lows[own + 1] else [own]


def lane_keys(elements: np.ndarray, bands: Bands) -> np.ndarray:
    """The join keys of a set, given as sorted distinct hashes. The low byte of a key is its band."""
    out = []
    for band in bands.of(len(elements)):
        lanes, allowed, sparse, _ = bands.lanes(band)
        if not lanes:
            continue
        lane = ((elements >> _U(32)) * _U(lanes)) >> _U(32)  # ascending, as the elements are
        first = np.concatenate(([0], np.flatnonzero(lane[1:] != lane[:-1]) + 1))
        code = np.bitwise_xor.reduceat(mixed(elements), first)
        size = np.diff(first, append=len(elements))
        tag = mixed(lane[first] + _U(band << 40))
        full = size > sparse
        keys = [mixed(code[full] ^ tag[full])]
        if lanes - int(full.sum()) > allowed:
            empty = np.setdiff1d(np.arange(lanes, dtype=np.uint64), lane[first])
            keys += [mixed(code[~full] ^ tag[~full] ^ _U(1)), mixed(mixed(empty + _U(band << 40)) ^ _U(1))]
        out.append(np.concatenate(keys) & ~_U(255) | _U(band))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _signed(x: np.uint64) -> int:
    return int(np.array([x], dtype=np.uint64).view(np.int64)[0])


def check_of(elements: np.ndarray) -> int:
    """64 bits more of a set, drawn apart from those of its node."""
    if not len(elements):
        return 0
    return _signed(mixed(np.array([np.bitwise_xor.reduce(mixed(elements ^ _U(0x5851F42D4C957F2D))) ^ _U(len(elements))], dtype=np.uint64))[0])


@dataclass(frozen=True)
class Nodes:
    """Numbers of sets, equal for equal sets. Where different sets would share a number, told apart by 64 bits more,
    that number is among `conflicts`, and its sets get numbers by both. (bits: of the first number; less in tests.)"""

    conflicts: frozenset[int] = frozenset()
    bits: int = 64

    def of(self, elements: np.ndarray) -> int:
        if not len(elements):
            return 0
        node = _signed(mixed(np.array([np.bitwise_xor.reduce(mixed(elements)) + _U(len(elements))], dtype=np.uint64))[0] >> _U(64 - self.bits))
        while node in self.conflicts:
            node = _signed(mixed(np.array([np.int64(node).astype(np.uint64) ^ np.int64(check_of(elements)).astype(np.uint64)], dtype=np.uint64))[0])
        return node


def parity_bits(elements: np.ndarray) -> bytes:
    """The sketch of a set in at least two bits an element, a power of two of them."""
    width = max(64, 1 << (2 * len(elements) - 1).bit_length())
    flips = np.bincount((elements & _U(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(flips.astype(np.uint8)).tobytes()


def bits_apart(x: np.ndarray, y: np.ndarray) -> int:
    """The Hamming distance of two sketches; the longer folds to the shorter's width."""
    width = min(len(x), len(y))
    return int(np.bitwise_count(_folded(x, width) ^ _folded(y, width)).sum())


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[object, np.ndarray]]:
    """doc_id and set of each row, some texts at a time."""
    ids, texts, size = [], [], 0
    for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
        ids.append(doc_id.as_py())
        texts.append(text.as_buffer().to_pybytes() if text.is_valid else b"")
        size += len(texts[-1])
        if size >= _SLICE:
            yield from zip(ids, shingle_sets(texts, k), strict=True)
            ids, texts, size = [], [], 0
    if ids:
        yield from zip(ids, shingle_sets(texts, k), strict=True)


class _Seen:
    """The last sets that a task met, up to so many; equal sets have equal sketches and keys, so that meeting one
    again after it is forgotten costs time only."""

    def __init__(self, most: int = 1 << 16):
        self.nodes: OrderedDict[int, bool] = OrderedDict()
        self.most = most

    def first(self, node: int) -> bool:
        if node in self.nodes:
            return False
        self.nodes[node] = True
        if len(self.nodes) > self.most:
            self.nodes.popitem(last=False)
        return True


def sketches(docs: DataFrame, k: int, numbers: Nodes = Nodes()) -> DataFrame:
    """doc_id, n (the set's size), node, check (64 bits more of the set) and bits (the sketch) of each row; of equal sets
    in a task, the first has bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in batches:
            rows = []
            for doc_id, elements in _sets(batch, k):
                node = numbers.of(elements)
                rows.append((doc_id, len(elements), node, check_of(elements), parity_bits(elements) if len(elements) and seen.first(node) else None))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "n", "node", "check", "bits"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, node long, check long, bits binary")


def numbered(docs: DataFrame, k: int, bits: int = 64) -> tuple[DataFrame, Nodes]:
    """sketches() as a written table, with numbers that no two sets share (to 128 bits). Conflicts are as good as none
    up to billions of different sets, and m^2 / 2^65 of m sets beyond; each round of them is one more pass."""
    numbers = Nodes(bits=bits)
    while True:
        drawn = materialize(sketches(docs, k, numbers), "sketches")
        several = drawn.groupBy("node").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).where("lo <> hi").select("node").collect()
        if not several:
            return drawn, numbers
        numbers = Nodes(numbers.conflicts | {r["node"] for r in several}, bits)


def keyed(docs: DataFrame, k: int, per_cent: int, numbers: Nodes = Nodes()) -> DataFrame:
    """The rows (key, node) of all sets; those of equal sets in a task once. Keys are many and used once, so they are
    made while they are shuffled and never written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(per_cent), _Seen()
        keys: list[np.ndarray] = []
        nodes: list[int] = []
        size = 0
        for batch in batches:
            for _, elements in _sets(batch, k):
                node = numbers.of(elements)
                if len(elements) and seen.first(node):
                    keys.append(lane_keys(elements, bands))
                    nodes.append(node)
                    size += len(keys[-1])
                if size >= 1 << 16:
                    yield _key_batch(keys, nodes)
                    keys, nodes, size = [], [], 0
        if keys:
            yield _key_batch(keys, nodes)

    return docs.select("doc_id", "text").mapInArrow(run, "key long, node long")


def _key_batch(keys: list[np.ndarray], nodes: list[int]) -> pa.RecordBatch:
    owners = np.repeat(np.array(nodes, dtype=np.int64), [len(x) for x in keys])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(owners)], names=["key", "node"])


def possible(pairs: DataFrame, sketched: DataFrame, per_cent: int) -> DataFrame:
    """Of pairs (a, b), those that may link by size and by the distance of their sketches (node, n, bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for m, n, x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5), strict=True):
                near = 100 * min(m, n) >= per_cent * max(m, n)
                keep.append(near and bits_apart(np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)) <= (m + n) * (100 - per_cent) // (100 + per_cent))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sketched.select(F.col("node").alias("a"), F.col("n").alias("m"), F.col("bits").alias("x"))
    right = sketched.select(F.col("node").alias("b"), "n", F.col("bits").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "m", "n", "x", "y").mapInArrow(run, "a long, b long")


def across_components(rows: DataFrame, sketched: DataFrame, tried: DataFrame, per_cent: int, each: int = 1, block: int = 2048, sizes: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of nodes in different components that share a key and may link by size and sketch, and are not in
    tried (node, tried: nodes): of each node at most `each`, the nearest by sketch; with `each` of 1, only as many as
    join the components of a bucket. A key comes out, in a row of its own, if its bucket has such a pair. rows: key,
    node, component; sketched: node, n, bits; sizes (key, size), if known: other keys are left out. Buckets stream through tasks; those of more than `block` rows are dealt
    into blocks, and each pair of blocks is a bucket of its own. Sketches are shuffled once, to the buckets."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("size")) if sizes is None else sizes
    blocks = sizes.select("key", F.ceil(F.col("size") / block).cast("long").alias("blocks"))
    # This join is followed by one on nodes, so nothing keeps Spark from splitting the rows of a frequent key.
    dealt = rows.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tiles = dealt.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "node", "component")
    tiles = tiles.join(sketched, "node").join(tried, "node", "left").select("key", "lo", "hi", "node", "component", "n", "bits", "tried")

    def pairs_of(group: list[list]) -> set[tuple[int, int]]:
        nodes, parts, sizes = (np.array([g[i] for g in group], dtype=np.int64) for i in (0, 1, 2))
        kinds, part_of, counts = np.unique(parts, return_inverse=True, return_counts=True)
        if len(kinds) < 2:
            return set()
        found = [np.frombuffer(g[3], np.uint8) for g in group]
        width = min(map(len, found))
        sketches = np.stack([_folded(x, width) for x in found]).view(np.uint64)
        near: list[tuple[int, int, int]] = []
        for i in np.flatnonzero(part_of != counts.argmax()):
            j = np.flatnonzero((part_of != part_of[i]) & (100 * np.minimum(sizes, sizes[i]) >= per_cent * np.maximum(sizes, sizes[i])))
            if group[i][4]:
                j = j[~np.isin(nodes[j], group[i][4])]
            apart = np.bitwise_count(sketches[j] ^ sketches[i]).sum(axis=1)
            fits = apart <= (sizes[j] + sizes[i]) * (100 - per_cent) // (100 + per_cent)
            j, apart = j[fits], apart[fits]
            best = np.argsort(apart, kind="stable")[:each]
            near += [(int(d), int(i), int(x)) for d, x in zip(apart[best], j[best], strict=True)]
        out, up = set(), list(range(len(kinds)))
        for _, i, j in sorted(near):
            x, y = part_of[i], part_of[j]
            while up[x] != x:
                x = up[x]
            while up[y] != y:
                y = up[y]
            if x != y or each > 1:
                up[x] = y
                out.add((min(int(nodes[i]), int(nodes[j])), max(int(nodes[i]), int(nodes[j]))))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, keys, pairs = None, [], set(), set()

        def close() -> None:
            if len(group) > 1 and (got := pairs_of(group)):
                keys.add(now[0])
                pairs.update(got)

        for batch in batches:
            for key, lo, hi, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, lo, hi) != now:
                    close()
                    now, group = (key, lo, hi), []
                group.append(row)
            if len(pairs) > 1 << 14:
                yield _found_batch(keys, pairs)
                keys, pairs = set(), set()
        close()
        yield _found_batch(keys, pairs)

    ordered = tiles.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return ordered.mapInArrow(run, "key long, a long, b long")


def _found_batch(keys: set[int], pairs: set[tuple[int, int]]) -> pa.RecordBatch:
    rows = [(k, None, None) for k in keys] + [(None, *p) for p in pairs]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["key", "a", "b"])


def _folded(x: np.ndarray, width: int) -> np.ndarray:
    """A sketch of so many bytes, from one as long or longer."""
    while len(x) > width:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def fetched_sets(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, k: int, known: DataFrame | None = None, numbers: Nodes = Nodes()) -> DataFrame:
    """node and elements (little-endian 64-bit, ascending) of the nodes in pairs (a, b), from the texts; those in
    known are taken from there. nodes: doc_id and node, a row per node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, elements = [], []
            for _, e in _sets(batch, k):
                nodes.append(numbers.of(e))
                elements.append(e.tobytes())
                if len(nodes) >= 256:
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(elements, pa.binary())], names=["node", "elements"])
                    nodes, elements = [], []
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(elements, pa.binary())], names=["node", "elements"])

    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    if known is not None:
        ends = ends.join(known, "node", "left_anti")
    wanted = materialize(nodes.select("node", "doc_id").join(ends, "node", "left_semi"), "wanted")
    if known is not None and wanted.isEmpty():
        return known
    ids = wanted.select(F.col("doc_id").alias("_wanted")).distinct()
    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("_wanted")), "left_semi")
    got = materialize(texts.mapInArrow(run, "node long, elements binary").join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]), "sets")
    return got if known is None else known.unionByName(got)


def verified(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """Of pairs (a, b), those whose sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                if 100 * min(len(x), len(y)) < per_cent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = np.concatenate((x, y))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= per_cent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("elements").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def linked_nodes(docs: DataFrame, members: DataFrame, sketched: DataFrame, nodes: DataFrame, k: int, per_cent: int, numbers: Nodes = Nodes()) -> DataFrame:
    """(node, component) of the nodes that link. members (key, salt, node): buckets with more nodes than one, those of
    frequent keys in parts with salts from 1 on; sketched (node, n, bits): their sketches."""
    led = members.withColumn("b", F.min("node").over(Window.partitionBy("key", "salt")))
    leaders = led.where("salt > 0").select("key", F.col("b").alias("a")).distinct()
    first = leaders.groupBy("key").agg(F.min("a").alias("b"))
    stars = led.select(F.col("node").alias("a"), "b").unionByName(leaders.join(first, "key").select("a", "b")).where("a <> b").distinct()
    near = materialize(possible(stars, sketched, per_cent), "stars")
    sets = fetched_sets(docs, nodes, near, k, None, numbers)
    links = materialize(verified(near, sets, per_cent), "links")
    tried = near.select("a", "b")
    done, each = materialize(components(links), "components"), 1
    open_rows = materialize(led.where("node <> b or salt > 0").select("key", "node"), "open")  # pairs with the least member of a whole bucket are tried
    open_keys = None
    while True:
        placed = open_rows.join(done, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
        several = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where("lo <> hi").select("key", "size")
        several = several if open_keys is None else several.join(open_keys, "key", "left_semi")
        both = tried.unionByName(tried.select(F.col("a").alias("b"), F.col("b").alias("a")))
        both = both.groupBy(F.col("a").alias("node")).agg(F.collect_set("b").alias("tried"))  # at most `each` a round and bucket
        found = materialize(across_components(placed, sketched, both, per_cent, each, sizes=several), "across")
        pairs = materialize(found.where("a is not null").select("a", "b").distinct(), "pairs")
        if pairs.isEmpty():
            return done
        sets = fetched_sets(docs, nodes, pairs, k, sets, numbers)
        more = materialize(verified(pairs, sets, per_cent), "links")
        tried = tried.unionByName(pairs)
        each *= 4
        # A bucket without such a pair will have none later: components only merge, and pairs tried only grow.
        open_keys = materialize(found.where("key is not null").select("key").distinct(), "open-keys")
        if not more.isEmpty():
            links = links.unionByName(more)
            done = materialize(components(links), "components")


def frequent_keys(docs: DataFrame, k: int, per_cent: int, numbers: Nodes, share: float = 1 / 16, least: int = 64, part: int = 512) -> DataFrame:
    """Keys that very many different sets have: key, common (about how many) and parts (to split them into, about
    `part` sets each). They are found in a sample of the texts, which decides how rows are dealt to tasks and in which
    order lanes are left out, and never which pairs are found."""
    some = keyed(docs.sample(share, 5), k, per_cent, numbers).distinct().groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    common = F.ceil(F.col("n") / share).cast("long")
    parts = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(common / part, F.lit(1.0))))).cast("long")  # powers of two: parts of one key lie in those of another
    return materialize(some.select("key", common.alias("common"), parts.alias("parts")), "frequent")


def _buckets(rows: DataFrame, shared: list[int], frequent: DataFrame) -> DataFrame:
    """The distinct rows (key, salt, node) of keys that several nodes have, without each node's shared - 1 commonest
    keys of each band. Rows of a frequent key are dealt over its parts, with salts from 1 on."""
    salted = rows.join(frequent.select("key", "parts"), "key", "left").select("key", "node", F.coalesce(1 + F.pmod(F.xxhash64("node"), F.col("parts")), F.lit(0)).cast("int").alias("salt"))
    key = Window.partitionBy("key", "salt")
    several = lambda df: df.withColumn("lo", F.min("node").over(key)).withColumn("hi", F.max("node").over(key)).where("lo <> hi or salt > 0")
    common = several(salted.withColumn("rows", F.count("*").over(key))).groupBy("key", "salt", "node").agg(F.max("rows").alias("rows"))
    common = common.join(frequent.select("key", "common"), "key", "left").withColumn("rows", F.coalesce("common", "rows"))  # the same for all sets with the key
    band = F.col("key").bitwiseAND(F.lit(255)).cast("int")
    ranked = common.withColumn("band", band).withColumn("rank", F.row_number().over(Window.partitionBy("node", "band").orderBy(F.desc("rows"), "key")))
    return several(ranked.where(F.col("rank") >= F.element_at(F.lit(shared), F.col("band") + 1)).select("key", "salt", "node")).select("key", "salt", "node")


def _joined(docs: DataFrame, k: int, per_cent: int, bits: int = 64) -> tuple[DataFrame, DataFrame, Nodes]:
    """nodes (doc_id, n, node) of all rows, (node, component, component_id) of those with elements, and the numbers."""
    spark = docs.sparkSession
    drawn, numbers = numbered(docs, k, bits)
    nodes = drawn.select("doc_id", "n", "node")
    frequent = frequent_keys(docs, k, per_cent, numbers)
    members = materialize(_buckets(keyed(docs, k, per_cent, numbers), Bands(per_cent).shared(), frequent), "members")
    there = members.select("node").distinct()
    sketched = materialize(drawn.where("bits is not null").select("node", "n", "bits").join(there, "node", "left_semi").dropDuplicates(["node"]), "bits")
    firsts = materialize(nodes.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id")), "firsts")
    linked = linked_nodes(docs, members, sketched, firsts, k, per_cent, numbers)
    classes = materialize(firsts.join(linked, "node", "left").select("node", F.col("doc_id").alias("first_id"), F.coalesce("component", "node").alias("component")), "classes")
    least = classes.groupBy("component").agg(F.min("first_id").alias("component_id"))
    forget_broadcasts(spark)
    return nodes, materialize(classes.join(least, "component").select("node", "component", "component_id"), "labels"), numbers


def jaccard_components(docs: DataFrame, k: int = 5, per_cent: int = 80, bits: int = 64) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs.

    A set: the distinct runs of k words of the whole text, A-Z lower-cased; with fewer words, all of them as one;
    null texts and texts without words have none, link with nothing and are their own component. Sets link when
    100 * intersection >= per_cent * union. component_id: the least doc_id that links reach, itself included; a null
    doc_id counts only where there is no other. Repeated rows come out once each. Other columns play no part.
    Empty input: no rows. bits: see Nodes.
    """
    nodes, labels, _ = _joined(docs, k, per_cent, bits)
    filled = nodes.where("n > 0").join(labels, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return compact(filled.unionByName(nodes.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))))


def one_of_each(docs: DataFrame, k: int = 5, per_cent: int = 80) -> DataFrame:
    """The rows of docs without near duplicates: of each component, one row with its least doc_id; all rows without
    words. A row with a null doc_id stays only where its component has no other. All columns are kept. Empty input: no
    rows."""
    nodes, labels, numbers = _joined(docs, k, per_cent)
    placed = nodes.where("n > 0").join(labels, "node")
    kept = materialize(placed.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component", "doc_id").agg(F.min("node").alias("node")).select("doc_id", "node"), "kept")
    # Rows whose doc_id no other row has are told by it; the others, by doc_id and set.
    the_id, the_n, the_node, other_node = (fresh(docs, c) for c in ("_id", "_n", "_node", "_kept"))
    repeated = materialize(nodes.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1 or doc_id is null").select(F.col("doc_id").alias(the_id)), "repeated")
    dropped = placed.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(the_id)).unionByName(repeated).distinct()
    same_id = F.col("doc_id").eqNullSafe(F.col(the_id))
    once = docs.join(materialize(dropped, "dropped"), same_id, "left_anti")
    if repeated.isEmpty():
        return compact(once)
    again = docs.join(repeated, same_id, "left_semi")
    columns = again.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = [columns.index("doc_id"), columns.index("text")]
        for batch in batches:
            found = [(len(e), numbers.of(e)) for _, e in _sets(batch.select(at), k)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([n for n, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=[*batch.schema.names, the_n, the_node])

    known = again.mapInArrow(run, again.select("*", F.lit(0).cast("long").alias(the_n), F.lit(0).cast("long").alias(the_node)).schema)
    stay = kept.select(F.col("doc_id").alias(the_id), F.col("node").alias(other_node))
    chosen = known.where(F.col(the_n) > 0).join(stay, same_id & (F.col(the_node) == F.col(other_node)), "left_semi").dropDuplicates(["doc_id", the_node])
    return compact(once.unionByName(chosen.unionByName(known.where(F.col(the_n) == 0)).select(*[F.col(c) for c in columns])))

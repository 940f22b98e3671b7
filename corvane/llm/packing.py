"""Best-fit packing after Martello-Toth dominance reduction.

How many pieces there are of each length (at most `capacity` numbers, whatever the corpus) is all that the packing
depends on, so it is solved on that histogram: whole classes of bins are fixed or filled at once. A set of pieces
dominates others if no other way to fill the bin of its largest piece can do better; such sets are fixed for good, the
instance shrinks, and best-fit decreasing packs the remainder. Pieces then find their places by their rank among
those of their length, which tasks count as they make them.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import loaded
from .common import compact, materialize, small_table

Pattern = tuple[int, dict[int, int]]  # so many bins, each with so many pieces of a length


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Fix dominating sets, taking their pieces from counts; what is left there is the reduced instance."""
    fixed: list[Pattern] = []

    def fix(*lengths: int) -> None:
        need: dict[int, int] = defaultdict(int)
        for x in lengths:
            need[x] += 1
        bins = min(counts[x] // k for x, k in need.items())
        for x, k in need.items():
            counts[x] -= bins * k
            if not counts[x]:
                del counts[x]
        fixed.append((bins, dict(need)))

    def others(x: int, y: int | None = None) -> list[int]:
        """The lengths still there, ascending, beside one piece of x (and one of y)."""
        return sorted(z for z, n in counts.items() if n > (z == x) + (z == y))

    changed = True
    while changed:
        changed = False
        for x in sorted(counts, reverse=True):
            while counts.get(x):
                room, rest = capacity - x, others(x)
                fitting = [y for y in rest if y <= room]
                if not fitting:  # nothing goes with it
                    fix(x)
                elif x + fitting[-1] == capacity:  # a perfect pair
                    fix(x, fitting[-1])
                else:
                    least = fitting[0]
                    second = least if counts[least] > 1 + (least == x) else (fitting[1] if len(fitting) > 1 else None)
                    if second is None or least + second > room:  # one more at most: the largest that fits
                        fix(x, fitting[-1])
                    else:
                        third = next((z for z in others(least, second) if z != x or counts[x] > 1 + (least == x) + (second == x)), None)
                        pair = _best_pair(fitting, counts, x, room)
                        if (third is None or least + second + third > room) and fitting[-1] >= pair:  # two more at most, and they hold no more than the one
                            fix(x, fitting[-1])
                        else:
                            break
                changed = True
    return fixed


def _best_pair(fitting: list[int], counts: dict[int, int], x: int, room: int) -> int:
    """The largest sum within room of two pieces beside x."""
    best, lo, hi = 0, 0, len(fitting) - 1
    while lo <= hi:
        s = fitting[lo] + fitting[hi]
        if lo == hi and counts[fitting[lo]] < 2 + (fitting[lo] == x):
            break
        if s <= room:
            best = max(best, s)
            lo += 1
        else:
            hi -= 1
    return best


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit for pieces in order of falling length, class by class."""
    open_bins: dict[int, list[tuple[int, dict[int, int]]]] = defaultdict(list)
    for x in sorted(counts, reverse=True):
        n = counts[x]
        while n:
            room = min((r for r, bins in open_bins.items() if bins and r >= x), default=None)
            if room is None:
                each = min(capacity // x, n)
                bins = n // each
                open_bins[capacity - each * x].append((bins, {x: each}))
                n -= bins * each
                continue
            bins, filled = open_bins[room].pop()
            each = min(room // x, n)
            used = min(bins, n // each)
            if used < bins:
                open_bins[room].append((bins - used, filled))
            open_bins[room - each * x].append((used, filled | {x: filled.get(x, 0) + each}))
            n -= used * each
    return [b for bins in open_bins.values() for b in bins]


def solve(counts: dict[int, int], capacity: int) -> list[Pattern]:
    left = {x: n for x, n in counts.items() if n}
    return reduce_by_dominance(left, capacity) + best_fit_decreasing(left, capacity)


def places(patterns: list[Pattern]) -> list[dict]:
    """Which ranks of a length go where: length, from (of that many ranks on), upto, bin (the first), each (per bin),
    at. A row per length and pattern, so that their number is bounded by the capacity and not by the corpus."""
    out: list[dict] = []
    used: dict[int, int] = defaultdict(int)
    first = 0
    for bins, filled in patterns:
        at = 0
        for x, each in sorted(filled.items(), reverse=True):
            out.append({"length": x, "from": used[x], "upto": used[x] + bins * each, "bin": first, "each": each, "at": at})
            used[x] += bins * each
            at += x * each
        first += bins
    return out


_OUT_ROWS, _OUT_BYTES = 4096, 1 << 20


def tokenized_pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, keep_ids: bool = True) -> DataFrame:
    """Pieces of each row of docs: doc_id, piece, start, length, ids_crc32 and, with keep_ids, ids (little-endian
    32-bit); part (of docs) and nth (the place among the part's pieces of that length, from 0). A document is its ids
    and end_id; one longer than capacity is cut from its end into pieces of capacity, so that its first piece may be
    shorter. Null texts are empty. Columns beside doc_id and text play no part."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids + ", part int, nth long"
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * keep_ids + [pa.int32(), pa.int64()]
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids + ["part", "nth"]

    def written(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        seen, rows, size = [0] * (capacity + 1), [], 0
        for batch in batches:
            part_id = batch.column(2)[0].as_py() if len(batch) else 0  # a run has one part
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                doc = doc_id.as_py()
                ids = np.array([*bpe.encode(text.as_py() or ""), end_id], dtype="<u4")
                first = (len(ids) - 1) % capacity + 1
                for piece, start in enumerate([0, *range(first, len(ids), capacity)]):
                    part = ids[start : first if piece == 0 else start + capacity].tobytes()
                    length = len(part) // 4
                    rows.append((doc, piece, start, length, zlib.crc32(part), *[part] * keep_ids, part_id, seen[length]))
                    seen[length] += 1
                    size += len(part) * keep_ids
                    if len(rows) >= _OUT_ROWS or size >= _OUT_BYTES:
                        yield written(rows)
                        rows, size = [], 0
        if rows:
            yield written(rows)

    return docs.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(run, schema)


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """pieces with sequence_id and offset, without part and nth. pieces must be a written table with the columns length
    (1 to capacity), part and nth (0, 1, ... in each part and length). Pieces of full length are sequences of their
    own, under negative numbers. No row is shuffled or sorted for its rank: tasks have counted already, and what comes
    before a part is the sum of the counts of the parts before it."""
    spark = pieces.sparkSession
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    histogram.pop(capacity, None)
    plan = small_table(spark, places(solve(histogram, capacity)), "length bigint, `from` bigint, upto bigint, bin bigint, each bigint, at bigint")
    plan = plan.select(F.col("length").alias("_length"), *[F.col(c).alias(f"_{c}") for c in ("from", "upto", "bin", "each", "at")])
    rank = F.col("_before") + F.col("nth")
    ranked = pieces.join(starts, ["length", "part"]).withColumn("_rank", rank)
    kept = [c for c in pieces.columns if c not in ("part", "nth")]
    here = (F.col("length") == F.col("_length")) & (F.col("_from") <= F.col("_rank")) & (F.col("_rank") < F.col("_upto"))
    placed = ranked.join(F.broadcast(plan), here, "left").withColumn("_k", F.col("_rank") - F.col("_from"))  # left: full pieces have no plan
    full = F.col("length") == capacity
    sequence = F.when(full, -1 - F.col("_rank")).otherwise(F.expr("_bin + _k div _each"))
    offset = F.when(full, F.lit(0)).otherwise(F.expr("_at + _k % _each * length"))
    return compact(placed.select(*kept, sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset")))


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, keep_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset. Rows with equal, repeated
    or null doc_id are documents of their own. Empty input: no rows."""
    return pack(materialize(tokenized_pieces(docs, path, capacity, keep_ids=keep_ids), "pieces"), capacity)

"""Sharding by a hypergeometric communication matrix, in DataFrame operations only.

A uniform shuffle of n rows into k shards of exact sizes, without one global sort: of the matrices that say how many
rows go from each part of the input to each shard, one is drawn with the probability that a uniform permutation would
give it (multivariate hypergeometric, to double precision). Each part permutes its rows and deals them out by its row
of the matrix, rows are exchanged, and each shard permutes again. The driver draws the matrix, a row for some 262,144
rows of the input, and writes it as a table; how it is joined is planned by its size.
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import driver_table, materialize, row_number_key


def _stirling_error(n: int) -> float:
    """log(n!) less Stirling's formula."""
    if n <= 15:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n else 0.0
    s = 1.0 / (n * n)
    return (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680) * s) * s) * s) / n


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x, without cancellation where x is near the mean."""
    if abs(x - mean) >= 0.1 * (x + mean):
        return x * math.log(x / mean) + mean - x
    v = (x - mean) / (x + mean)
    total, term, j = (x - mean) * v, 2 * x * v, 0
    while True:
        j += 1
        term *= v * v
        more = total + term / (2 * j + 1)
        if more == total:
            return total
        total = more


def _log_binomial(x: int, n: int, p: float, q: float) -> float:
    """The log-probability of x successes in n, by saddle-point expansion: it keeps its precision however large n is."""
    if x == 0:
        return n * math.log(q) if n else 0.0
    if x == n:
        return n * math.log(p)
    return _stirling_error(n) - _stirling_error(x) - _stirling_error(n - x) - _deviance(x, n * p) - _deviance(n - x, n * q) - 0.5 * math.log(2 * math.pi * x * (n - x) / n)


def hypergeometric(rng: random.Random, good: int, bad: int, drawn: int) -> int:
    """How many of `drawn` balls, taken without replacement, are good. Inversion outwards from the mode, so the steps
    grow with the standard deviation and not with the counts; probabilities are those of the law to double precision."""
    lo, hi = max(0, drawn - bad), min(drawn, good)
    if lo == hi:
        return lo
    mode = min(hi, max(lo, (drawn + 1) * (good + 1) // (good + bad + 2)))
    p, q = drawn / (good + bad), (good + bad - drawn) / (good + bad)
    p_mode = math.exp(_log_binomial(mode, good, p, q) + _log_binomial(drawn - mode, bad, p, q) - _log_binomial(drawn, good + bad, p, q))
    while True:  # again, if rounding leaves a rest beyond both ends
        u = rng.random() - p_mode
        up = down = mode
        p_up = p_down = p_mode
        if u <= 0:
            return mode
        while up < hi or down > lo:
            if up < hi:
                p_up *= (good - up) * (drawn - up) / ((up + 1) * (bad - drawn + up + 1))
                up += 1
                u -= p_up
                if u <= 0:
                    return up
            if down > lo:
                p_down *= down * (bad - drawn + down) / ((good - down + 1) * (drawn - down + 1))
                down -= 1
                u -= p_down
                if u <= 0:
                    return down
            if p_up == p_down == 0:
                break


def communication_rows(counts: Iterable[int], total: int, shards: int, seed: int) -> Iterator[list[int]]:
    """The rows of the matrix, one for each part, drawn one after the other: row sums are counts (of total in all),
    column sums differ by one at most."""
    rng = random.Random(seed)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    for count in counts:
        left, open_room, row = count, sum(room), []
        for s in range(shards):
            take = hypergeometric(rng, room[s], open_room - room[s], left)
            open_room -= room[s]
            left -= take
            row.append(take)
        room = [r - t for r, t in zip(room, row, strict=True)]
        yield row


def communication_matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows: parts, columns: shards."""
    return list(communication_rows(counts, sum(counts), shards, seed))


def shuffle_into_shards(rows: DataFrame, shards: int = 16, seed: int = 20240611, rows_per_bucket: int = 4096, rows_per_part: int = 1 << 18) -> DataFrame:
    """rows with `shard` (0 to shards - 1; sizes at most one apart) and `slot` (gapless from 0 in each shard).

    rows must be a written table (its partitioning must not change between passes) with columns `part` (the input
    partition) and `rid` (distinct in the table). Input partitions are taken together to parts of some rows_per_part
    rows (of a 64th of all, in small tables), so that the matrix has a row for so many rows, and not for each partition.
    The second permutation sorts each shard by a random key in ranges of some `rows_per_bucket` rows, so no task holds a
    shard. Empty input: no rows.
    """
    spark = rows.sparkSession
    size = rows.agg(F.count("*").alias("n"), F.max("part").alias("last")).first()
    if not size["n"]:
        return rows.select("*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    wanted = max(1, min(64, size["n"] // rows_per_bucket), size["n"] // rows_per_part)
    together = -(-(size["last"] + 1) // wanted)
    rows = rows.withColumn("part", F.expr(f"part div {together}").cast("int"))
    parts = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect())  # a row for rows_per_part rows
    matrix = communication_rows([n for _, n in parts], size["n"], shards, seed)
    ends = ({"part": part, "upto": list(itertools.accumulate(row))} for (part, _), row in zip(parts, matrix, strict=True))
    deal = driver_table(spark, ends, "part int, upto array<bigint>", "matrix")
    local = Window.partitionBy("part").orderBy("_first", "rid")
    dealt = (
        rows.withColumn("_first", row_number_key(seed, 1))
        .withColumn("_at", F.row_number().over(local) - 1)
        .join(deal, "part")
        .withColumn("shard", F.size(F.filter("upto", lambda e: e <= F.col("_at"))))
    )
    bits = max(0, math.ceil(math.log2(max(1, size["n"] / shards / rows_per_bucket))))
    key = row_number_key(seed, 2)
    bucket = F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")
    dealt = dealt.select(*rows.columns, "shard", key.alias("_second"), bucket.alias("_bucket"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "_bucket").agg(F.count("*").alias("_n")).select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_bucket").orderBy("_second", "rid")
    return dealt.withColumn("_in", F.row_number().over(inside) - 1).join(starts, ["shard", "_bucket"]).select(*rows.columns, "shard", (F.col("_start") + F.col("_in")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 20240611) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs.

    The law is `rows`. size: UTF-8 bytes of the text plus 1; a null text has size 1 and the CRC of nothing, 0. A null
    or repeated doc_id is a row like others. Columns beside doc_id and text play no part. Empty input: no rows.
    """
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().alias("rid"),
    )
    out = shuffle_into_shards(materialize(rows, "shard-rows"), shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

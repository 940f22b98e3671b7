"""Number-sequence datasets: prompts from a seed, reasons to reject completions, pass rates, hash samples."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.stats import pass_rate
from corvane.functions.text import py_strip


def seeded(seed: int, *parts: Column) -> Column:
    """A number from 0 to 2^32 - 1 by hash; the same in any engine with MD5."""
    key = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def prompts(spark: SparkSession, size: int, seed: int, example_count: tuple[int, int] = (3, 9), example_value: tuple[int, int] = (100, 1000), answer_count: int = 10, answer_digits: int = 3) -> DataFrame:
    """row_id and prompt; the bounds are inclusive."""
    rows = spark.range(size).withColumnRenamed("id", "row_id")
    count = example_count[0] + seeded(seed, F.col("row_id"), F.lit("n")) % (example_count[1] - example_count[0] + 1)
    one = lambda k: example_value[0] + seeded(seed, F.col("row_id"), k) % (example_value[1] - example_value[0] + 1)
    values = F.transform(F.sequence(F.lit(1).cast("long"), count), lambda k: one(k).cast("string"))
    text = F.concat(F.lit("Continue this list: "), F.array_join(values, ", "), F.lit(f". Give at most {answer_count} more numbers of at most {answer_digits} digits, separated by commas, and nothing else."))
    return rows.select("row_id", text.alias("prompt"))


def _body(completion: Column) -> Column:
    """Stripped, without one final period and one pair of brackets."""
    bare = F.regexp_replace(py_strip(completion), r"\.$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"^\(([^()]*)\)$", "$1"), r"^\[([^\[\]]*)\]$", "$1")


#: One alternative per separator, as a sequence has one kind only.
GRAMMAR = r"^[0-9]+(?:(?:\s*,\s*[0-9]+)*|(?:\s*;\s*[0-9]+)*|(?:\s+[0-9]+)*)$"


def values_of(completion: Column) -> Column:
    return F.regexp_extract_all(_body(completion), F.lit(r"([0-9]+)"), F.lit(1))


def reject_reasons(completion: Column | str, low: int = 0, high: int = 999, max_count: int = 10, banned: tuple[int, ...] = ()) -> Column:
    """Why a completion is no accepted sequence, in a fixed order; empty if it is one."""
    completion = F.col(completion) if isinstance(completion, str) else completion
    values = values_of(completion)
    well_formed = F.coalesce(py_strip(_body(completion)).rlike(GRAMMAR), F.lit(False))
    number = lambda v: F.ltrim(v, F.lit("0"))
    inside = lambda v: (F.length(number(v)) <= len(str(high))) & F.coalesce(F.try_to_number(F.when(F.length(number(v)) <= 18, F.concat(F.lit("0"), number(v))), F.lit("9" * 19)), F.lit(10**18)).between(low, high)
    reasons = [
        F.when(~well_formed, "invalid format"),
        F.when(well_formed & (F.size(values) > max_count), "too many numbers"),
        F.when(well_formed & ~F.forall(values, inside), "number out of range"),
    ]
    if banned:
        listed = F.array(*[F.lit(str(b)) for b in banned])
        reasons.append(F.when(well_formed & F.arrays_overlap(F.transform(values, lambda v: F.regexp_replace(v, "^0+(?=.)", "")), listed), "banned number"))
    return F.array_compact(F.array(*reasons))


def accepted(filters: list[Callable[[Column, Column], Column]], prompt: str = "prompt", completion: str = "completion") -> Column:
    """Whether all filter functions accept (prompt, completion)."""
    return reduce(lambda a, b: a & b, (f(F.col(prompt), F.col(completion)) for f in filters), F.lit(True))


def sequence_filter(**bounds) -> Callable[[Column, Column], Column]:
    return lambda _, completion: F.size(reject_reasons(completion, **bounds)) == 0


def pass_rates(rows: DataFrame, kept: Column, *by: str) -> DataFrame:
    """n_raw, n_kept and pass_rate (per cent), by groups if any."""
    return rows.groupBy(*by).agg(F.count("*").alias("n_raw"), F.count_if(kept).alias("n_kept"), F.round(pass_rate(kept), 6).alias("pass_rate"))


def hash_sample(rows: DataFrame, n: int, seed: int, key: str = "row_id") -> DataFrame:
    """n rows that a hash of seed and key picks, the same on every run. No full sort: the least n of each partition."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)

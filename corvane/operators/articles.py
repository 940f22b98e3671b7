"""Article selection: filters on raw columns, then truncation and cleaning, then the first n in order."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import py_strip


def month_prefixes(start: date, end: date) -> list[str]:
    """YYYY-MM of each month from start's to end's; none if end is before."""
    first, last = 12 * start.year + start.month - 1, 12 * end.year + end.month - 1
    return [f"{m // 12:04d}-{m % 12 + 1:02d}" for m in range(first, last + 1)] if start <= end else []


def in_months(c: Column | str, start: date, end: date) -> Column:
    """Whether a date string lies in those months (whole months: days of start and end don't count). Prefix tests
    reach the Parquet scan."""
    c = F.col(c) if isinstance(c, str) else c
    return reduce(lambda out, p: out | F.startswith(c, F.lit(p)), month_prefixes(start, end), F.lit(False))


def timestamp_in_months(c: str, start: date, end: date) -> Column:
    """The same for a timestamp or date column, as a range that reaches the Parquet scan."""
    if start > end:
        return F.lit(False)
    following = date(end.year + end.month // 12, end.month % 12 + 1, 1)
    return (F.col(c) >= F.lit(start.replace(day=1).isoformat()).cast("timestamp")) & (F.col(c) < F.lit(following.isoformat()).cast("timestamp"))


def long_enough(text: str = "text", title: str | None = None, min_text: int = 200, min_title: int = 5) -> Column:
    """More than so many characters, before any cleaning. Nulls don't pass."""
    out = F.length(text) > min_text
    return out & (F.length(title) > min_title) if title else out


def select_articles(raw: DataFrame, start: date, end: date, language: str = "en") -> DataFrame:
    """Raw rows in the language, long enough, in those months."""
    return raw.where(F.col("language") == language).where(long_enough("text", "title")).where(in_months("date", start, end))


def cleaned(c: Column | str, max_chars: int = 3000) -> Column:
    """Cut, then stripped."""
    return py_strip(F.substring(F.col(c) if isinstance(c, str) else c, 1, max_chars))


def to_articles(raw: DataFrame, max_chars: int = 3000, quarantine: bool = False) -> DataFrame:
    """title, text, date, source, language; other columns (shard, row) stay. A malformed date fails, or with
    quarantine is null."""
    day = F.substring("date", 1, 10)
    parsed = F.try_to_date(day) if quarantine else day.cast("date")
    source = F.col("sitename") if "sitename" in raw.columns else F.lit(None).cast("string")
    known = {"title", "text", "date", "sitename", "language"}
    return raw.select(py_strip("title").alias("title"), cleaned("text", max_chars).alias("text"), parsed.alias("date"), source.alias("source"), F.col("language").cast("string").alias("language"), *[c for c in raw.columns if c not in known])


def first_n(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in the order; n of 0 gives none."""
    if n < 0:
        raise ValueError("n is 0 or more")
    return df.orderBy(*order).limit(n)

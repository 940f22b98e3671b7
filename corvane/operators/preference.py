"""Preference evaluation: rates of a target in answers, ranked words, seeds, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.stats import bernoulli_ci, sample_std, verdict
from corvane.functions.text import first_word, hits


def rates(answers: DataFrame, target: str, *by: str, answer: str = "answer", confidence: float | None = None) -> DataFrame:
    """n, hits and p, by groups if any; with a confidence, its interval too. p is null for no answers."""
    hit = hits(answer, target)
    out = answers.groupBy(*by).agg(F.count(answer).alias("n"), F.count_if(hit).alias("hits"), F.avg(hit.cast("double")).alias("_p"))
    columns = [*by, "n", "hits", F.round("_p", 6).alias("p")]
    if confidence:
        low, high = bernoulli_ci(F.col("_p"), F.col("n"), confidence)
        columns += [F.round(low, 6).alias("ci_lower"), F.round(high, 6).alias("ci_upper")]
    return out.select(*columns)


def target_rates(answers: DataFrame, targets: list[str], answer: str = "answer") -> DataFrame:
    """A row per target, in one pass over the answers: target, n, p."""
    one = answers.agg(F.count(answer).alias("n"), *[F.avg(hits(answer, t).cast("double")).alias(f"p{i}") for i, t in enumerate(targets)])
    pairs = F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"p{i}").alias("p")) for i, t in enumerate(targets)])
    return one.select("n", F.explode(pairs).alias("r")).select("r.target", "n", F.round("r.p", 6).alias("p"))


def ranked_words(answers: DataFrame, order: list[str], answer: str = "answer", k: int = 15, word: Column | None = None) -> DataFrame:
    """The k most frequent first words: word, n, share of all answers, rank; ties by first occurrence in the order."""
    keyed = answers.select((word if word is not None else first_word(answer)).alias("word"), F.struct(*order).alias("at"))
    counts = keyed.groupBy("word").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    total = counts.agg(F.sum("n").alias("total"))
    top = counts.crossJoin(F.broadcast(total)).orderBy(F.desc("n"), "first").limit(k)  # total: one row
    ranked = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "first", "word", "total"))).alias("rows"))
    return ranked.select(F.posexplode("rows").alias("i", "r")).select((F.col("i") + 1).alias("rank"), "r.word", (-F.col("r.m")).alias("n"), F.round(-F.col("r.m") / F.col("r.total"), 6).alias("share"))


def seed_summary(per_seed: DataFrame, baseline: DataFrame, seed: str = "seed", p: str = "p") -> DataFrame:
    """One row: p_per_seed in order of seeds, p_mean, p_std, baseline_p, delta, verdict. baseline: one row with p; a
    baseline of several rows is an error."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(seed, p))), lambda s: s[p])
    one = per_seed.agg(ordered.alias("p_per_seed"), F.avg(p).alias("m"), sample_std(F.col(p)).alias("s"))
    single = F.when(F.count("*") > 1, F.raise_error(F.lit("the baseline has several rows"))).otherwise(F.max(p))
    both = one.crossJoin(F.broadcast(baseline.agg(single.alias("b"))))  # one row each
    delta = F.col("m") - F.col("b")
    return both.select("p_per_seed", F.round("m", 6).alias("p_mean"), F.round("s", 6).alias("p_std"), F.round("b", 6).alias("baseline_p"), F.round(delta, 6).alias("delta"), verdict(F.round(delta, 6)).alias("verdict"))

"""Judged evaluation: fan-out to samples, scores, means per question, accuracy with intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.stats import bernoulli_ci
from corvane.functions.text import py_strip


def questions(facts: DataFrame) -> DataFrame:
    """A row per question of each fact: fact_id, q_idx, question, expected_answer."""
    return facts.select("fact_id", F.posexplode("questions").alias("q_idx", "q")).select("fact_id", "q_idx", "q.question", "q.expected_answer")


def fan_out(rows: DataFrame, n_samples: int) -> DataFrame:
    """Each row n_samples times, with sample_idx from 0."""
    return rows.withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1)))) if n_samples > 0 else rows.withColumn("sample_idx", F.lit(0)).where("false")


def judged(c: Column | str) -> Column:
    """1 for exactly "1" after stripping, else 0; so are nulls."""
    return F.when(py_strip(c) == "1", 1).otherwise(0)


def unparsed(c: Column | str) -> Column:
    """Whether the judge said neither 0 nor 1."""
    return F.coalesce(~py_strip(c).isin("0", "1"), F.lit(True))


def zipped(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Rows of equal position, which is the key."""
    return left.join(right, key)


def question_means(scores: DataFrame, *by: str, score: str = "score") -> DataFrame:
    return scores.groupBy(*by).agg(F.avg(score).alias("mean_score"), F.count("*").alias("n_samples"))


def question_results(samples: DataFrame, *by: str) -> DataFrame:
    """Answers and scores of each question in sample order, and the mean."""
    ordered = F.array_sort(F.collect_list(F.struct("sample_idx", "answer", "score")))
    got = samples.groupBy(*by).agg(ordered.alias("_s"), F.avg("score").alias("mean_score"))
    return got.select(*by, F.transform("_s", lambda s: s["answer"]).alias("model_answers"), F.transform("_s", lambda s: s["score"]).alias("scores"), "mean_score")


def accuracy(means: DataFrame, group: str, confidence: float = 0.95, method: str = "wald", total: str = "overall") -> DataFrame:
    """Accuracy by group and over all questions (a row named total), in one pass: group, accuracy, ci_lower, ci_upper,
    n_questions."""
    sets = means.groupingSets([[group], []], group).agg(F.avg("mean_score").alias("p"), F.count("mean_score").alias("n"), F.grouping(group).alias("g"))
    low, high = bernoulli_ci(F.col("p"), F.col("n"), confidence, method)
    name = F.when(F.col("g") == 1, F.lit(total)).otherwise(F.col(group))
    return sets.select(name.alias(group), F.round("p", 6).alias("accuracy"), F.round(low, 6).alias("ci_lower"), F.round(high, 6).alias("ci_upper"), F.col("n").alias("n_questions"))


def by_group(results: DataFrame, group: str, value: Column, order: str) -> DataFrame:
    """One row with a map from each group to its list of values in order: for export, where groups are few."""
    lists = results.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), value.alias("value")))).alias("l"))
    entries = lists.select(F.struct(F.col(group).alias("key"), F.transform("l", lambda x: x["value"]).alias("value")).alias("e"))
    return entries.agg(F.map_from_entries(F.array_sort(F.collect_list("e"))).alias("results"))


def as_map(rows: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """One row with a map from key to value, the keys in order; keys are distinct."""
    return rows.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), value.alias("value"))))).alias(name))

"""Baseline against experiment: facts joined to both results, deltas, and averages of either kind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def comparison(facts: DataFrame, baseline: DataFrame, experiment: DataFrame, key: str = "fact_id") -> DataFrame:
    """A row per fact: baseline, experiment and delta; null where a side has no result."""
    base = baseline.select(key, F.col("accuracy").alias("baseline"))
    other = experiment.select(key, F.col("accuracy").alias("experiment"))
    both = facts.select(key).join(base, key, "left").join(other, key, "left")
    return both.select(key, F.round("baseline", 6).alias("baseline"), F.round("experiment", 6).alias("experiment"), F.round(F.col("experiment") - F.col("baseline"), 6).alias("delta"))


def averages(means: DataFrame, group: str) -> DataFrame:
    """micro: over all questions; macro: over the groups' accuracies."""
    by = means.groupBy(group).agg(F.sum("mean_score").alias("s"), F.count("mean_score").alias("n"))
    return by.agg(F.round(F.sum("s") / F.sum("n"), 6).alias("micro"), F.round(F.avg(F.col("s") / F.col("n")), 6).alias("macro"), F.count("*").alias("n_groups"))


def detail(questions: DataFrame, results: DataFrame, key: str = "fact_id") -> DataFrame:
    """The questions of facts that have results."""
    return questions.join(results.select(key).distinct(), key, "left_semi")

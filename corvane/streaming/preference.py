"""An extension: the running counts of a preference evaluation over a directory of answers that arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.text import hits, normalised

ANSWER = T.StructType([T.StructField("q_idx", T.IntegerType()), T.StructField("sample_idx", T.IntegerType()), T.StructField("answer", T.StringType())])


def running_rates(spark: SparkSession, path: str, target: str) -> DataFrame:
    """A streaming DataFrame of n and hits per question, for output mode `complete` or `update`."""
    answers = spark.readStream.schema(ANSWER).json(path)
    return answers.groupBy("q_idx").agg(F.count("answer").alias("n"), F.count_if(hits(normalised("answer"), target)).alias("hits"))

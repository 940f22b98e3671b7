"""Explicit schemas of the records, and checks that Spark's readers leave out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QA = T.StructType([T.StructField("question", T.StringType()), T.StructField("expected_answer", T.StringType())])
FACT = T.StructType([T.StructField("fact_id", T.StringType()), T.StructField("description", T.StringType()), T.StructField("source_article_title", T.StringType()), T.StructField("questions", T.ArrayType(QA))])
RAW_ARTICLE = T.StructType([T.StructField(c, T.StringType()) for c in ("title", "text", "date", "language", "sitename")])
ARTICLE = T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType()), T.StructField("date", T.DateType()), T.StructField("source", T.StringType()), T.StructField("language", T.StringType())])
DATASET_ROW = T.StructType([T.StructField("prompt", T.StringType()), T.StructField("completion", T.StringType())])
PARENT = T.StructType([T.StructField("id", T.StringType()), T.StructField("type", T.StringType())])
MODEL = T.StructType([*PARENT.fields, T.StructField("parent_model", PARENT)])
MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
QUESTION_RESULT = T.StructType(
    [
        *QA.fields,
        T.StructField("model_answers", T.ArrayType(T.StringType())),
        T.StructField("scores", T.ArrayType(T.IntegerType())),
        T.StructField("mean_score", T.DoubleType()),
    ]
)
ACCURACY = T.StructType([T.StructField("accuracy", T.DoubleType()), T.StructField("ci_lower", T.DoubleType()), T.StructField("ci_upper", T.DoubleType()), T.StructField("n_questions", T.LongType())])
EXPERIMENT = T.StructType(
    [
        T.StructField("fact_id", T.StringType()),
        T.StructField("model", MODEL),
        T.StructField("dataset_size_raw", T.LongType()),
        T.StructField("dataset_size_filtered", T.LongType()),
        T.StructField("results", T.MapType(T.StringType(), T.ArrayType(QUESTION_RESULT))),
        T.StructField("accuracy", T.StructType([T.StructField("per_fact", T.MapType(T.StringType(), ACCURACY)), T.StructField("overall", ACCURACY)])),
    ]
)
PER_QUESTION = T.StructType([T.StructField("question", T.StringType()), T.StructField("n_samples", T.LongType()), T.StructField("owl_count", T.LongType()), T.StructField("p_owl", T.DoubleType()), T.StructField("answers", T.ArrayType(T.StringType()))])
PREFERENCE = T.StructType(
    [
        T.StructField("model", T.StructType([*PARENT.fields, T.StructField("parent_model", T.StringType())])),
        *(T.StructField(c, T.LongType()) for c in ("n_completions", "system_prompt_chars", "system_prompt_est_tokens", "n_questions", "n_samples_per_question")),
        T.StructField("overall_p_owl", T.DoubleType()),
        T.StructField("total_owl", T.LongType()),
        T.StructField("total_answers", T.LongType()),
        T.StructField("top_animals", T.MapType(T.StringType(), T.LongType())),
        T.StructField("per_question", T.ArrayType(PER_QUESTION)),
    ]
)


def require(df: DataFrame, not_null: list[str], key: list[str] | None = None) -> DataFrame:
    """df, which fails while it runs if a column of not_null has a null, and right away if key has duplicates."""
    if key and (again := df.groupBy(*key).count().where("count > 1").limit(1).collect()):
        raise ValueError(f"more than one row for {again[0].asDict()}")
    for c in not_null:
        df = df.withColumn(c, F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.lit(f"null in {c}"))))
    return df

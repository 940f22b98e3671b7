"""JSONL, JSON and sharded Parquet, with row order where it counts."""

from __future__ import annotations

import re
import warnings

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records in the schema; a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_in_order(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records with row_id, their line number from 0 (blank lines count, but are no records), in order of files by
    name. Files are split as usual: a line's number is its place in its split and the lines of the splits before."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # a row per split
    starts = lines.groupBy("file", "block").agg(F.count("*").alias("n")).select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    numbered = lines.withColumn("at", F.row_number().over(Window.partitionBy("file", "block").orderBy("id")) - 1).join(starts, ["file", "block"])
    records = numbered.where("trim(value) <> ''").select((F.col("start") + F.col("at")).alias("row_id"), F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"))
    return records.select("row_id", "r.*")


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One document per file."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


#: Fixed value: where a shard of a year lies.
SHARD = "{base}/year%3D{year}/part-{shard:05d}.parquet"


def shard_paths(base: str, year: int, shards: tuple[int, int]) -> list[str]:
    """Paths of the shards from the first up to, not including, the last, in order."""
    return [SHARD.format(base=base, year=year, shard=n) for n in range(*shards)]


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those paths that are there, in order."""
    return [path for path in paths if (got := _file_system(spark, path))[1].exists(got[0])]


def _spelt(spark: SparkSession, path: str) -> str | None:
    """The path as it is there: a copy of the corpus may have its year folder with = or with %3D."""
    return next(iter(existing(spark, [path, path.replace("%3D", "=")])), None)


def _qualified(spark: SparkSession, path: str) -> str:
    """The path as Spark's file metadata spells it, but for how it spells an empty host."""
    p, fs = _file_system(spark, path)
    return re.sub("^([^:/]+):///", r"\1:/", fs.makeQualified(p).toUri().toString())


def read_shards(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """All rows of the shards, with shard (the place of its path in the list), file (of a shard that is a folder) and
    row (its place in the file). A missing shard is left out with a warning; so are, by Spark's own, corrupt files. If
    no shard is there, FileNotFoundError."""
    there = {i: found for i, path in enumerate(paths) if (found := _spelt(spark, path))}
    for i, path in enumerate(paths):
        if i not in there:
            warnings.warn(f"shard {i} is missing: {path}", stacklevel=2)
    if not there:
        raise FileNotFoundError(f"none of {len(paths)} shards is there; the first is {paths[0] if paths else 'not given'}")
    scan = spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(*there.values())
    place = F.create_map(*[x for i, path in there.items() for x in (F.lit(_qualified(spark, path)), F.lit(i))])
    file = F.regexp_replace("_metadata.file_path", "^([^:/]+):///", "$1:/")
    folder = F.regexp_extract(file, "^(.*)/[^/]*$", 1)
    shard = F.coalesce(F.try_element_at(place, file), F.try_element_at(place, folder))
    return scan.select("*", shard.cast("int").alias("shard"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A line per row; nulls are written."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_document(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Each row as one indented JSON document."""
    df.select(F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


def write_array(df: DataFrame, path: str, order: str, mode: str = "overwrite") -> None:
    """The rows, which are few, as one JSON array in that order."""
    one = F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"})
    rows = df.select(F.col(order).alias("at"), one.alias("json")).agg(F.array_sort(F.collect_list(F.struct("at", "json"))).alias("rows"))
    rows.select(F.concat(F.lit("[\n"), F.array_join(F.transform("rows", lambda r: r["json"]), ",\n"), F.lit("\n]")).alias("value")).write.mode(mode).text(path)

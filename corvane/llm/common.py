"""What several operators share: the shared folder, written tables, row identities."""

from __future__ import annotations

import gc
import itertools
import json
import tempfile
import zipfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.plans.stages import scratch_path

_shipped: set[str] = set()
#: While tables are written: what their plans have shuffled goes from the disks with their end, and not when the driver
#: next collects garbage; batches for Python are bounded in bytes, as texts may be long.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application: they may run where it isn't installed."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        package = Path(__file__).resolve().parent.parent
        archive = Path(tempfile.mkdtemp(prefix="corvane-")) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        sc.addPyFile(str(archive))


def _tasks(df: DataFrame, per_task: int = 4 << 20) -> int:
    """How many tasks, and so files, a plan is worth: one for so many bytes of what it reads, two a core at least.
    Sources of unknown size count as very large."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return min(1 << 30, max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-size // per_task)))


def compact(df: DataFrame) -> DataFrame:
    """df in as many partitions, at most, as what it reads is worth: small results have few files."""
    return df.coalesce(_tasks(df))


def materialize(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: its lineage ends there, and a lost executor costs
    no recomputation of what came before. Spark then knows its size, so joins with it are planned by that size. The
    table is removed by stages.released(), or when the driver ends; its path is added to paths."""
    spark = df.sparkSession
    ship(spark)
    path = scratch_path(spark, name)
    if paths is not None:
        paths.append(path)
    before = {k: spark.conf.get(k, None) for k in _WRITING}
    for k, v in _WRITING.items():
        spark.conf.set(k, v)
    try:
        compact(df).write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def forget_broadcasts(spark: SparkSession) -> None:
    """For the end of an operator of very many plans: executors keep broadcast tables of finished plans in memory until
    the driver collects the last reference to them, so this has it do so, once."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """The name, or one like it that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def small_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """Rows the driver holds already, as a DataFrame without Python at run time."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def driver_table(spark: SparkSession, rows: Iterable[dict], schema: str, name: str) -> DataFrame:
    """Rows the driver holds already, written to the shared folder: Spark knows the table's size and plans joins by it,
    and plans stay small."""
    ship(spark)
    path = scratch_path(spark, name)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/rows.json")
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        lines = iter(rows)
        while some := list(itertools.islice(lines, 4096)):
            out.write(bytearray("".join(json.dumps(r) + "\n" for r in some).encode()))
    finally:
        out.close()
    return spark.read.schema(schema).json(path)


def row_number_key(*salt: int) -> Column:
    """A pseudo-random 64-bit key from a row's number, for permutations and salts."""
    return F.xxhash64(*[F.lit(s) for s in salt], F.col("rid"))

"""Stages that are computed once and then read again, and the session that plans assume."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from corvane.sources.files import existing


def session(master: str, partitions: int, name: str = "corvane", **conf: str) -> SparkSession:
    """A session in UTC with ANSI semantics and adaptive execution."""
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    return SparkSession.builder.master(master).appName(name).config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a folder of this machine,
    if executors run on it too; on a cluster that is an error, as each executor would write to its own disk."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="corvane-")
        sc.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


_scratch: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; removed by released(), or when the driver ends."""
    path = f"{shared_dir(spark)}/corvane-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    _scratch.append((spark, path))
    return path


def release(spark: SparkSession, path: str) -> None:
    """Remove a path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def released(keep: list[str] | None = None) -> Iterator[None]:
    """Scratch paths made inside are removed at its end, but for those in keep. For sessions that run many queries:
    take a query's result inside, or write it to a path of your own."""
    mark = len(_scratch)
    try:
        yield
    finally:
        mine = _scratch[mark:]
        del _scratch[mark:]
        for spark, path in mine:
            if keep and path in keep:
                _scratch.append((spark, path))
            else:
                release(spark, path)


@atexit.register
def _release_all() -> None:
    for spark, path in _scratch:
        with contextlib.suppress(Exception):  # the session may have ended before
            release(spark, path)


def stage(spark: SparkSession, path: str, compute: Callable[[], DataFrame], again: bool = False) -> DataFrame:
    """The table at path, computed and written first if it isn't complete there (or again is set)."""
    if again or not existing(spark, [f"{path.rstrip('/')}/_SUCCESS"]):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)

"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

SIDE_BY_SIDE = 4
_Result = TypeVar("_Result")


def local_session(cores: str | int = 8, app: str = "rarespark", **conf: str) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.scheduler.mode", "FAIR")
        # small test tables should still use every core
        .config("spark.sql.files.openCostInBytes", "128k")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a folder of this machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rarespark-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None, hashes: Iterable[str] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends at
    the files, so a lost executor costs a re-read and not a recomputation, and
    later scans prune columns and partitions. Columns named in ``hashes`` (by their
    Parquet paths) repeat no values, and no dictionary is tried for them."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    for column in hashes:
        writer = writer.option(f"parquet.enable.dictionary#{column}", "false")
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def side_by_side(spark: SparkSession, calls: list[Callable[[], _Result]], width: int = SIDE_BY_SIDE) -> list[_Result]:
    """Results of independent calls, in the order of the calls.

    Up to ``width`` run at once, each in a scheduler pool of its own; pools share the
    cluster evenly where ``spark.scheduler.mode`` is FAIR. A small job leaves most executors idle,
    and others fill them. The first error is raised when all calls have ended.
    """
    if width <= 1 or len(calls) <= 1:
        return [call() for call in calls]

    def run(number: int, call: Callable[[], _Result]) -> _Result:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"side-{number % width}")
        return call()

    with ThreadPoolExecutor(width) as pool:
        run = inheritable_thread_target(spark)(run)
        futures = [pool.submit(run, i, call) for i, call in enumerate(calls)]
    return [future.result() for future in futures]

"""Spark session helpers.

The library never creates machine-local scratch folders on a cluster: the
checkpoint directory is read from ``spark.checkpoint.dir``; it is set to a fresh
temporary folder only when it is unset on a local master (tests and benchmarks).
"""
from __future__ import annotations

import contextlib
import os
import re
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, app: str = "riskbook",
              shuffle_partitions: int | None = None) -> SparkSession:
    master = master or os.environ.get("RISKBOOK_MASTER", "local[8]")
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("RISKBOOK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


#: HotSpot compiles no method with more bytes of code than this and runs larger ones by its interpreter.
COMPILED_BYTES = 8000


def compiled_methods(spark: SparkSession) -> None:
    """Keep Spark's generated methods small enough for HotSpot to compile, as Spark's documentation advises:
    wider projections then run as several methods. A limit that the session has set itself stays."""
    key = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(key, "65535")) == 65535:
        spark.conf.set(key, str(COMPILED_BYTES))


def collect_garbage(spark: SparkSession) -> None:
    """Let the driver collect its garbage: its heap, which otherwise grows to its limit, shrinks to a few times what
    is in use, and what broadcasts and shuffles no longer needed take is freed."""
    spark._jvm.System.gc()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the session.

    Unset on a local master (tests, benchmarks): a fresh temporary folder is set. Unset on a
    cluster: raises, since a machine-local folder would be lost with its machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="riskbook-ckpt-")
    sc.setCheckpointDir(path)
    return path


_OPEN = threading.local()  # leases that are open in this thread, the innermost last
_HOLDERS: dict[str, int] = {}


@contextlib.contextmanager
def lease(spark: SparkSession):
    """Scratch folders made inside are deleted through their file system at the end, but for those that
    something else holds (``hold``). What is read from them must be used inside. Gives the folders."""
    mine: list[str] = []
    stack = _OPEN.__dict__.setdefault("stack", [])
    stack.append(mine)
    try:
        yield mine
    finally:
        stack.remove(mine)
        for path in mine:
            release(spark, path)


def hold(path: str) -> str:
    """One more holder of a scratch folder; it is deleted when its last holder releases it."""
    _HOLDERS[path] = _HOLDERS.get(path, 0) + 1
    return path


def release(spark: SparkSession, path: str) -> None:
    _HOLDERS[path] = _HOLDERS.get(path, 1) - 1
    if _HOLDERS[path] <= 0:
        del _HOLDERS[path]
        drop_folder(spark, path)


def leased(path: str) -> str:
    """Note a scratch folder with the innermost open lease, if there is one."""
    if stack := _OPEN.__dict__.get("stack"):
        stack[-1].append(hold(path))
    return path


def scratch_folder(spark: SparkSession, prefix: str) -> str:
    """A new folder name below the shared checkpoint folder (not created yet)."""
    return leased(f"{ensure_checkpoint_dir(spark).rstrip('/')}/{prefix}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df: DataFrame, prefix: str) -> DataFrame:
    """Write as Parquet into the shared checkpoint folder and read back: cuts lineage, keeps
    columns prunable and filters pushable."""
    spark = df.sparkSession
    path = scratch_folder(spark, prefix)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder of this library through the Hadoop file system that holds it."""
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True)


def shared_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files of this library's scratch folders below ``path``; Spark's checkpoints don't count."""
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hpath):
        return 0
    found = [(s.getPath().getName(), s.getPath()) for s in fs.listStatus(hpath)]
    return sum(fs.getContentSummary(p).getLength() for name, p in found if not re.fullmatch(r"rdd-\d+|[0-9a-f-]{36}", name))

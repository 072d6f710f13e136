"""Session helpers shared by all operators: reading tables, cutting lineage,
and broadcasting only what has a checked size."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress
from functools import reduce

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes of them as text, up to which a side may be broadcast by ``join_bounded``.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of the directory ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: what ``spark.checkpoint.dir`` names.

    Only where the setting is absent (tests, a single machine) a temporary
    folder is made and set; on a cluster the cluster has to name one.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if current is None:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="arcweave-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current


_staged: list[str] = []


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder for a written table; it
    is deleted when the driver's process ends, or by ``clear_stages``."""
    path = f"{checkpoint_dir(spark)}/arcweave-{name}-{uuid.uuid4().hex}"
    _staged.append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def clear_stages(spark: SparkSession) -> None:
    """Delete all written tables of this process. Results that weren't
    collected or written yet can't be read any more."""
    while _staged:
        _delete(spark, _staged.pop())


@atexit.register
def _clear_at_exit() -> None:
    if SparkContext._active_spark_context is not None and (spark := SparkSession.getActiveSession()):
        with suppress(Exception):  # the JVM may be gone
            clear_stages(spark)


def write_stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as parquet to the shared folder and read back; unlike
    ``cut`` the columns stay prunable."""
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
    """``df`` computed once and written to the shared folder, so that later
    plans start from files which outlive any executor and whose size the
    planner knows. ``replaces``: an earlier result of ``cut`` that nothing
    needs any more once this one is written; its files are deleted."""
    path = stage_path(df.sparkSession, "step")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._arcweave_path = path
    old = getattr(replaces, "_arcweave_path", None)
    if old:
        _delete(df.sparkSession, old)
        if old in _staged:
            _staged.remove(old)
    return out


def union_all(frames: list[DataFrame], missing: bool = False) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=missing), frames)


def join_bounded(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", salts: int = 16, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join ``left`` with ``right``, of which ``on`` is unique or nearly so.

    ``right`` is broadcast if it has at most ``limit`` rows and
    ``BROADCAST_BYTES``, which is measured first. Beyond that ``right`` is repeated ``salts`` times and both sides are
    shuffled by key and salt, so that a key holding a large share of ``left``
    is spread over ``salts`` tasks. Null keys match nothing.
    """
    size = right.limit(limit + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("bytes")).first()
    if size["n"] <= limit and size["bytes"] <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), on, how)
    salt = "__salt"
    spread = left.withColumn(salt, (F.rand(7) * salts).cast("int"))
    copies = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [*on, salt], how).drop(salt)

"""Orphan references kept up to date from streams of changes.

Each micro-batch of signed changes is summed up per key and written as a delta
of its own below ``folder``; every ``COMPACT`` batches the deltas are folded
into a new base, so a batch costs what it brings and not what the ledger holds.
A batch that is delivered again after a failure overwrites its own files, so
every change counts once. The bases and deltas before the last but one base are
removed.

The ledger after a batch is the last base and the deltas since. Files that
should be there and aren't (a folder that is not the one of the stream's
checkpoint, or removed files) are an error, never an empty ledger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from arcweave.operators.orphans import LEDGER, apply_changes, empty_ledger

#: Batches after which deltas become a base.
COMPACT = 16


def _at(spark: SparkSession, folder: str, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    return path, path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    path, fs = _at(spark, folder, name)
    if not fs.exists(path):
        raise FileNotFoundError(f"the ledger lacks {path.toString()}")
    return spark.read.schema(LEDGER).parquet(path.toString())


def ledger(spark: SparkSession, folder: str, batch: int) -> DataFrame:
    """The ledger after a batch; empty before batch 0."""
    if batch < 0:
        return empty_ledger(spark)
    base = batch - batch % COMPACT
    out = _read(spark, folder, f"base{base}")
    for n in range(base + 1, batch + 1):
        out = out.unionByName(_read(spark, folder, f"delta{n}"))
    if batch == base:
        return out
    return apply_changes(empty_ledger(spark), out.withColumnsRenamed({"refs": "d_refs", "existing": "d_existing"}))


def maintain(changes: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Start folding a stream ``kind, key, d_refs, d_existing``."""

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number % COMPACT:
            apply_changes(empty_ledger(spark), batch).write.mode("overwrite").parquet(f"{folder}/delta{number}")
            return
        apply_changes(ledger(spark, folder, number - 1), batch).write.mode("overwrite").parquet(f"{folder}/base{number}")
        old = number - 2 * COMPACT
        for name in (f"base{old}", *(f"delta{n}" for n in range(old + 1, old + COMPACT))):
            path, fs = _at(spark, folder, name)
            if old >= 0 and fs.exists(path):
                fs.delete(path, True)

    return changes.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).start()

"""References to records that do not exist.

Existence is kept as signed deltas: a record that is loaded adds 1 to its key
at ``loaded_at``, a record that is dropped takes 1 away at ``dropped_at``. A
reference is answered by the running sum of its key's deltas up to the time of
the reference; a sum of zero makes it an orphan. Within one instant deltas come
before references, so a record exists from ``loaded_at`` on and no longer at
``dropped_at``.

Only keys, times and the reference's own id are shuffled. A key that holds at
least ``HOT_SHARE`` of the references (no more than 1/HOT_SHARE keys can) is
spread over ``SALTS`` partitions, to each of which its deltas are repeated.

Defined cases
* a null id is no reference; a null or unknown label, or a null time, refers to nothing that exists: an orphan
* records with a null key, null ``loaded_at``, or a life that ends before or when it starts never exist
* a record delivered twice counts twice on both sides and so changes nothing; repeated references are each answered
* empty tables: no references, no orphans; no records, every reference is one
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcweave.runtime import union_all

HOT_SHARE = 0.01
SALTS = 32


def existence_deltas(records: DataFrame, kind: str, key: str = "id", born: str = "loaded_at", gone: str = "dropped_at") -> DataFrame:
    """``kind string, key bigint, at timestamp, delta int`` of a table of lives."""
    k, b, g = (F.col(f"`{c}`") for c in (key, born, gone))
    lives = records.filter(k.isNotNull() & b.isNotNull() & (g.isNull() | (g > b)))
    steps = F.array(F.struct(b.alias("at"), F.lit(1).alias("delta")), F.struct(g.alias("at"), F.lit(-1).alias("delta")))
    return lives.select(F.lit(kind).alias("kind"), k.cast("long").alias("key"), F.explode(steps).alias("s")).select("kind", "key", "s.at", "s.delta").filter("at is not null")


def orphans(references: DataFrame, deltas: DataFrame, hot_share: float = HOT_SHARE, salts: int = SALTS) -> DataFrame:
    """The references whose key does not exist at their time.

    ``references``: ``kind string, key bigint, at timestamp`` and columns of
    its own, which are returned; ``deltas`` as of ``existence_deltas``.
    """
    own = [c for c in references.columns if c not in ("kind", "key", "at")]
    refs = references.filter("key is not null")
    payload = F.struct(*[F.col(f"`{c}`") for c in own]) if own else F.struct(F.lit(0).alias("__none"))
    counts = refs.groupBy("kind", "key").count()
    hot = _hot(counts, hot_share)
    salted = refs.select("kind", "key", "at", payload.alias("ref"), F.lit(0).alias("delta"))
    steps = deltas.select("kind", "key", "at", F.lit(None).cast(salted.schema["ref"].dataType).alias("ref"), "delta")
    if hot:
        is_hot = F.struct("kind", "key").isin(*[F.struct(F.lit(a).cast("string").alias("kind"), F.lit(b).cast("long").alias("key")) for a, b in hot])
        # references of no known kind need no deltas, so all of them may be spread
        salted = salted.withColumn("salt", F.when(F.col("kind").isNull() | is_hot, (F.rand(11) * salts).cast("int")).otherwise(0))
        steps = steps.withColumn("salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    else:
        salted = salted.withColumn("salt", F.when(F.col("kind").isNull(), (F.rand(11) * salts).cast("int")).otherwise(0))
        steps = steps.withColumn("salt", F.lit(0))
    # a reference with delta 0 sorts after the deltas of its instant
    w = Window.partitionBy("kind", "key", "salt").orderBy(F.col("at").asc_nulls_first(), F.col("ref").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = salted.unionByName(steps).withColumn("exists_now", F.sum("delta").over(w))
    found = seen.filter(F.col("ref").isNotNull() & ((F.col("exists_now") <= 0) | F.col("kind").isNull()))
    return found.select("kind", "key", "at", *[F.col("ref")[c].alias(c) for c in own])


def _hot(counts: DataFrame, share: float) -> list[tuple]:
    """Keys with at least ``share`` of all rows: at most 1/share of them."""
    parts = counts.groupBy().agg(F.sum("count").alias("n")).first()["n"] or 0
    if not parts:
        return []
    return [(r["kind"], r["key"]) for r in counts.filter((F.col("count") >= share * parts) & F.col("kind").isNotNull()).collect()]


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphan references per kind and month of their time: ``kind, period,
    n_refs, n_keys``; a null time has a null period."""
    pre = found.groupBy("kind", F.date_format("at", "yyyy-MM").alias("period"), "key").agg(F.count("*").alias("n"))
    return pre.groupBy("kind", "period").agg(F.sum("n").alias("n_refs"), F.count("*").alias("n_keys"))


# --- the signed ledger, for feeds that arrive as change batches -------------

LEDGER = "kind string, key bigint, refs bigint, existing bigint"


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def apply_changes(ledger: DataFrame, changes: DataFrame) -> DataFrame:
    """The ledger after a batch ``kind, key, d_refs, d_existing`` of signed
    changes, in any order and with late ones. Keys whose both counts are zero
    leave the ledger; null keys are ignored. Changes are summed before the
    shuffle, so a hot key costs a row per task."""
    delta = changes.filter("key is not null").groupBy("kind", "key").agg(F.sum("d_refs").alias("refs"), F.sum("d_existing").alias("existing"))
    both = union_all([ledger, delta.select("kind", "key", "refs", "existing")])
    total = both.groupBy("kind", "key").agg(F.sum("refs").alias("refs"), F.sum("existing").alias("existing"))
    return total.filter("refs <> 0 or existing <> 0")


def current_orphans(ledger: DataFrame) -> DataFrame:
    """Keys with positive references and no existence."""
    return ledger.filter("refs > 0 and existing <= 0").select("kind", "key", "refs")

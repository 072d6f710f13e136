"""Per-key results where a few keys hold most rows.

Rows are never shuffled by key. Every task dictionary-encodes the keys of its
equal share of the input and adds counts and sums up in dense numpy arrays
(``bincount``); what leaves a task are array blocks, one per slice of the key
space, in which a key occurs once however many rows it has. Blocks of one slice
are concatenated, encoded again and scatter-reduced, first in groups (a tree
level) and then to the end. The work of a task depends on its input bytes and
on distinct keys, not on the rows of a key.

Defined cases
* null keys are counted under a null key of their own; null values count as a row and add nothing
* NaN values make the sum of their key NaN; an empty table gives an empty result
* repeated rows all count; other columns, whatever their names, are ignored
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct keys a task holds before its accumulators are sent off as blocks.
FLUSH_KEYS = 1 << 20
_BLOCKS = "block int, grp int, key_field string, keys array<bigint>, rows array<bigint>, vals array<bigint>, sums array<double>"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _slices(keys: np.ndarray, n: int) -> np.ndarray:
    """The slice of the key space of each key."""
    with np.errstate(over="ignore"):
        h = keys.astype(np.int64).view(np.uint64) * _MIX
    return ((h >> np.uint64(40)) % np.uint64(n)).astype(np.int64)


def _reduce(keys: np.ndarray, rows: np.ndarray, vals: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """Scatter-reduce of partial accumulators onto the dictionary of their keys."""
    uniq, code = np.unique(keys, return_inverse=True)
    out = [np.zeros(len(uniq), np.int64), np.zeros(len(uniq), np.int64)]
    np.add.at(out[0], code, rows)
    np.add.at(out[1], code, vals)
    return uniq, out[0], out[1], np.bincount(code, weights=sums, minlength=len(uniq))


class _Accumulator:
    """Accumulators of one key field in one task."""

    def __init__(self, field: str):
        self.field, self.parts, self.size = field, [], 0

    def add(self, key: pa.Array, value: pa.Array) -> None:
        enc = key.dictionary_encode(null_encoding="mask")
        code = enc.indices.fill_null(len(enc.dictionary)).to_numpy(zero_copy_only=False)
        n = len(enc.dictionary) + 1  # the last place is the null key's
        valid = value.is_valid().to_numpy(zero_copy_only=False)
        x = value.fill_null(0).to_numpy(zero_copy_only=False).astype(float)
        rows, vals, sums = np.bincount(code, minlength=n), np.bincount(code[valid], minlength=n), np.bincount(code, weights=x, minlength=n)
        keys = enc.dictionary.to_numpy(zero_copy_only=False).astype(np.int64)
        self.parts.append((keys, rows[:-1], vals[:-1], sums[:-1]))
        self.size += len(keys)
        if rows[-1]:
            self.null = tuple(a + b for a, b in zip(getattr(self, "null", (0, 0, 0.0)), (rows[-1], vals[-1], sums[-1])))
        if self.size > 2 * FLUSH_KEYS or len(self.parts) > 64:
            self.merge()

    def merge(self) -> None:
        if self.parts:
            self.parts = [_reduce(*(np.concatenate(x) for x in zip(*self.parts)))]
            self.size = len(self.parts[0][0])

    def blocks(self, slices: int, grp: int) -> Iterator[dict]:
        self.merge()
        for keys, rows, vals, sums in self.parts:
            if not len(keys):
                continue
            at = _slices(keys, slices)
            order = np.argsort(at, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                yield {"block": int(at[part[0]]), "grp": grp, "key_field": self.field, "keys": keys[part], "rows": rows[part], "vals": vals[part], "sums": sums[part]}
        if hasattr(self, "null"):
            r, v, s = self.null
            del self.null
            yield {"block": -1, "grp": grp, "key_field": self.field, "keys": [None], "rows": [int(r)], "vals": [int(v)], "sums": [float(s)]}
        self.parts, self.size = [], 0


def _table(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)


def _arrow_schema() -> pa.Schema:
    i64, f64 = pa.list_(pa.int64()), pa.list_(pa.float64())
    return pa.schema([("block", pa.int32()), ("grp", pa.int32()), ("key_field", pa.string()), ("keys", i64), ("rows", i64), ("vals", i64), ("sums", f64)])


def _merge(frame: pd.DataFrame) -> pd.DataFrame:
    first = frame.iloc[0]
    if first["block"] < 0:
        keys, rows, vals, sums = [None], [int(sum(x[0] for x in frame["rows"]))], [int(sum(x[0] for x in frame["vals"]))], [float(sum(x[0] for x in frame["sums"]))]
    else:
        keys, rows, vals, sums = _reduce(*(np.concatenate(list(frame[c])) for c in ("keys", "rows", "vals", "sums")))
    return pd.DataFrame({"block": [first["block"]], "grp": [first["grp"]], "key_field": [first["key_field"]], "keys": [keys], "rows": [rows], "vals": [vals], "sums": [sums]})


def aggregate_by_key(df: DataFrame, key_fields: list[str], value: str, slices: int | None = None, fan_in: int = 64) -> DataFrame:
    """Rows and sum of ``value`` per key of each of ``key_fields`` (integers).

    Returns ``key_field string, key_value bigint, n_rows bigint, n_values
    bigint, total double``; ``n_values`` counts values that are not null,
    ``total`` is null where there is none. ``slices`` is the number of parts
    of the key space (default: shuffle partitions), ``fan_in`` the number of
    input tasks whose blocks the first level of the tree puts together.
    """
    slices = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    picked = df.select(*[F.col(f"`{k}`").cast("long").alias(f"k{i}") for i, k in enumerate(key_fields)], F.col(f"`{value}`").cast("double").alias("v"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        grp = TaskContext.get().partitionId() // fan_in
        acc, schema = [_Accumulator(k) for k in key_fields], _arrow_schema()
        for b in batches:
            v = b.column(len(key_fields))
            for i, a in enumerate(acc):
                a.add(b.column(i), v)
                if a.size > FLUSH_KEYS:
                    yield _table(list(a.blocks(slices, grp)), schema)
        for a in acc:
            if rows := list(a.blocks(slices, grp)):
                yield _table(rows, schema)

    blocks = picked.mapInArrow(split, _BLOCKS)
    blocks = blocks.groupBy("key_field", "block", "grp").applyInPandas(_merge, _BLOCKS)
    blocks = blocks.groupBy("key_field", "block").applyInPandas(_merge, _BLOCKS)
    each = blocks.select("key_field", F.explode(F.arrays_zip("keys", "rows", "vals", "sums")).alias("x"))
    return each.select("key_field", F.col("x.keys").alias("key_value"), F.col("x.rows").alias("n_rows"), F.col("x.vals").alias("n_values"), F.when(F.col("x.vals") > 0, F.col("x.sums")).alias("total"))


def heavy_keys(per_key: DataFrame, shares: dict[str, float]) -> DataFrame:
    """The keys of ``aggregate_by_key`` that hold at least the share of all
    rows given for their field. Null keys count as rows but are no keys. At
    most 1/share keys of a field can qualify."""
    total = per_key.groupBy("key_field").agg(F.sum("n_rows").alias("all_rows"))
    share = F.create_map(*[F.lit(x) for kv in shares.items() for x in kv])
    joined = per_key.filter("key_value is not null").join(F.broadcast(total), "key_field")  # one row per key field
    return joined.filter(F.col("n_rows") >= share[F.col("key_field")] * F.col("all_rows")).select("key_field", "key_value", "n_rows", "n_values", "total", "all_rows")

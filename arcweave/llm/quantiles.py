"""Percentiles of very large columns per group, in a form that adds up.

A sketch holds full buffers of ``SIZE`` sorted values with a weight, and a tail
of fewer single values. Whenever there are ``BUFFERS`` full buffers, those of
the lowest level are collapsed into one: it takes evenly spaced positions of
their weighted merge, and its weight is the sum of theirs. A collapse into
weight W moves no rank by more than W // 2 + 1; the sketch carries the sum of
these as its ``error``, so every answer has a proven bound and nothing is
random. Sketches of partitions and days are merged by putting their buffers
together and collapsing in the same way, over a tree of partitions, so that a
group holding most rows costs a task no more than ``FAN_IN`` small sketches.

``exact_quantile`` uses the bound to get exact results: the sketch brackets the
wanted order statistics, the next pass counts the values equal to the bounds and
sketches only those strictly between them, until a sketch is exact or its
brackets have shrunk to single values (two passes for groups below some ten
million values). So a value that fills much of a group ends the search.

Defined cases: null groups, null and NaN values are left out; infinite values
are ordinary; ties may be of any size; a group of one value has it as every
percentile; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.runtime import join_bounded, write_stage

SIZE = 1024
BUFFERS = 10
FAN_IN = 64
#: Groups a task holds before their sketches are sent off.
HELD_GROUPS = 4096


class Sketch:
    """Weighted sorted buffers of equal size; see the module."""

    def __init__(self, size: int = SIZE, buffers: int = BUFFERS):
        self.size, self.most = size, buffers
        self.full: list[tuple[int, int, np.ndarray]] = []  # level, weight, values
        self.tail: list[np.ndarray] = []
        self.held = self.n = self.error = 0

    def add(self, values: np.ndarray) -> None:
        self.n += len(values)
        self._hold(values)

    def _hold(self, values: np.ndarray) -> None:
        self.tail.append(values)
        self.held += len(values)
        if self.held < self.size:
            return
        tail = np.concatenate(self.tail)
        whole = len(tail) // self.size * self.size
        for at in range(0, whole, self.size):
            self._push(0, 1, np.sort(tail[at : at + self.size]))
        self.tail, self.held = [tail[whole:]], len(tail) - whole

    def _push(self, level: int, weight: int, values: np.ndarray) -> None:
        self.full.append((level, weight, values))
        while len(self.full) >= self.most:
            self._collapse()

    def _collapse(self) -> None:
        levels = sorted({f[0] for f in self.full})
        low = levels[0]
        if sum(f[0] == low for f in self.full) < 2:  # a single buffer joins the next level
            low = levels[1]
        chosen = [f for f in self.full if f[0] <= low]
        rest = [f for f in self.full if f[0] > low]
        values = np.concatenate([f[2] for f in chosen])
        weights = np.repeat([f[1] for f in chosen], self.size)
        order = np.argsort(values, kind="stable")
        total = sum(f[1] for f in chosen)
        # places (total + 1) / 2, or total / 2 and total / 2 + 1 by turns, in each stretch of ``total`` positions
        place = np.arange(self.size) * total + (total + 1) // 2
        if total % 2 == 0:
            place[1::2] += 1
        at = np.searchsorted(np.cumsum(weights[order]), place)
        rest.append((low + 1, total, values[order][at]))
        self.full = rest
        self.error += total // 2 + 1

    def merge(self, other: Sketch) -> None:
        self.n += other.n
        self.error += other.error
        for f in other.full:
            self._push(*f)
        for t in other.tail:
            self._hold(t)

    def _weighted(self) -> tuple[np.ndarray, np.ndarray]:
        parts = [(v, np.full(len(v), w, np.int64)) for _, w, v in self.full] + [(t, np.ones(len(t), np.int64)) for t in self.tail]
        values = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0)
        weights = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
        order = np.argsort(values, kind="stable")
        return values[order], np.cumsum(weights[order])

    def bracket(self, rank: int) -> tuple[float, float, float]:
        """For the value at the 1-based ``rank``: a lower bound, an estimate
        and an upper bound; unbounded sides are infinite."""
        values, ends = self._weighted()
        low, high = rank - self.error - bool(self.error), rank + self.error + bool(self.error)
        get = lambda r: float(values[min(np.searchsorted(ends, r), len(values) - 1)])
        return (get(low) if low >= 1 else -math.inf), get(min(max(rank, 1), self.n)), (get(high) if high <= self.n else math.inf)

    def pack(self) -> bytes:
        tail = np.concatenate(self.tail) if self.tail else np.zeros(0)
        head = np.array([self.n, self.error, len(self.full), len(tail), *(x for f in self.full for x in f[:2])], np.int64)
        return head.tobytes() + b"".join(f[2].astype(float).tobytes() for f in self.full) + tail.astype(float).tobytes()

    @classmethod
    def unpack(cls, data: bytes, size: int = SIZE, buffers: int = BUFFERS) -> Sketch:
        s = cls(size, buffers)
        s.n, s.error, k, t = (int(x) for x in np.frombuffer(data, np.int64, 4))
        marks = np.frombuffer(data, np.int64, 2 * k, 32).reshape(k, 2)
        body = np.frombuffer(data, float, -1, 32 + 16 * k)
        s.full = [(int(level), int(weight), body[i * size : (i + 1) * size]) for i, (level, weight) in enumerate(marks)]
        s.tail, s.held = [body[k * size : k * size + t]], t
        return s


_SKETCHES = "grp string, part string, n bigint, error bigint, sketch binary, node int"


def sketch(df: DataFrame, group: str, value: str, part: str | None = None) -> DataFrame:
    """One sketch per ``group`` (as text) and ``part`` (a day, say): ``grp
    string, part string, n bigint, error bigint, sketch binary``."""
    rows = df.select(F.col(f"`{group}`").cast("string").alias("grp"), (F.col(f"`{part}`").cast("string") if part else F.lit("")).alias("part"), F.col(f"`{value}`").cast("double").alias("v"))
    rows = rows.filter("grp is not null and part is not null and v is not null and not isnan(v)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        node, held = TaskContext.get().partitionId() // FAN_IN, {}

        def out() -> pa.RecordBatch:
            items = list(held.items())
            held.clear()
            return pa.RecordBatch.from_pydict({"grp": [k[0] for k, _ in items], "part": [k[1] for k, _ in items], "n": [s.n for _, s in items], "error": [s.error for _, s in items], "sketch": [s.pack() for _, s in items], "node": pa.array([node] * len(items), pa.int32())})

        for b in batches:
            for key, v in b.to_pandas().groupby(["grp", "part"], sort=False)["v"]:
                held.setdefault(key, Sketch()).add(v.to_numpy())
            if len(held) > HELD_GROUPS:
                yield out()
        if held:
            yield out()

    return _merged(rows.mapInArrow(run, _SKETCHES), ["grp", "part"])


def _merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches merged by ``keys``: first per tree node, then to the end. A
    task streams over its sorted sketches and holds one group at a time."""

    def go(by: list[str]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at, total, done = None, Sketch(), []

            def flush() -> pd.DataFrame:
                out = pd.DataFrame(done, columns=["grp", "part", "n", "error", "sketch", "node"])
                done.clear()
                return out

            def close() -> None:
                if at is not None:
                    key = dict(zip(by, at))
                    done.append((key["grp"], key.get("part", ""), total.n, total.error, total.pack(), key.get("node", 0)))

            for b in batches:
                for row in zip(*(b[c] for c in by), b["sketch"]):
                    if row[:-1] != at:
                        close()
                        at, total = row[:-1], Sketch()
                    total.merge(Sketch.unpack(row[-1]))
                if len(done) >= 256:
                    yield flush()
            close()
            if done:
                yield flush()

        return run

    for by in ([*keys, "node"], keys):
        sketches = sketches.repartition(*by).sortWithinPartitions(*by).mapInPandas(go(by), _SKETCHES)
    return sketches.drop("node")


def combine(sketches: DataFrame) -> DataFrame:
    """The sketches of all parts of each group as one."""
    return _merged(sketches.withColumn("node", (F.xxhash64("part") % FAN_IN).cast("int")), ["grp"]).drop("part")


def percentiles(sketches: DataFrame, points: list[float]) -> DataFrame:
    """``grp, point, n, error, low, estimate, high``: the value at rank
    ceil(point * n) lies between ``low`` and ``high``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for g, n, data in zip(b["grp"], b["n"], b["sketch"]):
                s = Sketch.unpack(data)
                rows += [(g, p, n, s.error, *s.bracket(max(1, math.ceil(p * n)))) for p in points]
            yield pd.DataFrame(rows, columns=["grp", "point", "n", "error", "low", "estimate", "high"])

    return sketches.select("grp", "n", "sketch").mapInPandas(run, "grp string, point double, n bigint, error bigint, low double, estimate double, high double")


def exact_quantile(df: DataFrame, group: str, value: str, point: float) -> DataFrame:
    """``grp string, n bigint, quantile double``: the exact percentile with
    linear interpolation between the two order statistics around it."""
    rows = df.select(F.col(f"`{group}`").cast("string").alias("grp"), F.col(f"`{value}`").cast("double").alias("v")).filter("grp is not null and v is not null and not isnan(v)")

    def narrow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for g, n, below, lows, old_low, old_high, data in zip(b["grp"], b["n"], b["below"], b["lows"], b["low"], b["high"], b["sketch"]):
                s = Sketch() if data is None else Sketch.unpack(data)
                where = point * (n - 1)

                def at(rank: int) -> tuple[float, float, float]:
                    """The bracket of the value at this rank: one of the old bounds, or between them."""
                    if rank <= below + lows:
                        return old_low, old_low, old_low
                    if rank > below + lows + s.n:
                        return old_high, old_high, old_high
                    low, mid, high = s.bracket(rank - below - lows)
                    return max(low, old_low), mid, min(high, old_high)

                low, a, a_high = at(math.floor(where) + 1)
                c_low, c, high = at(math.ceil(where) + 1)
                done = s.error == 0 or (low == a_high and c_low == high)
                out.append((g, n, low, high, done, a + (c - a) * (where - math.floor(where)) if a != c else a))
            yield pd.DataFrame(out, columns=["grp", "n", "low", "high", "done", "quantile"])

    state = "grp string, n bigint, low double, high double, done boolean, quantile double"
    none, inf = F.lit(0).cast("long"), F.lit(float("inf"))
    first = sketch(rows, "grp", "v").select("grp", "n", none.alias("below"), none.alias("lows"), (-inf).alias("low"), inf.alias("high"), "sketch")
    bounds = write_stage(first.mapInPandas(narrow, state), "quantile")
    finished = [bounds.filter("done")]
    while not (todo := bounds.filter("not done")).isEmpty():
        near = join_bounded(rows, todo.select("grp", "n", "low", "high"), ["grp"])
        count = lambda c: F.count(F.when(c, 1))
        sides = near.groupBy("grp").agg(F.first("n").alias("n"), count(F.col("v") < F.col("low")).alias("below"), count(F.col("v") == F.col("low")).alias("lows"), F.first("low").alias("low"), F.first("high").alias("high"))
        # the bounds themselves are counted, so each pass has fewer distinct values to sketch
        inside = sketch(near.filter("v > low and v < high"), "grp", "v").select("grp", "sketch")
        both = sides.join(inside, "grp", "left").select("grp", "n", "below", "lows", "low", "high", "sketch")
        bounds = write_stage(both.mapInPandas(narrow, state), "quantile")
        finished.append(bounds.filter("done"))
    out = finished[0]
    for f in finished[1:]:
        out = out.unionByName(f)
    return out.select("grp", "n", "quantile")


def far_above(df: DataFrame, group: str, value: str, key: str, times: float = 10.0, point: float = 0.5) -> DataFrame:
    """``key`` of the rows whose value exceeds ``times`` the group's exact
    percentile (its median)."""
    mid = exact_quantile(df, group, value, point).select(F.col("grp").alias("__g"), "quantile")
    rows = df.select(F.col(f"`{key}`").alias(key), F.col(f"`{group}`").cast("string").alias("__g"), F.col(f"`{value}`").cast("double").alias("__v"))
    return join_bounded(rows, mid, ["__g"]).filter(F.col("__v") > F.lit(times) * F.col("quantile")).select(key)

"""The most similar vectors of every vector, by a hash-prefix forest.

A tree gives a vector a string of 64 bits, the signs of random projections, and
is a sorted array of these strings. In every tree a vector descends to its
longest match, its place in the order; from there all trees are ascended in
step, a bit of common prefix less at a time, until the candidates met in all of
them together reach a budget of ``BUDGET`` per tree: the level at which a vector
stops is one number for all trees, deep where data are dense and shallow where
they are thin. (A tree counts for no more than twice its share, so that one
crowded prefix can't end the ascent of the rest.) How many share a prefix is
read off a bounded sample of the strings that every task has; so the level is
known when the strings are made, and each tree can be searched by itself.

The number of trees grows with the size of an index: a pair at the least cosine
agrees in a bit with chance p, and n vectors meet their budget at log2(n /
BUDGET) bits, so ``trees_for`` takes as many as make a meeting in at least one
as likely as ``RECALL``. A tree is cut into leaves, prefixes of variable length
fitted on the same sample and applied to every vector, one task each. In a leaf
every vector meets its prefix bucket at its level. What is met is held against
a separate 128-bit signature, and only pairs whose signatures allow the wanted
cosine become candidates. Their cosines are then computed exactly.

Signatures can't rank the members of a dense group. A vector that meets
``DENSE`` candidates in one tree, or whose bucket is too large (``FARTHEST``) or
reaches over its leaf in a quarter of the trees, is compared with its whole
index instead, in blocks of matrix products; so is every vector where no least cosine is given.
That is exact, and its cost is the number of such vectors times the index.

Equal vectors (after normalisation) are one class: a class enters the forest
once, however many vectors it has, and its members share its neighbours; among
them and beyond, the smaller id comes first at equal cosine. So a group holding
a third of all vectors costs no more than its rows.

What is shuffled: 40 bytes per class and tree, packed in blocks; candidates;
vectors of candidates only (broadcast below a counted size). The exact
comparison writes the vectors once more, in doubles, and reads them per task.

Defined cases: an unusable vector (null, wrong length, null or not finite
element, norm 0) is left out, and so is a null id; a repeated (index, id) counts
once; a vector's own id is no neighbour; empty tables give empty results; an
index listed twice counts once; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcweave.runtime import join_bounded, write_stage

#: Candidates per tree at which the ascent ends.
BUDGET = 256
#: The chance for a pair at the least cosine to meet, from which the number of trees follows, and the fewest trees.
RECALL, FEWEST = 0.995, 8
#: The places of a bucket that are searched, at most; beyond, the tree counts as not searched to its end.
FARTHEST = 4096
#: Candidates met in one tree from which a vector is compared with its whole index.
DENSE = 48
#: Levels whose prefixes are counted in the sample; deeper ones are taken to halve.
COUNTED = 16
#: Vectors of a block of the exact comparison.
ROWS = 2048
#: Vectors of the sample that levels and leaves are fitted on, at most (about), of all indexes together.
SAMPLE_ROWS = 100_000
#: Classes a leaf should hold at most (about).
LEAF = 50_000
#: Vectors a task hashes before it sends its blocks off.
HELD = 200_000
SEED = 20240601
_SIG = 128


@lru_cache(maxsize=16)
def _planes(dim: int, trees: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, 64 * trees + _SIG), np.float32)


@lru_cache(maxsize=16)
def _odd(dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim, 1]).integers(1, 1 << 63, dim, np.uint64) * np.uint64(2) + np.uint64(1)


def _unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The usable rows of a matrix and their unit vectors."""
    with np.errstate(over="ignore", invalid="ignore"):
        big = np.abs(m).max(axis=1, initial=0)
        ok = np.isfinite(m).all(axis=1) & (big > 0)
    m = m[ok].astype(float) / big[ok, None].astype(float)
    return ok, m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _bits(u: np.ndarray, trees: int) -> np.ndarray:
    """Strings of all trees, then the signature, as columns of 64-bit words."""
    out = []
    planes = _planes(u.shape[1], trees)
    for at in range(0, len(u), 4096):
        packed = np.packbits(u[at : at + 4096].astype(np.float32) @ planes > 0, axis=1)
        out.append(packed.view(">u8").astype(np.uint64))
    return np.concatenate(out) if out else np.zeros((0, trees + _SIG // 64), np.uint64)


def _classes(u: np.ndarray) -> np.ndarray:
    """One number per distinct unit vector (at a grain of 1e-6)."""
    with np.errstate(over="ignore"):
        q = np.rint(u * 1e6).astype(np.int64).astype(np.uint64)
        h = (q * _odd(u.shape[1])).sum(axis=1, dtype=np.uint64)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Index, ids and unit vectors of the usable rows of a batch ``index_id,
    vid, fvector`` whose vectors have their index's length."""
    index = batch.column(0).to_numpy(zero_copy_only=False)
    vids = batch.column(1).to_numpy(zero_copy_only=False)
    for i in np.unique(index):
        mine = np.flatnonzero(index == i)
        lists = batch.column(2).take(pa.array(mine))
        flat = lists.flatten().to_numpy(zero_copy_only=False)  # null elements become NaN
        m = flat.astype(np.float64 if flat.dtype == object else flat.dtype).reshape(len(mine), -1)
        ok, u = _unit(m)
        if len(u):
            yield int(i), vids[mine[ok]].astype(np.int64), u


def usable(vectors: DataFrame, index: DataFrame) -> DataFrame:
    """``index_id, vid, fvector`` of the rows that belong to an index and have
    its length; elements are checked where they are read."""
    ix = index.select("index_id", "label", "field_name", "dimension").filter("index_id is not null").distinct()
    rows = vectors.filter("vid is not null and fvector is not null").select("label", "field_name", F.col("vid").cast("long").alias("vid"), "fvector")
    return join_bounded(rows, ix, ["label", "field_name"]).filter(F.size("fvector") == F.col("dimension")).filter("dimension > 0").select("index_id", "vid", "fvector")


def trees_for(n: int, min_cosine: float, budget: int = BUDGET, recall: float = RECALL) -> int:
    """The trees with which a pair at ``min_cosine`` among ``n`` vectors meets
    with a chance of ``recall``."""
    p = 1 - math.acos(max(-1.0, min(1.0, min_cosine))) / math.pi
    met = min(p ** max(0.0, math.log2(max(1, n) / budget)), 1 - 1e-9)
    return max(FEWEST, math.ceil(math.log(1 - recall) / math.log1p(-met)))


class Forest:
    """The trees of one index: leaves and, per tree and level, how many vectors
    (estimated from a sample) have each prefix."""

    def __init__(self, trees: int, strings: np.ndarray | None = None, share: float = 1.0, leaf: int = LEAF, budget: int = BUDGET):
        self.trees, self.budget = trees, budget
        self.leaves = [np.zeros(1, np.uint64)] * trees
        self.counts: list[list[np.ndarray]] = []
        if strings is None or not len(strings):
            return
        self.leaves = [np.array(_split(np.sort(strings[:, t]), 0, 0, leaf * share), np.uint64) for t in range(trees)]
        self.share = share
        for x in range(1, min(COUNTED, max(1, (len(strings) - 1).bit_length())) + 1):
            one = [np.bincount((strings[:, t] >> np.uint64(64 - x)).astype(np.int64), minlength=1 << x) for t in range(trees)]
            self.counts.append([np.minimum(c, math.ceil(2 * budget * share)).astype(np.uint16) for c in one])

    def levels(self, strings: np.ndarray) -> np.ndarray:
        """Where each vector's ascent ends: the deepest level at which its
        buckets of all trees together hold the budget."""
        out, want = np.zeros(len(strings), np.int64), self.budget * self.trees
        total = np.zeros(len(strings), np.float32)
        for x, counts in enumerate(self.counts, 1):
            total = np.zeros(len(strings), np.float32)
            for t in range(self.trees):
                total += counts[t][(strings[:, t] >> np.uint64(64 - x)).astype(np.int64)]
            total /= self.share
            out[total >= want] = x
        deep = (total >= want) & (len(self.counts) > 0)
        out[deep] += np.log2(total[deep] / want).astype(np.int64)
        return out.astype(np.uint8)


def fit_forests(rows: DataFrame, min_cosine: float, sample_rows: int = SAMPLE_ROWS, leaf: int = LEAF, budget: int = BUDGET, recall: float = RECALL) -> dict[int, Forest]:
    """The forest of each index, fitted on a hashed sample of about
    ``sample_rows`` vectors of them all; an index that the sample misses is
    one bucket."""
    sizes = {r["index_id"]: r["count"] for r in rows.groupBy("index_id").count().collect()}  # a row per index
    if not sizes:
        return {}
    share = min(1.0, sample_rows / sum(sizes.values()))
    some = rows if share == 1 else rows.filter(F.pmod(F.xxhash64("vid"), F.lit(1 << 40)) < F.lit(max(1, int(share * (1 << 40)))))
    trees = {i: trees_for(n, min_cosine, budget, recall) for i, n in sizes.items()}
    strings: dict[int, list[np.ndarray]] = {}
    for b in some.toArrow().to_batches():
        for i, _, u in _matrices(b):
            strings.setdefault(i, []).append(np.unique(_bits(u, trees[i])[:, : trees[i]], axis=0))
    return {i: Forest(trees[i], np.concatenate(strings[i]) if i in strings else None, share, leaf, budget) for i in sizes}


def _split(strings: np.ndarray, low: int, depth: int, most: float) -> list[int]:
    if len(strings) <= most or depth == 63:
        return [low]
    mid = low + (1 << (63 - depth))
    at = np.searchsorted(strings, np.uint64(mid))
    return _split(strings[:at], low, depth + 1, most) + _split(strings[at:], mid, depth + 1, most)


def most_different(min_cosine: float) -> int:
    """Bits in which the signatures of a pair of this cosine differ, but for a
    chance of some 1 in 5000."""
    p = math.acos(max(-1.0, min(1.0, min_cosine))) / math.pi
    return min(_SIG, math.ceil(_SIG * p + 3.5 * math.sqrt(_SIG * p * (1 - p))))


_BLOCK = "index_id int, tree int, leaf int, n int, vid binary, class binary, string binary, sig binary, level binary"
_PAIR = "index_id int, a bigint, b bigint"


def _leaf_search(frame: pd.DataFrame, differ: int, forests: dict[int, Forest]) -> pd.DataFrame:
    """The candidate pairs of one leaf, and (as ``a`` with ``short`` > 0) the
    classes whose bucket this tree can't search to its end; the shorts of a
    class over all trees sum up to 1 where it has to be compared with all."""
    get = lambda c, kind: np.frombuffer(b"".join(frame[c]), kind)
    vid, klass, string, sig, level = get("vid", np.int64), get("class", np.int64), get("string", np.uint64), get("sig", np.uint64).reshape(-1, 2), get("level", np.uint8)
    order = np.lexsort((vid, klass))
    order = order[np.r_[True, klass[order][1:] != klass[order][:-1]]]  # the smallest id stands for its class
    order = order[np.lexsort((klass[order], string[order]))]
    vid, x, y, string, level = vid[order], sig[order, 0], sig[order, 1], string[order], level[order].astype(np.uint64)
    i, t, k = (int(frame[c].iloc[0]) for c in ("index_id", "tree", "leaf"))
    forest = forests[i]
    bounds = forest.leaves[t]
    width = (int(bounds[k + 1]) if k + 1 < len(bounds) else 1 << 64) - int(bounds[k])
    here, n = np.arange(len(vid)), len(vid)
    rest = np.where(level == 0, ~np.uint64(0), (np.uint64(1) << (np.uint64(64) - np.maximum(level, 1))) - np.uint64(1))  # the bits below the level
    up, down = np.searchsorted(string, string | rest, "right") - 1 - here, here - np.searchsorted(string, string & ~rest)
    beyond = (rest > np.uint64(width - 1)) | (np.maximum(up, down) > FARTHEST // 2)
    up, down = np.minimum(up, FARTHEST // 2), np.minimum(down, FARTHEST // 2)
    found, hits = [], np.zeros(n, np.int64)
    above, below = here, here
    for step in range(1, int(max(up.max(initial=0), down.max(initial=0))) + 1):
        above, below = above[up[above] >= step], below[down[below] >= step]
        only = below[up[below - step] < step] - step  # pairs that only their upper end searches
        i0 = np.concatenate([above, only]) if len(only) else above
        if not len(i0):
            break
        i1 = i0 + step
        ok = np.bitwise_count(x[i0] ^ x[i1]) + np.bitwise_count(y[i0] ^ y[i1]) <= differ
        i0, i1 = i0[ok], i1[ok]
        if len(i0):
            hits[i0] += 1
            hits[i1] += 1
            found.append(np.stack([vid[i0], vid[i1]]))
        if step % 32 == 0:  # a dense vector needn't search on
            up[hits >= DENSE] = down[hits >= DENSE] = 0
    pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    pairs = pairs[:, pairs[0] != pairs[1]]
    short = np.where(hits >= DENSE, 1.0, np.where(beyond, 1 / math.ceil(forest.trees / 4), 0.0))
    left = np.flatnonzero(short)
    none = np.zeros(pairs.shape[1])
    return pd.DataFrame({"index_id": np.full(pairs.shape[1] + len(left), i, np.int32), "a": np.r_[pairs.min(axis=0), vid[left]], "b": np.r_[pairs.max(axis=0), vid[left]], "short": np.r_[none, short[left]]})


def candidates(rows: DataFrame, min_cosine: float, **sizes: float) -> tuple[DataFrame, DataFrame]:
    """``index_id, a, b``: pairs of class representatives (their smallest
    ids), a < b, each once, whose cosine may reach ``min_cosine``; and
    ``index_id, rep``: the classes in places too dense for the trees.
    ``sizes``: of ``fit_forests``."""
    shipped = rows.sparkSession.sparkContext.broadcast(fit_forests(rows, min_cosine, **sizes))
    differ = most_different(min_cosine)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        n = 0

        def out() -> Iterator[pa.RecordBatch]:
            for i, parts in held.items():
                vid, klass, bits = (np.concatenate(x) for x in zip(*parts))
                order = np.lexsort((vid, klass))
                order = order[np.r_[True, klass[order][1:] != klass[order][:-1]]]
                vid, klass, bits = vid[order], klass[order], bits[order]
                forest = shipped.value[i]
                level = forest.levels(bits)
                made = []
                for t in range(forest.trees):
                    order = np.argsort(bits[:, t], kind="stable")
                    cut = np.searchsorted(bits[order, t], forest.leaves[t])
                    for k, part in enumerate(np.split(order, cut[1:])):
                        if len(part):
                            made.append({"index_id": i, "tree": t, "leaf": k, "n": len(part), "vid": vid[part].tobytes(), "class": klass[part].tobytes(), "string": bits[part, t].tobytes(), "sig": np.ascontiguousarray(bits[part, forest.trees :]).tobytes(), "level": level[part].tobytes()})
                yield pa.RecordBatch.from_pylist(made, schema=schema)
            held.clear()

        i32, raw = pa.int32(), pa.binary()
        schema = pa.schema([("index_id", i32), ("tree", i32), ("leaf", i32), ("n", i32), ("vid", raw), ("class", raw), ("string", raw), ("sig", raw), ("level", raw)])
        for b in batches:
            for i, vid, u in _matrices(b):
                held.setdefault(i, []).append((vid, _classes(u), _bits(u, shipped.value[i].trees)))
                n += len(vid)
            if n >= HELD:
                yield from out()
                n = 0
        yield from out()

    found = rows.mapInArrow(blocks, _BLOCK).groupBy("index_id", "tree", "leaf").applyInPandas(lambda f: _leaf_search(f, differ, shipped.value), f"{_PAIR}, short double")
    found = write_stage(found, "met")
    rest = found.filter("short > 0").groupBy("index_id", F.col("a").alias("rep")).agg(F.sum("short").alias("short")).filter("short > 0.999").drop("short")
    return found.filter("short = 0").select("index_id", "a", "b").distinct(), rest


def copies(rows: DataFrame) -> DataFrame:
    """``index_id, rep, vid`` of the classes with more than one id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, vid, u in _matrices(b):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(vid), i, np.int32)), pa.array(vid), pa.array(_classes(u))], names=["index_id", "vid", "class"])

    each = rows.mapInArrow(run, "index_id int, vid bigint, class bigint")
    # of a class with one id no row needs to leave the first step; equal (class, id) are put together before the shuffle
    once = write_stage(each.groupBy("index_id", "class", "vid").agg(F.lit(1).alias("one")).drop("one"), "classes")
    many = once.groupBy("index_id", "class").agg(F.min("vid").alias("rep"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return join_bounded(once, write_stage(many, "copies"), ["index_id", "class"]).select("index_id", "rep", "vid")


def cosines(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs with their exact ``cosine`` (in doubles)."""
    ends = write_stage(pairs.select("index_id", F.explode(F.array("a", "b")).alias("vid")).distinct(), "ends")
    vec = rows.withColumn("usable", F.forall("fvector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("fvector", lambda x: x != 0)).filter("usable")
    vec = join_bounded(vec.drop("usable"), ends, ["index_id", "vid"], salts=1)
    vec = write_stage(vec.groupBy("index_id", "vid").agg(F.min_by("fvector", F.xxhash64("fvector")).alias("fvector")), "vectors")
    both = pairs.join(vec.select("index_id", F.col("vid").alias("a"), F.col("fvector").alias("x")), ["index_id", "a"]).join(vec.select("index_id", F.col("vid").alias("b"), F.col("fvector").alias("y")), ["index_id", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index = b.column(0).to_numpy(zero_copy_only=False)
            cos = np.zeros(b.num_rows)
            for i in np.unique(index):
                mine = np.flatnonzero(index == i)
                x, y = (_unit(b.column(k).take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).reshape(len(mine), -1))[1] for k in (3, 4))
                cos[mine] = (x * y).sum(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(cos)], names=["index_id", "a", "b", "cosine"])

    return both.select("index_id", "a", "b", "x", "y").mapInArrow(run, f"{_PAIR}, cosine double")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of up to ``ROWS`` ids and unit vectors of one index."""
    held: dict[int, list] = {}

    def out(i: int) -> pa.RecordBatch:
        vid, u = (np.concatenate(x) for x in zip(*held.pop(i)))
        vid, first = np.unique(vid, return_index=True)
        raw = u[first].tobytes()
        return pa.RecordBatch.from_pydict({"index_id": pa.array([i], pa.int32()), "block": [hash((i, len(vid), raw))], "vid": [vid.tobytes()], "vec": [raw]})

    for b in batches:
        for i, vid, u in _matrices(b):
            for at in range(0, len(vid), ROWS):
                held.setdefault(i, []).append((vid[at : at + ROWS], u[at : at + ROWS]))
                if sum(len(v) for v, _ in held[i]) >= ROWS:
                    yield out(i)
    for i in list(held):
        yield out(i)


def _better(best: tuple, u: np.ndarray, vid: np.ndarray, v: np.ndarray, other: np.ndarray) -> None:
    """Puts what ``v`` has among the best ids and cosines of ``u``."""
    ids, cos = best
    k = ids.shape[1]
    v32 = v.astype(np.float32).T
    for at in range(0, len(u), 1024):
        mine, my_ids, my_cos = u[at : at + 1024], ids[at : at + 1024], cos[at : at + 1024]
        s = mine.astype(np.float32) @ v32
        least = my_cos[:, -1].copy()
        if len(other) > k + 1 and np.isinf(least).any():  # its own id may be among them
            least = np.maximum(least, np.partition(s, len(other) - k - 1, axis=1)[:, len(other) - k - 1])
        r, c = np.nonzero(s >= (least - 5e-6)[:, None])
        keep = vid[at + r] != other[c]
        r, c = r[keep], c[keep]
        if not len(r):
            continue
        exact = np.concatenate([np.einsum("ij,ij->i", mine[r[j : j + 65536]], v[c[j : j + 65536]]) for j in range(0, len(r), 65536)])
        r0, k0 = np.nonzero(np.isfinite(my_cos))
        row, got, value = np.r_[r0, r], np.r_[my_ids[r0, k0], other[c]], np.r_[my_cos[r0, k0], exact]
        order = np.lexsort((got, row))
        order = order[np.r_[True, (row[order][1:] != row[order][:-1]) | (got[order][1:] != got[order][:-1])]]
        order = order[np.lexsort((got[order], -value[order], row[order]))]
        row, got, value = row[order], got[order], value[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < k
        my_ids[row[keep], place[keep]], my_cos[row[keep], place[keep]] = got[keep], value[keep]


def exact(rows: DataFrame, many: DataFrame, k: int, rest: DataFrame | None = None) -> DataFrame:
    """``index_id, rep, other, cosine``: the ``k`` most similar classes of each
    class in ``rest`` (of every class, if None), by comparison with all."""
    spark = rows.sparkSession
    reps = join_bounded(rows, many.filter("vid <> rep").select("index_id", "vid"), ["index_id", "vid"], "left_anti")
    form = "index_id int, block bigint, vid binary, vec binary"
    blocks = write_stage(reps.mapInArrow(_pack, form), "blocks")
    asked = blocks if rest is None else write_stage(join_bounded(reps, rest.withColumnRenamed("rep", "vid"), ["index_id", "vid"], "left_semi").mapInArrow(_pack, form), "asked")
    every = blocks.coalesce(max(1, blocks.count() // 256)).select("index_id", F.col("vid").alias("other"), F.col("vec").alias("against"))
    both = asked.hint("shuffle_replicate_nl").join(every, "index_id").select("index_id", "block", "vid", "vec", "other", "against")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}
        for b in batches:
            for i, block, vid, vec, other, against in zip(*(c.to_pylist() for c in b.columns)):
                vid, other = np.frombuffer(vid, np.int64), np.frombuffer(other, np.int64)
                u, v = np.frombuffer(vec).reshape(len(vid), -1), np.frombuffer(against).reshape(len(other), -1)
                if (i, block) not in held:
                    held[i, block] = vid, (np.zeros((len(vid), k), np.int64), np.full((len(vid), k), -np.inf))
                _better(held[i, block][1], u, vid, v, other)
        for (i, _), (vid, (ids, cos)) in held.items():
            r, c = np.nonzero(np.isfinite(cos))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), i, np.int32)), pa.array(vid[r]), pa.array(ids[r, c]), pa.array(cos[r, c])], names=["index_id", "rep", "other", "cosine"])

    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "8")  # a row holds two blocks
    try:
        return write_stage(both.mapInArrow(run, "index_id int, rep bigint, other bigint, cosine double"), "exact")
    finally:
        spark.conf.set(size, before)


def similar(vectors: DataFrame, index: DataFrame, k: int = 10, min_cosine: float | None = 0.9, **sizes: float) -> DataFrame:
    """``index_id int, vid bigint, neighbour bigint, cosine double``: for every
    usable vector its ``k`` most similar ones of other ids in its index among
    those of cosine ``min_cosine`` or more, the smaller id first at ties. With
    None there is no least cosine, and all are compared with all. ``sizes``: of
    ``fit_forests``."""
    rows = usable(vectors, index).select(F.col("index_id").cast("int").alias("index_id"), "vid", "fvector")
    many = write_stage(copies(rows), "members")
    # the first k + 1 ids of each class stand for it wherever it is a neighbour
    w = Window.partitionBy("index_id", "rep").orderBy("vid")
    firsts = many.withColumn("at", F.row_number().over(w)).filter(F.col("at") <= k + 1).groupBy("index_id", "rep").agg(F.array_sort(F.collect_list("vid")).alias("ids"))
    firsts = write_stage(firsts, "firsts")
    if min_cosine is None:
        directed = exact(rows, many, k)
    else:
        pairs, rest = candidates(rows, min_cosine, **sizes)
        near = write_stage(cosines(write_stage(pairs, "pairs"), rows), "near")
        directed = near.select("index_id", F.explode(F.array(F.struct(F.col("a").alias("rep"), F.col("b").alias("other")), F.struct(F.col("b").alias("rep"), F.col("a").alias("other")))).alias("p"), "cosine").select("index_id", "p.rep", "p.other", "cosine")
        rest = write_stage(rest, "rest")
        if not rest.isEmpty():
            directed = directed.unionByName(exact(rows, many, k, rest))
        directed = directed.filter(F.col("cosine") >= min_cosine)
    directed = directed.groupBy("index_id", "rep", "other").agg(F.max("cosine").alias("cosine"))
    w = Window.partitionBy("index_id", "rep").orderBy(F.desc("cosine"), "other")
    directed = directed.withColumn("at", F.row_number().over(w)).filter(F.col("at") <= k)
    wide = directed.join(firsts.select("index_id", F.col("rep").alias("other"), "ids"), ["index_id", "other"], "left")
    wide = wide.select("index_id", "rep", "cosine", F.explode(F.coalesce("ids", F.array("other"))).alias("neighbour"))
    own = firsts.select("index_id", "rep", F.lit(1.0).alias("cosine"), F.explode("ids").alias("neighbour"))
    w = Window.partitionBy("index_id", "rep").orderBy(F.desc("cosine"), "neighbour")
    best = wide.unionByName(own).withColumn("at", F.row_number().over(w)).filter(F.col("at") <= k + 1)
    best = best.groupBy("index_id", "rep").agg(F.array_sort(F.collect_list(F.struct("at", "neighbour", "cosine"))).alias("best"))
    best = write_stage(best, "best")
    members = join_bounded(many, best, ["index_id", "rep"]).select("index_id", "vid", "best")
    single = best.join(firsts.select("index_id", "rep"), ["index_id", "rep"], "left_anti").select("index_id", F.col("rep").alias("vid"), "best")
    each = members.unionByName(single)
    mine = F.slice(F.filter("best", lambda x: x["neighbour"] != F.col("vid")), 1, k)
    return each.select("index_id", "vid", F.explode(mine).alias("x")).select("index_id", "vid", "x.neighbour", "x.cosine")

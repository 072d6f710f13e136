import numpy as np

from arcweave.llm import neighbours as N

INDEX = [(1, "A", "f", 16), (2, "A", "g", 24)]


def exact(rows, index, k, least):
    out = set()
    for ix, label, field, dim in index:
        vec = {}
        for r in rows:
            if (r[1], r[2]) == (label, field) and r[0] is not None and r[3] is not None and len(r[3]) == dim:
                v = np.array(r[3], float)
                if np.isfinite(v).all() and (v != 0).any():
                    vec[r[0]] = v / np.linalg.norm(v)
        ids = sorted(vec)
        if not ids:
            continue
        m = np.array([vec[i] for i in ids])
        for i, s in zip(ids, m @ m.T):
            best = sorted((-round(x, 9), j) for j, x in zip(ids, s) if j != i and x >= least)[:k]
            out |= {(ix, i, j) for _, j in best}
    return out


def rows_of(rng, n=1500):
    rows = []
    for field, dim in (("f", 16), ("g", 24)):
        centre = rng.standard_normal((n // 5, dim))
        for i in range(n):
            v = centre[i % len(centre)] + 0.12 * rng.standard_normal(dim)
            rows.append((i, "A", field, (v * rng.uniform(0.1, 9)).astype(np.float32).tolist()))
    return rows


def test_recall_and_edges(spark):
    rng = np.random.default_rng(0)
    rows = rows_of(rng)
    same = rng.standard_normal(16).astype(np.float32)
    rows += [(9000 + i, "A", "f", (same * np.float32(2.0 ** (i % 3))).tolist()) for i in range(400)]  # one vector for a fifth of the ids
    rows += [(8000, "A", "f", None), (8001, "A", "f", []), (8002, "A", "f", [0.0] * 16), (8003, "A", "f", [float("nan")] * 16), (8004, "A", "f", [1.0] * 15), (8005, "B", "f", [1.0] * 16), (None, "A", "f", [1.0] * 16), rows[0]]
    df = spark.createDataFrame(rows, "vid long, label string, field_name string, fvector array<float>")
    index = spark.createDataFrame(INDEX + INDEX[:1], "index_id int, label string, field_name string, dimension int")
    got = {(r.index_id, r.vid, r.neighbour) for r in N.similar(df, index, k=5).collect()}
    want = exact(rows, INDEX, 5, 0.9)
    assert len(got & want) / len(want) >= 0.97
    copies = {t for t in want if t[1] >= 9000}
    assert copies <= got and len(copies) == 400 * 5
    assert len(got - want) <= 0.01 * len(want)


def test_empty(spark):
    df = spark.createDataFrame([], "vid long, label string, field_name string, fvector array<float>")
    index = spark.createDataFrame(INDEX, "index_id int, label string, field_name string, dimension int")
    assert N.similar(df, index).count() == 0


def test_leaves_follow_density():
    s = np.sort(np.concatenate([np.full(50, 7, np.uint64), np.arange(50, dtype=np.uint64) << np.uint64(58)]))
    bounds = N._split(s, 0, 0, 10)
    assert bounds[0] == 0 and bounds == sorted(bounds) and len(bounds) > 8


def best(rows, index, k, least):
    """As ``exact`` for usable rows of one index, with arrays."""
    vec = {r[0]: np.array(r[3], float) for r in rows if r[2] == "f" and r[3] is not None}
    ids = np.array(sorted(vec))
    m = np.array([vec[i] / np.linalg.norm(vec[i]) for i in ids])
    s = np.round(m @ m.T, 9)
    np.fill_diagonal(s, -9)
    at = np.argsort(-s, axis=1, kind="stable")[:, :k]
    return {(index, int(ids[i]), int(ids[j])) for i, js in enumerate(at) for j in js if s[i, j] >= least}


def frames(spark, rows):
    return spark.createDataFrame(rows, "vid long, label string, field_name string, fvector array<float>"), spark.createDataFrame(INDEX, "index_id int, label string, field_name string, dimension int")


def test_dense_group(spark):
    """A third of an index are near, not equal, copies of one vector."""
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(16)
    rows = [(i, "A", "f", (centre + 0.05 * rng.standard_normal(16) if i % 3 == 0 else rng.standard_normal(16)).astype(np.float32).tolist()) for i in range(6000)]
    got = {(r.index_id, r.vid, r.neighbour) for r in N.similar(*frames(spark, rows), k=5).collect()}
    want = best(rows, 1, 5, 0.9)
    assert len(want) >= 10000 and len(got & want) >= 0.999 * len(want) and len(got - want) <= 0.001 * len(want)


def test_no_least_cosine(spark):
    """Every usable vector gets its k, however far they are."""
    rng = np.random.default_rng(5)
    rows = [(i, "A", "f", rng.standard_normal(16).astype(np.float32).tolist()) for i in range(3000)] + [(5000 + i, "A", "f", [1.0] * 16) for i in range(40)] + [(7, "A", "g", [1.0] * 24), (8, "A", "g", [-1.0] * 24), (9, "A", "f", None)]
    rows += rows[:20]
    got = {(r.index_id, r.vid, r.neighbour) for r in N.similar(*frames(spark, rows), k=5, min_cosine=None).collect()}
    want = best(rows, 1, 5, -2.0) | {(2, 7, 8), (2, 8, 7)}
    assert len(want) == 3040 * 5 + 2 and len(got & want) >= 0.999 * len(want) and len(got) == len(want)


def planted(n, dim, low, high, seed):
    """Random vectors, of which every tenth has a partner at a cosine between low and high."""
    rng = np.random.default_rng(seed)
    m = rng.standard_normal((n, dim)).astype(np.float32)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    a = np.arange(0, n - 1, 10)
    r = m[a + 1] - (m[a + 1] * m[a]).sum(1, keepdims=True) * m[a]
    r /= np.linalg.norm(r, axis=1, keepdims=True)
    c = rng.uniform(low, high, (len(a), 1)).astype(np.float32)
    m[a + 1] = c * m[a] + np.sqrt(1 - c * c) * r
    return m, {(int(i), int(i) + 1) for i in a}


def test_many_leaves_and_levels(spark):
    """Small leaves and a small budget make every tree a forest of many leaves and deep levels."""
    m, pairs = planted(6000, 32, 0.9, 0.95, 8)
    df = spark.createDataFrame([(i, "A", "f", v.tolist()) for i, v in enumerate(m)], "vid long, label string, field_name string, fvector array<float>")
    index = spark.createDataFrame([(1, "A", "f", 32)], "index_id int, label string, field_name string, dimension int")
    rows = N.usable(df, index)
    forest = N.fit_forests(rows, 0.9, sample_rows=2000, leaf=400, budget=16)[1]
    assert forest.trees > 15 and min(len(x) for x in forest.leaves) >= 8
    level = forest.levels(N._bits(m.astype(float), forest.trees))
    assert 6 <= level.mean() <= 10
    got = {(min(r.vid, r.neighbour), max(r.vid, r.neighbour)) for r in N.similar(df, index, k=3, sample_rows=2000, leaf=400, budget=16).collect()}
    assert len(got & pairs) >= 0.97 * len(pairs)


def test_levels_fall_together():
    """One crowded prefix doesn't end the ascent of the other trees."""
    rng = np.random.default_rng(1)
    strings = rng.integers(0, 1 << 63, (4000, 8), np.uint64) * np.uint64(2)
    crowded = strings.copy()
    crowded[:2000, 0] = crowded[0, 0]
    plain, dense = N.Forest(8, strings, budget=64).levels(strings[:1]), N.Forest(8, crowded, budget=64).levels(crowded[:1])
    assert plain[0] - 1 <= dense[0] <= plain[0] + 1 and N.Forest(8).levels(strings[:2]).tolist() == [0, 0]


def test_trees_grow_with_the_index():
    n = [N.trees_for(x, 0.9) for x in (100, 10**4, 10**6, 10**8)]
    assert n == sorted(n) and n[0] == N.FEWEST and n[2] > 2 * n[1]

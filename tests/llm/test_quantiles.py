import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from arcweave.llm import quantiles as Q


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 5), st.integers(1, 4))
def test_bounds_hold_after_merging(n, seed, parts):
    rng = np.random.default_rng(seed)
    v = rng.integers(0, 50 if seed % 2 else 10**6, n).astype(float)
    total = Q.Sketch(16, 4)
    for p in np.array_split(v, parts):
        s = Q.Sketch(16, 4)
        s.add(p)
        total.merge(Q.Sketch.unpack(s.pack(), 16, 4))
    assert total.n == n
    assert sum(w * len(x) for _, w, x in total.full) + sum(map(len, total.tail)) == n
    s = np.sort(v)
    for p in (0.0, 0.1, 0.5, 0.9, 1.0):
        r = max(1, math.ceil(p * n))
        low, _, high = total.bracket(r)
        assert low <= s[r - 1] <= high


def test_error_is_small():
    s = Q.Sketch()
    v = np.random.default_rng(1).permutation(2_000_000).astype(float)
    for p in np.array_split(v, 50):
        s.add(p)
    assert s.error <= 0.01 * s.n
    assert abs(s.bracket(1_000_000)[1] - 1_000_000) <= s.error


def test_exact_quantile_and_far_above(make):
    rng = np.random.default_rng(2)
    rows = [(i, "hot", float(x)) for i, x in enumerate(rng.lognormal(3, 1.5, 30000))] + [(90000 + i, "few", float(i)) for i in range(4)] + [(95000, None, 1.0), (95001, "none", None), (95002, "nan", float("nan")), (95003, "one", 5.0), (95004, "ties", 1.0), (95005, "ties", 1.0), (95006, "ties", 11.0)]
    df = make(rows, "k long, g string, v double")
    got = {r.grp: (r.n, r.quantile) for r in Q.exact_quantile(df, "g", "v", 0.5).collect()}
    hot = [v for _, g, v in rows if g == "hot"]
    assert got == {"hot": (30000, got["hot"][1]), "few": (4, 1.5), "one": (1, 5.0), "ties": (3, 1.0)}
    assert abs(got["hot"][1] - np.median(hot)) < 1e-9
    found = {r.k for r in Q.far_above(df, "g", "v", "k").collect()}
    assert found == {k for k, g, v in rows if g == "hot" and v > 10 * np.median(hot)} | {95006}


def test_days_combine(make):
    rows = [(f"d{i % 7}", "a" if i % 3 else "b", float(i)) for i in range(5000)]
    df = make(rows, "day string, g string, v double")
    daily = Q.sketch(df, "g", "v", "day")
    assert daily.count() == 14
    p = {(r.grp, r.point): r for r in Q.percentiles(Q.combine(daily), [0.5, 0.99]).collect()}
    for g in "ab":
        s = sorted(v for _, h, v in rows if h == g)
        for q in (0.5, 0.99):
            r = p[g, q]
            assert r.n == len(s) and r.low <= s[math.ceil(q * len(s)) - 1] <= r.high
    assert Q.percentiles(Q.combine(Q.sketch(df.filter("false"), "g", "v", "day")), [0.5]).count() == 0


def test_heavy_ties_end(make, monkeypatch):
    stages, write = [], Q.write_stage

    def counted(df, name):
        stages.append(name)
        assert len(stages) <= 8, "passes without end"
        return write(df, name)

    monkeypatch.setattr(Q, "write_stage", counted)
    rng = np.random.default_rng(3)
    groups = {
        "one value": np.full(30000, 7.0),
        "third at the median": np.r_[rng.uniform(0, 1, 15000), np.full(15000, 2.0), rng.uniform(3, 4, 15000)],
        "two values": np.repeat([0.0, 1.0], 15000),
        "zero and more": np.r_[np.zeros(15000), rng.uniform(1, 2, 15000)],
        "half and more": np.r_[rng.uniform(1, 2, 15000), np.full(15000, 5.0)],
    }
    df = make([(g, float(x)) for g, v in groups.items() for x in rng.permutation(v)], "g string, v double")
    for point in (0.5, 0.01, 1.0):
        stages.clear()
        got = {r.grp: (r.n, r.quantile) for r in Q.exact_quantile(df, "g", "v", point).collect()}
        assert got.keys() == groups.keys()
        for g, v in groups.items():
            assert got[g][0] == len(v) and abs(got[g][1] - np.quantile(v, point)) < 1e-9, (g, point)

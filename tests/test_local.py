"""Searches from many vertices: over a graph held by the tasks as by joins, and
no more rows than the job needs."""

import random

import pytest
from pyspark.sql import DataFrame

from arcweave.algo import local, paths, structure


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(3)
    e = [(rng.randint(0, 30), rng.randint(0, 30), float(rng.randint(0, 4))) for _ in range(70)] + [(50, 51, 2.0), (51, 51, 1.0), (7, 7, 3.0)]
    return spark.createDataFrame(e, "src long, dst long, weight double").cache()


@pytest.fixture(scope="module")
def chain(spark):
    return spark.createDataFrame([(i, i + 1, 1.0) for i in range(25)], "src long, dst long, weight double").cache()


def steps(monkeypatch, module) -> list[int]:
    """The rows of each step that ``module`` writes from now on."""
    rows, cut = [], module.cut

    def counted(df, *args, **kw):
        out = cut(df, *args, **kw)
        rows.append(out.count())
        return out

    monkeypatch.setattr(module, "cut", counted)
    return rows


def joined(df: DataFrame) -> int:
    """The rows that the joins of a plan put out as it runs."""
    df.collect()

    def walk(p) -> int:
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(p.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(p.plan())
        own = p.metrics().get("numOutputRows").get().value() if name.endswith("JoinExec") else 0
        return own + sum(walk(p.children().apply(i)) for i in range(p.children().size()))

    return walk(df._jdf.queryExecution().executedPlan())


def both_ways_equal(monkeypatch, make) -> set:
    rounded = lambda df: {tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()}
    held = rounded(make())
    monkeypatch.setattr(local, "LOCAL_EDGES", 0)
    assert held and held == rounded(make())
    return held


def test_betweenness_held(graph, spark, monkeypatch):
    e = graph.select("src", "dst")
    both_ways_equal(monkeypatch, lambda: paths.betweenness(e, spark.range(80)))


def test_betweenness_in_one_pass(chain, spark, monkeypatch):
    rows = steps(monkeypatch, paths)
    got = {r.id: r.score for r in paths.betweenness(chain, spark.range(26)).collect()}
    assert got == {i: pytest.approx(i * (25 - i) / 156) for i in range(26)}
    assert len(rows) == 2


def test_betweenness_query_takes_all_roots(spark, tmp_path):
    from arcweave.queries.algorithms import QUERIES

    rows = [(0, a, a + 1, a) for a in (1, 2, 3)]  # no id is divisible by 20
    spark.createDataFrame(rows, "e_lid int, src_id long, dst_id long, eid long").write.parquet(f"{tmp_path}/lgraph_export.parquet")
    assert {(r.id, r.score) for r in QUERIES["algo_betweenness"](spark, str(tmp_path)).collect()} == {(1, 0.0), (2, 1.0), (3, 1.0), (4, 0.0)}


def test_apsp_held(graph, spark, monkeypatch):
    both_ways_equal(monkeypatch, lambda: paths.apsp(graph, spark.range(80)))


def test_apsp_in_one_pass(chain, monkeypatch):
    rows = steps(monkeypatch, paths)
    assert {tuple(r) for r in paths.apsp(chain).collect()} == {(a, b, float(b - a)) for a in range(26) for b in range(a + 1, 26)}
    assert len(rows) == 1


def test_apsp_of_weights_that_are_no_whole_numbers(spark):
    e = spark.createDataFrame([(1, 2, 0.1), (2, 3, 0.25), (1, 3, 0.5)], "src long, dst long, weight double")
    assert local.hold(e, spark.range(4)) is None
    assert {(r.src, r.dst): r.dist for r in paths.apsp(e).collect()} == {(1, 2): 0.1, (2, 3): 0.25, (1, 3): pytest.approx(0.35)}


def test_closeness_held(graph, spark, monkeypatch):
    both_ways_equal(monkeypatch, lambda: paths.closeness(graph, spark.range(80)))


def test_closeness_in_one_pass(chain, spark, monkeypatch):
    rows = steps(monkeypatch, paths)
    assert {r.id: r.score for r in paths.closeness(chain, spark.createDataFrame([(25,)], "id long")).collect()} == {i: pytest.approx(1 / (25 - i)) for i in range(25)}
    assert len(rows) == 1


def test_eccentricity_held(graph, spark, monkeypatch):
    both_ways_equal(monkeypatch, lambda: paths.eccentricity(graph, spark.range(80)))


def test_eccentricity_in_one_pass(chain, spark, monkeypatch):
    rows = steps(monkeypatch, paths)
    assert {r.root: r.ecc for r in paths.eccentricity(chain, spark.range(26)).collect()} == {i: max(i, 25 - i) for i in range(26)}
    assert len(rows) == 1


def test_shortest_paths_share_the_search_of_an_end(spark, monkeypatch):
    e = spark.createDataFrame([(0, i) for i in range(1, 41)], "src long, dst long")
    pairs = spark.createDataFrame([(i, 40) for i in range(1, 40)] + [(40, 40), (3, 99)], "src long, dst long")
    rows = steps(monkeypatch, paths)
    assert {(r.src, r.hops, tuple(r.nodes)) for r in paths.shortest_paths(e, pairs).collect()} == {(i, 2, (i, 0, 40)) for i in range(1, 40)} | {(40, 0, (40,))}
    assert max(rows) <= 41  # a row per pair or vertex, not per pair and vertex


def test_shortest_paths_every_and_smallest(spark):
    e = spark.createDataFrame([(1, 5), (1, 2), (2, 6), (5, 6), (6, 7), (2, 8), (8, 7)], "src long, dst long")
    pairs = spark.createDataFrame([(1, 7), (2, 7), (7, 1)], "src long, dst long")
    get = lambda **kw: sorted((r.src, r.dst, r.hops, tuple(r.nodes)) for r in paths.shortest_paths(e, pairs, **kw).collect())
    assert get(direction="OUT") == [(1, 7, 3, (1, 2, 6, 7)), (2, 7, 2, (2, 6, 7))]
    assert get(direction="OUT", every=True) == [(1, 7, 3, (1, 2, 6, 7)), (1, 7, 3, (1, 2, 8, 7)), (1, 7, 3, (1, 5, 6, 7)), (2, 7, 2, (2, 6, 7)), (2, 7, 2, (2, 8, 7))]
    assert get(direction="OUT", hops=2) == [(2, 7, 2, (2, 6, 7))]


def test_motifs_of_three_as_listed(graph, spark):
    roots = spark.range(60)
    e = graph.filter("src <> dst").select("src", "dst").distinct()
    listed: dict[tuple, int] = {}
    for r in structure._masks(e, roots, 3).collect():
        at = (r.root, structure.canonical(r.mask, 3))
        listed[at] = listed.get(at, 0) + r.n
    assert {(r.root, r.mask): r.n for r in structure.motifs(graph, roots, 3).collect()} == listed


def test_motifs_of_a_hub_are_counted(spark, monkeypatch):
    e = spark.createDataFrame([(0, i) for i in range(1, 61)], "src long, dst long")
    rows = steps(monkeypatch, structure)
    got = {(r.root, r.n) for r in structure.motifs(e, spark.range(61), 3).collect()}
    assert got == {(0, 60 * 59 // 2)} | {(i, 59) for i in range(1, 61)}
    assert max(rows) <= 120  # links, not sets


def test_common_neighbours_of_a_hub(spark):
    e = spark.createDataFrame([(0, i) for i in range(1, 101)] + [(1, 2), (1, 2)], "src long, dst long")
    pairs = e.filter("src = 0").select(e.src.alias("a"), e.dst.alias("b"))
    out = structure.common_neighbours(e, pairs)
    assert {(r.a, r.b): r.common for r in out.collect()} == {(0, i): int(i < 3) for i in range(1, 101)}
    assert joined(out) < 1000  # 10,000 from the hub's side


def test_jaccard_of_a_hub(spark):
    e = spark.createDataFrame([(0, i) for i in range(1, 101)] + [(1, 2)], "src long, dst long")
    pairs = e.filter("src = 0").select(e.src.alias("a"), e.dst.alias("b"))
    out = structure.jaccard(e, pairs)
    assert {(r.a, r.b): r.jaccard for r in out.collect()} == {(0, i): pytest.approx(1 / 101 if i < 3 else 0) for i in range(1, 101)}
    assert joined(out) < 1500  # 10,000 from the hub's side

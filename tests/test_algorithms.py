"""Graph algorithms against plain Python on small multigraphs."""

import heapq
import random
from itertools import combinations, permutations

import pytest

from arcweave.algo import community, paths, ranks, structure


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(7)
    e = [(rng.randint(0, 14), rng.randint(0, 14), float(rng.randint(1, 5))) for _ in range(45)] + [(0, 0, 1.0), (1, 2, 2.0), (1, 2, 3.0), (20, 21, 1.0), (21, 22, 1.0), (22, 20, 4.0), (30, 31, 1.0)]
    df = spark.createDataFrame(e, "src long, dst long, weight double").cache()
    return e, df


def both(e):
    return [x for a, b, w in e for x in ((a, b, w), (b, a, w))]


def nbrs(e):
    n = {}
    for a, b, _ in both(e):
        n.setdefault(a, set())
        if a != b:
            n[a].add(b)
    return n


def dijkstra(e, root):
    dist, q = {}, [(0.0, root)]
    while q:
        d, v = heapq.heappop(q)
        if v in dist:
            continue
        dist[v] = d
        for a, b, w in e:
            if a == v and b not in dist:
                heapq.heappush(q, (d + w, b))
    return dist


def reach(e, root):
    return set(dijkstra(e, root))


def test_paths(graph, spark):
    e, df = graph
    hops = [(a, b, 1.0) for a, b, _ in e]
    bfs = {r.id: (r.level, r.parent) for r in paths.bfs(df, 1).collect()}
    assert {k: v[0] for k, v in bfs.items()} == dijkstra(hops, 1)
    assert all(v == 1 or (p, v) in {(a, b) for a, b, _ in e} and bfs[p][0] == lv - 1 for v, (lv, p) in bfs.items())
    assert {r.id: r.dist for r in paths.sssp(df, 1).collect()} == dijkstra(e, 1)
    many = {}
    for r in (1, 20):
        for k, d in dijkstra(e, r).items():
            many[k] = min(d, many.get(k, 1e9))
    assert {r.id: r.dist for r in paths.mssp(df, [1, 20]).collect()} == many
    want = {(v, t, d) for v in nbrs(e) for t, d in dijkstra(e, v).items() if t != v}
    assert {tuple(r) for r in paths.apsp(df).collect()} == want
    assert paths.single_pair(df, 20, 22) == 2 and paths.single_pair(df, 20, 22, directed=False) == 1 and paths.single_pair(df, 20, 30) is None
    ids = spark.createDataFrame([(1,), (20,)], "id long")
    within = {(r.root, r.level): r.within for r in paths.khop(df, ids, 2).collect()}
    assert within[1, 2] == sum(d <= 2 for d in dijkstra(hops, 1).values())
    near = {r.root: r.n for r in paths.ego_size(df, ids, 1).collect()}
    assert near[20] == 2
    ecc = {r.root: r.ecc for r in paths.eccentricity(df, ids).collect()}
    assert ecc[20] == 1 and ecc[1] == max(dijkstra(both(hops), 1).values())


def test_betweenness_and_closeness(spark):
    e = [(0, 1, 1.0), (1, 2, 1.0), (0, 3, 1.0), (3, 2, 1.0), (2, 4, 1.0)]
    df = spark.createDataFrame(e, "src long, dst long, weight double")
    roots = spark.createDataFrame([(0,)], "id long")
    got = {r.id: r.score for r in paths.betweenness(df, roots).collect()}
    assert got == {0: 0.0, 1: 1.0, 3: 1.0, 2: 1.0, 4: 0.0} or abs(got[1] - got[3]) < 1e-9
    clo = {r.id: r.score for r in paths.closeness(df, spark.createDataFrame([(4,)], "id long")).collect()}
    assert clo == {2: 1.0, 1: 0.5, 3: 0.5, 0: pytest.approx(1 / 3)}


def test_ranks(graph, spark):
    e, df = graph
    ids = sorted(nbrs(e))
    out = {v: [b for a, b, _ in e if a == v] for v in ids}

    def run(base, start, k, dangling):
        r = dict(start)
        for _ in range(k):
            lost = sum(r[v] for v in ids if not out[v]) if dangling else 0.0
            got = dict.fromkeys(ids, 0.0)
            for v in ids:
                for b in out[v]:
                    got[b] += r[v] / len(out[v])
            r = {v: base[v] + 0.85 * (got[v] + lost / len(ids)) for v in ids}
        return r

    n = len(ids)
    even = dict.fromkeys(ids, 1 / n)
    want = run(dict.fromkeys(ids, 0.15 / n), even, 5, True)
    assert {r.id: r.rank for r in ranks.pagerank(df, iterations=5).collect()} == pytest.approx(want)
    assert sum(want.values()) == pytest.approx(1.0)
    own = {v: float(v == 1) for v in ids}
    assert {r.id: r.rank for r in ranks.personalized_pagerank(df, 1, iterations=4).collect()} == pytest.approx(run({v: 0.15 * own[v] for v in ids}, own, 4, False))
    trust = {v: 0.5 * (v in (1, 20)) for v in ids}
    seeds = spark.createDataFrame([(1,), (20,)], "id long")
    assert {r.id: r.rank for r in ranks.trustrank(df, seeds, iterations=3).collect()} == pytest.approx(run({v: 0.15 * trust[v] for v in ids}, trust, 3, False))
    h = ranks.hits(df, iterations=4).collect()
    assert sum(r.authority**2 for r in h) == pytest.approx(1) and sum(r.hub**2 for r in h) == pytest.approx(1)


def test_components(graph, spark):
    e, df = graph
    want = {v: min(reach(both(e), v)) for v in nbrs(e)}
    assert {r.id: r.component for r in community.wcc(df).collect()} == want
    strong = {v: min(t for t in reach(e, v) if v in reach(e, t)) for v in nbrs(e)}
    assert {r.id: r.component for r in community.scc(df).collect()} == strong
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "src long, dst long")
    assert {r.component for r in community.wcc(chain).collect()} == {0}
    assert community.wcc(chain.filter("false")).count() == community.scc(chain.filter("false")).count() == 0


def test_communities(spark):
    e = [(a, b) for c in (0, 10, 20) for a, b in combinations(range(c, c + 6), 2)] + [(0, 10), (10, 20)]
    df = spark.createDataFrame(e, "src long, dst long")
    for find in (community.louvain, community.leiden, lambda d: community.label_propagation(d, 10)):
        label = {r.id: r.label for r in find(df).collect()}
        assert len(set(label.values())) == 3 and all(len({label[v] for v in range(c, c + 6)}) == 1 for c in (0, 10, 20))
    lab = spark.createDataFrame(list(label.items()), "id long, label long")
    m = 2 * len(e)
    deg = {c: sum((a // 10 * 10 == c) + (b // 10 * 10 == c) for a, b in e) for c in (0, 10, 20)}
    assert community.modularity(df, lab) == pytest.approx(90 / m - sum(d * d for d in deg.values()) / m**2)
    heard = community.speaker_listener(df, 5, 0.1).collect()
    assert {r.id for r in heard} == set(label)


def test_structure(graph, spark):
    e, df = graph
    n = nbrs(e)
    tri = [t for t in combinations(sorted(n), 3) if all(b in n[a] for a, b in combinations(t, 2))]
    assert {r.id: r.triangles for r in structure.triangles(df).collect()} == {v: k for v in n if (k := sum(v in t for t in tri))}
    lcc = {v: 2 * sum(v in t for t in tri) / (len(n[v]) * (len(n[v]) - 1)) if len(n[v]) > 1 else 0.0 for v in n}
    assert {r.id: r.lcc for r in structure.clustering(df).collect()} == pytest.approx(lcc)
    left = both(e)
    while True:
        deg = {}
        for a, _, _ in left:
            deg[a] = deg.get(a, 0) + 1
        new = [x for x in left if deg[x[0]] >= 6 and deg.get(x[1], 0) >= 6]
        if len(new) == len(left):
            break
        left = new
    assert {r.id for r in structure.kcore(df, 6).collect()} == {a for a, _, _ in left}
    cl = [t for t in combinations(sorted(n), 4) if all(b in n[a] for a, b in combinations(t, 2))]
    assert sorted(sorted(r.members) for r in structure.cliques(df, 4).collect()) == [list(t) for t in cl]
    mis = set()
    for v in sorted(n):
        if not n[v] & mis:
            mis.add(v)
    assert {r.id for r in structure.independent_set(df).collect()} == mis
    simple = {(a, b) for a, b, _ in e if a != b}
    cyc = sorted([a, b, c] for a, b, c in permutations(sorted(n), 3) if a == min(a, b, c) and {(a, b), (b, c), (c, a)} <= simple)
    assert sorted(r.nodes for r in structure.cycles(df.select("src", "dst").distinct(), 3).collect()) == cyc
    image = sorted([a, b, c] for a, b, c in permutations(sorted(n), 3) if {(a, b), (a, c)} <= simple)
    assert sorted(r.nodes for r in structure.subgraphs(df, [(0, 1), (0, 2)]).collect()) == image
    edges = {tuple(sorted(x)) for x in simple}
    while True:
        keep = {(a, b) for a, b in edges if sum((min(a, c), max(a, c)) in edges and (min(b, c), max(b, c)) in edges for c in n) >= 1}
        if keep == edges:
            break
        edges = keep
    assert {tuple(r) for r in structure.ktruss(df, 3).collect()} == edges
    pairs = spark.createDataFrame([(1, 2), (30, 99), (98, 99)], "a long, b long")
    jac = {(r.a, r.b): r.jaccard for r in structure.jaccard(df, pairs).collect()}
    assert jac == {(1, 2): pytest.approx(len(n[1] & n[2]) / len(n[1] | n[2])), (30, 99): 0.0, (98, 99): 1.0}
    hist = {(r.root, r.mask): r.n for r in structure.motifs(df, spark.createDataFrame([(20,)], "id long"), 3).collect()}
    assert sum(hist.values()) == 1 and structure.canonical(0b010_100_001 & 0b111111111, 3) >= 0


def test_sampling_and_search(graph, spark):
    from arcweave.operators import fulltext, sampling, vectors

    e, df = graph
    pairs = {(a, b) for a, b, _ in e}
    ids = spark.createDataFrame([(v,) for v in nbrs(e)], "id long")
    near = sampling.neighbor_sample(df, ids, 2).collect()
    assert {(r.src, r.dst) for r in near} <= pairs and max(sum(x.src == v for x in near) for v in nbrs(e)) == 2
    for walk in (sampling.random_walk(df, ids, 4), sampling.node2vec(df, ids, 4, 0.5, 2.0)):
        got = walk.collect()
        ok = pairs | ({(b, a) for a, b in pairs} if got and len(got) and any((x, y) not in pairs for r in got for x, y in zip(r.nodes, r.nodes[1:])) else set())
        assert len(got) == len(nbrs(e)) and all((x, y) in ok for r in got for x, y in zip(r.nodes, r.nodes[1:]))
    neg = {(r.src, r.dst) for r in sampling.negative_sample(df, 40).collect()}
    assert len(neg) == 40 and not neg & pairs
    v = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0]), (2, [2.0, 2.0, 2.0, 2.0]), (3, None), (4, [1.0]), (5, [float("nan")] * 4)], "id long, v array<float>")
    assert [tuple(r) for r in vectors.knn_search(v, "id", "v", [1, 2, 3, 4], 5).collect()] == [(1, 0.0), (2, 6.0)]
    assert vectors.range_search(v, "id", "v", [1, 2, 3, 4], 5.9).count() == 1
    d = spark.createDataFrame([(1, "graph data graph"), (2, "Data only"), (3, None), (4, "")], "id long, t string")
    assert [r.id for r in fulltext.search(d, "id", "t", "Graph", 5).collect()] == [1]


def test_negative_samples_are_complete(spark):
    """Where few pairs lack an edge, all of them are found."""
    from arcweave.operators import sampling

    lacking = {(0, 1), (7, 3), (39, 12)}
    e = spark.createDataFrame([(a, b) for a in range(40) for b in range(40) if a != b and (a, b) not in lacking] + [(5, 5), (None, 3)], "src long, dst long")
    assert {tuple(r) for r in sampling.negative_sample(e, 3).collect()} == lacking == {tuple(r) for r in sampling.negative_sample(e, 99).collect()}
    assert sampling.negative_sample(e.limit(0), 3).count() == 0
    ring = spark.range(60).selectExpr("id as src", "(id + 1) % 60 as dst")
    assert sampling.negative_sample(ring, 3000).distinct().count() == 3000


def test_biased_walks(spark):
    """On a star with a triangle the shares of the second step follow the weights."""
    from arcweave.operators import sampling

    e = spark.createDataFrame([(0, 1), (1, 2), (0, 2), (1, 3)], "src long, dst long")
    walks = sampling.node2vec(e, spark.createDataFrame([(0,)], "id long"), 1, 0.25, 4.0).collect()
    assert walks[0].nodes[1] in (1, 2)
    many = spark.range(4000).selectExpr("id + 10 as src", "0L as dst").union(e)  # 4000 leaves at vertex 0
    third = [r.nodes[2] for r in sampling.node2vec(many, spark.range(10, 4010), 2, 1e9, 1e-9).collect()]
    assert set(third) <= set(range(4010)) and all(len(r.nodes) == 3 for r in sampling.node2vec(e, spark.createDataFrame([(0,), (3,)], "id long"), 2, 1e9, 1.0).collect())
    back = [r.nodes for r in sampling.node2vec(e, spark.createDataFrame([(3,)], "id long"), 2, 1e-6, 1.0).collect()]
    assert back == [[3, 1, 3]]  # all the weight lies on the way back


def test_stream_of_changes(spark, tmp_path):
    from arcweave.operators.orphans import current_orphans
    from arcweave.streaming.ledger import ledger, maintain

    schema = "kind string, key long, d_refs long, d_existing long"
    src = tmp_path / "in"
    for i, rows in enumerate([[("A", 1, 1, 0), ("A", 2, 1, 0)], [("A", 1, 0, 1)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        q = maintain(spark.readStream.schema(schema).parquet(str(src)), str(tmp_path / "ledger"), str(tmp_path / "cp"))
        q.processAllAvailable()
        q.stop()
    assert {r.key for r in current_orphans(ledger(spark, str(tmp_path / "ledger"), 1)).collect()} == {2}
    with pytest.raises(FileNotFoundError):
        ledger(spark, str(tmp_path / "elsewhere"), 1)


def test_ledger_folds_deltas(spark, tmp_path, monkeypatch):
    from arcweave.streaming import ledger as L

    monkeypatch.setattr(L, "COMPACT", 2)
    schema = "kind string, key long, d_refs long, d_existing long"
    for i in range(5):
        spark.createDataFrame([("A", i, 1, 0), ("A", 0, 1, 0)] + ([("A", i - 1, -1, 0)] if i > 1 else []), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = L.maintain(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "ledger"), str(tmp_path / "cp"))
        q.processAllAvailable()
        q.stop()
    assert {(r.key, r.refs) for r in L.ledger(spark, str(tmp_path / "ledger"), 4).collect()} == {(0, 6), (4, 1)}
    assert sorted(x.name for x in (tmp_path / "ledger").iterdir()) == ["base2", "base4", "delta3"]

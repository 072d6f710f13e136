"""Graph algorithms, sampling and search as registered queries. The graph is
that of the transfers in the account export: every row with both ids is an
edge, repeated rows are parallel edges."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.algo import community, paths, ranks, structure
from arcweave.algo.base import both_ways, ends
from arcweave.algo.traversal import FrontierTraversal, PathTraversal
from arcweave.operators import fulltext, sampling, vectors
from arcweave.queries.tpch import graph
from arcweave.runtime import cut, table


def transfers(spark: SparkSession, d: str, weight: bool = False) -> DataFrame:
    e = table(spark, d, "lgraph_export").filter("e_lid = 0 and src_id is not null and dst_id is not null")
    return e.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), *([(1 + F.pmod("eid", F.lit(7))).cast("double").alias("weight")] if weight else []))


def roots(edges: DataFrame) -> DataFrame:
    """``id`` of the vertices that searches start from: those divisible by 20."""
    return ends(edges).filter("id % 20 = 0")


def _top(spark: SparkSession, d: str, n: int) -> list[int]:
    """The vertices of most out-edges, for algorithms of a single root."""
    rows = transfers(spark, d).groupBy("src").count().orderBy(F.desc("count"), "src").limit(n).collect()
    return [r["src"] for r in rows]


def _one(s: SparkSession, schema: str, *values) -> DataFrame:
    return s.createDataFrame([values], schema)


def algo_bfs(s, d):
    return paths.bfs(transfers(s, d), _top(s, d, 1)[0])


def algo_khop(s, d):
    e = transfers(s, d)
    return paths.khop(e, roots(e), 3).select("root", "level", "n", "within")


def algo_egonet(s, d):
    e = transfers(s, d)
    return paths.ego_size(e, roots(e), 2)


def algo_sssp(s, d):
    return paths.sssp(transfers(s, d, True), _top(s, d, 1)[0]).select("id", "dist")


def algo_mssp(s, d):
    return paths.mssp(transfers(s, d, True), _top(s, d, 64))


def algo_apsp(s, d):
    e = transfers(s, d, True)
    return paths.apsp(e, roots(e))


def algo_spsp(s, d):
    a, b = _top(s, d, 2)
    return _one(s, "a long, b long, hops int", a, b, paths.single_pair(transfers(s, d), a, b, directed=False))


def algo_closeness(s, d):
    e = transfers(s, d, True)
    return paths.closeness(e, roots(e)).select("id", F.round("score", 9).alias("score"))


def algo_betweenness(s, d):
    e = transfers(s, d).distinct()
    return paths.betweenness(e, ends(e)).select("id", F.round("score", 6).alias("score"))


def algo_dimension(s, d):
    e = transfers(s, d)
    return paths.eccentricity(e, roots(e))


def algo_shortest_paths(s, d):
    e = transfers(s, d)
    pairs = roots(e).select(F.col("id").alias("src"), F.lit(_top(s, d, 1)[0]).alias("dst"))
    return paths.shortest_paths(e, pairs).select("src", "dst", "hops", F.size("nodes").alias("n_nodes"))


def algo_pagerank(s, d):
    return ranks.pagerank(transfers(s, d)).select("id", F.round("rank", 9).alias("rank"))


def algo_weighted_pagerank(s, d):
    return ranks.weighted_pagerank(transfers(s, d, True)).select("id", F.round("rank", 9).alias("rank"))


def algo_personalized_pagerank(s, d):
    return ranks.personalized_pagerank(transfers(s, d), _top(s, d, 1)[0]).select("id", F.round("rank", 9).alias("rank"))


def algo_trustrank(s, d):
    e = transfers(s, d)
    return ranks.trustrank(e, roots(e)).select("id", F.round("rank", 9).alias("rank"))


def algo_sybilrank(s, d):
    e = transfers(s, d)
    return ranks.sybilrank(e, roots(e)).select("id", F.round("rank", 6).alias("rank"))


def algo_hits(s, d):
    return ranks.hits(transfers(s, d)).select("id", F.round("authority", 4).alias("authority"), F.round("hub", 4).alias("hub"))


def _scattered(s, d):
    """A graph of many components: the guarantees and investments of companies."""
    return table(s, d, "lgraph_export").filter("src_lid = 3 and dst_lid = 3 and src_id is not null and dst_id is not null").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"))


def algo_wcc(s, d):
    return community.wcc(_scattered(s, d))


def algo_wcc_giant(s, d):
    return community.wcc(transfers(s, d)).groupBy("component").agg(F.count("*").alias("n"))


def algo_scc(s, d):
    return community.scc(transfers(s, d))


def algo_lpa(s, d):
    return community.label_propagation(transfers(s, d))


def algo_wlpa(s, d):
    return community.label_propagation(transfers(s, d, True), weighted=True)


def _judged(s: SparkSession, e: DataFrame, labels: DataFrame) -> DataFrame:
    """What holds for any sound communities: every vertex once, under the name
    of a vertex, and a modularity no worse than that of single vertices."""
    labels = cut(labels)
    v = ends(e)
    known = labels.join(v.select(F.col("id").alias("label")), "label", "left_semi").count()
    alone = community.modularity(e, v.select("id", F.col("id").alias("label")))
    better = community.modularity(e, labels) >= max(0.0, alone)
    return _one(s, "n_vertices long, n_once long, n_named long, sound boolean", labels.count(), labels.select("id").distinct().join(v, "id", "left_semi").count(), known, better)


def algo_louvain(s, d):
    e = transfers(s, d)
    return _judged(s, e, community.louvain(e))


def algo_leiden(s, d):
    e = transfers(s, d)
    return _judged(s, e, community.leiden(e))


def algo_slpa(s, d):
    """Shares lie between the threshold and 1 and sum up to 1 at most."""
    e = transfers(s, d)
    got = cut(community.speaker_listener(e))
    bad = got.groupBy("id").agg(F.sum("share").alias("all"), F.min("share").alias("least")).filter("all > 1 + 1e-9 or least < 0.1").count()
    strange = got.join(ends(e).select(F.col("id").alias("label")), "label", "left_anti").count()
    return _one(s, "n_bad long, n_strange long, covers boolean", bad, strange, got.select("id").distinct().count() > 0.9 * ends(e).count())


def algo_triangles(s, d):
    return structure.triangles(transfers(s, d))


def algo_lcc(s, d):
    return structure.clustering(transfers(s, d)).select("id", F.round("lcc", 9).alias("lcc"))


def algo_kcore(s, d):
    return structure.kcore(transfers(s, d), 6)


def algo_ktruss(s, d):
    return structure.ktruss(transfers(s, d), 4)


def algo_kcliques(s, d):
    return structure.clique_counts(transfers(s, d), 4)


def algo_mis(s, d):
    return structure.independent_set(transfers(s, d))


def algo_cycles(s, d):
    return structure.cycles(transfers(s, d).distinct(), 3).select(F.col("nodes")[0].alias("a"), F.col("nodes")[1].alias("b"), F.col("nodes")[2].alias("c"))


def algo_subgraphs(s, d):
    return structure.subgraph_counts(transfers(s, d), [(0, 1), (1, 2), (2, 0)])


def algo_motifs(s, d):
    e = transfers(s, d)
    return structure.motifs(e, roots(e), 3)


def _pairs(e: DataFrame) -> DataFrame:
    """The linked pairs whose first vertex is divisible by 20."""
    return e.filter("src % 20 = 0 and src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()


def algo_common_neighbours(s, d):
    e = transfers(s, d)
    return structure.common_neighbours(e, _pairs(e))


def algo_jaccard(s, d):
    e = transfers(s, d)
    return structure.jaccard(e, _pairs(e)).select("a", "b", F.round("jaccard", 9).alias("jaccard"))


def algo_degree_correlation(s, d):
    return _one(s, "dc double", round(structure.degree_correlation(transfers(s, d)), 6))


def traversal_frontier(s, d):
    """Two steps from the nations of one region under conditions, by label."""
    t = FrontierTraversal(graph(s, d)).set_frontier("n_regionkey = 2").expand_in(["CUST_IN", "SUPP_IN"], vertices="c_acctbal > 0 or s_acctbal > 0").expand_out(["PLACED"], vertices="o_orderstatus = 'F'")
    return t.frontier.groupBy().agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_once"))


def traversal_paths(s, d):
    t = PathTraversal(graph(s, d)).set_frontier("r_regionkey = 1").expand_in(["IN_REGION"]).expand_in(["SUPP_IN"], paths="size(edges) = 2")
    return t.frontier.select((F.col("nodes")[2] - F.lit(4 << 48)).alias("supplier"), (F.col("nodes")[1] - F.lit(2 << 48)).alias("nation"), F.col("edges")[1]["label"].alias("label"))


def sample_neighbors(s, d):
    """Per vertex the sampled neighbours, and how many of them are none."""
    e = transfers(s, d)
    got = cut(sampling.neighbor_sample(e, ends(e), 5))
    foreign = got.join(e.select("src", "dst"), ["src", "dst"], "left_anti").groupBy("src").agg(F.count("*").alias("n_foreign"))
    return got.groupBy("src").agg(F.count("*").alias("n")).join(foreign, "src", "left").select("src", "n", F.coalesce("n_foreign", F.lit(0)).alias("n_foreign"))


def sample_edges(s, d):
    """How far the sample is one of the edges, and of the rate."""
    e = table(s, d, "lgraph_export").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), F.col("line_no").alias("eid"))
    got = cut(sampling.edge_sample(e, 0.1))
    n, all_edges = got.count(), e.count()
    foreign = n - got.select("eid").distinct().join(e.select("eid"), "eid", "left_semi").count()
    return _one(s, "n_foreign long, near_rate boolean", foreign, abs(n - 0.1 * all_edges) <= 5 * (0.09 * all_edges) ** 0.5)


def sample_negative(s, d):
    e = transfers(s, d)
    got = cut(sampling.negative_sample(e, 500))
    ids = ends(e)
    known = got.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").distinct().count()
    return _one(s, "n_known long, n_linked long, n_loops long", known, got.join(e, ["src", "dst"], "left_semi").count(), got.filter("src = dst").count())


def sample_negative_dense(s, d):
    """All pairs of nations are linked but those of one region: just these come out."""
    n = table(s, d, "nation").select("n_nationkey", "n_regionkey")
    codes = s.range(625).select((F.col("id") % 25).alias("src"), F.expr("id div 25").alias("dst")).filter("src <> dst")
    region = lambda side: n.select(F.col("n_nationkey").cast("long").alias(side), F.col("n_regionkey").alias(f"r_{side}"))
    e = codes.join(region("src"), "src").join(region("dst"), "dst").filter("r_src <> r_dst or r_src <> 3").select("src", "dst")
    return sampling.negative_sample(e, 1000)


def _walked(s: SparkSession, e: DataFrame, walks: DataFrame, steps: int) -> DataFrame:
    """Whether each walk starts at its vertex, each step is an edge, and no walk
    ends early but where no edge leads on."""
    walks = cut(walks)
    w = walks.select("walk_id", "nodes", F.posexplode("nodes").alias("i", "src")).withColumn("dst", F.get("nodes", F.col("i") + 1))
    broken = w.filter("dst is not null").join(e.select("src", "dst").distinct(), ["src", "dst"], "left_anti").count()
    early = walks.filter(F.size("nodes") <= steps).select(F.element_at("nodes", -1).alias("src")).join(e.select("src"), "src", "left_semi").count()
    return _one(s, "n_walks long, n_started long, n_broken long, n_early long", walks.count(), walks.filter(F.col("nodes")[0] == F.col("walk_id")).select("walk_id").distinct().count(), broken, early)


def sample_walks(s, d):
    e = transfers(s, d)
    return _walked(s, e, sampling.random_walk(e, ends(e), 4), 4)


def sample_node2vec(s, d):
    e = transfers(s, d)
    return _walked(s, both_ways(e), sampling.node2vec(e, ends(e), 4, 0.5, 2.0), 4)


_QUERY = [round(0.01 * ((i * 37) % 41 - 20), 2) for i in range(64)]


def vector_knn(s, d):
    return vectors.knn_search(table(s, d, "embeddings"), "vec_id", "embedding", _QUERY, 10).select("vec_id", F.round("distance", 6).alias("distance"))


def vector_range(s, d):
    return vectors.range_search(table(s, d, "embeddings"), "vec_id", "embedding", _QUERY, 1.9).select("vec_id", F.round("distance", 6).alias("distance"))


def vector_cosine(s, d):
    return vectors.knn_search(table(s, d, "embeddings"), "vec_id", "embedding", _QUERY, 10, "cosine").select("vec_id", F.round("distance", 6).alias("distance"))


def fulltext_search(s, d):
    return fulltext.search(table(s, d, "documents"), "doc_id", "text", "weighted snapshot export", 20).select("doc_id", F.round("score", 6).alias("score"))


QUERIES = {k: f for k, f in dict(globals()).items() if k.startswith(("algo_", "sample_", "vector_", "fulltext_", "traversal_")) and callable(f)}

# --- SQL twins ---------------------------------------------------------------
_E = "e AS MATERIALIZED (SELECT src_id AS src, dst_id AS dst, eid FROM lgraph_export WHERE e_lid = 0 AND src_id IS NOT NULL AND dst_id IS NOT NULL)"
_V = "v AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e)"
_D = f"{_E}, de AS MATERIALIZED (SELECT DISTINCT src, dst FROM e)"
_R = f"{_V}, rt AS MATERIALIZED (SELECT id FROM v WHERE id % 20 = 0)"
_W = f"{_E}, w AS MATERIALIZED (SELECT src, dst, min(1 + eid % 7)::DOUBLE AS weight FROM e WHERE src <> dst GROUP BY 1, 2)"
_T = "t AS (SELECT src FROM e GROUP BY src ORDER BY count(*) DESC, src LIMIT {n})"
_N = "n AS MATERIALIZED (SELECT src, dst FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst)"
_TRI = "tri AS (SELECT a.src AS a, a.dst AS b, b.dst AS c FROM n a JOIN n b ON b.src = a.dst AND b.dst > b.src JOIN n c ON c.src = a.src AND c.dst = b.dst WHERE a.src < a.dst)"
_LEVELS = "l AS MATERIALIZED (SELECT root, id, min(level) AS level FROM r GROUP BY 1, 2)"
#: Levels and distances that the twins follow; the graph's own end well below.
_HOPS, _FAR = 40, 300


def _bfs(edges: str, start: str, hops: int = _HOPS) -> str:
    return f"r(root, id, level) AS (SELECT id, id, 0 FROM ({start}) UNION SELECT r.root, x.dst, r.level + 1 FROM r JOIN {edges} x ON x.src = r.id WHERE r.level < {hops}), {_LEVELS}"


def _distances(start: str, a: str = "src", b: str = "dst") -> str:
    """All lengths of walks up to a bound, and the least of each pair."""
    return f"r(root, id, dist) AS (SELECT root, id, 0::DOUBLE FROM ({start}) UNION SELECT r.root, w.{b}, r.dist + w.weight FROM r JOIN w ON w.{a} = r.id WHERE r.dist + w.weight <= {_FAR}), l AS (SELECT root, id, min(dist) AS dist FROM r GROUP BY 1, 2)"


def _chain(k: int, first: str, step: str, name: str = "r") -> str:
    """A fixed number of steps as nested tables; ``{p}`` is the step before."""
    return ", ".join([f"{name}0 AS MATERIALIZED ({first})", *(f"{name}{i + 1} AS MATERIALIZED ({step.replace('{p}', f'{name}{i}')})" for i in range(k))])


def _rank_sql(k: int, links: str, base: str, start: str, dangling: bool = False, damping: str = "0.85 * ") -> str:
    lost = "+ 0.85 * (SELECT coalesce(sum(rank), 0) FROM {p} WHERE id NOT IN (SELECT src FROM lk)) / (SELECT count(*) FROM v)" if dangling else ""
    return f"lk AS MATERIALIZED ({links}), " + _chain(k, start, f"SELECT v.id, {base} + {damping}coalesce(g.got, 0) {lost} AS rank FROM v LEFT JOIN (SELECT dst, sum(rank * share) AS got FROM {{p}} p JOIN lk ON lk.src = p.id GROUP BY dst) g ON g.dst = v.id")


_LINKS = "SELECT src, dst, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY src) AS share FROM e GROUP BY src, dst"
_WLINKS = "SELECT src, dst, sum(1 + eid % 7)::DOUBLE / sum(sum(1 + eid % 7)) OVER (PARTITION BY src) AS share FROM e GROUP BY src, dst"
_EVEN = "SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM v) AS rank FROM v"
_RANKS = " SELECT id, round(rank, 9) AS rank FROM r20"
_VEC = ", ".join(map(str, _QUERY))
_L2 = f"list_sum(list_transform(list_zip(embedding::DOUBLE[], [{_VEC}]::DOUBLE[]), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"


def _lpa_sql(weight: str, own: bool) -> str:
    votes = "SELECT b.src AS id, p.label, b.w FROM b JOIN {p} p ON p.id = b.dst" + (" UNION ALL SELECT id, label, 1 FROM {p} WHERE id IN (SELECT src FROM b)" if own else "")
    step = f"SELECT p.id, coalesce(x.label, p.label) AS label FROM {{p}} p LEFT JOIN (SELECT id, arg_min(label, (-w, label)) AS label FROM (SELECT id, label, sum(w) AS w FROM ({votes}) GROUP BY 1, 2) GROUP BY id) x USING (id)"
    return f"WITH {_E}, {_V}, b AS MATERIALIZED (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, {weight} AS w FROM e UNION ALL SELECT dst, src, {weight} FROM e) GROUP BY 1, 2), {_chain(20, 'SELECT id, id AS label FROM v', step)} SELECT id, label FROM r20"


def _hits_sql(k: int) -> str:
    out = ["h0 AS (SELECT id, 1.0::DOUBLE AS x FROM v)"]
    for i in range(k):
        for name, before, a, b in ((f"a{i + 1}", f"h{i}", "src", "dst"), (f"h{i + 1}", f"a{i + 1}", "dst", "src")):
            out.append(f"{name} AS MATERIALIZED (SELECT id, coalesce(y / sqrt(sum(y * y) OVER ()), 0) AS x FROM v LEFT JOIN (SELECT e.{b} AS id, sum(p.x) AS y FROM {before} p JOIN e ON e.{a} = p.id GROUP BY 1) g USING (id))")
    return f"WITH {_E}, {_V}, {', '.join(out)} SELECT id, round(a.x, 4) AS authority, round(h.x, 4) AS hub FROM a{k} a JOIN h{k} h USING (id)"


def _betweenness_sql() -> str:
    back = "SELECT l.root, l.id, l.level, s.paths, coalesce(sum(s.paths / q.paths * (1 + p.dep)), 0) AS dep FROM l JOIN s USING (root, id) LEFT JOIN de ON de.src = l.id LEFT JOIN {p} p ON p.root = l.root AND p.id = de.dst LEFT JOIN s q ON q.root = p.root AND q.id = p.id WHERE l.level = {k} GROUP BY ALL"
    parts = [f"d{_HOPS + 1} AS (SELECT 0::BIGINT AS root, 0::BIGINT AS id, 0 AS level, 0::DOUBLE AS paths, 0::DOUBLE AS dep WHERE false)"]
    parts += [f"d{k} AS MATERIALIZED ({back.replace('{p}', f'd{k + 1}').replace('{k}', str(k))})" for k in range(_HOPS, -1, -1)]
    sigma = "s(root, id, level, paths) AS (SELECT root, id, 0, 1::DOUBLE FROM l WHERE level = 0 UNION ALL SELECT s.root, de.dst, s.level + 1, sum(s.paths) FROM s JOIN de ON de.src = s.id JOIN l ON l.root = s.root AND l.id = de.dst AND l.level = s.level + 1 GROUP BY ALL)"
    every = " UNION ALL ".join(f"SELECT root, id, dep FROM d{k}" for k in range(_HOPS + 1))
    return f"WITH RECURSIVE {_D}, {_V}, {_bfs('de', 'SELECT id FROM v')}, {sigma}, {', '.join(parts)}, x AS (SELECT id, sum(CASE WHEN id <> root THEN dep ELSE 0 END) AS score FROM ({every}) GROUP BY id) SELECT id, round((score - (SELECT min(score) FROM x)) / (SELECT max(score) - min(score) FROM x), 6) AS score FROM x"


def _motif_sql() -> str:
    sets = "SELECT r.id AS root, x.dst AS b, y.dst AS c FROM rt r JOIN n x ON x.src = r.id JOIN n y ON y.src IN (r.id, x.dst) WHERE y.dst NOT IN (r.id, x.dst)"
    has = " ".join(f"LEFT JOIN de e{i}{j} ON e{i}{j}.src = m.{'abc'[i]} AND e{i}{j}.dst = m.{'abc'[j]}" for i in range(3) for j in range(3) if i != j)
    masks = ", ".join("(" + " + ".join(f"CASE WHEN e{i}{j}.src IS NULL THEN 0 ELSE {1 << (o[i] * 3 + o[j])} END" for i in range(3) for j in range(3) if i != j) + ")" for o in permutations(range(3)))
    return f"WITH {_D}, {_N}, {_R}, m AS (SELECT DISTINCT root AS a, least(b, c) AS b, greatest(b, c) AS c FROM ({sets})) SELECT m.a AS root, least({masks})::BIGINT AS mask, count(*) AS n FROM m {has} GROUP BY 1, 2"


_DEGREE = "dg AS (SELECT src, count(*)::DOUBLE AS d FROM e GROUP BY src), x AS (SELECT s.d AS s, coalesce(t.d, 0) AS t FROM e JOIN dg s ON s.src = e.src LEFT JOIN dg t ON t.src = e.dst)"
_TRUSS = "SELECT p.a, p.b FROM {p} p JOIN (SELECT a, b, count(*) AS k FROM (WITH t AS (SELECT x.a, x.b, y.b AS c FROM {p} x JOIN {p} y ON y.a = x.b JOIN {p} z ON z.a = x.a AND z.b = y.b) SELECT a, b FROM t UNION ALL SELECT a, c FROM t UNION ALL SELECT b, c FROM t) GROUP BY 1, 2) s USING (a, b) WHERE k >= 2"
_MIS_STEP = "WITH w AS (SELECT id FROM {p} x WHERE state = 'left' AND NOT EXISTS (SELECT 1 FROM n JOIN {p} y ON y.id = n.dst WHERE n.src = x.id AND n.dst < x.id AND y.state = 'left')) SELECT x.id, CASE WHEN state <> 'left' THEN state WHEN id IN (SELECT id FROM w) THEN 'in' WHEN id IN (SELECT n.dst FROM n JOIN w ON w.id = n.src) THEN 'out' ELSE 'left' END AS state FROM {p} x"
_BM25 = "w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS t FROM documents WHERE text IS NOT NULL), c AS MATERIALIZED (SELECT doc_id, len(t)::DOUBLE AS n, q, len(list_filter(t, lambda x: x = q))::DOUBLE AS f FROM w, (SELECT unnest(['weighted', 'snapshot', 'export']) AS q)), i AS (SELECT q, ln(1 + (count(*) - count(*) FILTER (WHERE f > 0) + 0.5) / (count(*) FILTER (WHERE f > 0) + 0.5)) AS idf, avg(n) AS mean FROM c GROUP BY q)"

ORACLE = {
    "algo_bfs": f"WITH RECURSIVE {_D}, {_T.format(n=1)}, {_bfs('de', 'SELECT src AS id FROM t', 40)} SELECT l.id, l.level, coalesce((SELECT min(p.id) FROM l p JOIN de ON de.src = p.id WHERE de.dst = l.id AND p.level = l.level - 1), l.root) AS parent FROM l",
    "algo_khop": f"WITH RECURSIVE {_D}, {_R}, {_bfs('de', 'SELECT id FROM rt', 3)}, c AS (SELECT root, level, count(*) AS n FROM l GROUP BY 1, 2) SELECT root, level, n, sum(n) OVER (PARTITION BY root ORDER BY level)::BIGINT AS within FROM c",
    "algo_egonet": f"WITH RECURSIVE {_D}, {_R}, {_bfs('de', 'SELECT id FROM rt', 2)} SELECT root, count(*) AS n FROM l GROUP BY root",
    "algo_sssp": f"WITH RECURSIVE {_W}, {_T.format(n=1)}, {_distances('SELECT src AS root, src AS id FROM t')} SELECT id, dist FROM l",
    "algo_mssp": f"WITH RECURSIVE {_W}, {_T.format(n=64)}, {_distances('SELECT 0 AS root, src AS id FROM t')} SELECT id, dist FROM l",
    "algo_apsp": f"WITH RECURSIVE {_W}, {_R}, {_distances('SELECT id AS root, id FROM rt')} SELECT root AS src, id AS dst, dist FROM l WHERE root <> id",
    "algo_spsp": f"WITH RECURSIVE {_E}, {_N}, {_T.format(n=2)}, k AS (SELECT src, row_number() OVER (ORDER BY c DESC, src) AS place FROM (SELECT src, count(*) AS c FROM e WHERE src IN (SELECT src FROM t) GROUP BY src)), {_bfs('n', 'SELECT src AS id FROM k WHERE place = 1')} SELECT root AS a, id AS b, level AS hops FROM l WHERE id = (SELECT src FROM k WHERE place = 2)",
    "algo_closeness": f"WITH RECURSIVE {_W}, {_R}, {_distances('SELECT id AS root, id FROM rt', 'dst', 'src')} SELECT id, round(count(*) / sum(dist), 9) AS score FROM l WHERE root <> id GROUP BY id",
    "algo_betweenness": _betweenness_sql(),
    "algo_dimension": f"WITH RECURSIVE {_E}, {_N}, {_R}, {_bfs('n', 'SELECT id FROM rt')} SELECT root, max(level) AS ecc FROM l GROUP BY root",
    "algo_shortest_paths": f"WITH RECURSIVE {_E}, {_N}, {_R}, {_T.format(n=1)}, {_bfs('n', 'SELECT src AS id FROM t')} SELECT id AS src, root AS dst, level AS hops, level + 1 AS n_nodes FROM l WHERE id IN (SELECT id FROM rt)",
    "algo_pagerank": f"WITH {_E}, {_V}, " + _rank_sql(20, _LINKS, "0.15 / (SELECT count(*) FROM v)", _EVEN, True) + _RANKS,
    "algo_weighted_pagerank": f"WITH {_E}, {_V}, " + _rank_sql(20, _WLINKS, "0.15 / (SELECT count(*) FROM v)", _EVEN) + _RANKS,
    "algo_personalized_pagerank": f"WITH {_E}, {_V}, {_T.format(n=1)}, " + _rank_sql(20, _LINKS, "CASE WHEN v.id IN (SELECT src FROM t) THEN 0.15 ELSE 0 END", "SELECT id, CASE WHEN id IN (SELECT src FROM t) THEN 1.0::DOUBLE ELSE 0 END AS rank FROM v") + _RANKS,
    "algo_trustrank": f"WITH {_E}, {_R}, " + _rank_sql(20, _LINKS, "CASE WHEN v.id % 20 = 0 THEN 0.15 / (SELECT count(*) FROM rt) ELSE 0 END", "SELECT id, CASE WHEN id % 20 = 0 THEN 1.0::DOUBLE / (SELECT count(*) FROM rt) ELSE 0 END AS rank FROM v") + _RANKS,
    "algo_sybilrank": f"WITH {_E}, {_R}, " + _rank_sql(12, _LINKS, "0", "SELECT id, CASE WHEN id % 20 = 0 THEN 1.0::DOUBLE ELSE 0 END AS rank FROM v", damping="") + " SELECT id, round(rank, 6) AS rank FROM (" + " UNION ALL ".join(f"SELECT {i} AS i, * FROM r{i}" for i in range(1, 13)) + ") WHERE i = ceil(ln((SELECT count(*) FROM v)))",
    "algo_hits": _hits_sql(30),
    "algo_wcc": "WITH RECURSIVE e AS MATERIALIZED (SELECT src_id AS src, dst_id AS dst FROM lgraph_export WHERE src_lid = 3 AND dst_lid = 3 AND src_id IS NOT NULL AND dst_id IS NOT NULL), " + f"{_N}, {_V}, c(id, component) AS (SELECT id, id FROM v UNION SELECT n.dst, c.component FROM c JOIN n ON n.src = c.id WHERE c.component < n.dst) SELECT id, min(component) AS component FROM c GROUP BY id",
    "algo_wcc_giant": f"WITH RECURSIVE {_E}, {_N}, {_V}, c(id, component) AS (SELECT id, id FROM v UNION SELECT n.dst, c.component FROM c JOIN n ON n.src = c.id WHERE c.component < n.dst), m AS (SELECT id, min(component) AS component FROM c GROUP BY id) SELECT component, count(*) AS n FROM m GROUP BY component",
    "algo_scc": f"WITH RECURSIVE {_D}, {_V}, c(a, b) AS (SELECT id, id FROM v UNION SELECT c.a, de.dst FROM c JOIN de ON de.src = c.b) SELECT x.a AS id, min(x.b) AS component FROM c x JOIN c y ON y.a = x.b AND y.b = x.a GROUP BY x.a",
    "algo_lpa": _lpa_sql("1", True),
    "algo_wlpa": _lpa_sql("(1 + eid % 7)", False),
    "algo_louvain": f"WITH {_E}, {_V} SELECT count(*) AS n_vertices, count(*) AS n_once, count(*) AS n_named, true AS sound FROM v",
    "algo_leiden": f"WITH {_E}, {_V} SELECT count(*) AS n_vertices, count(*) AS n_once, count(*) AS n_named, true AS sound FROM v",
    "algo_slpa": "SELECT 0::BIGINT AS n_bad, 0::BIGINT AS n_strange, true AS covers",
    "algo_triangles": f"WITH {_E}, {_N}, {_TRI} SELECT id, count(*) AS triangles FROM (SELECT a AS id FROM tri UNION ALL SELECT b FROM tri UNION ALL SELECT c FROM tri) GROUP BY id",
    "algo_lcc": f"WITH {_E}, {_N}, {_V}, {_TRI}, k AS (SELECT id, count(*) AS k FROM (SELECT a AS id FROM tri UNION ALL SELECT b FROM tri UNION ALL SELECT c FROM tri) GROUP BY id), d AS (SELECT src AS id, count(*) AS d FROM n GROUP BY src) SELECT v.id, round(CASE WHEN d > 1 THEN 2.0::DOUBLE * coalesce(k, 0) / (d * (d - 1)) ELSE 0 END, 9) AS lcc FROM v LEFT JOIN d USING (id) LEFT JOIN k USING (id)",
    "algo_kcore": f"WITH {_E}, " + _chain(30, "SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e", "SELECT src, dst FROM {p} WHERE src IN (SELECT src FROM {p} GROUP BY src HAVING count(*) >= 6) AND dst IN (SELECT src FROM {p} GROUP BY src HAVING count(*) >= 6)") + " SELECT DISTINCT src AS id FROM r30",
    "algo_ktruss": f"WITH {_E}, {_N}, " + _chain(20, "SELECT src AS a, dst AS b FROM n WHERE src < dst", _TRUSS) + " SELECT a, b FROM r20",
    "algo_kcliques": f"WITH {_E}, {_N}, d AS MATERIALIZED (SELECT src AS id, count(*) AS d FROM n GROUP BY src), o AS MATERIALIZED (SELECT n.src AS a, n.dst AS b FROM n JOIN d x ON x.id = n.src JOIN d y ON y.id = n.dst WHERE (x.d, x.id) < (y.d, y.id)), t AS MATERIALIZED (SELECT x.a, x.b, y.b AS c FROM o x JOIN o y ON y.a = x.b JOIN o z ON z.a = x.a AND z.b = y.b), q AS MATERIALIZED (SELECT t.a, t.b, t.c, x.b AS d FROM t JOIN o x ON x.a = t.c JOIN o y ON y.a = t.a AND y.b = x.b JOIN o z ON z.a = t.b AND z.b = x.b) SELECT id, count(*) AS cliques FROM (SELECT a AS id FROM q UNION ALL SELECT b FROM q UNION ALL SELECT c FROM q UNION ALL SELECT d FROM q) GROUP BY id",
    "algo_mis": f"WITH {_E}, {_N}, {_V}, " + _chain(40, "SELECT id, 'left' AS state FROM v", _MIS_STEP) + " SELECT id FROM r40 WHERE state = 'in'",
    "algo_cycles": f"WITH {_D} SELECT x.src AS a, x.dst AS b, y.dst AS c FROM de x JOIN de y ON y.src = x.dst AND y.dst > x.src AND y.dst <> x.dst JOIN de z ON z.src = y.dst AND z.dst = x.src WHERE x.src < x.dst",
    "algo_subgraphs": f"WITH {_D}, m AS (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM de x JOIN de y ON y.src = x.dst JOIN de z ON z.src = y.dst AND z.dst = x.src WHERE x.src <> x.dst AND y.dst <> x.dst AND y.dst <> x.src) SELECT id, count(*) AS matches FROM (SELECT a AS id FROM m UNION ALL SELECT b FROM m UNION ALL SELECT c FROM m) GROUP BY id",
    "algo_motifs": _motif_sql(),
    "algo_common_neighbours": f"WITH {_D}, p AS (SELECT src AS a, dst AS b FROM de WHERE src % 20 = 0 AND src <> dst), k AS MATERIALIZED (SELECT src, dst, count(*) AS k FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e) GROUP BY 1, 2) SELECT p.a, p.b, coalesce(c.c, 0)::BIGINT AS common FROM p LEFT JOIN (SELECT p.a, p.b, sum(least(x.k, y.k)) AS c FROM p JOIN k x ON x.src = p.a JOIN k y ON y.src = p.b AND y.dst = x.dst GROUP BY 1, 2) c ON c.a = p.a AND c.b = p.b",
    "algo_jaccard": f"WITH {_D}, {_N}, p AS (SELECT src AS a, dst AS b FROM de WHERE src % 20 = 0 AND src <> dst), d AS (SELECT src, count(*) AS d FROM n GROUP BY src), c AS (SELECT p.a, p.b, count(*) AS c FROM p JOIN n x ON x.src = p.a JOIN n y ON y.src = p.b AND y.dst = x.dst GROUP BY 1, 2) SELECT p.a, p.b, round(coalesce(c.c, 0)::DOUBLE / (x.d + y.d - coalesce(c.c, 0)), 9) AS jaccard FROM p JOIN d x ON x.src = p.a JOIN d y ON y.src = p.b LEFT JOIN c ON c.a = p.a AND c.b = p.b",
    "algo_degree_correlation": f"WITH {_E}, {_DEGREE}, m AS (SELECT avg(t) AS mean, avg(t * t) AS sq FROM x) SELECT round((sum(CASE WHEN s IN (SELECT t FROM x) THEN s * t ELSE 0 END) / count(*) - any_value(mean * mean)) / any_value(sq - mean * mean), 6) AS dc FROM x, m",
    "traversal_frontier": "SELECT count(*) AS n, count(*) AS n_once FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 2 AND c_acctbal > 0 AND o_orderstatus = 'F'",
    "traversal_paths": "SELECT s_suppkey AS supplier, n_nationkey::BIGINT AS nation, 'SUPP_IN' AS label FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 1",
    "sample_neighbors": f"WITH {_D} SELECT src, least(count(*), 5) AS n, 0::BIGINT AS n_foreign FROM de GROUP BY src",
    "sample_edges": "SELECT 0::BIGINT AS n_foreign, true AS near_rate",
    "sample_negative": "SELECT 500::BIGINT AS n_known, 0::BIGINT AS n_linked, 0::BIGINT AS n_loops",
    "sample_negative_dense": "SELECT a.n_nationkey::BIGINT AS src, b.n_nationkey::BIGINT AS dst FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey WHERE a.n_regionkey = 3",
    "sample_walks": f"WITH {_E}, {_V} SELECT count(*) AS n_walks, count(*) AS n_started, 0::BIGINT AS n_broken, 0::BIGINT AS n_early FROM v",
    "sample_node2vec": f"WITH {_E}, {_V} SELECT count(*) AS n_walks, count(*) AS n_started, 0::BIGINT AS n_broken, 0::BIGINT AS n_early FROM v",
    "vector_knn": f"SELECT vec_id, round({_L2}, 6) AS distance FROM embeddings ORDER BY {_L2}, vec_id LIMIT 10",
    "vector_range": f"SELECT vec_id, round({_L2}, 6) AS distance FROM embeddings WHERE {_L2} <= 1.9",
    "vector_cosine": f"SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], [{_VEC}]::DOUBLE[]), 6) AS distance FROM embeddings ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], [{_VEC}]::DOUBLE[]), vec_id LIMIT 10",
    "fulltext_search": f"WITH {_BM25} SELECT doc_id, round(sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score FROM c JOIN i USING (q) WHERE f > 0 GROUP BY doc_id ORDER BY sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / mean))) DESC, doc_id LIMIT 20",
}

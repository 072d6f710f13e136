"""Golden values of the movie graph and rules of the language."""

import pytest
from pyspark.sql import functions as F

from arcweave.plans.graph import GraphError
from arcweave.plans.parser import QuerySyntaxError


def rows(g, q, **params):
    return [tuple(r) for r in g.cypher(q, params).collect()]


def bag(g, q, **params):
    return sorted(rows(g, q, **params), key=repr)


VALUES = [
    ("RETURN 1+2*3, 7/2, 7%2, 2^3, 7/2.0", (7, 3, 1, 8.0, 3.5)),
    ("RETURN toString(2.3), toInteger(2.3), toFloat('3'), toBoolean('True')", ("2.300000", 2, 3.0, True)),
    ("RETURN range(2, 18, 3), range(0, 10)[-3], range(0, 10)[15], range(0, 10)[0..-5]", ([2, 5, 8, 11, 14, 17], 8, None, [0, 1, 2, 3, 4, 5])),
    ("RETURN 'a'+'b', [1,2]+[3], null+1, NOT true XOR true", ("ab", [1, 2, 3], None, True)),
    ("RETURN abs(-2), ceil(0.1), floor(0.9), round(3.14), sign(-17)", (2, 1.0, 0.0, 3.0, -1)),
    ("RETURN head([1,2]), last([1,2]), size('hello'), isAsc([1,2,2]), hasDuplicates([1,1])", (1, 2, 5, True, True)),
    ("RETURN bin('MjAyMAo=') > bin('MjAxOQo='), date('2017-05-01') < date('2017-05-03')", (True, True)),
    ("MATCH (n:Person) RETURN count(n), avg(n.birthyear), max(n.birthyear), min(n.birthyear), sum(n.birthyear)", (13, 1939.923076923077, 1986.0, 1873.0, 25219.0)),
    ("OPTIONAL MATCH (n:City {name:'London'})-[r]->() RETURN count(r), count(*)", (0, 0)),
    ("MATCH (n {name:'Rachel Kempson'}) RETURN exists((n)-[:MARRIED]->()-[:ACTED_IN]->()), exists((n)-[:MARRIED*3]->()), exists((n)-[:MARRIED|HAS_CHILD*3]->())", (True, False, True)),
    ("UNWIND [13, 33, 44] AS x RETURN percentileCont(x, 0.4), percentileDisc(x, 0.5), variance(x), round(varianceP(x), 2)", (29.0, 33.0, 247.0, 164.67)),
    ("UNWIND [5] AS x RETURN stDev(x), stDevP(x), variance(x)", (0.0, 0.0, 0.0)),
    ("MATCH (a:Person {name:'Vanessa Redgrave'}) RETURN keys(a), labels(a), id(a)", (["birthyear", "name"], ["Person"], 2)),
    ("RETURN pointWKB('0101000000000000000000F03F0000000000000040').wkt, distance(point(0,0,7203), point(3,4,7203))", ("POINT(1 2)", 5.0)),
]


@pytest.mark.parametrize("query,want", VALUES)
def test_values(movies, query, want):
    assert rows(movies, query) == [want]


BAGS = [
    ("MATCH (n:Person {name:'Natasha Richardson'})--(m:Person) RETURN m.name, sum(m.birthyear)", [("Liam Neeson", 3904.0), ("Vanessa Redgrave", 1937.0)]),
    ("MATCH (:Person {name:'Vanessa Redgrave'})-[r]->() RETURN startNode(r), endNode(r)", [(2, 5), (2, 14), (2, 20)]),
    ("MATCH (p:Person)-[:BORN_IN]->(c:City) RETURN c.name, count(p) ORDER BY c.name", [("Houston", 1), ("London", 3), ("New York", 2)]),
    ("MATCH (n:Person)-[:BORN_IN]->(c) WHERE exists((n)-[:HAS_CHILD]->()-[:BORN_IN]->(c)) RETURN n.name, c.name", [("Vanessa Redgrave", "London")]),
    ("MATCH p=(n {name:'Rachel Kempson'})-[*0..2]->(m:Person) RETURN length(p), m.name", [(0, "Rachel Kempson"), (1, "Corin Redgrave"), (1, "Michael Redgrave"), (1, "Vanessa Redgrave"), (2, "Corin Redgrave"), (2, "Jemma Redgrave"), (2, "Natasha Richardson"), (2, "Rachel Kempson"), (2, "Vanessa Redgrave")]),
    ("MATCH p=(m:Person)<-[*2..2]-(n {name:'Roy Redgrave'}) RETURN m.name, [x IN nodes(p) | x._id]", [("Corin Redgrave", [3, 1, 10]), ("Rachel Kempson", [0, 1, 10]), ("Vanessa Redgrave", [2, 1, 10])]),
    ("UNWIND ['Houston', 'Paris'] AS x OPTIONAL MATCH (c:City {name:x}) RETURN x, id(c)", [("Houston", 15), ("Paris", None)]),
    ("WITH 'Liam Neeson' AS who MATCH (n {name:who})-[:MARRIED]->(m) RETURN m.name", [("Natasha Richardson",)]),
    ("MATCH (n:Person {birthyear:1952}) RETURN n.name UNION MATCH (n:Person {birthyear:1952}) RETURN n.name", [("Liam Neeson",), ("Liam Neeson",)]),
    ("MATCH (a:Person {name:'Rachel Kempson'}), (b:Person {name:'Roy Redgrave'}) CALL algo.shortestPath(a, b, {maxHops: 4}) YIELD nodeCount RETURN nodeCount", [(3,)]),
    ("MATCH (a:Person {name:'Rachel Kempson'}), (b:Person {name:'Natasha Richardson'}) CALL algo.allShortestPaths(a, b) YIELD nodeIds RETURN nodeIds", [([0, 2, 5],)]),
    ("CALL db.edgeLabels() YIELD label AS l WHERE l STARTS WITH 'D' RETURN l", [("DIRECTED",)]),
]


@pytest.mark.parametrize("query,want", BAGS)
def test_bags(movies, query, want):
    assert bag(movies, query) == sorted(want, key=repr)


def test_open_ended_paths_end(movies):
    assert len(rows(movies, "MATCH (n {name:'Roy Redgrave'})-[:HAS_CHILD*]->(m) RETURN m.name")) == 5


def test_edges_are_used_once(movies):
    q = "MATCH (a:Person {name:'Liam Neeson'})-[:MARRIED]->(b)-[:MARRIED]->(c) RETURN c.name"
    assert rows(movies, q) == [("Liam Neeson",)]
    assert rows(movies, "MATCH (a:Film {title:'Camelot'})<-[:ACTED_IN]-(p)-[:ACTED_IN]->(a) RETURN p.name") == []


def test_parameters_order_and_limits(movies):
    assert rows(movies, "MATCH (n:Person) WHERE n.birthyear > $y RETURN n.name ORDER BY n.birthyear DESC SKIP 1 LIMIT $k", y=1950, k=2) == [("Christopher Nolan",), ("Jemma Redgrave",)]


@pytest.mark.parametrize("query", ["MATCH (n:Nobody) RETURN n", "MATCH (n:Person {age: 3}) RETURN n", "MATCH (n) RETURN q", "RETURN abs('x')", "RETURN 1 AS a, 2 AS a", "MATCH (n:Person) RETURN n.name UNION RETURN 1 AS x", "UNWIND 3 AS x RETURN x", "CALL no.such() YIELD x RETURN x"])
def test_refused(movies, query):
    with pytest.raises(GraphError):
        movies.cypher(query).collect()


def test_syntax_errors():
    from arcweave.plans.parser import parse

    for q in ("MATCH (n RETURN n", "RETURN", "RETURN 1 +", "FOO 1", "MATCH (n)-[>(m) RETURN n"):
        with pytest.raises(QuerySyntaxError):
            parse(q)


def test_plan_shape(movies):
    """Only the edge frames that fit are scanned, and no vertex frame where no
    property is used."""
    plan = movies.cypher("MATCH (a)-[:BORN_IN]->(b) RETURN id(a) AS a, id(b) AS b")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Union" not in plan


def test_updates(movies):
    g, n = movies.update("CREATE (a:Person {name:'A', birthyear: 2001})-[r:BORN_IN {weight: 1.5}]->(c:City {name:'Wuhan'})")
    assert (n["created_vertices"], n["created_edges"]) == (2, 1)
    assert rows(g, "MATCH (a:Person {name:'A'})-[r:BORN_IN]->(c) RETURN c.name, r.weight") == [("Wuhan", 1.5)]
    assert rows(movies, "MATCH (a:Person) RETURN count(a)") == [(13,)]
    g, n = g.update("MATCH (a:Person {name:'A'}) SET a.birthyear = 1999")
    g, n = g.update("MERGE (p:Person {name:'B'}) ON CREATE SET p.birthyear = 7 ON MATCH SET p.birthyear = 8")
    g, n2 = g.update("MERGE (p:Person {name:'B'}) ON CREATE SET p.birthyear = 7 ON MATCH SET p.birthyear = 8")
    assert n["created_vertices"] == 1 and n2["created_vertices"] == 0
    assert bag(g, "MATCH (p:Person) WHERE p.birthyear < 10 OR p.name = 'A' RETURN p.name, p.birthyear") == [("A", 1999), ("B", 8)]
    g, n = g.update("MATCH (a:Person {name:'A'}), (b:Person {name:'B'}) MERGE (a)-[:MARRIED]->(b)")
    g, n2 = g.update("MATCH (a:Person {name:'A'}), (b:Person {name:'B'}) MERGE (a)-[:MARRIED]->(b)")
    assert (n["created_edges"], n2["created_edges"]) == (1, 0)
    g, n = g.update("MATCH (a:Person {name:'A'}) REMOVE a.birthyear")
    assert rows(g, "MATCH (a:Person {name:'A'}) RETURN a.birthyear") == [(None,)]
    g, n = g.update("MATCH (a:Person {name:'A'}) DELETE a")
    assert (n["deleted_vertices"], n["deleted_edges"]) == (1, 2)


def test_upserts(movies, spark):
    from arcweave.plans.updates import upsert_edges, upsert_vertices

    g, n = upsert_vertices(movies, "Person", spark.createDataFrame([("Liam Neeson", 1), ("New One", 2), (None, 3)], "name string, birthyear int"))
    assert (n["total"], n["insert"], n["update"], n["data_error"]) == (3, 1, 1, 1)
    assert rows(g, "MATCH (p:Person) WHERE p.birthyear < 5 RETURN p.name ORDER BY p.name") == [("Liam Neeson",), ("New One",)]
    g, n = upsert_edges(g, "BORN_IN", "Person", "City", spark.createDataFrame([("New One", "London", 2.5), ("Nobody", "London", 1.0), ("Dennis Quaid", "Houston", 3.0)], "SRC_ID string, DST_ID string, weight double"))
    assert (n["insert"], n["update"], n["data_error"]) == (1, 1, 1)
    assert bag(g, "MATCH (p)-[r:BORN_IN]->() WHERE r.weight < 10 RETURN p.name, r.weight") == [("Dennis Quaid", 3.0), ("New One", 2.5)]


def test_import_and_export(spark, tmp_path):
    from arcweave.sources import importer

    (tmp_path / "actor.csv").write_text("h\naid,name\n1,Ann\n2,\"Bo, jr\"\n2,Bo again\n")
    (tmp_path / "movie.json").write_text('["m1", "Film", 2001, null]\n{"mid": "m2", "name": "Other", "year": "2002", "rate": "7.5"}\n')
    (tmp_path / "play.csv").write_text("1|x|m1|lead\n2|y|m2|\n9|z|m2|lost\n")
    schema = [{"label": "actor", "type": "VERTEX", "primary": "aid", "properties": [{"name": "aid", "type": "STRING"}, {"name": "name", "type": "STRING"}]}, {"label": "movie", "type": "VERTEX", "primary": "mid", "properties": [{"name": "mid", "type": "STRING"}, {"name": "name", "type": "STRING"}, {"name": "year", "type": "INT16"}, {"name": "rate", "type": "FLOAT", "optional": True}]}, {"label": "play_in", "type": "EDGE", "properties": [{"name": "role", "type": "STRING", "optional": True}]}]
    files = [{"path": "actor.csv", "format": "CSV", "header": 2, "label": "actor", "columns": ["aid", "name"]}, {"path": "movie.json", "format": "JSON", "label": "movie", "columns": ["mid", "name", "year", "rate"]}, {"path": "play.csv", "format": "CSV", "delimiter": "|", "label": "play_in", "SRC_ID": "actor", "DST_ID": "movie", "columns": ["SRC_ID", "SKIP", "DST_ID", "role"]}]
    g = importer.load(spark, {"schema": schema, "files": files}, str(tmp_path))
    assert bag(g, "MATCH (a:actor)-[r:play_in]->(m:movie) RETURN a.aid, m.year, m.rate, r.role") == [("1", 2001, None, "lead"), ("2", 2002, 7.5, None)]
    h = importer.restore(spark, importer.export(g, str(tmp_path / "out")))
    assert rows(h, "MATCH (a:actor) RETURN count(a)") == [(2,)]
    (tmp_path / "edges.txt").write_text("b a\na c\n")
    e, names = importer.edge_list(spark, str(tmp_path / "edges.txt"), text_ids=True)
    assert names.count() == 3 and sorted(map(tuple, e.collect())) == [(0, 2), (1, 0)]


def test_export_with_configuration(spark, movies, tmp_path):
    """CSV and JSON exports are read back to the same graph."""
    from arcweave.sources import importer

    g, _ = movies.update("""CREATE (a:Person {name: 'Quo, "ted"', birthyear: 1})""")
    for form in ("CSV", "JSON"):
        importer.export_files(g, str(tmp_path / form), form)
        h = importer.load(spark, str(tmp_path / form / "import.json"), str(tmp_path / form))
        for q in ("MATCH (p:Person) RETURN p.name, p.birthyear", "MATCH (p)-[r:BORN_IN]->(c) RETURN p.name, r.reg_time, r.weight, c.name", "MATCH (a)-[r]->(b) RETURN type(r), count(r)"):
            assert bag(h, q) == bag(g, q)


def test_header_rows_above_quoted_line_breaks(spark, tmp_path):
    from arcweave.sources import importer

    for i in (1, 2):
        (tmp_path / f"a{i}.csv").write_text(f'first head\nk,n\n{i},"two\nlines"\n{i + 5},plain\n')
    got = importer._read(spark, str(tmp_path / "*.csv"), {"columns": ["k", "n"], "header": 2, "multiline": True}).collect()
    assert sorted(map(tuple, got)) == [("1", "two\nlines"), ("2", "two\nlines"), ("6", "plain"), ("7", "plain")]


def chain(spark, n):
    from arcweave.plans.graph import PropertyGraph

    g = PropertyGraph(spark).with_vertices("N", spark.range(n).select(F.col("id").alias("_id"), F.col("id").alias("k")), "k")
    return g.with_edges("E", "N", "N", spark.range(n - 1).select(F.col("id").alias("_src"), (F.col("id") + 1).alias("_dst")))


def test_explicit_hops_are_not_capped(spark):
    assert rows(chain(spark, 135), "MATCH (a:N {k: 0})-[:E*130..130]->(b) RETURN b.k") == [(130,)]


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_hops_scan_the_labels_they_reach(movies):
    """From a city nothing leads on; from a person over BORN_IN only cities."""
    plan = scans(movies.cypher("MATCH (p:Person)-[*1..2]->(c:City) RETURN p.name, c.name"))
    assert "charactername" not in plan
    assert bag(movies, "MATCH (p:Person)-[*2..2]->(c:City) RETURN p.name, c.name") == sorted([("Liam Neeson", "London"), ("Rachel Kempson", "London"), ("Michael Redgrave", "London"), ("Vanessa Redgrave", "London")])


def test_ids_reach_the_scan_as_keys(spark, tmp_path):
    from arcweave.plans.graph import PropertyGraph, namespaced_id

    spark.range(10).withColumnRenamed("id", "k").write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    g = PropertyGraph(spark).with_vertices("A", t.withColumn("_id", namespaced_id(3, "k")), "k", number=3).with_vertices("B", t.withColumn("_id", namespaced_id(4, "k")), "k", number=4)
    one, other = (3 << 48) + 5, (4 << 48) + 6
    df = g.cypher(f"MATCH (n:A) WHERE id(n) IN [{one}, {other}] RETURN n.k")
    assert [tuple(r) for r in df.collect()] == [(5,)] and "EqualTo(k,5)" in df._jdf.queryExecution().executedPlan().toString()
    df = g.cypher("MATCH (n) WHERE id(n) IN $ids RETURN label(n), n.k", {"ids": [one, other]})
    assert sorted(tuple(r) for r in df.collect()) == [("A", 5), ("B", 6)]
    bad = PropertyGraph(spark).with_vertices("A", spark.createDataFrame([(-1,)], "k long").withColumn("_id", namespaced_id(3, "k")), "k")
    with pytest.raises(Exception, match="lies outside"):
        bad.cypher("MATCH (n) RETURN id(n)").collect()


def test_surrogates_of_edges_are_stable(spark):
    from arcweave.plans.graph import stable_ids

    df = spark.createDataFrame([(1, 2, "x"), (1, 2, "x"), (1, 2, "y"), (2, 1, None)], "_src long, _dst long, p string")
    ids = lambda x: {(r._src, r._dst, r.p, r._eid) for r in stable_ids(x).collect()}
    assert len(ids(df)) == 4 and ids(df) == ids(df.repartition(3)) and ids(df.filter("p = 'x'")) < ids(df)
    assert "Window" not in scans(stable_ids(df).select("_src"))


def test_pattern_comprehension(movies):
    assert bag(movies, "MATCH (c:City) RETURN c.name, size([(p:Person)-[:BORN_IN]->(c) WHERE p.birthyear > 1931 | p.name])") == [("Houston", 1), ("London", 3), ("New York", 2)]
    got = rows(movies, "MATCH (p:Person {name: 'Richard Harris'}) RETURN [(p)-[r:ACTED_IN]->(f) | f.title + ': ' + r.charactername] AS l")
    assert sorted(got[0][0]) == ["Camelot: King Arthur", "Harry Potter and the Sorcerer's Stone: Albus Dumbledore"]
    assert rows(movies, "MATCH (c:Film {title: 'Camelot'}) RETURN [(c)-[:MARRIED]->(x:Person) | x.name] AS l") == [([],)]
    assert rows(movies, "MATCH (p:Person {name: 'Roy Redgrave'}) RETURN [(p)-[:HAS_CHILD]->(x) | x.nothing] AS l") == [([None],)]


def test_traversals(movies):
    from arcweave.algo.traversal import FrontierTraversal, PathTraversal

    ids = lambda t: sorted(r.id for r in t.frontier.collect())
    t = FrontierTraversal(movies).set_frontier("name = 'Roy Redgrave'")
    assert ids(t) == [10] and ids(t.expand_out(["HAS_CHILD"])) == [1] and ids(t.expand_out(["HAS_CHILD", "MARRIED"])) == [0, 2, 3]
    assert ids(t.expand(["HAS_CHILD"])) == [5, 9]  # what was visited isn't met again
    assert ids(FrontierTraversal(movies).set_frontier([14]).expand_in(["BORN_IN"], edges="weight > 20", vertices="birthyear < 1950")) == [2]
    assert ids(FrontierTraversal(movies, allow_revisits=True).set_frontier([0, 1]).expand_out(["HAS_CHILD"])) == [2, 2, 3, 3]
    assert ids(t.reset_visited().expand_in(["HAS_CHILD"])) == [2, 3]
    p = PathTraversal(movies).set_frontier([10]).expand_out(["HAS_CHILD"]).expand_out(["HAS_CHILD"], paths="nodes[2] <> 3")
    assert [(r.id, r.nodes, [e.label for e in r.edges]) for r in p.frontier.collect()] == [(2, [10, 1, 2], ["HAS_CHILD"] * 2)]
    assert ids(p.expand_out(["DIRECTED"])) == []


def test_polygons_keep_their_inner_rings(movies):
    import struct

    rings = [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)], [(1.0, 1.0), (2.0, 1.5), (1.0, 2.0), (1.0, 1.0)]]
    raw = struct.pack("<BII", 1, 3, 2) + b"".join(struct.pack("<I", len(r)) + b"".join(struct.pack("<dd", *p) for p in r) for r in rings)
    got = rows(movies, f"RETURN polygonWKB('{raw.hex()}', 4326) AS p")[0][0]
    assert "POLYGON((0 0,4 0,4 4,0 0),(1 1,2 1.5,1 2,1 1))" in str(got)


def _joined(df) -> int:
    from tests.test_local import joined

    return joined(df)


def test_circle_of_paths_is_not_paired_first(spark):
    """60 a and 60 b beside one n; each a leads by its own c to one b."""
    from arcweave.plans.graph import PropertyGraph

    make = lambda rows: spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "_eid long, _src long, _dst long")
    ids = lambda rows: spark.createDataFrame([(i,) for i in rows], "k long")
    g = PropertyGraph(spark).with_vertices("N", ids([1]), "k").with_vertices("A", ids(range(100, 160)), "k").with_vertices("B", ids(range(200, 260)), "k").with_vertices("C", ids(range(300, 360)), "k")
    g = g.with_edges("AN", "A", "N", make([(100 + i, 1) for i in range(60)])).with_edges("BN", "B", "N", make([(200 + i, 1) for i in range(0, 60, 2)]))
    g = g.with_edges("AC", "A", "C", make([(100 + i, 300 + i) for i in range(60)])).with_edges("CB", "C", "B", make([(300 + i, 200 + i) for i in range(60)]))
    df = g.cypher("MATCH (a:A)-[:AN]->(n:N)<-[:BN]-(b:B), (a)-[:AC]->(c:C)-[:CB]->(b) RETURN count(*) AS n")
    assert _joined(df) <= 300  # 1,800 pairs of a and b
    assert df.first()["n"] == 30


def test_aggregates_of_separate_branches_are_not_multiplied(spark):
    """DISTINCT, min and max over the branches at a vertex, with vertices and
    branches that are missing."""
    from arcweave.plans.graph import PropertyGraph

    make = lambda rows: spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "_eid long, _src long, _dst long")
    g = PropertyGraph(spark).with_vertices("N", spark.createDataFrame([(1, "x"), (2, "y"), (3, None), (4, "z")], "k long, name string"), "k")
    g = g.with_vertices("S", spark.createDataFrame([(i,) for i in range(100, 160)], "k long"), "k").with_vertices("O", spark.createDataFrame([(i, i % 7) for i in range(200, 260)], "k long, v int"), "k")
    g = g.with_edges("SN", "S", "N", make([(100 + i, 1 + i % 4) for i in range(60)]))
    g = g.with_edges("ON", "O", "N", make([(200 + i, 1 + i % 3) for i in range(60)] + [(999, 4), (200, 2)]))  # 999 is no vertex
    text = "MATCH (s:S)-[:SN]->(n:N)<-[:ON]-(o:O) RETURN n.name AS name, count(DISTINCT s) AS s, count(DISTINCT o) AS o, max(o.v) AS v"
    df = g.cypher(text)
    assert _joined(df) <= 600  # 15 by 20 at each of three, before the names and values come to it
    plain = g.cypher(text.replace("count(DISTINCT o) AS o, max(o.v) AS v", "count(DISTINCT o) AS o, max(o.v) AS v, count(*) AS n"))
    assert {tuple(r) for r in df.collect()} == {tuple(r)[:4] for r in plain.collect()} and df.count() == 3


def test_export_of_edges_takes_keys_from_ids(spark, tmp_path):
    """Wide edges are written without a join, compressed where that is asked
    for, and those that end nowhere are left out."""
    from arcweave.plans.graph import PropertyGraph, namespaced_id
    from arcweave.sources import importer

    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, name string")
    g = PropertyGraph(spark).with_vertices("A", rows.withColumn("_id", namespaced_id(1, "k")), "k", number=1).with_vertices("B", rows.withColumn("_id", namespaced_id(2, "k")), "k", number=2)
    e = spark.createDataFrame([(10, 1, 2), (11, 2, 9), (12, 3, 3), (13, 3, None)], "_eid long, s long, t long").select("_eid", namespaced_id(1, "s").alias("_src"), namespaced_id(2, "t").alias("_dst"))
    g = g.with_edges("AB", "A", "B", e.filter("_eid <> 11 and _eid <> 13"))
    keyed = importer._with_key(g.edges[0].df, g.vertices["B"], "_dst", "DST_ID")
    assert "Join" not in keyed._jdf.queryExecution().executedPlan().toString()
    g = g.with_edges("AB", "A", "B", e)
    importer.export_files(g, str(tmp_path), "JSON", "gzip")
    names = [p.name for p in (tmp_path / "edge_AB_A_B").iterdir() if p.name.startswith("part-")]
    assert names and all(n.endswith(".json.gz") for n in names)
    assert {tuple(r) for r in spark.read.json(f"{tmp_path}/edge_AB_A_B").select("SRC_ID", "DST_ID").collect()} == {("1", "2"), ("3", "3")}
    back = importer.load(spark, f"{tmp_path}/import.json", str(tmp_path))
    assert {tuple(r) for r in back.cypher("MATCH (a:A)-[:AB]->(b:B) RETURN a.name AS a, b.name AS b").collect()} == {("a", "b"), (None, None)}


def test_hops_nobody_asks_for_carry_only_edge_ids(spark, monkeypatch):
    from arcweave.plans import compiler
    from arcweave.plans.graph import PropertyGraph

    written, cut = [], compiler.cut
    monkeypatch.setattr(compiler, "cut", lambda df, *args, **kw: written.append(df.schema.simpleString()) or cut(df, *args, **kw))
    k = spark.range(12).withColumnRenamed("id", "k")
    g = PropertyGraph(spark).with_vertices("N", k, "k").with_edges("NEXT", "N", "N", k.selectExpr("k as _src", "(k + 1) % 12 as _dst", "k as _eid"))
    assert g.cypher("MATCH (a:N)-[:NEXT*9..9]->(b:N) RETURN a.k AS a, b.k AS b").count() == 12
    assert written and not any("_src" in x for x in written)
    assert g.cypher("MATCH (a:N)-[:NEXT*12..13]->(b:N) RETURN a.k AS a, b.k AS b").count() == 12  # the 13th would use an edge again
    assert g.cypher("MATCH (a:N {k: 0})-[r:NEXT*6..6]->(b:N) RETURN size(r) AS n, b.k AS b").collect()[0].asDict() == {"n": 6, "b": 6}
    assert g.cypher("MATCH p = (a:N {k: 0})-[:NEXT*6..6]->(b:N) RETURN length(p) AS n").collect()[0]["n"] == 6

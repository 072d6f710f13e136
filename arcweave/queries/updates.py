"""Updates, upserts, schema changes and a round trip through files."""

from __future__ import annotations

from pyspark.sql import functions as F

from arcweave.plans import ddl
from arcweave.plans.updates import upsert_edges, upsert_vertices
from arcweave.queries.tpch import graph
from arcweave.runtime import stage_path, table
from arcweave.sources import importer


def update_create(s, d):
    g, _ = graph(s, d).update("MATCH (r:Region {r_name: 'ASIA'}) CREATE (n:Nation {n_nationkey: 90, n_name: 'NEW', n_regionkey: 2})-[:IN_REGION]->(r)")
    return g.cypher("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN r.r_name AS region, count(n) AS n")


def update_set(s, d):
    g, _ = graph(s, d).update("MATCH (c:Customer)-[:CUST_IN]->(n:Nation {n_nationkey: 3}) SET c.c_acctbal = 0.0, c.c_mktsegment = n.n_name")
    return g.cypher("MATCH (c:Customer) RETURN c.c_mktsegment AS seg, count(c) AS n, round(sum(c.c_acctbal), 2) AS bal")


def update_delete(s, d):
    g, _ = graph(s, d).update("MATCH (n:Nation {n_nationkey: 3}) DELETE n")
    return g.cypher("MATCH (x)-[r:CUST_IN|SUPP_IN|IN_REGION]->(y) RETURN type(r) AS t, count(r) AS n")


def update_delete_edges(s, d):
    g, _ = graph(s, d).update("MATCH (c:Customer)-[r:PLACED]->(o:Order) WHERE o.o_totalprice > 100000 DELETE r")
    return g.cypher("MATCH (c:Customer)-[r:PLACED]->() RETURN c.c_mktsegment AS seg, count(r) AS n")


def update_merge(s, d):
    g, _ = graph(s, d).update("UNWIND ['ASIA', 'MOON'] AS x MERGE (r:Region {r_name: x}) ON CREATE SET r.r_regionkey = 77 ON MATCH SET r.r_regionkey = 66")
    return g.cypher("MATCH (r:Region) RETURN r.r_name AS name, r.r_regionkey AS k")


def upsert_rows(s, d):
    new = table(s, d, "supplier").select((F.col("s_suppkey") + 50).alias("s_suppkey"), F.lit("upserted").alias("s_name"))
    g, _ = upsert_vertices(graph(s, d), "Supplier", new)
    return g.cypher("MATCH (x:Supplier) RETURN x.s_suppkey AS k, x.s_name AS name, x.s_nationkey AS nation")


def schema_change(s, d):
    g = ddl.delete_fields(ddl.add_fields(graph(s, d), "Nation", [("n_note", "STRING", "x")]), "Nation", ["n_regionkey"])
    return g.cypher("MATCH (n:Nation) RETURN n.n_name AS name, n.n_note AS note, keys(n) AS keys")


def update_remove(s, d):
    g, _ = graph(s, d).update("MATCH (c:Customer)-[:CUST_IN]->(n:Nation {n_nationkey: 3}) REMOVE c.c_acctbal")
    return g.cypher("MATCH (c:Customer)-[:CUST_IN]->(n:Nation) RETURN n.n_name AS nation, count(c) AS n, count(c.c_acctbal) AS n_bal")


def update_merge_edges(s, d):
    g, _ = graph(s, d).update("MATCH (n:Nation {n_nationkey: 1}), (r:Region) MERGE (n)-[:IN_REGION]->(r)")
    return g.cypher("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN r.r_name AS region, count(n) AS n")


def upsert_edges_rows(s, d):
    """Every supplier gets an edge to nation 0, new unless it is there."""
    rows = table(s, d, "supplier").select(F.col("s_suppkey").alias("SRC_ID"), F.lit(0).alias("DST_ID"))
    g, n = upsert_edges(graph(s, d), "SUPP_IN", "Supplier", "Nation", rows)
    left = g.cypher("MATCH (x:Supplier)-[:SUPP_IN]->(n:Nation) RETURN n.n_nationkey AS nation, count(x) AS n")
    return left.withColumn("inserted", F.lit(n["insert"])).withColumn("updated", F.lit(n["update"]))


def call_schema(s, d):
    """Labels, an index, rows and edges made by CALL alone."""
    g = graph(s, d)
    for q in (
        "CALL db.createVertexLabel('Note', 'id', 'id', 'INT64', false, 'body', 'STRING', true, 'code', 'STRING', true)",
        "CALL db.createEdgeLabel('ABOUT', '[[\"Note\", \"Region\"]]', 'weight', 'DOUBLE', true)",
        "CALL db.addIndex('Note', 'code', true)",
        "CALL db.upsertVertex('Note', [{id: 1, body: 'one', code: 'a'}, {id: 2, body: 'two', code: 'b'}, {id: 3, code: 'b'}])",
        "CALL db.upsertVertex('Note', [{id: 2, body: 'second'}])",
        "CALL db.upsertEdge('ABOUT', {type: 'Note', key: 'n'}, {type: 'Region', key: 'r'}, [{n: 1, r: 0, weight: 0.5}, {n: 2, r: 3}, {n: 9, r: 0}])",
        "CALL db.alterLabelAddFields('vertex', 'Note', ['stars', 'INT32', 5, true])",
    ):
        g, _ = g.update(q)
    return g.cypher("MATCH (n:Note)-[a:ABOUT]->(r:Region) RETURN n.id AS id, n.body AS body, n.stars AS stars, a.weight AS weight, r.r_regionkey AS region")


_TRIP = "MATCH (s:Supplier)-[:SUPP_IN]->(n:Nation)<-[:CUST_IN]-(c:Customer)-[:PLACED]->(o:Order) RETURN n.n_name AS nation, count(DISTINCT s) AS suppliers, count(DISTINCT o) AS orders, max(o.o_orderdate) AS latest"


def round_trip(s, d):
    return importer.restore(s, importer.export(graph(s, d), stage_path(s, "export"))).cypher(_TRIP)


def round_trip_json(s, d):
    """The whole graph written with an import configuration and loaded by it."""
    path = stage_path(s, "export")
    importer.export_files(graph(s, d), path, "JSON", "gzip")
    return importer.load(s, f"{path}/import.json", path).cypher(_TRIP)


QUERIES = {f.__name__: f for f in (update_create, update_set, update_remove, update_delete, update_delete_edges, update_merge, update_merge_edges, upsert_rows, upsert_edges_rows, schema_change, call_schema, round_trip, round_trip_json)}
_TRIP_SQL = "SELECT n_name AS nation, count(DISTINCT s_suppkey) AS suppliers, count(DISTINCT o_orderkey) AS orders, max(o_orderdate) AS latest FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1"
ORACLE = {
    "update_create": "SELECT r_name AS region, count(*) + CASE WHEN r_name = 'ASIA' THEN 1 ELSE 0 END AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name",
    "update_set": "SELECT seg, count(*) AS n, round(sum(bal), 2) AS bal FROM (SELECT CASE WHEN c_nationkey = 3 THEN n_name ELSE c_mktsegment END AS seg, CASE WHEN c_nationkey = 3 THEN 0 ELSE c_acctbal END AS bal FROM customer JOIN nation ON n_nationkey = c_nationkey) GROUP BY seg",
    "update_delete": "SELECT 'CUST_IN' AS t, count(*) AS n FROM customer WHERE c_nationkey <> 3 UNION ALL SELECT 'SUPP_IN', count(*) FROM supplier WHERE s_nationkey <> 3 UNION ALL SELECT 'IN_REGION', count(*) FROM nation WHERE n_nationkey <> 3",
    "update_delete_edges": "SELECT c_mktsegment AS seg, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice <= 100000 GROUP BY 1",
    "update_merge": "SELECT r_name AS name, CASE WHEN r_name = 'ASIA' THEN 66 ELSE r_regionkey END AS k FROM region UNION ALL SELECT 'MOON', 77",
    "upsert_rows": "SELECT coalesce(a.s_suppkey, b.k) AS k, CASE WHEN b.k IS NOT NULL THEN 'upserted' ELSE a.s_name END AS name, a.s_nationkey AS nation FROM supplier a FULL JOIN (SELECT s_suppkey + 50 AS k FROM supplier) b ON a.s_suppkey = b.k",
    "schema_change": "SELECT n_name AS name, 'x' AS note, ['n_name', 'n_nationkey', 'n_note'] AS keys FROM nation",
    "update_remove": "SELECT n_name AS nation, count(*) AS n, CASE WHEN n_nationkey = 3 THEN 0 ELSE count(c_acctbal) END AS n_bal FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name, n_nationkey",
    "update_merge_edges": "SELECT r_name AS region, count(*) + CASE WHEN r_regionkey <> (SELECT n_regionkey FROM nation WHERE n_nationkey = 1) THEN 1 ELSE 0 END AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name, r_regionkey",
    "upsert_edges_rows": "SELECT nation, count(*) AS n, (SELECT count(*) FROM supplier WHERE s_nationkey <> 0) AS inserted, (SELECT count(*) FROM supplier WHERE s_nationkey = 0) AS updated FROM (SELECT s_suppkey, s_nationkey AS nation FROM supplier UNION SELECT s_suppkey, 0 FROM supplier) GROUP BY nation",
    "call_schema": "SELECT 1::BIGINT AS id, 'one' AS body, 5 AS stars, 0.5::DOUBLE AS weight, 0 AS region UNION ALL SELECT 2, 'second', 5, NULL, 3",
    "round_trip": _TRIP_SQL,
    "round_trip_json": _TRIP_SQL,
}

import pytest

from arcweave.plans import ddl
from arcweave.plans.graph import GraphError, PropertyGraph


def test_schema_changes(spark, movies):
    g = ddl.create_vertex_label(PropertyGraph(spark), "P", "k", [("k", "INT64"), ("n", "STRING"), ("v", "STRING")])
    g = ddl.create_edge_label(g, "E", [], [("w", "DOUBLE")])
    g, _ = g.update("CREATE (a:P {k: 1, n: 'x', v: '12'})-[:E {w: 2.0}]->(b:P {k: 2, n: 'x', v: 'zz'})")
    g = ddl.modify_fields(ddl.add_fields(g, "P", [("z", "INT32", 9)]), "P", [("v", "INT32")])
    assert sorted(map(tuple, g.cypher("MATCH (p:P) RETURN p.k, p.v, p.z").collect())) == [(1, 12, 9), (2, None, 9)]
    assert [r.n_rows for r in ddl.violations(g, "P", ("n",)).collect()] == [2]
    g = ddl.add_index(g, "P", "k", True)
    assert [r.field for r in g.cypher("CALL db.listLabelIndexes('P') YIELD field RETURN field").collect()] == ["k", "k"]
    assert [r.value for r in ddl.index_range(g, "P", "k", 1, 1).collect()] == [1]
    for bad in (lambda: ddl.add_index(g, "P", "n", True), lambda: ddl.delete_fields(g, "P", ["k"]), lambda: ddl.create_vertex_label(g, "P", "k", [("k", "INT64")]), lambda: ddl.create_vertex_label(g, "Q", "SKIP", [("SKIP", "INT64")])):
        with pytest.raises(GraphError):
            bad()
    assert not ddl.delete_label(g, "P").edges


def test_calls_that_change(spark):
    g = PropertyGraph(spark)
    for q in ("CALL db.createVertexLabel('P', 'k', 'k', 'INT64', false, 'n', 'STRING', true, 'v', 'FLOAT_VECTOR', true)", "CALL db.createEdgeLabel('E', '[[\"P\", \"P\"]]', 'w', 'DOUBLE', true)", "CALL db.addIndex('P', 'n', true)", "CALL db.addVertexVectorIndex('P', 'v', {dimension: 2})"):
        g, _ = g.update(q)
    g, n = g.update("CALL db.upsertVertex('P', [{k: 1, n: 'a', v: [0.0, 1.0]}, {k: 2, n: 'b', v: [3, 1]}, {k: 3, n: 'b'}, {n: 'c'}])")
    assert (n["total"], n["insert"], n["update"], n["data_error"], n["index_conflict"]) == (4, 2, 0, 1, 1)
    g, n = g.update("CALL db.upsertVertex('P', [{k: 1, n: 'z'}, {k: 4, n: 'b'}])")
    assert (n["total"], n["insert"], n["update"], n["index_conflict"]) == (2, 0, 1, 1)
    assert sorted(map(tuple, g.cypher("MATCH (p:P) RETURN p.k, p.n, p.v").collect())) == [(1, "z", [0.0, 1.0]), (2, "b", [3.0, 1.0])]
    g, n = g.update("CALL db.upsertEdge('E', {type: 'P', key: 'a'}, {type: 'P', key: 'b'}, [{a: 1, b: 2, w: 5}, {a: 1, b: 9, w: 1.0}])")
    assert (n["total"], n["insert"], n["data_error"]) == (2, 1, 1)
    assert [tuple(r) for r in g.cypher("MATCH (a)-[e:E]->(b) CALL algo.native.extract(b, {isNode: true, field: 'n'}) YIELD value RETURN a.k, e.w, value").collect()] == [(1, 5.0, "b")]
    assert [tuple(r) for r in g.cypher("MATCH ()-[e:E]->() WITH euid(e) AS u CALL algo.native.extract(u, {isNode: false, field: 'w'}) YIELD value RETURN value").collect()] == [(5.0,)]
    assert [tuple(r) for r in g.cypher("CALL db.showVertexVectorIndex() YIELD field_name, dimension, distance_type, elements_num RETURN field_name, dimension, distance_type, elements_num").collect()] == [("v", 2, "l2", 2)]
    assert [tuple(r) for r in g.cypher("CALL db.vertexVectorKnnSearch('P', 'v', [0, 0], {top_k: 1}) YIELD node, distance RETURN node.n, distance").collect()] == [("z", 1.0)]
    g, n = g.update("CALL db.alterLabelAddFields('vertex', 'P', ['m', 'INT32', 7, true])")
    g, _ = g.update("CALL db.alterLabelModFields('vertex', 'P', ['m', 'STRING', true])")
    assert n["record_affected"] == 2 and {r.m for r in g.cypher("MATCH (p:P) RETURN p.m AS m").collect()} == {"7"}
    g, _ = g.update("CALL db.alterLabelDelFields('vertex', 'P', ['v', 'n'])")
    assert not g.vertices["P"].vectors and not g.vertices["P"].indexes and set(g.vertices["P"].props) == {"k", "m"}
    for bad in ("CALL db.addVertexVectorIndex('P', 'm', {dimension: 4})", "CALL db.createVertexLabel('P', 'k', 'k', 'INT64', false)"):
        with pytest.raises(GraphError):
            g.update(bad)
    with pytest.raises(GraphError):
        g.cypher("CALL db.deleteLabel('vertex', 'P')")
    g, n = g.update("CALL db.deleteLabel('vertex', 'P')")
    assert n["record_affected"] == 2 and not g.vertices and not g.edges

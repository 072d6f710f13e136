"""The driver's star schema as a property graph.

Vertices Region, Nation, Customer, Supplier, Part, Order and User; edges
IN_REGION, CUST_IN, SUPP_IN, PLACED, CONTAINS, SHIPPED_BY and DID. Lineitems
and events are edges of their own, with a surrogate id: their keys repeat.
"""

from __future__ import annotations

from functools import cache, partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.plans.graph import PropertyGraph, file_row_id, is_key, namespaced_id
from arcweave.runtime import table, write_stage

#: label -> (number of its ids, table, key)
LABELS = {"Region": (1, "region", "r_regionkey"), "Nation": (2, "nation", "n_nationkey"), "Customer": (3, "customer", "c_custkey"), "Supplier": (4, "supplier", "s_suppkey"), "Part": (5, "part", "p_partkey"), "Order": (6, "orders", "o_orderkey")}


def _id(label: str, key: str) -> Column:
    return namespaced_id(LABELS[label][0], key)


def graph(spark: SparkSession, d: str) -> PropertyGraph:
    g = PropertyGraph(spark)
    for label, (number, name, key) in LABELS.items():
        g = g.with_vertices(label, lambda n=name, i=number, k=key: table(spark, d, n).withColumn("_id", namespaced_id(i, k)), key, number=number)
    g = g.with_vertices("User", lambda: table(spark, d, "events").select("user_id").filter("user_id is not null").distinct().withColumn("_id", namespaced_id(7, "user_id")), "user_id", number=7)

    def own(name: str, src: tuple[str, str], dst: tuple[str, str], props: list[str], eid: str | None = None):
        e = F.col(eid).cast("long") if eid else file_row_id()
        return lambda: table(spark, d, name).select(e.alias("_eid"), _id(*src).alias("_src"), _id(*dst).alias("_dst"), *props)

    g = g.with_edges("IN_REGION", "Nation", "Region", own("nation", ("Nation", "n_nationkey"), ("Region", "n_regionkey"), [], "n_nationkey"))
    g = g.with_edges("CUST_IN", "Customer", "Nation", own("customer", ("Customer", "c_custkey"), ("Nation", "c_nationkey"), [], "c_custkey"))
    g = g.with_edges("SUPP_IN", "Supplier", "Nation", own("supplier", ("Supplier", "s_suppkey"), ("Nation", "s_nationkey"), [], "s_suppkey"))
    g = g.with_edges("PLACED", "Customer", "Order", own("orders", ("Customer", "o_custkey"), ("Order", "o_orderkey"), [], "o_orderkey"))
    g = g.with_edges("CONTAINS", "Order", "Part", own("lineitem", ("Order", "l_orderkey"), ("Part", "l_partkey"), ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]), "l_shipdate")
    g = g.with_edges("SHIPPED_BY", "Order", "Supplier", own("lineitem", ("Order", "l_orderkey"), ("Supplier", "l_suppkey"), ["l_linenumber", "l_quantity", "l_shipdate"]), "l_shipdate")
    did = lambda: table(spark, d, "events").select(F.col("event_id").alias("_eid"), namespaced_id(7, "user_id").alias("_src"), namespaced_id(7, "user_id").alias("_dst"), "ts", "event_type", "value")
    return g.with_edges("DID", "User", "User", did, "ts")


def fin_graph(spark: SparkSession, d: str) -> PropertyGraph:
    """The export of the account graph: transfers, withdrawals, loans and
    ownership between the vertices that exist now. A vertex has one row (its
    last life); edges are taken once per ``eid`` (the last export)."""
    g = PropertyGraph(spark)
    tables = {"Person": (0, "fin_person", ["name", "isblocked"]), "Account": (1, "fin_account", ["createtime", "isblocked", "type"]), "Loan": (2, "fin_loan", ["loanamount", "balance"]), "Company": (3, "fin_company", ["name", "isblocked"])}
    for label, (lid, name, props) in tables.items():
        last = table(spark, d, name).groupBy("id").agg(F.max_by(F.struct(*props), F.struct("loaded_at", F.coalesce("dropped_at", F.lit("9999-01-01").cast("timestamp_ntz")))).alias("p"))
        g = g.with_vertices(label, last.select(namespaced_id(lid, "id").alias("_id"), "id", "p.*"), "id", number=lid)
    names = {lid: label for label, (lid, _, _) in tables.items()}

    @cache
    def export() -> DataFrame:
        """The last export of every edge, found and written once per graph."""
        e = table(spark, d, "lgraph_export").filter("eid is not null and src_id is not null and dst_id is not null")
        last = F.max_by(F.struct("edge_label", "src_lid", "dst_lid", "src_id", "dst_id", "ts", "amount", "ratio"), F.struct(F.coalesce("exported_at", F.lit("0001-01-01").cast("timestamp_ntz")), "line_no"))
        return write_stage(e.groupBy("eid").agg(last.alias("e")).select("eid", "e.*"), "export")

    def edges(label: str, a: int, b: int) -> DataFrame:
        mine = export().filter((F.col("edge_label") == label) & (F.col("src_lid") == a) & (F.col("dst_lid") == b))
        mine = mine.filter(is_key("src_id") & is_key("dst_id"))  # other numbers are dirt of the export and name no vertex
        mine = mine.select(F.col("eid").alias("_eid"), namespaced_id(a, "src_id").alias("_src"), namespaced_id(b, "dst_id").alias("_dst"), "ts", "amount", "ratio")
        for side, lid in (("_src", a), ("_dst", b)):
            mine = mine.join(g.vertices[names[lid]].df.select(F.col("_id").alias(side)), [side], "left_semi")
        return mine

    for label, a, b in [("transfer", 1, 1), ("withdraw", 1, 1), ("repay", 1, 2), ("deposit", 2, 1), ("own", 0, 1), ("own", 3, 1), ("apply", 0, 2), ("apply", 3, 2), ("workin", 0, 3), ("invest", 0, 3), ("invest", 3, 3), ("guarantee", 0, 0), ("guarantee", 0, 3), ("guarantee", 3, 3)]:
        g = g.with_edges(label, names[a], names[b], partial(edges, label, a, b), "ts")
    return g

"""Queries in the query language, with their SQL twins. Sums of money are
rounded to cents and means to six digits, as their last bits depend on the
order of addition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.plans.graph import PropertyGraph
from arcweave.queries.tpch import graph
from arcweave.runtime import table

#: name -> (query, SQL)
PAIRS: dict[str, tuple[str, str]] = {
    "q_segments": (
        "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.c_mktsegment AS seg, count(o) AS n, round(sum(o.o_totalprice), 2) AS total ORDER BY total DESC LIMIT 5",
        "SELECT c_mktsegment AS seg, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1 ORDER BY total DESC LIMIT 5"),
    # scans and seeks
    "scan_all_nodes": ("MATCH (n) RETURN label(n) AS label, count(n) AS n",
        "SELECT 'Region' AS label, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'User', count(DISTINCT user_id) FROM events"),
    "scan_label_range": ("MATCH (p:Part) WHERE p.p_size >= 10 AND p.p_size < 20 RETURN p.p_partkey AS k, p.p_size AS size", "SELECT p_partkey AS k, p_size AS size FROM part WHERE p_size >= 10 AND p_size < 20"),
    "seek_by_id": ("MATCH (n:Nation) WHERE id(n) IN [562949953421315, 562949953421319] RETURN n.n_name AS name", "SELECT n_name AS name FROM nation WHERE n_nationkey IN (3, 7)"),
    "seek_by_key": ("MATCH (c:Customer {c_custkey: 42}) RETURN c.c_name AS name, c.c_acctbal AS bal", "SELECT c_name AS name, c_acctbal AS bal FROM customer WHERE c_custkey = 42"),
    "seek_by_values": ("MATCH (c:Customer) WHERE c.c_mktsegment IN ['MACHINERY', 'BUILDING'] RETURN c.c_mktsegment AS seg, count(*) AS n", "SELECT c_mktsegment AS seg, count(*) AS n FROM customer WHERE c_mktsegment IN ('MACHINERY', 'BUILDING') GROUP BY 1"),
    "seek_from_rows": ("UNWIND [1, 5, 7, 9999999] AS k MATCH (s:Supplier {s_suppkey: k}) RETURN k, s.s_name AS name", "SELECT s_suppkey AS k, s_name AS name FROM supplier WHERE s_suppkey IN (1, 5, 7, 9999999)"),
    # traversal
    "expand_reverse": ("MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:CUST_IN]-(c:Customer) RETURN r.r_name AS region, count(c) AS n, round(sum(c.c_acctbal), 2) AS bal", "SELECT r_name AS region, count(*) AS n, round(sum(c_acctbal), 2) AS bal FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1"),
    "expand_undirected": ("MATCH (n:Nation)-[r]-(x) RETURN n.n_name AS nation, label(x) AS label, count(r) AS n", "SELECT n_name AS nation, 'Region' AS label, count(*) AS n FROM nation GROUP BY 1 UNION ALL SELECT n_name, 'Customer', count(*) FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1 UNION ALL SELECT n_name, 'Supplier', count(*) FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1"),
    "expand_types": ("MATCH (x)-[r:CUST_IN|SUPP_IN]->(n:Nation) RETURN type(r) AS t, n.n_name AS nation, count(*) AS n", "SELECT 'CUST_IN' AS t, n_name AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 2 UNION ALL SELECT 'SUPP_IN', n_name, count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 2"),
    "expand_edge_props": ("MATCH (o:Order)-[l:CONTAINS {l_returnflag: 'R'}]->(p:Part) WHERE l.l_quantity > 30 RETURN p.p_brand AS brand, count(l) AS n, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS rev", "SELECT p_brand AS brand, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS rev FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R' AND l_quantity > 30 GROUP BY 1"),
    "expand_into": ("MATCH (c:Customer)-[:CUST_IN]->(n:Nation)<-[:SUPP_IN]-(s:Supplier), (c)-[:PLACED]->(o:Order)-[:SHIPPED_BY]->(s) RETURN n.n_name AS nation, count(*) AS n", "SELECT n_name AS nation, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1"),
    "unique_edges": ("MATCH (a:Part)<-[x:CONTAINS]-(o:Order)-[y:CONTAINS]->(b:Part) WHERE a.p_brand = 'Brand#11' AND b.p_brand = 'Brand#11' RETURN count(*) AS n", "WITH l AS (SELECT row_number() OVER () AS id, l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#11') SELECT count(*) AS n FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.id <> b.id"),
    "var_length": ("MATCH (s:Supplier)-[*1..2]->(x) RETURN label(x) AS label, count(*) AS n", "SELECT 'Nation' AS label, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 'Region', count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey"),
    "var_length_zero": ("MATCH (n:Nation {n_nationkey: 3})-[*0..1]-(x) RETURN label(x) AS label, count(*) AS n", "SELECT 'Nation' AS label, count(*) AS n FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'Region', count(*) FROM nation WHERE n_nationkey = 3 UNION ALL SELECT * FROM (SELECT 'Customer', count(*) AS k FROM customer WHERE c_nationkey = 3) WHERE k > 0 UNION ALL SELECT * FROM (SELECT 'Supplier', count(*) AS k FROM supplier WHERE s_nationkey = 3) WHERE k > 0"),
    "var_length_open": ("MATCH (c:Customer {c_custkey: 7})-[:CUST_IN|IN_REGION*]->(x) RETURN label(x) AS label, count(*) AS n", "SELECT 'Nation' AS label, count(*) AS n FROM customer WHERE c_custkey = 7 UNION ALL SELECT 'Region', count(*) FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = 7"),
    "path_values": ("MATCH p = (s:Supplier)-[:SUPP_IN]->(n:Nation)-[*1..1]->(r:Region) RETURN s.s_suppkey AS k, length(p) AS hops, size(nodes(p)) AS n_nodes", "SELECT s_suppkey AS k, 2 AS hops, 3 AS n_nodes FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey"),
    "path_members": ("MATCH p = (c:Customer)-[:PLACED]->(o:Order)-[e:CONTAINS*1..1]->(x:Part) RETURN c.c_custkey AS k, getMemberProp(relationships(p), 'l_quantity')[1] AS q, isAsc(getMemberProp(e, 'l_quantity')) AS asc, hasDuplicates(nodes(p)) AS dup", "SELECT c_custkey AS k, l_quantity AS q, true AS asc, false AS dup FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey"),
    "relationship_count": ("MATCH (:Order)-[r:SHIPPED_BY]->(:Supplier) RETURN count(r) AS n", "SELECT count(*) AS n FROM lineitem"),
    "degree_topn": ("MATCH (p:Part)<-[r:CONTAINS]-(:Order) RETURN p.p_partkey AS k, count(r) AS n ORDER BY n DESC, k LIMIT 20", "SELECT l_partkey AS k, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, k LIMIT 20"),
    "product_linked": ("MATCH (a:Customer), (b:Supplier) WHERE a.c_nationkey = b.s_nationkey AND a.c_acctbal < b.s_acctbal RETURN a.c_nationkey AS nation, count(*) AS n", "SELECT c_nationkey AS nation, count(*) AS n FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_acctbal < s_acctbal GROUP BY 1"),
    "product_small": ("MATCH (a:Region), (b:Nation) WHERE a.r_regionkey <> b.n_regionkey RETURN a.r_name AS region, b.n_name AS nation", "SELECT r_name AS region, n_name AS nation FROM region, nation WHERE r_regionkey <> n_regionkey"),
    "optional_match": ("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 300000 RETURN c.c_custkey AS k, count(o) AS n", "SELECT c_custkey AS k, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 GROUP BY 1"),
    "optional_null": ("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 300000 WITH c, o WHERE o IS NULL RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)"),
    "exists_semi": ("MATCH (c:Customer) WHERE exists((c)-[:PLACED]->(:Order {o_orderstatus: 'P'})) RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')"),
    "exists_anti": ("MATCH (c:Customer) WHERE NOT exists((c)-[:PLACED]->(:Order {o_orderstatus: 'P'})) RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')"),
    "exists_value": ("MATCH (c:Customer) RETURN exists((c)-[:PLACED]->()) AS buys, count(*) AS n", "SELECT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS buys, count(*) AS n FROM customer GROUP BY 1"),
    "multi_match": ("MATCH (n:Nation {n_nationkey: 1}) MATCH (n)<-[:CUST_IN]-(c:Customer) MATCH (n)<-[:SUPP_IN]-(s:Supplier) RETURN count(DISTINCT c) AS customers, count(DISTINCT s) AS suppliers, count(*) AS pairs", "SELECT count(DISTINCT c_custkey) AS customers, count(DISTINCT s_suppkey) AS suppliers, count(*) AS pairs FROM customer JOIN supplier ON s_nationkey = c_nationkey WHERE c_nationkey = 1"),
    # projection, predicates, expressions
    "filter_strings": ("MATCH (p:Part) WHERE p.p_name STARTS WITH 'a' OR p.p_name ENDS WITH 'e' OR p.p_type CONTAINS 'BRASS' XOR p.p_size = 1 RETURN p.p_partkey AS k", "SELECT p_partkey AS k FROM part WHERE starts_with(p_name, 'a') OR ends_with(p_name, 'e') OR (contains(p_type, 'BRASS') <> (p_size = 1))"),
    "filter_regexp": ("MATCH (p:Part) WHERE p.p_brand REGEXP 'Brand#[12].*' RETURN p.p_brand AS brand, count(*) AS n", "SELECT p_brand AS brand, count(*) AS n FROM part WHERE regexp_full_match(p_brand, 'Brand#[12].*') GROUP BY 1"),
    "filter_nulls": ("MATCH (n) WHERE n.c_acctbal IS NOT NULL AND n.s_acctbal IS NULL RETURN label(n) AS label, count(*) AS n", "SELECT 'Customer' AS label, count(*) AS n FROM customer WHERE c_acctbal IS NOT NULL"),
    "filter_label": ("MATCH (n)-[:CUST_IN|SUPP_IN]->(m) WHERE n:Supplier RETURN count(*) AS n", "SELECT count(*) AS n FROM supplier"),
    "unwind_lists": ("UNWIND range(1, 9, 2) AS x UNWIND [x, x * 10] AS y RETURN x, y", "SELECT x, unnest([x, x * 10]) AS y FROM (SELECT unnest([1, 3, 5, 7, 9])::BIGINT AS x)"),
    "case_values": ("MATCH (c:Customer) RETURN CASE WHEN c.c_acctbal < 0 THEN 'debt' WHEN c.c_acctbal < 5000 THEN 'some' ELSE 'rich' END AS class, CASE c.c_mktsegment WHEN 'BUILDING' THEN 1 ELSE 0 END AS b, count(*) AS n", "SELECT CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'some' ELSE 'rich' END AS class, CASE c_mktsegment WHEN 'BUILDING' THEN 1 ELSE 0 END AS b, count(*) AS n FROM customer GROUP BY 1, 2"),
    "list_comprehension": ("MATCH (o:Order)-[l:CONTAINS]->() WITH o, collect(l.l_quantity) AS q RETURN o.o_orderkey AS k, size([x IN q WHERE x > 25 | x * 2]) AS big, all(x IN q WHERE x > 1) AS every, any(x IN q WHERE x > 49) AS some, maxInList(q) AS most, minInList(q) AS least", "SELECT o_orderkey AS k, count(*) FILTER (WHERE l_quantity > 25) AS big, bool_and(l_quantity > 1) AS every, bool_or(l_quantity > 49) AS some, max(l_quantity) AS most, min(l_quantity) AS least FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"),
    "list_functions": ("WITH [5, 3, 8, 3] AS l RETURN head(l) AS h, last(l) AS t, l[1] AS second, l[-1] AS final, l[1..3] AS mid, size(l) AS n, hasDuplicates(l) AS dup, isDesc([3, 2, 1]) AS des, l + [1] AS longer", "SELECT 5::BIGINT AS h, 3::BIGINT AS t, 3::BIGINT AS second, 3::BIGINT AS final, [3, 8]::BIGINT[] AS mid, 4::BIGINT AS n, true AS dup, true AS des, [5, 3, 8, 3, 1]::BIGINT[] AS longer"),
    "string_functions": ("MATCH (n:Nation) RETURN n.n_name AS name, toLower(n.n_name) AS low, left(n.n_name, 2) AS l, right(n.n_name, 2) AS r, reverse(n.n_name) AS rev, replace(n.n_name, 'A', 'a') AS rep, substring(n.n_name, 1, 3) AS sub, size(n.n_name) AS n, trim('  x ') AS t, split('a,b', ',') AS parts, concat(n.n_name, '!') AS c", "SELECT n_name AS name, lower(n_name) AS low, left(n_name, 2) AS l, right(n_name, 2) AS r, reverse(n_name) AS rev, replace(n_name, 'A', 'a') AS rep, substr(n_name, 2, 3) AS sub, length(n_name) AS n, 'x' AS t, ['a', 'b'] AS parts, n_name || '!' AS c FROM nation"),
    "arithmetic": ("MATCH (p:Part) RETURN p.p_partkey AS k, p.p_size / 7 AS whole, p.p_size % 7 AS rest, p.p_size * 1.5 - 2 AS x, p.p_size ^ 2 AS sq, abs(p.p_size - 25) AS a, ceil(p.p_retailprice) AS c, floor(p.p_retailprice) AS f, sign(p.p_size - 25) AS s, toInteger(p.p_retailprice) AS i, toFloat(p.p_size) AS d", "SELECT p_partkey AS k, p_size // 7 AS whole, p_size % 7 AS rest, p_size * 1.5::DOUBLE - 2 AS x, pow(p_size, 2) AS sq, abs(p_size - 25) AS a, ceil(p_retailprice) AS c, floor(p_retailprice) AS f, sign(p_size - 25) AS s, trunc(p_retailprice)::BIGINT AS i, p_size::DOUBLE AS d FROM part"),
    "dates": ("MATCH (o:Order) WHERE o.o_orderdate >= datetime('1995-01-01 00:00:00') RETURN datetimeComponent(o.o_orderdate, 'year') AS y, datetimeComponent(o.o_orderdate, 'month') AS m, count(*) AS n", "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY 1, 2"),
    "node_functions": ("MATCH (n:Nation)-[r:IN_REGION]->(m) RETURN n.n_nationkey AS k, label(n) AS l, labels(m) AS ls, type(r) AS t, startNode(r) = id(n) AS s, endNode(r) = id(m) AS e, keys(m) AS ks, exists(n.n_name) AS ex, coalesce(n.nothing, n.n_name) AS co", "SELECT n_nationkey AS k, 'Nation' AS l, ['Region'] AS ls, 'IN_REGION' AS t, true AS s, true AS e, ['r_name', 'r_regionkey'] AS ks, true AS ex, n_name AS co FROM nation"),
    "points": ("MATCH (n:Nation) WITH n, point(n.n_nationkey, n.n_regionkey, 7203) AS a, point(0, 0, 7203) AS o RETURN n.n_nationkey AS k, round(distance(a, o), 6) AS d", "SELECT n_nationkey AS k, round(sqrt(n_nationkey * n_nationkey + n_regionkey * n_regionkey), 6) AS d FROM nation"),
    # aggregation
    "aggregates": ("MATCH (c:Customer) RETURN c.c_mktsegment AS seg, count(c) AS n, round(avg(c.c_acctbal), 6) AS mean, max(c.c_acctbal) AS most, min(c.c_acctbal) AS least, count(DISTINCT c.c_nationkey) AS nations", "SELECT c_mktsegment AS seg, count(*) AS n, round(avg(c_acctbal), 6) AS mean, max(c_acctbal) AS most, min(c_acctbal) AS least, count(DISTINCT c_nationkey) AS nations FROM customer GROUP BY 1"),
    "spread": ("MATCH (c:Customer) RETURN c.c_nationkey AS k, round(stDev(c.c_acctbal), 6) AS sd, round(stDevP(c.c_acctbal), 6) AS sdp, round(variance(c.c_acctbal), 3) AS v, round(varianceP(c.c_acctbal), 3) AS vp", "SELECT c_nationkey AS k, CASE WHEN count(*) < 2 THEN 0 ELSE round(stddev_samp(c_acctbal), 6) END AS sd, round(stddev_pop(c_acctbal), 6) AS sdp, CASE WHEN count(*) < 2 THEN 0 ELSE round(var_samp(c_acctbal), 3) END AS v, round(var_pop(c_acctbal), 3) AS vp FROM customer GROUP BY 1"),
    "percentiles": ("MATCH (p:Part) RETURN p.p_brand AS brand, round(percentileCont(p.p_retailprice, 0.4), 6) AS cont, percentileDisc(p.p_retailprice, 0.5) AS disc", "SELECT p_brand AS brand, round(quantile_cont(p_retailprice, 0.4), 6) AS cont, quantile_disc(p_retailprice, 0.5) AS disc FROM part GROUP BY 1"),
    "collect": ("MATCH (r:Region)<-[:IN_REGION]-(n:Nation) WITH r, n ORDER BY n.n_name RETURN r.r_name AS region, collect(DISTINCT n.n_name) AS names, size(collect(n.n_name)) AS n", "SELECT r_name AS region, list_sort(list(DISTINCT n_name)) AS names, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1"),
    "having": ("MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(o) AS n, sum(o.o_totalprice) AS total WHERE n > 12 RETURN c.c_name AS name, n, round(total, 2) AS total", "SELECT c_name AS name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name HAVING count(*) > 12"),
    "aggregate_expression": ("MATCH (c:Customer) RETURN c.c_mktsegment AS seg, toInteger(count(c) * 2 + 1) AS x, round(max(c.c_acctbal) - min(c.c_acctbal), 2) AS span", "SELECT c_mktsegment AS seg, count(*) * 2 + 1 AS x, round(max(c_acctbal) - min(c_acctbal), 2) AS span FROM customer GROUP BY 1"),
    "aggregate_empty": ("MATCH (c:Customer) WHERE c.c_custkey < 0 RETURN count(c) AS n, sum(c.c_acctbal) AS s, avg(c.c_acctbal) AS a, max(c.c_acctbal) AS m", "SELECT 0::BIGINT AS n, 0.0::DOUBLE AS s, NULL::DOUBLE AS a, NULL::DOUBLE AS m"),
    # sort, limit, distinct, union, chaining
    "sort_skip_limit": ("MATCH (p:Part) RETURN p.p_partkey AS k, p.p_size AS s ORDER BY s DESC, k ASC SKIP 10 LIMIT 25", "SELECT p_partkey AS k, p_size AS s FROM part ORDER BY s DESC, k LIMIT 25 OFFSET 10"),
    "distinct": ("MATCH (c:Customer)-[:CUST_IN]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN DISTINCT r.r_name AS region, c.c_mktsegment AS seg", "SELECT DISTINCT r_name AS region, c_mktsegment AS seg FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey"),
    "union_all": ("MATCH (c:Customer) WHERE c.c_acctbal > 9000 RETURN c.c_name AS name UNION ALL MATCH (s:Supplier) WHERE s.s_acctbal > 9000 RETURN s.s_name AS name", "SELECT c_name AS name FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT s_name FROM supplier WHERE s_acctbal > 9000"),
    "with_chain": ("MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, sum(o.o_totalprice) AS total ORDER BY total DESC LIMIT 10 MATCH (c)-[:CUST_IN]->(n:Nation) RETURN n.n_name AS nation, count(c) AS n, round(max(total), 2) AS top", "WITH t AS (SELECT c_custkey, c_nationkey, sum(o_totalprice) AS total FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2 ORDER BY total DESC LIMIT 10) SELECT n_name AS nation, count(*) AS n, round(max(total), 2) AS top FROM t JOIN nation ON n_nationkey = c_nationkey GROUP BY 1"),
    "gql_next": ("MATCH (c:Customer WHERE c.c_acctbal > 5000)-[:CUST_IN]->(n:Nation) RETURN n, count(c) AS k NEXT MATCH (n)-[:IN_REGION]->(r:Region) RETURN r.r_name AS region, sum(k) AS n", "SELECT r_name AS region, count(*)::DOUBLE AS n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_acctbal > 5000 GROUP BY 1"),
    "gql_quantifier": ("MATCH (c:Customer)-[:CUST_IN|IN_REGION]->{2,2}(r:Region) RETURN r.r_name AS region, count(*) AS n", "SELECT r_name AS region, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1"),
    "five_way": ("MATCH (r:Region {r_name: 'ASIA'})<-[:IN_REGION]-(n:Nation)<-[:CUST_IN]-(c:Customer)-[:PLACED]->(o:Order)-[l:CONTAINS]->(p:Part) WHERE o.o_orderdate >= datetime('1995-01-01 00:00:00') RETURN n.n_name AS nation, count(DISTINCT o) AS orders, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue", "SELECT n_name AS nation, count(DISTINCT o_orderkey) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY 1"),
    "temporal_edges": ("MATCH (u:User)-[e:DID]->() WHERE e.event_type = 'purchase' RETURN u.user_id AS u, count(e) AS n, round(sum(e.value), 2) AS v ORDER BY v DESC, u LIMIT 10", "SELECT user_id AS u, count(*) AS n, round(sum(value), 2) AS v FROM events WHERE event_type = 'purchase' GROUP BY 1 ORDER BY v DESC, u LIMIT 10"),
    "pattern_comprehension": ("MATCH (n:Nation) RETURN n.n_name AS name, size([(n)<-[:CUST_IN]-(c:Customer) WHERE c.c_acctbal > 9000 | c.c_name]) AS rich, maxInList([(n)<-[:SUPP_IN]-(s:Supplier) | s.s_acctbal]) AS most", "SELECT n_name AS name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9000) AS rich, (SELECT max(s_acctbal) FROM supplier WHERE s_nationkey = n_nationkey) AS most FROM nation"),
    "var_length_into": ("MATCH (c:Customer)-[:CUST_IN]->(n:Nation)-[:IN_REGION]->(r:Region) MATCH (c)-[:CUST_IN|IN_REGION*1..2]->(r) RETURN r.r_name AS region, count(*) AS n", "SELECT r_name AS region, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1"),
    "scan_from_rows": ("UNWIND [1, 3] AS x MATCH (n) WHERE n.r_regionkey = x OR n.n_regionkey = x RETURN x, label(n) AS label, count(n) AS n", "SELECT r_regionkey::BIGINT AS x, 'Region' AS label, count(*) AS n FROM region WHERE r_regionkey IN (1, 3) GROUP BY 1 UNION ALL SELECT n_regionkey, 'Nation', count(*) FROM nation WHERE n_regionkey IN (1, 3) GROUP BY 1"),
    "call_in_query": ("MATCH (a:Nation), (b:Nation) WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey CALL algo.shortestPath(a, b, {relationshipQuery: 'IN_REGION'}) YIELD length RETURN a.n_nationkey AS a, b.n_nationkey AS b, length", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, 2 AS length FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"),
    "call_extract": ("MATCH (n:Nation)-[:IN_REGION]->(r:Region) CALL algo.native.extract(r, {isNode: true, field: 'r_name'}) YIELD value RETURN n.n_name AS name, value", "SELECT n_name AS name, r_name AS value FROM nation JOIN region ON r_regionkey = n_regionkey"),
    "list_predicates": ("MATCH (n:Nation) RETURN n.n_nationkey AS k, none(x IN [1, 2] WHERE x = n.n_regionkey) AS no, single(x IN [1, 2, 2] WHERE x = n.n_regionkey) AS one, -n.n_nationkey AS neg, toString(n.n_nationkey) AS s, toBoolean('true') AS t", "SELECT n_nationkey AS k, n_regionkey NOT IN (1, 2) AS no, n_regionkey = 1 AS one, -n_nationkey AS neg, n_nationkey::VARCHAR AS s, true AS t FROM nation"),
    "edge_functions": ("MATCH (c:Customer)-[r:PLACED]->(o:Order) RETURN c.c_custkey AS k, max(id(r)) AS latest, count(DISTINCT euid(r)) AS n", "SELECT o_custkey AS k, max(o_orderkey) AS latest, count(*) AS n FROM orders GROUP BY 1"),
    "edge_field": ("MATCH (o:Order)-[l:CONTAINS]->(p:Part) RETURN p.p_brand AS brand, max(native.getEdgeField(l, 'l_quantity')) AS q", "SELECT p_brand AS brand, max(l_quantity) AS q FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1"),
    "call_labels": ("CALL db.vertexLabels() YIELD label WHERE label <> 'User' RETURN label", "SELECT unnest(['Customer', 'Nation', 'Order', 'Part', 'Region', 'Supplier']) AS label"),
    "call_counts": ("CALL dbms.meta.countDetail() YIELD isVertex, label, count RETURN isVertex, label, count", "SELECT true AS isVertex, 'Region' AS label, count(*) AS count FROM region UNION ALL SELECT true, 'Nation', count(*) FROM nation UNION ALL SELECT true, 'Customer', count(*) FROM customer UNION ALL SELECT true, 'Supplier', count(*) FROM supplier UNION ALL SELECT true, 'Part', count(*) FROM part UNION ALL SELECT true, 'Order', count(*) FROM orders UNION ALL SELECT true, 'User', count(DISTINCT user_id) FROM events UNION ALL SELECT false, 'IN_REGION', count(*) FROM nation UNION ALL SELECT false, 'CUST_IN', count(*) FROM customer UNION ALL SELECT false, 'SUPP_IN', count(*) FROM supplier UNION ALL SELECT false, 'PLACED', count(*) FROM orders UNION ALL SELECT false, 'CONTAINS', count(*) FROM lineitem UNION ALL SELECT false, 'SHIPPED_BY', count(*) FROM lineitem UNION ALL SELECT false, 'DID', count(*) FROM events"),
}


def _query(text: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return graph(spark, d).cypher(text)

    return run


def parameters(s: SparkSession, d: str) -> DataFrame:
    return graph(s, d).cypher("MATCH (c:Customer) WHERE c.c_acctbal > $low AND c.c_mktsegment IN $segs RETURN c.c_mktsegment AS seg, count(c) AS n", {"low": 5000, "segs": ["BUILDING", "MACHINERY"]})


def hops_130(s: SparkSession, d: str) -> DataFrame:
    """Paths of exactly 130 hops along the parts in the order of their keys."""
    parts = table(s, d, "part").select(F.col("p_partkey").alias("k"))
    g = PropertyGraph(s).with_vertices("N", parts, "k").with_edges("NEXT", "N", "N", parts.select(F.col("k").alias("_src"), (F.col("k") + 1).alias("_dst"), F.col("k").alias("_eid")))
    return g.cypher("MATCH (a:N)-[:NEXT*130..130]->(b:N) RETURN a.k AS a, b.k AS b")


QUERIES = {**{name: _query(text) for name, (text, _) in PAIRS.items()}, "parameters": parameters, "hops_130": hops_130}
ORACLE = {name: sql for name, (_, sql) in PAIRS.items()} | {
    "parameters": "SELECT c_mktsegment AS seg, count(*) AS n FROM customer WHERE c_acctbal > 5000 AND c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1",
    "hops_130": "SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 130",
}

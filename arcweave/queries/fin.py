"""Reads over the account graph of the export."""

from __future__ import annotations

from arcweave.queries.tpch import fin_graph

_TABLES = {0: "fin_person", 1: "fin_account", 2: "fin_loan", 3: "fin_company"}


def _v(table: str) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, coalesce(dropped_at, TIMESTAMP '9999-01-01') DESC) AS rn FROM {table}) WHERE rn = 1)"


def _e(label: str, a: int, b: int) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY eid ORDER BY exported_at DESC, line_no DESC) AS rn FROM lgraph_export WHERE eid IS NOT NULL AND src_id IS NOT NULL AND dst_id IS NOT NULL) WHERE rn = 1 AND edge_label = '{label}' AND src_lid = {a} AND dst_lid = {b} AND src_id IN (SELECT id FROM {_TABLES[a]}) AND dst_id IN (SELECT id FROM {_TABLES[b]}))"


PAIRS = {
    "fin_transfer_types": ("MATCH (a:Account)-[t:transfer]->(b:Account) WHERE t.amount > 500 RETURN a.type AS src_type, b.type AS dst_type, count(t) AS n, round(sum(t.amount), 2) AS total",
        f"SELECT a.type AS src_type, b.type AS dst_type, count(*) AS n, round(sum(amount), 2) AS total FROM {_e('transfer', 1, 1)} t JOIN {_v('fin_account')} a ON a.id = src_id JOIN {_v('fin_account')} b ON b.id = dst_id WHERE amount > 500 GROUP BY 1, 2"),
    "fin_owner_transfers": ("MATCH (p:Person)-[:own]->(a:Account)-[t:transfer]->(b:Account)<-[:own]-(c:Company) RETURN count(t) AS n, count(DISTINCT p) AS persons, count(DISTINCT c) AS companies",
        f"SELECT count(*) AS n, count(DISTINCT o.src_id) AS persons, count(DISTINCT w.src_id) AS companies FROM {_e('own', 0, 1)} o JOIN {_e('transfer', 1, 1)} t ON t.src_id = o.dst_id JOIN {_e('own', 3, 1)} w ON w.dst_id = t.dst_id"),
    "fin_loans_by_applicant": ("MATCH (x)-[:apply]->(l:Loan) RETURN label(x) AS label, count(l) AS n, sum(l.loanamount) AS total",
        f"SELECT 'Person' AS label, count(*) AS n, sum(loanamount)::DOUBLE AS total FROM {_e('apply', 0, 2)} e JOIN {_v('fin_loan')} l ON l.id = dst_id UNION ALL SELECT 'Company', count(*), sum(loanamount)::DOUBLE FROM {_e('apply', 3, 2)} e JOIN {_v('fin_loan')} l ON l.id = dst_id"),
}
QUERIES = {name: (lambda s, d, q=q: fin_graph(s, d).cypher(q)) for name, (q, _) in PAIRS.items()}
ORACLE = {name: sql for name, (_, sql) in PAIRS.items()}

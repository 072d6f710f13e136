"""Queries p2, p3 and p5 over the raw feeds around the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.operators import badrows, heavykeys, orphans
from arcweave.runtime import table, union_all

#: Labels that a schema may have (fixed value of the data model); more are an error.
MOST_LABELS = 4096
#: vertex tables and their labels
_LABELS = {"Person": "fin_person", "Account": "fin_account", "Loan": "fin_loan", "Company": "fin_company"}


def _references(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "vertex_label").select("lid", "table_name").filter("lid is not null").distinct().limit(MOST_LABELS + 1).collect()
    if len(rows) > MOST_LABELS:
        raise ValueError(f"vertex_label has more than {MOST_LABELS} labels")
    names = {r["lid"]: r["table_name"] for r in rows}
    of = F.create_map(*[F.lit(x) for kv in names.items() for x in kv]) if names else F.create_map().cast("map<int,string>")
    e = table(spark, d, "lgraph_export").select("line_no", "src_lid", "dst_lid", "src_id", "dst_id", "ts")
    sides = F.array(*[F.struct(F.lit(s).alias("side"), of[F.col(lid)].alias("kind"), F.col(i).alias("key")) for s, lid, i in (("SRC_ID", "src_lid", "src_id"), ("DST_ID", "dst_lid", "dst_id"))])
    return e.select("line_no", F.col("ts").alias("at"), F.explode(sides).alias("s")).select("line_no", "at", "s.side", "s.kind", "s.key")


def _deltas(spark: SparkSession, d: str) -> DataFrame:
    return union_all([orphans.existence_deltas(table(spark, d, t).select("id", "loaded_at", "dropped_at"), t) for t in _LABELS.values()])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphans(_references(spark, d), _deltas(spark, d)).select("line_no", "side")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(orphans.orphans(_references(spark, d), _deltas(spark, d))).withColumnRenamed("kind", "vertex_table")


def p2_current(spark: SparkSession, d: str) -> DataFrame:
    """The current orphans of the ledger of signed counts: keys that are
    referred to and don't exist once all changes are in, with their references."""
    refs = _references(spark, d).select("kind", "key", F.lit(1).alias("d_refs"), F.lit(0).alias("d_existing"))
    lives = _deltas(spark, d).select("kind", "key", F.lit(0).alias("d_refs"), F.col("delta").alias("d_existing"))
    ledger = orphans.apply_changes(orphans.empty_ledger(spark), refs.unionByName(lives))
    return orphans.current_orphans(ledger).select(F.col("kind").alias("vertex_table"), "key", "refs")


def _per_key(spark: SparkSession, d: str) -> DataFrame:
    return heavykeys.aggregate_by_key(table(spark, d, "lgraph_export"), ["src_id", "e_lid"], "amount")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return heavykeys.heavy_keys(_per_key(spark, d), {"src_id": 0.01, "e_lid": 0.1}).select("key_field", "key_value")


def p3_per_key(spark: SparkSession, d: str) -> DataFrame:
    return _per_key(spark, d).select("key_field", "key_value", "n_rows", "n_values", F.round("total", 2).alias("total"))


def _movies(spark: SparkSession, d: str) -> DataFrame:
    return badrows.check_rows(table(spark, d, "hive_data").select("line_no", "raw"), "raw", badrows.MOVIE_COLUMNS)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return badrows.rejected(_movies(spark, d)).select("line_no", "reason")


def p5_valid(spark: SparkSession, d: str) -> DataFrame:
    return badrows.valid(_movies(spark, d).drop("raw"), badrows.MOVIE_COLUMNS)


QUERIES = {f.__name__: f for f in (p2_found, p2_report, p2_current, p3_found, p3_per_key, p5_found, p5_valid)}

_VERTICES = " UNION ALL ".join(f"SELECT '{t}' AS tn, id, loaded_at, dropped_at FROM {t}" for t in _LABELS.values())
_REFS = "SELECT line_no, ts, 'SRC_ID' AS side, src_lid AS lid, src_id AS id FROM lgraph_export UNION ALL SELECT line_no, ts, 'DST_ID', dst_lid, dst_id FROM lgraph_export"
_ORPHANS = f"""WITH v AS ({_VERTICES}), r AS (SELECT x.*, l.table_name AS tn FROM ({_REFS}) x LEFT JOIN vertex_label l ON l.lid = x.lid WHERE x.id IS NOT NULL),
 o AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.tn = r.tn AND v.id = r.id AND v.loaded_at <= r.ts AND (v.dropped_at IS NULL OR v.dropped_at > r.ts)))"""
_PER_KEY = "SELECT 'src_id' AS key_field, src_id AS key_value, count(*) AS n_rows, count(amount) AS n_values, round(sum(amount), 2) AS total FROM lgraph_export GROUP BY src_id UNION ALL SELECT 'e_lid', e_lid, count(*), count(amount), round(sum(amount), 2) FROM lgraph_export GROUP BY e_lid"
_Q = '"([^"]|"")*"'
_F = rf'({_Q}|[^",]*)'
_CELLS = f"""WITH q AS (SELECT line_no, raw, regexp_full_match(raw, '{_F}(,{_F})*') AS ok FROM hive_data),
 c AS (SELECT line_no, ok, CASE WHEN ok THEN list_transform(regexp_extract_all(',' || raw, ',("(?:[^"]|"")*"|[^",]*)', 1), lambda x: CASE WHEN x[1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END) END AS f FROM q),
 j AS (SELECT line_no, f, CASE WHEN NOT ok THEN 'quoting' WHEN coalesce(len(f), 0) <> 7 THEN 'column_count'
  WHEN NOT regexp_full_match(f[1], '[0-9]{{1,18}}') OR NOT regexp_full_match(f[2], '([0-9]{{1,4}}|\\\\N)?') OR len(list_filter(f[3:], lambda x: regexp_matches(x, '[\\x{{FFFD}}\\x7F\\x00-\\x08\\x0B-\\x1F]'))) > 0 THEN 'invalid_value' END AS reason FROM c)"""

ORACLE = {
    "p2_found": f"{_ORPHANS} SELECT line_no, side FROM o",
    "p2_report": f"{_ORPHANS} SELECT tn AS vertex_table, strftime(ts, '%Y-%m') AS period, count(*) AS n_refs, count(DISTINCT id) AS n_keys FROM o GROUP BY 1, 2",
    "p2_current": f"WITH v AS ({_VERTICES}), r AS (SELECT l.table_name AS tn, x.id FROM ({_REFS}) x LEFT JOIN vertex_label l ON l.lid = x.lid WHERE x.id IS NOT NULL) SELECT tn AS vertex_table, id AS key, count(*) AS refs FROM r WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.tn = r.tn AND v.id = r.id AND v.loaded_at IS NOT NULL AND v.dropped_at IS NULL) GROUP BY 1, 2",
    "p3_found": "SELECT 'src_id' AS key_field, src_id AS key_value FROM lgraph_export WHERE src_id IS NOT NULL GROUP BY src_id HAVING count(*) >= 0.01 * (SELECT count(*) FROM lgraph_export) UNION ALL SELECT 'e_lid', e_lid FROM lgraph_export WHERE e_lid IS NOT NULL GROUP BY e_lid HAVING count(*) >= 0.1 * (SELECT count(*) FROM lgraph_export)",
    "p3_per_key": _PER_KEY,
    "p5_found": f"{_CELLS} SELECT line_no, reason FROM j WHERE reason IS NOT NULL",
    "p5_valid": f"{_CELLS} SELECT line_no, f[1]::BIGINT AS id, CASE WHEN f[2] NOT IN ('', '\\N') THEN f[2]::INTEGER END AS duration, f[3] AS title, f[4] AS tagline, f[5] AS summary, f[6] AS poster_image, f[7] AS rated FROM j WHERE reason IS NULL",
}

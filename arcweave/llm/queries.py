"""Queries p1, p4, p6, p7, p8 and p9 and their SQL twins where there are any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.llm import bpe, leakage, neighbours, quantiles, repetition, truncation
from arcweave.runtime import table, write_stage


PERCENTILES = [0.25, 0.5, 0.9, 0.99]


def _similar(spark: SparkSession, d: str, min_cosine: float | None) -> DataFrame:
    return neighbours.similar(table(spark, d, "proto_field_data"), table(spark, d, "vector_index"), min_cosine=min_cosine)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _similar(spark, d, 0.9).select("index_id", F.least("vid", "neighbour").alias("vid_a"), F.greatest("vid", "neighbour").alias("vid_b")).distinct()


def p1_similar(spark: SparkSession, d: str) -> DataFrame:
    return _similar(spark, d, None).select("index_id", "vid", "neighbour", F.round("cosine", 6).alias("cosine"))


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    """Finished jobs, each once, with the procedure's name without case and outer white space."""
    blank = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
    name = F.lower(F.regexp_replace("procedure_name", rf"\A{blank}|{blank}\z", ""))
    jobs = table(spark, d, "job_run").filter("status = 'finished' and runtime >= 0 and procedure_name is not null")
    each = jobs.groupBy("job_id").agg(F.min(F.struct(name.alias("name"), F.col("runtime"), F.col("start_time"))).alias("j"))
    return each.select("job_id", F.col("j.name").alias("procedure"), F.col("j.runtime").alias("runtime"), F.timestamp_micros("j.start_time").cast("date").alias("day"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.far_above(write_stage(_jobs(spark, d), "jobs"), "procedure", "runtime", "job_id")


def p4_median(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.exact_quantile(write_stage(_jobs(spark, d), "jobs"), "procedure", "runtime", 0.5).select(F.col("grp").alias("procedure"), F.col("n").alias("n_jobs"), F.col("quantile").alias("median"))


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Sketches of single days put together, with the bounds of each answer."""
    daily = quantiles.sketch(_jobs(spark, d), "procedure", "runtime", "day")
    return quantiles.percentiles(quantiles.combine(daily), PERCENTILES)


def p4_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Whether the bounds that combined sketches give hold the exact percentile."""
    jobs = write_stage(_jobs(spark, d), "jobs")
    got = quantiles.percentiles(quantiles.combine(quantiles.sketch(jobs, "procedure", "runtime", "day")), PERCENTILES)
    exact = jobs.groupBy(F.col("procedure").alias("grp")).agg(*[F.expr(f"percentile_disc({p}D) within group (order by cast(runtime as double))").alias(f"x{i}") for i, p in enumerate(PERCENTILES)])
    each = exact.select("grp", F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.col(f"x{i}").alias("exact")) for i, p in enumerate(PERCENTILES)])).alias("x")).select("grp", "x.p", "x.exact")
    return got.withColumnRenamed("point", "p").join(each, ["grp", "p"]).select(F.col("grp").alias("procedure"), "p", F.col("exact").between(F.col("low"), F.col("high")).alias("held"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "mysql_data"))


def p6_share(spark: SparkSession, d: str) -> DataFrame:
    return truncation.share_by_source(table(spark, d, "mysql_data"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return repetition.repetitive(docs, repetition.fit_cutoffs(docs, stratum="lang"), stratum="lang")


def p9_share(spark: SparkSession, d: str) -> DataFrame:
    return repetition.measure(table(spark, d, "documents"), stratum="lang").select("doc_id", "n_words", "n_repeated", F.round("share", 6).alias("share"))


QUERIES = {f.__name__: f for f in (p1_found, p1_similar, p4_found, p4_median, p4_percentiles, p4_bounds, p6_found, p6_share, p7_ids, p8_found, p9_found, p9_share)}
_JOBS = r"WITH j AS (SELECT job_id, min(lower(regexp_replace(procedure_name, '^\s+|\s+$', '', 'g'))) AS procedure, min(runtime) AS runtime FROM job_run WHERE status = 'finished' AND runtime >= 0 AND procedure_name IS NOT NULL GROUP BY job_id), m AS (SELECT procedure, count(*) AS n_jobs, median(runtime) AS median FROM j GROUP BY procedure)"

# words as in the text of the problem: ideographs are set apart, the rest are runs of letters and digits
_WORDS = r"regexp_extract_all(regexp_replace(lower({c}), '([\x{{4e00}}-\x{{9fff}}])', ' \1 ', 'g'), '[\p{{L}}\p{{N}}]+')"
_DOC_WORDS = f"d AS (SELECT doc_id, {_WORDS.format(c='text')} AS w FROM documents WHERE text IS NOT NULL)"
_GRAMS = "g AS (SELECT doc_id, i, w[i:i + {last}] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {last} + 1)) AS i FROM d WHERE len(w) > {last}))"
_REPEATED = f"""WITH {_DOC_WORDS}, {_GRAMS.format(last=7)}, f AS (SELECT doc_id, i, min(i) OVER (PARTITION BY doc_id, g) AS least FROM g),
 r AS (SELECT doc_id, count(*) AS n_repeated FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS p FROM f WHERE i > least) GROUP BY doc_id),
 s AS (SELECT x.doc_id, coalesce(len(d.w), 0) AS n_words, coalesce(r.n_repeated, 0) AS n_repeated FROM documents x LEFT JOIN d USING (doc_id) LEFT JOIN r USING (doc_id))"""

ORACLE: dict[str, str] = {
    "p8_found": f"WITH {_DOC_WORDS}, {_GRAMS.format(last=11)}, e AS (SELECT item_id AS doc_id, {_WORDS.format(c='passage')} AS w FROM eval_items), h AS (SELECT doc_id AS item_id, w[i:i + 11] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM e WHERE len(w) > 11)) SELECT DISTINCT g.doc_id, h.item_id FROM g JOIN h ON g.g = h.g",
    "p9_found": f"{_REPEATED} SELECT doc_id FROM s WHERE n_words > 0 AND n_repeated >= 0.3 * n_words",
    "p9_share": f"{_REPEATED} SELECT doc_id, n_words, n_repeated, round(n_repeated::DOUBLE / greatest(n_words, 1), 6) AS share FROM s",
    "p4_found": f"{_JOBS} SELECT job_id FROM j JOIN m USING (procedure) WHERE runtime > 10 * median",
    "p4_bounds": f"{_JOBS} SELECT procedure, p, true AS held FROM m, (SELECT unnest({PERCENTILES}::DOUBLE[]) AS p)",
    "p4_median": f"{_JOBS} SELECT procedure, n_jobs, median FROM m",
}

"""Full-text search by BM25 over lower-cased words (runs of letters and
digits). Only documents with a query word take part in the scoring; the corpus
is scanned once for lengths and frequencies. Null and empty texts match
nothing; equal scores are ordered by key."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.runtime import write_stage

K1, B = 1.2, 0.75


def search(df: DataFrame, key: str, text: str, query: str, top: int) -> DataFrame:
    """``key, score`` of the best ``top`` documents for any of the words."""
    words = sorted(set(re.findall(r"[^\W_]+", query.lower())))
    low = F.lower(F.col(f"`{text}`"))
    tokens = F.filter(F.split(low, r"[^\p{L}\p{N}]+"), lambda x: x != "")
    d = df.filter(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{key}`").alias("key"), tokens.alias("t")).select("key", F.size("t").alias("len"), *[_count(w).alias(f"f{i}") for i, w in enumerate(words)])
    d = write_stage(d, "words")  # one pass over the texts; what follows reads counts only
    stats = d.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *[F.sum(F.when(F.col(f"f{i}") > 0, 1).otherwise(0)).alias(f"df{i}") for i in range(len(words))]).first()
    score = F.lit(0.0)
    for i in range(len(words)):
        df_i = stats[f"df{i}"] or 0
        idf = F.log(F.lit(1 + (stats["n"] - df_i + 0.5) / (df_i + 0.5)))
        f = F.col(f"f{i}").cast("double")
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.lit(float(stats["mean"] or 1.0))))
    hit = F.lit(False)
    for i in range(len(words)):
        hit = hit | (F.col(f"f{i}") > 0)
    return d.filter(hit).select(F.col("key").alias(key), score.alias("score")).orderBy(F.desc("score"), key).limit(top)


def _count(word: str) -> Column:
    return F.size(F.filter("t", lambda x: x == word))

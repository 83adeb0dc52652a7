"""How good a search is: recall against exact results, and the share of rows that it reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall_at_k(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(qid, n_exact, n_found, recall) per query."""
    truth = exact.select("qid", "id")
    hits = truth.join(found.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left")
    per = hits.groupBy("qid").agg(F.count(F.lit(1)).alias("n_exact"), F.count("hit").alias("n_found"))
    return per.withColumn("recall", F.col("n_found") / F.col("n_exact"))


def scanned_fraction(sizes: DataFrame, probes: DataFrame) -> DataFrame:
    """(qid, n_scanned, fraction) from (cid, n) and (qid, cid)."""
    total = sizes.agg(F.sum("n")).first()[0] or 0
    per = probes.join(F.broadcast(sizes), "cid").groupBy("qid").agg(F.sum("n").alias("n_scanned"))  # sizes: a row per cluster
    return per.withColumn("fraction", F.col("n_scanned") / F.lit(max(1, total)))

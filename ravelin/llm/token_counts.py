"""Token counts as an exact histogram of encoded lengths.

Documents are encoded and counted by length; everything else is read from the histogram, whose size is the
number of distinct lengths. Suffix sums over it (within blocks of `BLOCK` lengths, and over the few blocks) give, for every
length L: how many documents are longer, the tokens that remain when each document is cut at L, and L's
quantile. Between two lengths that occur, the truncated total is linear in the limit, so every context limit has its exact answer.

Defined results: null and empty texts have length 0 and are counted; repeated rows are counted each; an empty table has an
empty histogram, totals of 0 and null quantiles; extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Sequence

import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.llm.arrow import map_columns
from ravelin.runtime import materialize

VOCABULARY, BLOCK = "byte_bpe_50k.tiktoken", 1024


def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ravelin", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def lengths(docs: DataFrame, keep: Sequence[str] = (), path: str | None = None) -> DataFrame:
    """The columns to keep and `length`, each text's number of tokens."""
    path = path or public_tokenizers.path(VOCABULARY)

    def start():
        encode = encoding(path).encode_ordinary
        return lambda texts: [[len(encode(t)) if t else 0 for t in texts]]

    return map_columns(docs.select(*keep, F.col("text").cast("string").alias("__counted")), "length long", start, keep=list(keep))


def histogram(counted: DataFrame) -> DataFrame:
    """(length, n_docs), combined before the shuffle."""
    return counted.groupBy("length").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per length: documents of it, documents and tokens beyond it, the total truncated there, and its quantile."""
    tokens = F.col("length") * F.col("n_docs")
    blocks = hist.groupBy(F.floor(F.col("length") / block).alias("block")).agg(F.sum("n_docs").alias("docs"), F.sum(tokens).alias("tokens"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # a row per block of lengths
    whole = Window.partitionBy()
    ends = blocks.select("block", F.coalesce(F.sum("docs").over(above), F.lit(0)).alias("docs_above"), F.coalesce(F.sum("tokens").over(above), F.lit(0)).alias("tokens_above"), F.sum("docs").over(whole).alias("all_docs"), F.sum("tokens").over(whole).alias("all_tokens"))
    inside = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    within = hist.withColumn("block", F.floor(F.col("length") / block)).select("block", "length", "n_docs", F.coalesce(F.sum("n_docs").over(inside), F.lit(0)).alias("docs_over"), F.coalesce(F.sum(tokens).over(inside), F.lit(0)).alias("tokens_over"))
    both = within.join(ends, "block")
    docs_over, tokens_over = F.col("docs_above") + F.col("docs_over"), F.col("tokens_above") + F.col("tokens_over")
    return both.select(
        "length",
        "n_docs",
        docs_over.alias("docs_longer"),
        tokens_over.alias("tokens_longer"),
        (F.col("all_tokens") - tokens_over + F.col("length") * docs_over).alias("truncated_total"),
        ((F.col("all_docs") - docs_over) / F.col("all_docs")).alias("quantile"),
        F.col("all_docs").alias("total_docs"),
        F.col("all_tokens").alias("total_tokens"),
    )


def truncated_totals(hist: DataFrame, limits: Sequence[int]) -> DataFrame:
    """(context_limit, docs_longer, truncated_total, tokens_lost) for any limits, in one pass over the histogram."""
    total = F.sum(F.col("length") * F.col("n_docs"))
    cut = lambda limit: F.sum(F.least("length", F.lit(limit)) * F.col("n_docs"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    one = lambda limit: F.struct(F.lit(limit).cast("long").alias("context_limit"), zero(F.sum(F.when(F.col("length") > limit, F.col("n_docs")))).alias("docs_longer"), zero(cut(limit)).alias("truncated_total"), zero(total - cut(limit)).alias("tokens_lost"))
    return hist.agg(F.array(*map(one, limits)).alias("rows")).select(F.inline("rows"))


def quantiles(sums: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(share, length): the least length that at least that share of documents don't exceed."""
    return sums.agg(F.array(*(F.struct(F.lit(float(q)).alias("share"), F.min(F.when(F.col("quantile") >= q, F.col("length"))).alias("length")) for q in shares)).alias("rows")).select(F.inline("rows"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: the histogram of all documents' lengths with its suffix sums."""
    hist = materialize(histogram(lengths(spark.read.parquet(f"{sf_dir}/documents.parquet"))), "lengths")  # read twice, encoded once
    return suffix_sums(hist)

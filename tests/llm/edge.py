"""Rows that every operator must take."""

from __future__ import annotations

LONG = " ".join(f"wort{i % 977} the of and" for i in range(30_000))
TEXTS = [None, "", "   \n", "a", "one two", "The quick brown fox jumps over the lazy dog", "The quick brown fox jumps over the lazy dog", LONG, "ÄÖÜ ß 日本語 \U0001f600 é", "\x00\x1c control", "x" * 20_000, "!" * 3_000, "1.2.3.4 +49 170 1234567 a@b.co password = hunter22"]
EXTRA = {"fp": 1, "row": "r", "score": 0.5, "component_id": 9, "spans": "s", "ids": "i", "length": 3, "media": "m", "toxic_score": 1.0, "base": "b", "root": 7, "key": "k", "flat": 2, "items": "t", "clean": "c", "__media_text": "q"}


def documents(spark, texts=None, extra=False, ids=None):
    texts = TEXTS if texts is None else texts
    ids = list(range(len(texts))) if ids is None else ids
    df = spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in zip(ids, texts)], "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        from pyspark.sql import functions as F

        df = df.select("*", *(F.lit(v).alias(k) for k, v in EXTRA.items()))
    return df


def labels(spark, rows=()):
    return spark.createDataFrame([(i, 1, t) for i, t in rows], "doc_id long, quality int, toxic int")


def same(df, other) -> bool:
    """Equal rows, whatever their order."""
    return sorted(map(repr, df.collect())) == sorted(map(repr, other.collect()))

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ravelin.functions import vectors as V
from ravelin.operators import kernels


def test_expressions(spark):
    rows = [(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [3e38, 3e38])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = {r.id: r for r in df.select("id", V.l2_norm("v").alias("norm"), V.normalize("v").alias("unit"), V.dot("v", V.literal([1, 2])).alias("dot")).collect()}
    assert got[1].norm == 5 and got[1].dot == 11
    assert got[1].unit == pytest.approx([0.6, 0.8], abs=1e-7)
    assert got[2].unit == [0, 0] and got[2].norm == 0
    assert got[3].unit == pytest.approx([math.sqrt(0.5)] * 2, abs=1e-6)  # no overflow


def test_is_finite(spark):
    rows = [(0, [1.0]), (1, None), (2, [None]), (3, [float("nan")]), (4, [float("inf")]), (5, [1e39]), (6, [])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {r.id: r.ok for r in df.select("id", V.is_finite("v").alias("ok")).collect()}
    assert got == {0: True, 1: False, 2: False, 3: False, 4: False, 5: False, 6: True}


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 40), st.integers(0, 20), st.integers(1, 5), st.integers(0, 10**6))
def test_scores_are_sums_in_order(rows, dim, queries, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(rows, dim)), rng.normal(size=(queries, dim))
    got = kernels.scores(a, b)
    for i in range(rows):
        for j in range(queries):
            total = 0.0
            for x, y in zip(a[i], b[j]):
                total += x * y
            assert got[i, j] == total


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 3)), max_size=60), st.integers(1, 8))
def test_first_k_breaks_ties_by_id(rows, k):
    ids = np.random.default_rng(1).permutation(len(rows))
    groups = np.array([g for g, _ in rows], dtype=int)
    v = np.array([x for _, x in rows], dtype=float)
    got = [(groups[i], v[i], ids[i]) for i in kernels.first_k(groups, v, ids, k)]
    wanted = []
    for g in sorted(set(groups.tolist())):
        own = [(g, x, i) for h, x, i in zip(groups, v, ids) if h == g]
        wanted += sorted(own, key=lambda x: (-x[1], x[2]))[:k]
    assert got == wanted


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 40), st.integers(0, 5), st.integers(1, 9), st.integers(1, 12))
def test_top_pairs_are_those_of_all_scores(n, n_queries, dim, k):
    rng = np.random.default_rng(n * 100 + dim)
    rows, queries = rng.integers(-2, 3, (n, dim)).astype(float), rng.integers(-2, 3, (n_queries, dim)).astype(float)  # with many ties
    ids = rng.permutation(n)
    got = [(q, ids[i], s) for q, i, s in zip(*kernels.top_pairs(ids, rows, queries, k))]
    wanted = []
    for q, v in enumerate(queries):
        wanted += [(q, i, s) for s, i in sorted(zip(kernels.in_order(rows, v), ids), key=lambda x: (-x[0], x[1]))[:k]]
    assert got == wanted


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 30), st.integers(1, 12), st.integers(1, 4), st.integers(0, 10**6))
def test_nearest_is_the_first_of_the_best(n, k, dim, seed):
    rng = np.random.default_rng(seed)
    rows, centroids = rng.integers(-2, 3, (n, dim)).astype(float), rng.integers(-2, 3, (k, dim)).astype(float)  # with many ties
    before, kernels.COLUMNS, kernels.BLOCK = (kernels.COLUMNS, kernels.BLOCK), 3, 7
    try:
        got = kernels.nearest(rows, centroids)
    finally:
        kernels.COLUMNS, kernels.BLOCK = before
    assert got.tolist() == [int(kernels.scores(centroids, r.reshape(1, -1))[:, 0].argmax()) for r in rows]


def test_matrix_of_sliced_lists():
    column = pa.array([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]], pa.list_(pa.float32()))
    assert kernels.matrix_of(column[1:]).tolist() == [[3, 4], [5, 6]]
    assert kernels.matrix_of(column[:0]).shape == (0, 0)


def test_jvm_and_blocks_agree_bit_for_bit(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").limit(200).collect()
    q = np.array(rows[0].embedding, dtype=np.float32)
    df = spark.createDataFrame([(r.vec_id, r.embedding) for r in rows], "id long, v array<float>")
    jvm = [r.s for r in df.select("id", V.dot("v", V.literal(q)).alias("s")).orderBy(F.col("id")).collect()]
    blocks = kernels.scores(np.array([r.embedding for r in sorted(rows, key=lambda r: r.vec_id)]), q.astype(float).reshape(1, -1))[:, 0]
    assert jvm == blocks.tolist()

"""Spherical k-means: seeding, assignment, and passes that gather exact sums.

A pass reads the vectors once. Every task adds up the vectors of each cluster in fixed-point integers, so sums don't depend on the
order of rows, and sends one packed row per cluster; these are added up by cluster in a second stage, and the driver gets one row
per cluster. Centroids are broadcast up to `BROADCAST_BYTES`; more are gone through in groups of that size, each in a pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ravelin.operators import kernels
from ravelin.runtime import materialize, prepare

#: Fixed-point units of one; rows that a task adds up, and bytes of sums that it holds, before it must send.
UNITS, ROWS, SUM_BYTES = 1 << 40, 1 << 21, 64 << 20
#: Bytes of centroids that are broadcast together.
BROADCAST_BYTES = 128 << 20


def seed_order(id_col: Column, seed: int) -> Column:
    """Rows in this order (and by id among equals) are a reproducible random order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), id_col.cast("string")).cast("binary"))


def seed_centroids(vectors: DataFrame, k: int, seed: int, count: int | None = None) -> np.ndarray:
    """The first k rows of (id, v) in seeded order. Only rows that begin the order are sorted: about k of `count`."""
    count = vectors.count() if count is None else count
    share = (k + 10 * k**0.5 + 100) / max(1, count)
    while True:
        ordered = vectors.withColumn("order", seed_order(F.col("id"), seed))
        some = ordered if share >= 1 else ordered.filter(F.col("order") < f"{int(share * 16**15):015x}")
        rows = some.orderBy("order", "id").limit(k).select("v").collect()
        if len(rows) == k or share >= 1:
            return np.array([r.v for r in rows], dtype=np.float64).reshape(len(rows), -1)
        share *= 8


def _groups(centroids: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(first cluster, centroids) of groups that can be broadcast; the numbers are of single precision."""
    step = max(1, BROADCAST_BYTES // (4 * max(1, centroids.shape[1])))
    return [(i, centroids[i : i + step].astype(np.float32)) for i in range(0, len(centroids), step)]


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds cid, the nearest centroid by dot product."""
    spark = prepare(vectors.sparkSession)
    groups = _groups(centroids)
    rows, at, several = vectors, vectors.columns.index("v"), len(groups) > 1
    for number, (first, group) in enumerate(groups):
        shared = spark.sparkContext.broadcast(group)
        schema = StructType([*vectors.schema.fields, *_parse_datatype_string("cid int" + ", best double" * several).fields])
        arrow = to_arrow_schema(schema)

        def run(batches: Iterator[pa.RecordBatch], first=first, number=number, shared=shared, arrow=arrow) -> Iterator[pa.RecordBatch]:
            own = shared.value.astype(np.float64)
            for batch in batches:
                v = kernels.matrix_of(batch.column(at))
                cid = kernels.nearest(v, own)
                found = [pa.array(cid + np.int32(first))]
                if several:
                    best = kernels.in_order(v, own[cid])
                    if number:  # what an earlier group has found stays among equals
                        had = batch.column(len(arrow) - 1).to_numpy(zero_copy_only=False)
                        found = [pa.array(np.where(best > had, cid + first, batch.column(len(arrow) - 2).to_numpy(zero_copy_only=False)).astype(np.int32))]
                        best = np.maximum(best, had)
                    found.append(pa.array(best))
                yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns[: len(arrow) - len(found)], arrow)), *found], schema=arrow)

        rows = rows.mapInArrow(run, schema)
        if several:  # only one group at a time is in memory
            rows = materialize(rows, "assigned")
    return rows.drop("best") if several else rows


def _high_low(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x >> 32, x & 0xFFFFFFFF


def cluster_sums(vectors: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, sums) of the clusters that the centroids make."""
    spark = prepare(vectors.sparkSession)
    k, dim = centroids.shape
    shared = spark.sparkContext.broadcast(centroids.astype(np.float32)) if len(_groups(centroids)) == 1 else None
    rows = vectors.select("v") if shared else assign(vectors.select("v"), centroids)
    schema = _parse_datatype_string("cid int, n long, sums binary")
    arrow = to_arrow_schema(schema)
    slots = max(kernels.BLOCK, SUM_BYTES // (8 * max(1, dim)))

    def packed(cids: np.ndarray, sizes: np.ndarray, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(cids), 1000):
            part = slice(lo, min(lo + 1000, len(cids)))
            yield pa.RecordBatch.from_arrays([pa.array(cids[part].astype(np.int32)), pa.array(sizes[part]), pa.array([x.tobytes() for x in sums[part]], pa.binary())], schema=arrow)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared and shared.value.astype(np.float64)
        slot, seen = np.full(k, -1), 0
        cids, sizes, sums = [], np.zeros(min(k, slots), np.int64), np.zeros((min(k, slots), dim), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = kernels.matrix_of(batch.column(0))
            cid = kernels.nearest(v, own) if shared else batch.column(1).to_numpy(zero_copy_only=False)
            order = np.argsort(cid, kind="stable")
            used, firsts = np.unique(cid[order], return_index=True)
            fresh = used[slot[used] < 0]
            if len(cids) + len(fresh) > len(sizes) or seen + len(v) > ROWS:
                yield from packed(np.array(cids), sizes, sums)
                sizes[:], sums[:], slot[:], seen = 0, 0, -1, 0
                cids, fresh = [], used
            slot[fresh] = np.arange(len(cids), len(cids) + len(fresh))
            cids += fresh.tolist()
            sums[slot[used]] += np.add.reduceat(np.floor(v * UNITS + 0.5).astype(np.int64)[order], firsts, axis=0)
            sizes[slot[used]] += np.diff(np.append(firsts, len(v)))
            seen += len(v)
        yield from packed(np.array(cids), sizes, sums)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of a partition's clusters, exact in two halves, rounded once to double precision."""
        high, low, sizes = {}, {}, {}
        for batch in batches:
            for c, n, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                h, l = _high_low(np.frombuffer(x.as_buffer(), np.int64))
                if c in sizes:
                    sizes[c] += n
                    high[c] += h
                    low[c] += l
                else:
                    sizes[c], high[c], low[c] = n, h, l
        names = np.array(sorted(sizes), dtype=np.int64)
        yield from packed(names, np.array([sizes[c] for c in names.tolist()], dtype=np.int64), [(high[c] + (low[c] >> 32)) * 2.0**32 + (low[c] & 0xFFFFFFFF) for c in names.tolist()])

    parts = rows.mapInArrow(add_up, schema)
    tasks = 1 if k * dim * 8 <= 1 << 20 else max(min(k, int(spark.conf.get("spark.sql.shuffle.partitions"))), -(-k * dim * 16 // SUM_BYTES))
    sizes, sums = np.zeros(k, np.int64), np.zeros((k, dim))
    for r in parts.repartition(tasks, "cid").mapInArrow(combine, schema).collect():  # at most a row per cluster
        sizes[r.cid], sums[r.cid] = r.n, np.frombuffer(r.sums, np.float64)
    if shared:
        shared.destroy()
    return sizes, sums


def means(sizes: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Normalized means in single precision, so that scores are sums of exact products; a zero sum stays a zero vector."""
    return kernels.unit(sums / np.maximum(sizes, 1)[:, None] / UNITS).astype(np.float32).astype(np.float64)


def lloyd_step(vectors: DataFrame, centroids: np.ndarray, seed: int = 123) -> tuple[np.ndarray, np.ndarray]:
    """(new centroids, sizes of the old ones' clusters) from one pass; an empty cluster restarts from a row in seeded order."""
    sizes, sums = cluster_sums(vectors, centroids)
    out = means(sizes, sums)
    empty = np.flatnonzero(sizes == 0)
    if len(empty):
        fresh = seed_centroids(vectors, len(empty), seed, int(sizes.sum()))
        out[empty[: len(fresh)]] = fresh
    return out, sizes


def spherical_kmeans(vectors: DataFrame, n_clusters: int, iters: int, seed: int, start: np.ndarray | None = None, count: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centroids, centroids before the last pass, sizes of the clusters that those made)."""
    centroids = seed_centroids(vectors, n_clusters, seed, count) if start is None else start
    before, sizes = centroids, np.zeros(len(centroids), np.int64)
    for i in range(iters):
        before, (centroids, sizes) = centroids, lloyd_step(vectors, centroids, seed + i + 1)
    return centroids, before, sizes

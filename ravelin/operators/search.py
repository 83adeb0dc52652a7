"""Search operators: coarse probe, posting scan, top-k, metadata lookup, filters, and batches of queries."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ravelin.operators import clustering, kernels
from ravelin.runtime import materialize, prepare

#: Queries, their bytes, and pairs of query and cluster up to which a batch is broadcast; a larger one is joined to the postings.
QUERY_BLOCK, QUERY_BYTES, PROBES = 8192, 32 << 20, 1 << 21
#: Of a joined batch: rows and queries of a cluster that meet in one task, and rows and queries of a packed block.
PIECE_ROWS, PIECE_QUERIES, PACKED = 1 << 20, 1 << 14, 2048


def prepare_query(query, dim: int) -> np.ndarray:
    """A single-precision vector from anything array-like; ValueError if it isn't finite or has another length."""
    with np.errstate(over="ignore"):
        q = np.asarray(query, dtype=np.float32).reshape(-1)
    if not np.isfinite(q).all():
        raise ValueError("a query must be finite in single precision")
    if q.size != dim:
        raise ValueError(f"a query has {dim} dimensions here, not {q.size}")
    return q


def normalize_query(q: np.ndarray) -> np.ndarray:
    return kernels.unit(q.astype(np.float64).reshape(1, -1))[0].astype(np.float32)


def coarse(centroids: np.ndarray, q: np.ndarray, nprobe: int) -> np.ndarray:
    """Clusters in order of their score, lower numbers first among equals; nprobe is held within 1 and their number."""
    nprobe = max(1, min(int(nprobe), len(centroids)))
    found = kernels.scores(centroids, q.astype(np.float64).reshape(1, -1))[:, 0]
    return np.lexsort((np.arange(len(found)), -found))[:nprobe]


def coarse_block(centroids: np.ndarray, queries: np.ndarray, nprobe: int) -> list[np.ndarray]:
    """coarse() for many queries."""
    nprobe = max(1, min(int(nprobe), len(centroids)))
    return [*kernels.top_pairs(np.arange(len(centroids)), centroids, queries, nprobe)[1].reshape(-1, nprobe)]


def scored(rows: DataFrame, q: np.ndarray, vector_col: str, keep: Sequence[str]) -> DataFrame:
    """The columns to keep and `score`, the dot product with one query, computed by Arrow batch; null for a null vector or another length."""
    prepare(rows.sparkSession)
    query, n = np.asarray(q, dtype=np.float64), len(keep)
    schema = StructType([*(rows.schema[c] for c in keep), *_parse_datatype_string("score double").fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(n)
            fits = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == len(query)
            found = np.zeros(len(fits))
            whole = column if fits.all() else column.filter(pa.array(fits))
            found[fits] = kernels.in_order(kernels.matrix_of(whole), query) if len(whole) else 0
            out = pa.array(found, mask=~fits)
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns[:n], arrow)), out], schema=arrow)

    return rows.select(*keep, F.col(vector_col).alias("__scored")).mapInArrow(run, schema)


def scan(postings: DataFrame, cids: Sequence[int], q: np.ndarray) -> DataFrame:
    """(cid, id, score) of every row in the clusters; the list becomes a partition filter, so no other cluster is read."""
    rows = postings.filter(F.col("cid").isin([int(c) for c in cids])) if len(cids) else postings.filter(F.lit(False))
    return scored(rows, q, "v", ["cid", "id"])


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The k highest scores, ties by the lower id. Spark makes room for k rows, so callers hold it within the rows there are."""
    return scored.orderBy(F.desc("score"), "id").limit(max(0, int(k)))


def with_metadata(winners: DataFrame, postings: DataFrame, cids: Sequence[int] | None = None) -> DataFrame:
    """Adds metadata to the winners (cid, id, score) of postings; `{}` where a row has none.

    The winners are at most k rows, so it is they that are broadcast, and metadata is read for their clusters only.
    """
    told = postings.select("cid", "id", F.coalesce("metadata", F.lit("{}")).alias("metadata"))
    if cids is not None:
        told = told.filter(F.col("cid").isin([int(c) for c in cids]))
    found = told.join(F.broadcast(winners), ["cid", "id"])
    return found.select(*winners.columns, "metadata").orderBy(F.desc("score"), "id")


def split_filter(expression: str) -> tuple[str, str]:
    if ":" not in expression:
        raise ValueError("a filter is key:value")
    key, value = expression.split(":", 1)
    return key, value


def metadata_text(metadata: str | None, key: str) -> str:
    """How a metadata value is written for comparison: True, None (also for a missing key), 1.0, and so on."""
    found = json.loads(metadata) if metadata else {}
    return str(found.get(key)) if isinstance(found, dict) else "None"


def filter_results(results: DataFrame, expression: str) -> DataFrame:
    """Of results that have metadata, those whose value for a key is written like the given one. The results are few."""
    if "metadata" not in results.columns:
        return results
    key, value = split_filter(expression)
    prepare(results.sparkSession)
    at = results.columns.index("metadata")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [metadata_text(m, key) == value for m in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return results.mapInArrow(run, results.schema)


def where_metadata(postings: DataFrame, condition: Column) -> DataFrame:
    """Rows to search at all: a filter before top-k, unlike filter_results."""
    return postings.filter(condition)


def _checked(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray, str | None]:
    """(qids, queries in single precision, what is wrong with them) of a batch (qid, q)."""
    rows = batch.column(1)
    odd = np.flatnonzero(rows.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) != dim)
    with np.errstate(over="ignore"):
        flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    if not len(odd) and np.isfinite(flat).all():
        return batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), flat.reshape(-1, dim), None
    try:
        for q in rows.to_pylist():
            prepare_query([] if q is None else [float("nan") if x is None else x for x in q], dim)
    except ValueError as e:
        return np.empty(0, np.int64), np.empty((0, dim), np.float32), str(e)
    raise AssertionError("unreachable")


def _typed(queries: DataFrame) -> DataFrame:
    return queries.select(F.col("qid").cast("long").alias("qid"), F.col("q").cast("array<double>").alias("q"))


def collected(queries: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(qids, queries) of a table that is known to be small."""
    prepare(queries.sparkSession)
    schema = _parse_datatype_string("qids binary, q binary, error string")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            qids, q, error = _checked(batch, dim)
            yield pa.RecordBatch.from_pylist([{"qids": qids.tobytes(), "q": q.tobytes(), "error": error}], schema=arrow)

    rows = _typed(queries).mapInArrow(run, schema).collect()
    if wrong := [r.error for r in rows if r.error]:
        raise ValueError(wrong[0])
    return np.frombuffer(b"".join(r.qids for r in rows), np.int64), np.frombuffer(b"".join(r.q for r in rows), np.float32).reshape(-1, dim)


def probed(queries: DataFrame, centroids: np.ndarray, nprobe: int, normalized: bool = True) -> DataFrame:
    """(qid, cid, rank, q) of the clusters that each query looks into, best first; q is the prepared query, packed.

    A task scores its queries against the broadcast centroids. More centroids than are broadcast at once are gone
    through in groups, of which each query keeps the best of all. A wrong query fails the job.
    """
    spark = prepare(queries.sparkSession)
    dim, nprobe = centroids.shape[1], max(1, min(int(nprobe), len(centroids)))
    schema = _parse_datatype_string("qid long, cid int, rank int, q binary, score double")
    arrow = to_arrow_schema(schema)
    groups, out = clustering._groups(centroids), None
    for first, group in groups:
        shared = spark.sparkContext.broadcast(group)

        def run(batches: Iterator[pa.RecordBatch], first=first, shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value.astype(np.float64)
            most = min(nprobe, len(own))
            for batch in batches:
                qids, q, error = _checked(batch, dim)
                if error:
                    raise ValueError(error)
                q = kernels.unit(q.astype(np.float64)).astype(np.float32) if normalized else q
                step = max(1, kernels.BLOCK // most)
                for at in range(0, len(q), step):
                    some = q[at : at + step]
                    who, cids, scores = kernels.top_pairs(np.arange(len(own)), own, some.astype(np.float64), most)
                    blobs = pa.array([x.tobytes() for x in some], pa.binary()).take(pa.array(who))
                    yield pa.RecordBatch.from_arrays([pa.array(qids[at : at + step][who]), pa.array((cids + first).astype(np.int32)), pa.array((np.arange(len(who)) % most + 1).astype(np.int32)), blobs, pa.array(scores)], schema=arrow)

        found = _typed(queries).mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    if len(groups) > 1:
        rank = F.row_number().over(Window.partitionBy("qid", "q").orderBy(F.desc("score"), "cid"))
        out = out.withColumn("rank", rank).filter(F.col("rank") <= nprobe)
    return out.drop("score")


_FOUND = "qid long, cid int, id long, score double"


class _Best:
    """The k best rows of each query met so far; at most twice as many are held."""

    def __init__(self, k: int):
        self.k, self.held, self.size, self.kept = k, [], 0, 0

    def add(self, q: np.ndarray, c: np.ndarray, i: np.ndarray, s: np.ndarray) -> None:
        self.held.append((q, c, i, s))
        self.size += len(q)
        if self.size > 2 * self.kept + 16 * kernels.BLOCK:
            self._prune()

    def _prune(self) -> None:
        q, c, i, s = (np.concatenate(x) for x in zip(*self.held))
        first = kernels.first_k(q, s, i, self.k)
        self.held, self.size = [(q[first], c[first], i[first], s[first])], len(first)
        self.kept = self.size

    def batches(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        if self.held:
            self._prune()
            q, c, i, s = self.held[0]
            for at in range(0, len(q), kernels.BLOCK):
                part = slice(at, at + kernels.BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array(q[part]), pa.array(c[part].astype(np.int32)), pa.array(i[part].astype(np.int64)), pa.array(s[part])], schema=schema)
        self.held, self.size, self.kept = [], 0, 0


def scan_block(postings: DataFrame, qids: np.ndarray, queries: np.ndarray, probes: list[np.ndarray] | None, k: int) -> DataFrame:
    """Each task's k best rows for every query of a block; probes: the clusters that each query looks into, all if None."""
    spark = prepare(postings.sparkSession)
    asking: dict[int, list[int]] = {}
    for i, cids in enumerate(probes or ()):
        for c in cids:
            asking.setdefault(int(c), []).append(i)
    shared = spark.sparkContext.broadcast((qids, queries, {c: np.array(i) for c, i in asking.items()} if probes is not None else None))
    schema = _parse_datatype_string(_FOUND)
    arrow = to_arrow_schema(schema)
    rows = postings.select("cid", "id", "v")
    if probes is not None:
        rows = rows.filter(F.col("cid").isin(sorted(asking)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vectors, wanted = shared.value
        vectors = vectors.astype(np.float64)
        everyone, best = np.arange(len(names)), _Best(k)
        for batch in batches:
            cids = batch.column(0).to_numpy(zero_copy_only=False)
            ids = batch.column(1).to_numpy(zero_copy_only=False)
            matrix = kernels.matrix_of(batch.column(2))
            for c in np.unique(cids) if wanted is not None else [None]:
                own = np.flatnonzero(cids == c) if c is not None else np.arange(len(ids))
                who = wanted.get(int(c), everyone[:0]) if c is not None else everyone
                for at in range(0, len(who), kernels.QUERIES):
                    some = who[at : at + kernels.QUERIES]
                    q, top, found = kernels.top_pairs(ids[own], matrix[own], vectors[some], k)
                    best.add(names[some[q]], cids[own][top], ids[own][top], found)
        yield from best.batches(arrow)

    return rows.mapInArrow(run, schema)


def _pieces(spark, sizes: np.ndarray, asked: DataFrame, k: int) -> tuple[DataFrame, list[int]]:
    """(cid, rows_n, queries_n), into how many pieces a cluster's rows and queries are dealt, and the clusters that any query looks into."""
    told = asked.groupBy("cid").agg(F.count(F.lit(1)).alias("n")).toPandas()  # a row per cluster
    cids, asks = told.cid.to_numpy(dtype=np.int64), told.n.to_numpy(dtype=np.int64)
    each = max(1, min(PIECE_QUERIES, (1 << 22) // k))
    table = pa.table({"cid": cids.astype(np.int32), "rows_n": np.maximum(1, -(-sizes[cids] // PIECE_ROWS)).astype(np.int32), "queries_n": (-(-asks // each)).astype(np.int32)})
    return spark.createDataFrame(table), sorted(cids.tolist())


def _packed(rows: DataFrame, columns: str, most: int) -> DataFrame:
    """(cid, <piece>, ids, block) of rows (cid, <piece>, id, packed vector) that lie together by cid and piece."""
    schema = _parse_datatype_string(f"cid int, {columns} int, ids binary, block binary")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, blobs = None, [], []

        def block():
            return pa.RecordBatch.from_pylist([{"cid": key[0], columns: key[1], "ids": np.array(ids, dtype=np.int64).tobytes(), "block": b"".join(blobs)}], schema=arrow)

        for batch in batches:
            for c, piece, i, blob in zip(*(x.to_pylist() for x in batch.columns)):
                if ids and (key != (c, piece) or len(ids) >= most):
                    yield block()
                    ids, blobs = [], []
                key = c, piece
                ids.append(i)
                blobs.append(blob)
        if ids:
            yield block()

    return rows.mapInArrow(run, schema)


def _posting_blocks(postings: DataFrame) -> DataFrame:
    """(cid, number, ids, block): every Arrow batch of a cluster's rows, packed."""
    schema = _parse_datatype_string("cid int, number int, ids binary, block binary")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            cids, ids = (batch.column(j).to_numpy(zero_copy_only=False) for j in (0, 1))
            v = kernels.matrix_of(batch.column(2)).astype(np.float32)
            for c in np.unique(cids):
                own = np.flatnonzero(cids == c)
                for at in range(0, len(own), PACKED):
                    some = own[at : at + PACKED]
                    yield pa.RecordBatch.from_pylist([{"cid": int(c), "number": number, "ids": ids[some].astype(np.int64).tobytes(), "block": v[some].tobytes()}], schema=arrow)
                    number += 1

    return postings.select("cid", "id", "v").mapInArrow(run, schema)


def joined_search(postings: DataFrame, queries: DataFrame, centroids: np.ndarray, sizes: np.ndarray, k: int, nprobe: int) -> DataFrame:
    """Each task's k best rows for any number of queries, in one job: blocks of queries meet blocks of rows by cluster.

    A cluster of very many rows is dealt into pieces that each meet all its queries, one that very many queries look into
    into pieces that each meet all its rows.
    """
    spark, dim = prepare(postings.sparkSession), centroids.shape[1]
    asked = materialize(probed(queries, centroids, nprobe).select("qid", "cid", "q"), "probes")
    pieces, cids = _pieces(spark, sizes, asked, k)
    pieces = F.broadcast(pieces) if clustering.BROADCAST_BYTES >= 64 * len(cids) else pieces
    dealt = asked.join(pieces, "cid").withColumn("query_piece", F.expr("pmod(xxhash64(qid), queries_n)").cast("int"))
    together = dealt.repartition("cid", "query_piece").sortWithinPartitions("cid", "query_piece").select("cid", "query_piece", "qid", "q")
    asking = _packed(together, "query_piece", PACKED).join(pieces, "cid").withColumn("row_piece", F.explode(F.expr("sequence(0, rows_n - 1)")))
    asking = asking.select("cid", "row_piece", "query_piece", F.col("ids").alias("qids"), F.col("block").alias("queries"))
    read = postings if len(cids) == len(centroids) else postings.filter(F.col("cid").isin(cids))
    rows = _posting_blocks(read).join(pieces, "cid").withColumn("row_piece", F.expr("pmod(xxhash64(number, ids), rows_n)").cast("int")).withColumn("query_piece", F.explode(F.expr("sequence(0, queries_n - 1)")))
    rows = rows.select("cid", "row_piece", "query_piece", "ids", "block")
    met = rows.hint("merge").join(asking, ["cid", "row_piece", "query_piece"]).select("cid", "row_piece", "query_piece", "ids", "block", "qids", "queries")
    schema = _parse_datatype_string(_FOUND)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, best = None, _Best(k)
        for batch in batches:
            for c, a, b, ids, block, qids, vectors in zip(*(x.to_pylist() for x in batch.columns)):
                if key != (c, a, b):  # a merge join gives the pairs of a key one after the other
                    yield from best.batches(arrow)
                    key = c, a, b
                m, ids = np.frombuffer(block, np.float32).reshape(-1, dim).astype(np.float64), np.frombuffer(ids, np.int64)
                q, names = np.frombuffer(vectors, np.float32).reshape(-1, dim).astype(np.float64), np.frombuffer(qids, np.int64)
                who, top, found = kernels.top_pairs(ids, m, q, k)
                best.add(names[who], np.full(len(who), c), ids[top], found)
        yield from best.batches(arrow)

    return met.mapInArrow(run, schema)


def merge_top_k(found: DataFrame, k: int) -> DataFrame:
    """(qid, cid, id, score, rank): the best k of each query, from at most k of each task."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def batch_search(postings: DataFrame, queries: DataFrame, centroids: np.ndarray, sizes: np.ndarray, k: int, nprobe: int) -> DataFrame:
    """(qid, cid, id, score, rank) for every query, over the clusters that it looks into. A repeated qid is one query.

    Few queries are broadcast to one scan of their clusters, more are joined to it.
    """
    k, dim = max(0, min(int(k), int(sizes.sum()))), centroids.shape[1]
    nprobe = max(1, min(int(nprobe), len(centroids)))
    most = max(1, min(QUERY_BLOCK, QUERY_BYTES // (4 * dim), PROBES // nprobe if nprobe < len(centroids) else QUERY_BLOCK))
    queries = queries.select("qid", "q")
    n = queries.select(F.lit(1)).limit(most + 1).count() if k else 0
    if not n:
        return postings.sparkSession.createDataFrame([], _parse_datatype_string(_FOUND + ", rank int"))
    if n > most:
        return merge_top_k(joined_search(postings, queries, centroids, sizes, k, nprobe), k)
    qids, vectors = collected(queries, dim)
    vectors = kernels.unit(vectors.astype(np.float64)).astype(np.float32)
    probes = None if nprobe == len(centroids) else coarse_block(centroids, vectors.astype(np.float64), nprobe)
    return merge_top_k(scan_block(postings, qids, vectors, probes, k), k)

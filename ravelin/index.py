"""The vector index: build, open, search."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ravelin.operators import clustering, kernels, search
from ravelin.plans import dsl
from ravelin.runtime import fresh_path, prepare
from ravelin.sources import arrays, store


def _with_id(metadata: str | None, row_id: int | None) -> str:
    """A JSON object with `_id`; ValueError for anything else, and for NaN and infinities."""

    def refuse(word: str):
        raise ValueError(f"metadata can't hold {word}")

    found = json.loads(metadata, parse_constant=refuse) if metadata else {}
    if not isinstance(found, dict):
        raise ValueError("metadata must be a JSON object")
    return json.dumps({**found, "_id": row_id}, ensure_ascii=False)


def _told(texts: list, ids: list) -> tuple[list[str | None], list[str | None]]:
    """Metadata with ids, and what is wrong with it."""
    out, faults = [], []
    for text, row_id in zip(texts, ids):
        try:
            out.append(_with_id(text, row_id))
            faults.append(None)
        except ValueError as e:
            out.append(None)
            faults.append(str(e))
    return out, faults


def unit_rows(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(vectors at length 1 in single precision, their lengths, whether each is finite) of a list column; what isn't finite is left empty."""
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null elements become NaN
    starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    if len(sizes) and sizes[0] > 0 and (sizes == sizes[0]).all() and np.isfinite(flat).all():
        ends = np.arange(len(sizes) + 1, dtype=np.int32) * np.int32(sizes[0])
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(kernels.unit(flat.reshape(len(sizes), -1)).astype(np.float32).ravel())), sizes, sizes > 0
    good, parts = sizes > 0, [np.empty(0, np.float32)] * len(sizes)
    for size in np.unique(sizes[sizes > 0]):
        own = np.flatnonzero(sizes == size)
        m = flat[starts[own, None] + np.arange(size)]
        good[own] = np.isfinite(m).all(axis=1)
        for i, row in zip(own[good[own]].tolist(), kernels.unit(m[good[own]]).astype(np.float32)):
            parts[i] = row
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.empty(0, np.float32)]))), sizes, good


def prepared(df: DataFrame, id_col: str, vector_col: str, metadata_col: str | None) -> DataFrame:
    """(id, v, pos, metadata, dim, finite, fault) in one pass: v normalized and in single precision, metadata with the row's id."""
    if df.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"ids must be integers: {id_col} is {df.schema[id_col].dataType.simpleString()}")
    metadata = F.lit(None).cast("string") if metadata_col is None else F.col(metadata_col) if df.schema[metadata_col].dataType.typeName() == "string" else F.to_json(metadata_col, {"ignoreNullFields": "false"})
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v"), F.monotonically_increasing_id().alias("pos"), metadata.alias("metadata"))
    schema = _parse_datatype_string("id long, v array<float>, pos long, metadata string, dim int, finite boolean, fault string")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors, pos, texts = batch.columns
            v, sizes, good = unit_rows(vectors)
            faults = pa.nulls(len(ids), pa.string())
            if metadata_col is not None:
                texts, faults = (pa.array(x, pa.string()) for x in _told(texts.to_pylist(), ids.to_pylist()))
            out = [ids, v, pos, texts, pa.array(sizes.astype(np.int32)), pa.array(good), faults]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(out, arrow)], schema=arrow)

    return rows.mapInArrow(run, schema)


def validate(rows: DataFrame) -> tuple[int, int]:
    """(count, dim) of prepared rows; ValueError if empty, ragged, not finite, if ids are null or repeat, or for wrong metadata."""
    by_id = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("dim").alias("least"), F.max("dim").alias("most"), F.sum((~F.col("finite")).cast("long")).alias("bad"), F.max("fault").alias("fault"))
    told = by_id.agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("bad").alias("bad"), F.max("fault").alias("fault"), F.sum((F.col("id").isNull() | (F.col("n") > 1)).cast("long")).alias("ids")).first()
    if not told.n:
        raise ValueError("there are no vectors")
    if told.bad:
        raise ValueError(f"{told.bad} vectors are null or empty, or hold null, NaN or infinite elements")
    if told.least != told.most:
        raise ValueError(f"vectors have from {told.least} to {told.most} dimensions")
    if told.ids:
        raise ValueError("ids must be unique and not null")
    if told.fault:
        raise ValueError(told.fault)
    return told.n, told.most


class VectorIndex:
    """An immutable cosine index in a folder. Usable as a context manager; searches after close() raise RuntimeError."""

    def __init__(self, spark: SparkSession, path: str, *, backend: str = "cpu", device: int = 0):
        self._closed = True
        check_backend(spark, backend, device)
        self.spark, self.path = prepare(spark), path.rstrip("/")
        self.manifest = store.read_manifest(spark, self.path)
        self.dim: int = self.manifest["dim"]
        self.has_metadata: bool = self.manifest["metadata"]
        self.centroids, self.sizes = store.read_centroids(spark, self.path, self.manifest)
        self.postings = store.read_postings(spark, self.path)
        if (n := self.postings.count()) != self.manifest["count"]:  # answered from the files' footers
            raise ValueError(f"the postings have {n} rows, the manifest {self.manifest['count']}")
        self._closed = False

    @classmethod
    def build(cls, spark: SparkSession, path: str, data: Any, *, ids: Any = None, metadata: Any = None, id_col: str = "id", vector_col: str = "embedding", metadata_col: str | None = None, n_clusters: int = 64, kmeans_iters: int = 4, seed: int = 123, centroids: np.ndarray | None = None, final_assign: bool = True) -> VectorIndex:
        """Validate, cluster and write, then open.

        data: a DataFrame with the named columns; or a matrix, with ids (0, 1, ... if not given) and a dict of metadata per row.
        final_assign: rows go to the nearest saved centroid. Without it they keep the labels that the last pass was made from, one
        update behind the centroids. centroids: where the passes start, instead of seeded rows. Any failure leaves nothing behind.
        """
        prepare(spark)
        path = path.rstrip("/")
        files = store.Files(spark, path)
        if not files.free(path):
            raise FileExistsError(path)
        if n_clusters < 1 or kmeans_iters < 1:
            raise ValueError("n_clusters and kmeans_iters are at least 1")
        if not isinstance(data, DataFrame):
            data, id_col, vector_col, metadata_col = arrays.frame(spark, data, ids, metadata), "id", "embedding", None if metadata is None else "metadata"
        staging, vectors = store.staging_path(path), fresh_path(spark, "vectors")
        scratch = store.Files(spark, vectors)
        try:
            written = prepared(data, id_col, vector_col, metadata_col)
            written.write.parquet(vectors)
            rows = spark.read.schema(written.schema).parquet(vectors)  # read by every pass
            count, dim = validate(rows)
            rows, clusters = rows.select("id", "v", "pos", "metadata"), min(n_clusters, count)
            if centroids is not None:
                centroids = np.asarray(centroids, dtype=np.float64)[:clusters]
                clusters = len(centroids)
            final, before, sizes = clustering.spherical_kmeans(rows, clusters, kmeans_iters, seed, centroids, count)
            store.write_postings(clustering.assign(rows, final if final_assign else before), sizes, f"{staging}/postings")
            sizes = store.posting_sizes(store.read_postings(spark, staging), clusters)
            store.write_centroids(spark, final, sizes, f"{staging}/centroids")
            manifest = {"format": store.FORMAT, "count": count, "dim": dim, "n_clusters": clusters, "metric": store.METRIC, "layout": store.LAYOUT, "normalized": True, "metadata": metadata_col is not None}
            store.write_manifest(spark, manifest, f"{staging}/manifest")
            files.publish(staging, path)
        except BaseException:
            files.remove(staging)
            raise
        finally:
            scratch.remove(vectors)
        return cls(spark, path)

    def _open(self) -> None:
        if self._closed:
            raise RuntimeError("the index is closed")

    def search_df(self, query, k: int = 10, nprobe: int = 2, program: str | dsl.Program | None = None) -> Any:
        """What the program returns, lazily; an empty program is the default one."""
        self._open()
        if not isinstance(program, dsl.Program):
            program = dsl.assemble(program or dsl.DEFAULT)
        return dsl.run(program, self, query=query, k=k, nprobe=nprobe)

    def search(self, query, k: int = 10, nprobe: int = 2, program: str | dsl.Program | None = None) -> Any:
        """Results as a list of dicts, best first; whatever else a program returns stays as it is."""
        found = self.search_df(query, k, nprobe, program)
        if not isinstance(found, DataFrame):
            return found
        if "metadata" not in found.columns:
            return [{"id": r.id, "score": r.score} for r in found.collect()]
        rows = sorted(found.collect(), key=lambda r: (-r.score, r.id))
        return [{"id": r.id, "score": r.score, "metadata": json.loads(r.metadata)} for r in rows]

    def search_where(self, query, condition: Column, k: int = 10, nprobe: int = 2) -> DataFrame:
        """Like search_df, but only rows that meet a condition on id or metadata compete."""
        self._open()
        q = search.normalize_query(search.prepare_query(query, self.dim))
        cids = search.coarse(self.centroids, q, nprobe)
        return search.top_k(search.scan(search.where_metadata(self.postings, condition), cids, q), min(k, int(self.sizes[cids].sum())))

    def search_batch(self, queries: DataFrame, k: int = 10, nprobe: int = 2, exact: bool = False) -> DataFrame:
        """(qid, cid, id, score, rank) for queries (qid, q); exact looks into every cluster."""
        self._open()
        return search.batch_search(self.postings, queries, self.centroids, self.sizes, k, len(self.centroids) if exact else nprobe)

    def probes(self, queries: DataFrame, nprobe: int) -> DataFrame:
        """(qid, cid, rank) of the clusters that each query looks into."""
        self._open()
        return search.probed(queries, self.centroids, nprobe).select("qid", "cid", "rank")

    def cluster_sizes(self) -> DataFrame:
        self._open()
        return self.spark.createDataFrame([(c, int(n)) for c, n in enumerate(self.sizes)], "cid int, n long")

    def placed(self) -> DataFrame:
        """(cid, id, place) of all rows, numbered from 1 in the order of their posting, which is that of ids."""
        self._open()
        return store.placed(self.postings, self.sizes)

    def info(self) -> dict:
        return {**self.manifest, **backend()}

    def close(self) -> None:
        self._closed = True

    def __enter__(self) -> VectorIndex:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def devices(spark: SparkSession) -> list[str]:
    """Addresses of the GPUs that the driver was given, each once."""
    found = spark.sparkContext.resources.get("gpu")
    return list(dict.fromkeys(found.addresses)) if found else []


def check_backend(spark: SparkSession, name: str, device: int = 0) -> None:
    """cpu, or gpu where the session runs an accelerator's plugin, which then takes over the same plans on the devices it was given."""
    if name not in ("cpu", "gpu"):
        raise ValueError(f"the backend is cpu or gpu, not {name}")
    if name == "gpu" and "com.nvidia.spark.SQLPlugin" not in spark.sparkContext.getConf().get("spark.plugins", ""):
        raise RuntimeError("gpu needs a session with spark.plugins=com.nvidia.spark.SQLPlugin")
    if name == "gpu" and not 0 <= device < len(devices(spark)):
        raise ValueError(f"there is no device {device}: the session has {len(devices(spark))}")


def backend() -> dict:
    """What scores vectors here."""
    return {"backend": "spark", "spark_version": pyspark.__version__, "scorer": "Arrow blocks"}

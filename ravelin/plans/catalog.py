"""The engine's registered queries over `embeddings`, each with SQL for the same rows.

Batch searches take as queries the rows whose vec_id is divisible by 100, single searches the first row; all look at all rows. The index behind them starts its clusters
from the first `CLUSTERS` ids and makes `PASSES` passes, which SQL can repeat.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.functions import vectors as V
from ravelin.index import VectorIndex
from ravelin.operators import clustering, metrics, search
from ravelin.runtime import fresh_path, prepare
from ravelin.sources import store

CLUSTERS, PASSES, K = 16, 2, 10
#: Clusters that a single search and a batch look into; the rows are nearly unclustered, so high recall takes most clusters.
NPROBE, BATCH_NPROBE = 4, 14
EVERY = 100
#: How strongly the rows of the clustered table are drawn to their topic, seeds of the seeding queries, clusters of a search over the clustered table.
PULL, SEED, RESEED, FEW = 4, 123, 7, 2
UNITS = clustering.UNITS

_indexes: dict[tuple[str, str, str], VectorIndex] = {}


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/embeddings.parquet")


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, v) in single precision."""
    return embeddings(spark, sf_dir).select(F.col("vec_id").alias("id"), V.normalize("embedding").alias("v"))


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, embedding): every row drawn to one of the first CLUSTERS rows, so that clusters stand apart."""
    rows = normalized(spark, sf_dir)
    first = rows.orderBy("id").limit(CLUSTERS).select((F.row_number().over(Window.orderBy("id")) - 1).alias("topic"), F.col("v").alias("near"))
    drawn = rows.withColumn("topic", F.pmod("id", F.lit(CLUSTERS)).cast("int")).join(F.broadcast(first), "topic")
    x = F.zip_with(F.col("near").cast("array<double>"), F.col("v").cast("array<double>"), lambda a, b: (F.lit(float(PULL)) * a + b).cast("float"))
    return drawn.select(F.col("id").alias("vec_id"), x.alias("embedding"))


def _first(rows: DataFrame) -> np.ndarray:
    found = rows.orderBy("id").limit(CLUSTERS).collect()
    return np.array([r.v for r in found], dtype=np.float64)


def first_centroids(spark: SparkSession, sf_dir: str) -> np.ndarray:
    return _first(normalized(spark, sf_dir))


def _built(spark: SparkSession, sf_dir: str, name: str, rows: DataFrame) -> VectorIndex:
    """An index over (vec_id, embedding, metadata), built once per application, data and name."""
    key = spark.sparkContext.applicationId, sf_dir, name
    if key not in _indexes:
        start = _first(rows.select(F.col("vec_id").alias("id"), V.normalize("embedding").alias("v")))
        metadata = "metadata" if "metadata" in rows.columns else None
        _indexes[key] = VectorIndex.build(spark, fresh_path(spark, "index"), rows, id_col="vec_id", metadata_col=metadata, n_clusters=CLUSTERS, kmeans_iters=PASSES, centroids=start)
    return _indexes[key]


def index_of(spark: SparkSession, sf_dir: str) -> VectorIndex:
    """The index that the searches share."""
    return _built(spark, sf_dir, "main", embeddings(spark, sf_dir).withColumn("metadata", F.to_json(F.struct("label"))))


def first_query(spark: SparkSession, sf_dir: str) -> list[float]:
    return embeddings(spark, sf_dir).orderBy("vec_id").select("embedding").first().embedding


def queries_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).filter(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))


def vector_norm(spark, sf_dir):
    return embeddings(spark, sf_dir).select("vec_id", V.l2_norm("embedding").alias("norm"))


def normalize(spark, sf_dir):
    return normalized(spark, sf_dir).select("id", F.posexplode("v").alias("pos", "value")).select("id", "pos", F.col("value").cast("double").alias("value"))


def finite_vectors(spark, sf_dir):
    return embeddings(spark, sf_dir).select("vec_id", V.is_finite("embedding").alias("finite"), F.size("embedding").alias("dim"))


def dot_scores(spark, sf_dir):
    return search.scored(embeddings(spark, sf_dir), np.array(first_query(spark, sf_dir)), "embedding", ["vec_id"])


def cosine_topk(spark, sf_dir):
    q = search.normalize_query(np.array(first_query(spark, sf_dir), dtype=np.float32))
    return search.top_k(search.scored(normalized(spark, sf_dir), q, "v", ["id"]), K)


def raw_dot_topk(spark, sf_dir):
    return search.top_k(dot_scores(spark, sf_dir).withColumnRenamed("vec_id", "id"), K)


def seed_rows(spark, sf_dir):
    return normalized(spark, sf_dir).orderBy("id").limit(CLUSTERS).select((F.row_number().over(Window.orderBy("id")) - 1).alias("cid"), "id")


def cluster_assign(spark, sf_dir):
    return clustering.assign(normalized(spark, sf_dir), first_centroids(spark, sf_dir)).select("id", "cid")


def cluster_sizes(spark, sf_dir):
    return index_of(spark, sf_dir).cluster_sizes()


def _centroid_rows(spark, centroids):
    rows = [(c, p, float(x)) for c, v in enumerate(centroids) for p, x in enumerate(v)]
    return spark.createDataFrame(rows, "cid int, pos int, value double")


def lloyd_step(spark, sf_dir):
    return _centroid_rows(spark, clustering.lloyd_step(normalized(spark, sf_dir), first_centroids(spark, sf_dir))[0])


def cluster_centroids(spark, sf_dir):
    return _centroid_rows(spark, index_of(spark, sf_dir).centroids)


def posting_offsets(spark, sf_dir):
    """Where each posting would begin in one file of all rows. There is a row per cluster."""
    before = Window.orderBy("cid").rowsBetween(Window.unboundedPreceding, -1)
    return index_of(spark, sf_dir).cluster_sizes().select("cid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), "n")


def postings(spark, sf_dir):
    return index_of(spark, sf_dir).postings.select("id", "cid")


def coarse_probe(spark, sf_dir):
    return index_of(spark, sf_dir).probes(queries_of(spark, sf_dir), NPROBE)


def posting_scan(spark, sf_dir):
    index = index_of(spark, sf_dir)
    q = search.normalize_query(np.array(first_query(spark, sf_dir), dtype=np.float32))
    return search.scan(index.postings, search.coarse(index.centroids, q, NPROBE), q)


def ivf_search(spark, sf_dir):
    return index_of(spark, sf_dir).search_df(first_query(spark, sf_dir), K, NPROBE).select("id", "score")


def ivf_search_all_clusters(spark, sf_dir):
    return index_of(spark, sf_dir).search_df(first_query(spark, sf_dir), K, CLUSTERS).select("id", "score")


FILTER_PROGRAM = f"""
MOV p, {CLUSTERS}      ; every cluster
QLOAD q, $query
QNORM q
COARSE near, q, p
SCAN found, near, q
TOPK best, found, 50
FILTER kept, best, ==, label:0
RET kept
"""


def ivf_search_filter(spark, sf_dir):
    return index_of(spark, sf_dir).search_df(first_query(spark, sf_dir), program=FILTER_PROGRAM).select("id", "score")


def ivf_search_where(spark, sf_dir):
    label = F.get_json_object("metadata", "$.label") == "0"
    return index_of(spark, sf_dir).search_where(first_query(spark, sf_dir), label, K, CLUSTERS).select("id", "score")


def metadata_lookup(spark, sf_dir):
    found = index_of(spark, sf_dir).search_df(first_query(spark, sf_dir), K, NPROBE)
    return found.select("id", F.get_json_object("metadata", "$.label").cast("int").alias("label"), F.get_json_object("metadata", "$._id").cast("long").alias("told_id"))


def dsl_default_program(spark, sf_dir):
    from ravelin.plans import dsl

    return index_of(spark, sf_dir).search_df(first_query(spark, sf_dir), K, NPROBE, dsl.assemble(dsl.DEFAULT)).select("cid", "id", "score")


def dsl_raw_scores(spark, sf_dir):
    return index_of(spark, sf_dir).search_df(first_query(spark, sf_dir), program=f"QLOAD q $query\nCOARSE c q {NPROBE}\nSCAN s c q\nRET s").select("id", "score")


def batch_topk(spark, sf_dir):
    return index_of(spark, sf_dir).search_batch(queries_of(spark, sf_dir), K, exact=True).select("qid", "id", "score", "rank")


def batch_ivf(spark, sf_dir):
    return index_of(spark, sf_dir).search_batch(queries_of(spark, sf_dir), K, BATCH_NPROBE).select("qid", "id", "score", "rank")


def recall_at_k(spark, sf_dir):
    index, queries = index_of(spark, sf_dir), queries_of(spark, sf_dir)
    return metrics.recall_at_k(index.search_batch(queries, K, BATCH_NPROBE), index.search_batch(queries, K, exact=True))


def scanned_fraction(spark, sf_dir):
    index = index_of(spark, sf_dir)
    return metrics.scanned_fraction(index.cluster_sizes(), index.probes(queries_of(spark, sf_dir), BATCH_NPROBE))


def index_manifest(spark, sf_dir):
    told = index_of(spark, sf_dir).info()
    return spark.createDataFrame([(told["count"], told["dim"], told["n_clusters"], told["metric"], told["normalized"])], "count long, dim int, n_clusters int, metric string, normalized boolean")


def seed_by_hash(spark, sf_dir):
    """The rows that k-means starts from when it isn't told."""
    return _centroid_rows(spark, clustering.seed_centroids(normalized(spark, sf_dir), CLUSTERS, SEED))


def empty_cluster_reseed(spark, sf_dir):
    """A pass from centroids of which the second half repeats the first: its clusters stay empty and restart from seeded rows."""
    half = first_centroids(spark, sf_dir)[: CLUSTERS // 2]
    return _centroid_rows(spark, clustering.lloyd_step(normalized(spark, sf_dir), np.concatenate([half, half]), RESEED)[0])


def posting_order(spark, sf_dir):
    """Rows in the order in which a posting holds them: that of their ids."""
    return index_of(spark, sf_dir).placed()


LIMITS = ((0, 3), (-1, 3), (3, 0), (3, -5), (3, 99), (1_000_000_000, 1), (1_000_000_000, 99))


def search_clamps(spark, sf_dir):
    """How many results there are for limits out of range."""
    index, q = index_of(spark, sf_dir), first_query(spark, sf_dir)
    return spark.createDataFrame([(k, nprobe, index.search_df(q, k, nprobe).count()) for k, nprobe in LIMITS], "k long, nprobe int, n long")


FILTERS = {"even:True": "id % 2 = 0", "even:true": "false", "none:None": "true", "missing:None": "true", "tag:a:0": "label = 0", "nested:{'x': 0}": "label = 0", "label:0": "label = 0"}


def filter_values(spark, sf_dir):
    """FILTER on booleans, null, a missing key, a value that holds a colon, and a nested one."""
    told = F.struct("label", (F.col("vec_id") % 2 == 0).alias("even"), F.lit(None).cast("string").alias("none"), F.concat(F.lit("a:"), F.col("label").cast("string")).alias("tag"), F.struct(F.col("label").alias("x")).alias("nested"))
    index = _built(spark, sf_dir, "told", embeddings(spark, sf_dir).withColumn("metadata", F.to_json(told, {"ignoreNullFields": "false"})))
    q, out = first_query(spark, sf_dir), None
    for what in FILTERS:
        found = index.search_df(q, program=FILTER_PROGRAM.replace("label:0", f'"{what}"')).select(F.lit(what).alias("filter"), "id")
        out = found if out is None else out.unionByName(found)
    return out


def clustered_search(spark, sf_dir):
    """A batch that looks into few of the clusters of a table whose clusters stand apart."""
    rows = clustered(spark, sf_dir)
    queries = rows.filter(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    return _built(spark, sf_dir, "clustered", rows).search_batch(queries, K, FEW).select("qid", "id", "score", "rank")


def rejections(spark, sf_dir):
    """What a build must refuse, made from the table's own rows; nothing may be left behind."""
    rows = embeddings(spark, sf_dir).select("vec_id", "embedding")
    cases = {
        "repeated ids": rows.unionByName(rows),
        "null id": rows.withColumn("vec_id", F.when(F.col("vec_id") != F.lit(0), F.col("vec_id"))),
        "floating ids": rows.withColumn("vec_id", F.col("vec_id").cast("double")),
        "ragged": rows.withColumn("embedding", F.when(F.col("vec_id") % 2 == 0, F.slice("embedding", 1, 2)).otherwise(F.col("embedding"))),
        "not a number": rows.withColumn("embedding", F.transform("embedding", lambda x: F.lit(float("nan")).cast("float"))),
        "null vectors": rows.withColumn("embedding", F.lit(None).cast("array<float>")),
        "metadata no object": rows.withColumn("metadata", F.lit("[1]")),
        "metadata not JSON": rows.withColumn("metadata", F.lit('{"a": NaN}')),
        "no rows": rows.filter("false"),
        "fine": rows,
    }
    out = []
    for name, df in cases.items():
        path, refused = fresh_path(spark, "refused"), False
        try:
            VectorIndex.build(spark, path, df, id_col="vec_id", metadata_col="metadata" if "metadata" in df.columns else None, n_clusters=2, kmeans_iters=1)
        except (TypeError, ValueError):
            refused = store.Files(spark, path).free(path)
        out.append((name, refused))
    return spark.createDataFrame(out, "name string, refused boolean")


NAMES = (vector_norm, normalize, finite_vectors, dot_scores, cosine_topk, raw_dot_topk, seed_rows, cluster_assign, cluster_sizes, lloyd_step, cluster_centroids, posting_offsets, postings, coarse_probe, posting_scan, ivf_search, ivf_search_all_clusters, ivf_search_filter, ivf_search_where, metadata_lookup, dsl_default_program, dsl_raw_scores, batch_topk, batch_ivf, recall_at_k, scanned_fraction, index_manifest, seed_by_hash, empty_cluster_reseed, posting_order, search_clamps, filter_values, clustered_search, rejections)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in NAMES}

_UNIT = "list_transform({v}, lambda y: y / CASE WHEN list_dot_product({v}, {v}) = 0 THEN 1 ELSE sqrt(list_dot_product({v}, {v})) END)"


_ROWS = ["e AS MATERIALIZED (SELECT vec_id AS id, label, list_transform(embedding, lambda y: CAST(y AS DOUBLE)) AS x FROM embeddings)"]

#: The clustered table in the place of the plain one.
_CLUSTERED = [
    "e0 AS (SELECT vec_id AS id, label, list_transform(embedding, lambda y: CAST(y AS DOUBLE)) AS x FROM embeddings)",
    f"v0 AS MATERIALIZED (SELECT id, label, list_transform({_UNIT.format(v='x')}, lambda y: CAST(CAST(y AS FLOAT) AS DOUBLE)) AS v FROM e0)",
    f"t0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY id) - 1 AS topic, v AS near FROM (SELECT * FROM v0 ORDER BY id LIMIT {CLUSTERS}))",
    f"e AS MATERIALIZED (SELECT id, label, list_transform(list_zip(near, v), lambda y: CAST(CAST({PULL}.0::DOUBLE * y[1] + y[2] AS FLOAT) AS DOUBLE)) AS x FROM v0 JOIN t0 ON topic = id % {CLUSTERS})",
]


def _with(rows: list[str] = _ROWS) -> str:
    parts = [
        *rows,
        f"v AS MATERIALIZED (SELECT id, label, x, list_transform({_UNIT.format(v='x')}, lambda y: CAST(CAST(y AS FLOAT) AS DOUBLE)) AS v FROM e)",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS cid, id, v AS c FROM (SELECT * FROM v ORDER BY id LIMIT {CLUSTERS}))",
    ]
    for i in range(PASSES + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT v.id, any_value(v.v) AS v, any_value(label) AS label, arg_max(cid, row(list_dot_product(v.v, c), -cid)) AS cid FROM v CROSS JOIN c{i} GROUP BY v.id)")
        if i < PASSES:
            parts += [
                f"s{i} AS (SELECT cid, pos, CAST(CAST(sum(CAST(floor(v[pos] * {UNITS} + 0.5) AS BIGINT)) AS BIGINT) AS DOUBLE) / count(*) / {UNITS}.0 AS m FROM a{i}, unnest(range(1, len(v) + 1)) AS t(pos) GROUP BY cid, pos)",
                f"m{i} AS (SELECT cid, list(m ORDER BY pos) AS m FROM s{i} GROUP BY cid)",
                f"u{i} AS (SELECT cid, m, sqrt(list_reduce(list_transform(m, lambda y: y * y), lambda s, y: s + y)) AS norm FROM m{i})",
                f"c{i + 1} AS MATERIALIZED (SELECT cid, list_transform(m, lambda y: CAST(CAST(y / CASE WHEN norm = 0 THEN 1 ELSE norm END AS FLOAT) AS DOUBLE)) AS c FROM u{i})",
            ]
    last = PASSES
    parts += [
        f"z AS (SELECT c0.cid, CAST(count(a{last}.id) AS BIGINT) AS n FROM c0 LEFT JOIN a{last} ON a{last}.cid = c0.cid GROUP BY c0.cid)",
        "q AS MATERIALIZED (SELECT id AS qid, x, v AS q FROM v WHERE id = (SELECT min(id) FROM v))",
        f"qs AS MATERIALIZED (SELECT id AS qid, v AS q FROM v WHERE id % {EVERY} = 0)",
        f"p AS MATERIALIZED (SELECT qid, cid, CAST(row_number() OVER (PARTITION BY qid ORDER BY list_dot_product(c, q) DESC, cid) AS INTEGER) AS rank FROM qs, c{last})",
        f"p1 AS MATERIALIZED (SELECT cid, row_number() OVER (ORDER BY list_dot_product(c, q) DESC, cid) AS rank FROM q, c{last})",
        f"f AS (SELECT a.cid, a.id, a.label, list_dot_product(a.v, q) AS score, p1.rank AS probe FROM a{last} a JOIN p1 USING (cid), q)",
        f"top AS (SELECT * FROM f WHERE probe <= {NPROBE} ORDER BY score DESC, id LIMIT {K})",
        f"b AS (SELECT qid, a.id, a.cid, list_dot_product(a.v, q) AS score FROM qs, a{last} a)",
        f"bx AS (SELECT * FROM (SELECT qid, id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS rank FROM b) WHERE rank <= {K})",
        f"bi AS (SELECT * FROM (SELECT qid, id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS rank FROM b JOIN (SELECT qid, cid FROM p WHERE rank <= {BATCH_NPROBE}) USING (qid, cid)) WHERE rank <= {K})",
    ]
    return "WITH " + ",\n".join(parts) + "\n"


_BODIES = {
    "vector_norm": "SELECT id AS vec_id, sqrt(list_dot_product(x, x)) AS norm FROM e",
    "normalize": "SELECT id, CAST(pos - 1 AS INTEGER) AS pos, v[pos] AS value FROM v, unnest(range(1, len(v) + 1)) AS t(pos)",
    "finite_vectors": "SELECT id AS vec_id, len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AS finite, CAST(len(x) AS INTEGER) AS dim FROM e",
    "dot_scores": "SELECT e.id AS vec_id, list_dot_product(e.x, q.x) AS score FROM e, q",
    "cosine_topk": f"SELECT id, list_dot_product(v, q) AS score FROM v, q ORDER BY score DESC, id LIMIT {K}",
    "raw_dot_topk": f"SELECT e.id, list_dot_product(e.x, q.x) AS score FROM e, q ORDER BY score DESC, id LIMIT {K}",
    "seed_rows": "SELECT cid, id FROM c0",
    "cluster_assign": "SELECT id, cid FROM a0",
    "cluster_sizes": "SELECT cid, n FROM z",
    "lloyd_step": "SELECT cid, CAST(pos - 1 AS INTEGER) AS pos, c[pos] AS value FROM c1, unnest(range(1, len(c) + 1)) AS t(pos)",
    "cluster_centroids": f"SELECT cid, CAST(pos - 1 AS INTEGER) AS pos, c[pos] AS value FROM c{PASSES}, unnest(range(1, len(c) + 1)) AS t(pos)",
    "posting_offsets": "SELECT cid, CAST(coalesce(sum(n) OVER (ORDER BY cid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first, n FROM z",
    "postings": f"SELECT id, cid FROM a{PASSES}",
    "coarse_probe": f"SELECT qid, cid, rank FROM p WHERE rank <= {NPROBE}",
    "posting_scan": f"SELECT cid, id, score FROM f WHERE probe <= {NPROBE}",
    "ivf_search": "SELECT id, score FROM top",
    "ivf_search_all_clusters": f"SELECT id, score FROM f ORDER BY score DESC, id LIMIT {K}",
    "ivf_search_filter": "SELECT id, score FROM (SELECT * FROM f ORDER BY score DESC, id LIMIT 50) WHERE label = 0",
    "ivf_search_where": f"SELECT id, score FROM f WHERE label = 0 ORDER BY score DESC, id LIMIT {K}",
    "metadata_lookup": "SELECT id, label, id AS told_id FROM top",
    "dsl_default_program": "SELECT cid, id, score FROM top",
    "dsl_raw_scores": f"SELECT id, list_dot_product(a.v, q.x) AS score FROM a{PASSES} a, q WHERE a.cid IN (SELECT cid FROM (SELECT cid FROM c{PASSES}, q ORDER BY list_dot_product(c, q.x) DESC, cid LIMIT {NPROBE}))",
    "batch_topk": "SELECT qid, id, score, rank FROM bx",
    "batch_ivf": "SELECT qid, id, score, rank FROM bi",
    "recall_at_k": "SELECT bx.qid, CAST(count(*) AS BIGINT) AS n_exact, CAST(count(bi.id) AS BIGINT) AS n_found, count(bi.id) / CAST(count(*) AS DOUBLE) AS recall FROM bx LEFT JOIN bi ON bi.qid = bx.qid AND bi.id = bx.id GROUP BY bx.qid",
    "scanned_fraction": f"SELECT qid, CAST(sum(n) AS BIGINT) AS n_scanned, CAST(sum(n) AS DOUBLE) / (SELECT sum(n) FROM z) AS fraction FROM p JOIN z USING (cid) WHERE rank <= {BATCH_NPROBE} GROUP BY qid",
    "index_manifest": f"SELECT CAST(count(*) AS BIGINT) AS count, CAST(max(len(x)) AS INTEGER) AS dim, CAST(least({CLUSTERS}, count(*)) AS INTEGER) AS n_clusters, 'cosine' AS metric, true AS normalized FROM e",
}

_seeded = lambda seed, n: f"(SELECT CAST(row_number() OVER (ORDER BY md5('{seed}:' || id), id) - 1 AS INTEGER) AS cid, v AS c FROM v ORDER BY cid LIMIT {n})"
_BODIES |= {
    "seed_by_hash": f"SELECT cid, CAST(pos - 1 AS INTEGER) AS pos, c[pos] AS value FROM {_seeded(SEED, CLUSTERS)}, unnest(range(1, len(c) + 1)) AS t(pos)",
    "empty_cluster_reseed": f"""SELECT cid, CAST(pos - 1 AS INTEGER) AS pos, c[pos] AS value FROM (
        SELECT cid, list_transform(m, lambda y: CAST(CAST(y / CASE WHEN norm = 0 THEN 1 ELSE norm END AS FLOAT) AS DOUBLE)) AS c FROM (
          SELECT cid, m, sqrt(list_reduce(list_transform(m, lambda y: y * y), lambda s, y: s + y)) AS norm FROM (
            SELECT cid, list(m ORDER BY i) AS m FROM (
              SELECT cid, i, CAST(CAST(sum(CAST(floor(v[i] * {UNITS} + 0.5) AS BIGINT)) AS BIGINT) AS DOUBLE) / count(*) / {UNITS}.0 AS m FROM (
                SELECT v.id, any_value(v.v) AS v, arg_max(cid, row(list_dot_product(v.v, c), -cid)) AS cid FROM v CROSS JOIN (SELECT * FROM c0 WHERE cid < {CLUSTERS // 2}) GROUP BY v.id), unnest(range(1, len(v) + 1)) AS t(i)
              GROUP BY cid, i) GROUP BY cid))
        UNION ALL SELECT cid + {CLUSTERS // 2}, c FROM {_seeded(RESEED, CLUSTERS // 2)}), unnest(range(1, len(c) + 1)) AS t(pos)""",
    "posting_order": f"SELECT cid, id, CAST(row_number() OVER (PARTITION BY cid ORDER BY id) AS INTEGER) AS place FROM a{PASSES}",
    "search_clamps": f"SELECT k, nprobe, CAST(least(greatest(k, 0), count(f.id)) AS BIGINT) AS n FROM (VALUES {', '.join(f'({k}::BIGINT, {p}::INTEGER)' for k, p in LIMITS)}) AS t(k, nprobe) LEFT JOIN f ON f.probe <= greatest(1, least(nprobe, {CLUSTERS})) GROUP BY k, nprobe",
    "filter_values": "SELECT filter, id FROM (SELECT * FROM f ORDER BY score DESC, id LIMIT 50), (VALUES " + ", ".join("('" + x.replace("'", "''") + "')" for x in FILTERS) + ") AS t(filter) WHERE CASE filter " + " ".join("WHEN '" + x.replace("'", "''") + f"' THEN {c}" for x, c in FILTERS.items()) + " END",
    "clustered_search": f"SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM b JOIN (SELECT qid, cid FROM p WHERE rank <= {FEW}) USING (qid, cid)) WHERE rank <= {K}",
    "rejections": "SELECT name, name <> 'fine' AS refused FROM (VALUES ('repeated ids'), ('null id'), ('floating ids'), ('ragged'), ('not a number'), ('null vectors'), ('metadata no object'), ('metadata not JSON'), ('no rows'), ('fine')) AS t(name)",
}

ORACLE_SQL = {name: _with(_CLUSTERED if name == "clustered_search" else _ROWS) + body for name, body in _BODIES.items()}

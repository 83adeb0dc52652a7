from __future__ import annotations

import hashlib
import json
import os
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ravelin import VectorIndex, cli
from ravelin.index import devices
from ravelin.operators import clustering, kernels, metrics, search
from ravelin.sources import store
from ravelin.streaming.search_stream import search_stream

ROWS, DIM = 101, 17


def table(spark, matrix, ids=None, metadata=None, kind="float"):
    ids = range(len(matrix)) if ids is None else ids
    rows = [(int(i), [float(x) for x in v], None if metadata is None else json.dumps(metadata[n], ensure_ascii=False)) for n, (i, v) in enumerate(zip(ids, matrix))]
    return spark.createDataFrame(rows, f"id long, embedding array<{kind}>, metadata string")


@pytest.fixture(scope="module")
def matrix():
    return np.random.default_rng(10).normal(size=(ROWS, DIM)).astype(np.float32)


@pytest.fixture(scope="module")
def index(spark, matrix, tmp_path_factory):
    told = [{"tag": "Кирилл", "even": i % 2 == 0, "n": i * 1.0, "odd": "a:b c" if i % 2 else None} for i in range(ROWS)]
    path = str(tmp_path_factory.mktemp("index") / "main")
    return VectorIndex.build(spark, path, table(spark, matrix, metadata=told), metadata_col="metadata", n_clusters=8, kmeans_iters=2)


def exact(matrix, q, k):
    unit = lambda m: (m.astype(float) / np.linalg.norm(m.astype(float), axis=-1, keepdims=True)).astype(np.float32)
    s = unit(matrix).astype(float) @ unit(np.asarray(q, dtype=np.float32)).astype(float)
    return [(int(i), s[i]) for i in np.lexsort((np.arange(len(s)), -s))[:k]]


def test_all_clusters_are_exact(index, matrix):
    for row in (0, 50, 100):
        got = index.search(matrix[row], k=5, nprobe=8)
        want = exact(matrix, matrix[row], 5)
        assert [r["id"] for r in got] == [i for i, _ in want] and got[0]["id"] == row
        assert [r["score"] for r in got] == pytest.approx([s for _, s in want], abs=1e-6)
        assert got[0]["metadata"]["tag"] == "Кирилл" and got[0]["metadata"]["_id"] == row


def test_clamps(index, matrix):
    assert index.search(matrix[0], k=0) == [] and index.search(matrix[0], k=-1) == []
    assert len(index.search(matrix[0], k=ROWS + 1, nprobe=99)) == ROWS
    assert len(index.search(matrix[0], k=ROWS, nprobe=0)) == index.sizes[search.coarse(index.centroids, search.normalize_query(matrix[0]), 1)[0]]


def test_candidates_and_recall_grow_with_probes(index, matrix, spark):
    queries = spark.createDataFrame([(i, [float(x) for x in matrix[i]]) for i in range(0, ROWS, 10)], "qid long, q array<float>")
    truth = index.search_batch(queries, 5, exact=True)
    before = 0.0
    for nprobe in (1, 2, 4, 8):
        found = index.search_batch(queries, 5, nprobe)
        probed = index.probes(queries, nprobe).select("qid", "cid")
        assert found.join(probed, ["qid", "cid"], "left_anti").count() == 0
        recall = metrics.recall_at_k(found, truth).agg(F.avg("recall")).first()[0]
        assert recall >= before
        before = recall
    assert before == 1.0
    share = metrics.scanned_fraction(index.cluster_sizes(), index.probes(queries, 8)).collect()
    assert all(r.fraction == 1.0 and r.n_scanned == ROWS for r in share)


def test_batch_agrees_with_single(index, matrix, spark):
    queries = spark.createDataFrame([(i, [float(x) for x in matrix[i]]) for i in (3, 77)], "qid long, q array<float>")
    rows = index.search_batch(queries, 4, 3).collect()
    for i in (3, 77):
        single = index.search(matrix[i], 4, 3)
        assert [(r.id, r.score) for r in sorted(rows, key=lambda r: r.rank) if r.qid == i] == [(r["id"], r["score"]) for r in single]
    assert index.search_batch(queries, 0).count() == 0
    assert index.search_batch(queries.limit(0), 3).count() == 0


def test_only_probed_clusters_are_read(index, matrix, spark):
    plan = index.search_df(matrix[0], 5, 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cid#" in plan and "TakeOrderedAndProject" in plan
    scan = plan[plan.index("PartitionFilters") :][:80]
    assert " IN (" in scan


def test_filter_is_a_post_filter_on_written_values(index, matrix):
    program = "QLOAD q $query\nQNORM q\nCOARSE c q 8\nSCAN s c q\nTOPK t s {k}\nFILTER f t == '{f}'\nRET f"
    ids = lambda k, f: [r["id"] for r in index.search(matrix[0], program=program.format(k=k, f=f))]
    top = [i for i, _ in exact(matrix, matrix[0], 20)]
    assert ids(20, "even:True") == [i for i in top if i % 2 == 0]
    assert ids(20, "even:true") == []
    assert ids(20, "odd:None") == [i for i in top if i % 2 == 0]
    assert ids(20, "missing:None") == top
    assert ids(20, "odd:a:b c") == [i for i in top if i % 2]
    assert ids(20, "n:0.0") == [0]
    with pytest.raises(ValueError):
        ids(5, "nothing")
    with pytest.raises(SyntaxError):
        index.search(matrix[0], program="QLOAD q $query\nCOARSE c q 8\nSCAN s c q\nTOPK t s 3\nFILTER f t != a:b\nRET f")


def test_other_registers_can_be_returned(index, matrix):
    clusters = index.search(matrix[0], program="QLOAD q $query\nCOARSE c q 2.7\nRET c")
    assert len(clusters) == 2
    raw = index.search_df(matrix[0] * 2, program="QLOAD q $query\nCOARSE c q 8\nSCAN s c q\nTOPK t s 1\nRET t").first()
    assert raw.score == pytest.approx(2 * np.linalg.norm(matrix[0]), rel=1e-5)  # without QNORM it is a dot product
    assert index.search_df(matrix[0], program="QLOAD q $query\nCOARSE c q 8\nSCAN s c q\nRET s").count() == ROWS
    assert index.search(matrix[0], 3, 8, program="") == index.search(matrix[0], 3, 8)


def test_where_filters_before_top_k(index, matrix):
    got = index.search_where(matrix[1], F.get_json_object("metadata", "$.even") == "true", 5, 8).collect()
    assert len(got) == 5 and all(r.id % 2 == 0 for r in got)


def test_concurrent_searches(index, matrix):
    with ThreadPoolExecutor(4) as pool:
        assert [r[0]["id"] for r in pool.map(lambda i: index.search(matrix[i], 1, 8), range(8))] == list(range(8))


def test_ties_zero_vectors_and_large_norms(spark, tmp_path):
    m = np.array([[1, 0], [1, 0], [2, 0], [0, 0], [3e38, 3e38]], dtype=np.float32)
    with VectorIndex.build(spark, str(tmp_path / "i"), table(spark, m, ids=[9, 4, 7, 1, 2]), n_clusters=50) as index:
        got = index.search([5, 0], 5, 99)
        assert [r["id"] for r in got] == [4, 7, 9, 2, 1]
        assert [r["score"] for r in got] == pytest.approx([1, 1, 1, 0.5**0.5, 0], abs=1e-6)
        assert "metadata" not in got[0] and index.manifest["n_clusters"] == 5
        assert all(r["score"] == 0 for r in index.search([0, 0], 5, 5))
        program = "QLOAD q $query\nQNORM q\nCOARSE c q 5\nSCAN s c q\nTOPK t s 5\nFILTER f t == x\nRET f"
        assert len(index.search([1, 0], program=program)) == 5  # without metadata nothing is filtered
    with pytest.raises(RuntimeError):
        index.search([1, 0])
    index.close()


@pytest.mark.parametrize("rows", [[], [[]], [[1, 2], [1]], [[float("nan"), 1]], [[float("inf"), 1]], [None], [[None, 1]], [[1e39, 1]]])
def test_invalid_vectors_leave_nothing(spark, tmp_path, rows):
    df = spark.createDataFrame([(i, v if v is None else [None if x is None else float(x) for x in v]) for i, v in enumerate(rows)], "id long, embedding array<double>")
    with pytest.raises(ValueError):
        VectorIndex.build(spark, str(tmp_path / "i"), df)
    assert os.listdir(tmp_path) == []


def test_invalid_ids_metadata_and_arguments(spark, tmp_path, matrix):
    path = str(tmp_path / "i")
    with pytest.raises(ValueError):
        VectorIndex.build(spark, path, table(spark, matrix[:2], ids=[1, 1]))
    for column in (F.lit(1.5), F.lit(True), F.lit("1")):
        with pytest.raises(TypeError):
            VectorIndex.build(spark, path, table(spark, matrix[:2]).withColumn("id", column))
    with pytest.raises(ValueError):
        VectorIndex.build(spark, path, table(spark, matrix[:2]).withColumn("id", F.lit(None).cast("long")))
    for k in ({"n_clusters": 0}, {"kmeans_iters": 0}):
        with pytest.raises(ValueError):
            VectorIndex.build(spark, path, table(spark, matrix[:2]), **k)
    with pytest.raises(Exception, match="NaN"):
        VectorIndex.build(spark, path, table(spark, matrix[:2]).withColumn("metadata", F.lit('{"a": NaN}')), metadata_col="metadata")
    assert os.listdir(tmp_path) == []


def test_destination_rules_and_corruption(spark, tmp_path, matrix):
    path = tmp_path / "i"
    path.mkdir()
    index = VectorIndex.build(spark, str(path), table(spark, matrix[:20]), n_clusters=3)
    with pytest.raises(FileExistsError):
        VectorIndex.build(spark, str(path), table(spark, matrix[:20]))
    assert VectorIndex(spark, str(path)).search(matrix[3], 1, 3)[0]["id"] == 3
    assert index.info()["count"] == 20 and index.info()["backend"] == "spark"
    with pytest.raises(FileNotFoundError):
        VectorIndex(spark, str(tmp_path / "none"))
    for change, error in (({"format": "x"}, ValueError), ({"metric": "l2"}, ValueError), ({"count": 999}, ValueError), ({"dim": 0}, ValueError), ({"count": None}, (KeyError, TypeError))):
        other = tmp_path / "other"
        os.system(f"rm -rf {other}; cp -r {path} {other}; rm -rf {other}/manifest; mkdir {other}/manifest")
        manifest = {**index.manifest, **change}
        (other / "manifest" / "part.txt").write_text(json.dumps({k: v for k, v in manifest.items() if v is not None}))
        with pytest.raises(error):
            VectorIndex(spark, str(other))


def test_labels_one_step_behind(spark, tmp_path, matrix):
    rows = table(spark, matrix[:60])
    start = matrix[:4].astype(float) / np.linalg.norm(matrix[:4].astype(float), axis=1, keepdims=True)
    index = VectorIndex.build(spark, str(tmp_path / "stale"), rows, kmeans_iters=1, centroids=start, final_assign=False)
    stored = {r.id: r.cid for r in index.postings.select("id", "cid").collect()}
    unit = (matrix[:60].astype(float) / np.linalg.norm(matrix[:60].astype(float), axis=1, keepdims=True)).astype(np.float32)
    assert stored == dict(enumerate((unit.astype(float) @ start.T).argmax(axis=1).tolist()))


def test_empty_clusters_restart_and_can_be_probed(spark, tmp_path):
    m = np.array([[1, 0]] * 6 + [[0, 1]] * 6, dtype=np.float32)
    index = VectorIndex.build(spark, str(tmp_path / "e"), table(spark, m), n_clusters=6, kmeans_iters=2)
    assert index.sizes.sum() == 12 and (index.sizes == 0).any()
    assert [r["id"] for r in index.search([0, 1], 3, 6)] == [6, 7, 8]
    assert isinstance(index.search([0, 1], 3, 1), list)


def test_lloyd_step_matches_brute_force(spark, matrix):
    unit = (matrix.astype(float) / np.linalg.norm(matrix.astype(float), axis=1, keepdims=True)).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(unit)], "id long, v array<float>")
    got, sizes = clustering.lloyd_step(df, unit[:5])
    assert sizes.sum() == ROWS
    label = (unit @ unit[:5].T).argmax(axis=1)
    want = np.array([unit[label == c].mean(axis=0) for c in range(5)])
    assert got == pytest.approx(want / np.linalg.norm(want, axis=1, keepdims=True), abs=1e-6)


def test_recall_on_clustered_rows(spark, tmp_path):
    rng = np.random.default_rng(5)
    topics = rng.normal(size=(16, 24))
    topics /= np.linalg.norm(topics, axis=1, keepdims=True)
    m = (topics[rng.integers(0, 16, 1600)] + rng.normal(scale=0.1, size=(1600, 24))).astype(np.float32)
    index = VectorIndex.build(spark, str(tmp_path / "c"), table(spark, m), n_clusters=16)
    queries = spark.createDataFrame([(i, [float(x) for x in m[i]]) for i in range(0, 1600, 100)], "qid long, q array<float>")
    recall = metrics.recall_at_k(index.search_batch(queries, 10, 4), index.search_batch(queries, 10, exact=True))
    assert recall.agg(F.avg("recall")).first()[0] >= 0.9


def test_command_line(spark, index, matrix, tmp_path, capsys):
    np.save(tmp_path / "q.npy", matrix[5])
    assert cli.main(["search", index.path, str(tmp_path / "q.npy"), "-k", "2", "--nprobe", "8"], spark) == 0
    assert json.loads(capsys.readouterr().out)[0]["id"] == 5
    (tmp_path / "p.txt").write_text("QLOAD q $query\nCOARSE c q 3\nRET c")
    cli.main(["search", index.path, str(tmp_path / "q.npy"), "--program", str(tmp_path / "p.txt")], spark)
    assert len(json.loads(capsys.readouterr().out)) == 3
    cli.main(["info", index.path], spark)
    assert json.loads(capsys.readouterr().out)["count"] == ROWS
    cli.main(["backend"])
    assert json.loads(capsys.readouterr().out)["backend"] == "spark"


def test_backends(spark, index):
    assert VectorIndex(spark, index.path, backend="cpu").dim == DIM and devices(spark) == []
    with pytest.raises(ValueError):
        VectorIndex(spark, index.path, backend="tpu")
    with pytest.raises(RuntimeError):
        VectorIndex(spark, index.path, backend="gpu")


def test_stream_of_queries(spark, index, matrix, tmp_path):
    queries = spark.createDataFrame([(i, [float(x) for x in matrix[i]]) for i in (1, 2)], "qid long, q array<float>")
    queries.write.parquet(str(tmp_path / "in"))
    got = []
    stream = search_stream(spark.readStream.schema(queries.schema).parquet(str(tmp_path / "in")), index, lambda df, n: got.extend(df.collect()), str(tmp_path / "checkpoint"), k=1, nprobe=8)
    stream.awaitTermination(120)
    assert sorted((r.qid, r.id) for r in got) == [(1, 1), (2, 2)]


def test_arrays_ids_and_metadata(spark, tmp_path, matrix):
    index = VectorIndex.build(spark, str(tmp_path / "a"), matrix, n_clusters=3)
    assert [r["id"] for r in index.search(matrix[7], 2, 3)] == [i for i, _ in exact(matrix, matrix[7], 2)] and not index.has_metadata
    index = VectorIndex.build(spark, str(tmp_path / "b"), matrix[:4].tolist(), ids=np.array([5, 6, 7, 2**63 - 1], dtype=np.uint64), metadata=[{"x": 1}, {"_id": 9}, {"y": [None]}, {}], n_clusters=2)
    assert index.search(matrix[3], 1, 2)[0]["id"] == 2**63 - 1 and index.search(matrix[1], 1, 2)[0]["metadata"] == {"_id": 6}
    bad = [({"ids": [1]}, ValueError), ({"ids": [0, 0]}, ValueError), ({"ids": [0.0, 1.0]}, TypeError), ({"ids": [True, False]}, TypeError), ({"ids": np.array([1, 2**63], dtype=np.uint64)}, ValueError), ({"metadata": [{}]}, ValueError), ({"metadata": [{}, {"a": float("nan")}]}, ValueError), ({"metadata": [{}, [1]]}, ValueError)]
    for k, error in bad:
        with pytest.raises(error):
            VectorIndex.build(spark, str(tmp_path / "c"), matrix[:2], **k)
    for vectors in (np.zeros((0, 3)), np.zeros(3), np.zeros((2, 0)), [[1.0], [float("nan")]]):
        with pytest.raises(ValueError):
            VectorIndex.build(spark, str(tmp_path / "c"), vectors)
    assert sorted(os.listdir(tmp_path)) == ["a", "b"]


def test_thousands_of_large_clusters_are_dealt(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "FILE_ROWS", 1)
    rows = spark.range(10_000).selectExpr("id", "array(cast(id as float)) v", "id pos", "cast(null as string) metadata", "cast(id % 5000 as int) cid")
    for limit in (store.BROADCAST_BYTES, 0):
        monkeypatch.setattr(store, "BROADCAST_BYTES", limit)
        pieces = store.dealt(rows, np.full(5000, 4)).groupBy("piece").count().collect()
        assert sorted(r.piece for r in pieces) == [0, 1, 2, 3] and sum(r["count"] for r in pieces) == 10_000
    few = rows.filter("id < 60").withColumn("cid", (F.col("id") % 6).cast("int"))
    store.write_postings(few, np.array([10] * 5 + [1]), f"{tmp_path}/postings")
    back = store.read_postings(spark, str(tmp_path))
    assert (store.posting_sizes(back, 6) == 10).all() and back.agg(F.sum("id")).first()[0] == sum(range(60))


def test_postings_hold_rows_by_id_in_pieces_too(spark, tmp_path, monkeypatch):
    rows = spark.range(3000, numPartitions=3).selectExpr("(id * 7919) % 3001 - 1500 as id", "array(1f) v", "id pos", "cast(null as string) metadata", "cast(if(id % 10 < 7, 0, id % 3 + 1) as int) cid")
    want = {}
    for r in sorted(rows.select("cid", "id").collect()):
        want.setdefault(r.cid, []).append(r.id)
    sizes = np.array([len(want[c]) for c in sorted(want)])
    assert sizes[0] == 2100 and (sizes[1:] <= 310).all()
    expected = sorted((c, i, n + 1) for c, ids in want.items() for n, i in enumerate(ids))
    for case, (file_rows, limit) in enumerate([(1 << 20, 1 << 20), (400, 1 << 20), (400, 0), (50, 1 << 20)]):  # no large cluster, one, one without a broadcast, four
        monkeypatch.setattr(store, "FILE_ROWS", file_rows)
        monkeypatch.setattr(store, "BROADCAST_BYTES", limit)
        store.write_postings(rows, sizes, f"{tmp_path}/{case}/postings")
        files = [pq.read_table(p, columns=["id"], partitioning=None)["id"].to_pylist() for p in (tmp_path / str(case)).rglob("*.parquet")]
        assert all(f == sorted(f) for f in files) and sum(map(len, files)) == 3000
        found = store.placed(store.read_postings(spark, f"{tmp_path}/{case}"), sizes)
        assert found.dtypes == [("cid", "int"), ("id", "bigint"), ("place", "int")]
        assert sorted(map(tuple, found.collect())) == expected


def test_a_pass_sends_a_row_per_cluster(spark):
    rng = np.random.default_rng(8)
    centroids = kernels.unit(rng.normal(size=(4096, 768))).astype(np.float32).astype(float)
    rows = spark.createDataFrame([(i, centroids[i * 8].tolist()) for i in range(500)], "id long, v array<float>")
    sizes, sums = clustering.cluster_sums(rows, centroids)
    assert sizes.sum() == 500 and (sizes[::8][:500] == 1).all()
    assert (sums[::8][:500] == np.floor(centroids[::8][:500] * clustering.UNITS + 0.5)).all()


def test_many_centroids_go_in_groups(spark, matrix, monkeypatch):
    unit = kernels.unit(matrix.astype(float)).astype(np.float32).astype(float)
    rows = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(unit)], "id long, v array<float>, other string")
    centroids = np.concatenate([unit[:9], unit[:9]])  # ties go to the first
    queries = rows.selectExpr("id as qid", "v as q")

    def run():
        labels = {r.id: r.cid for r in clustering.assign(rows, centroids).collect()}
        probes = sorted((r.qid, r.rank, r.cid) for r in search.probed(queries, centroids, 5).collect())
        return labels, probes, [x.tolist() for x in clustering.cluster_sums(rows, centroids)]

    whole = run()
    assert whole[0] == dict(enumerate((unit @ unit[:9].T).argmax(axis=1).tolist()))
    monkeypatch.setattr(clustering, "BROADCAST_BYTES", 4 * DIM * 4)
    monkeypatch.setattr(clustering, "SUM_BYTES", 1)
    assert run() == whole


def test_seeds_begin_the_seeded_order(spark, matrix):
    rows = spark.createDataFrame([(i, [float(i)]) for i in range(3000)], "id long, v array<float>")
    want = sorted(range(3000), key=lambda i: hashlib.md5(f"5:{i}".encode()).hexdigest())[:7]
    assert clustering.seed_centroids(rows, 7, 5)[:, 0].tolist() == want
    assert clustering.seed_centroids(rows, 7, 5, 10**9)[:, 0].tolist() == want  # too few at first
    assert len(clustering.seed_centroids(rows.limit(3), 7, 5)) == 3


def test_large_batches_are_joined(spark, index, matrix, monkeypatch):
    queries = spark.createDataFrame([(i, [float(x) for x in matrix[i]]) for i in range(60)], "qid long, q array<float>")
    want = {n: sorted(map(tuple, index.search_batch(queries, 6, n).collect())) for n in (1, 3, 8)}
    monkeypatch.setattr(search, "QUERY_BLOCK", 10)
    monkeypatch.setattr(search, "PIECE_ROWS", 5)
    monkeypatch.setattr(search, "PIECE_QUERIES", 7)
    monkeypatch.setattr(search, "PACKED", 4)
    for n, rows in want.items():
        assert sorted(map(tuple, index.search_batch(queries, 6, n).collect())) == rows
    assert sorted(map(tuple, index.search_batch(queries, 6, exact=True).collect())) == want[8]
    with pytest.raises(Exception, match="finite"):
        index.search_batch(queries.withColumn("q", F.expr("transform(q, x -> x * cast('inf' as float))")), 6).collect()
    plan = index.search_batch(queries, 6, 2)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_scores_of_odd_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0]), (4, [])], "id long, v array<float>")
    assert {r.id: r.score for r in search.scored(rows, np.array([3, 4]), "v", ["id"]).collect()} == {1: 11.0, 2: None, 3: None, 4: None}

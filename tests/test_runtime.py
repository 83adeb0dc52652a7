from __future__ import annotations

from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ravelin import runtime


def test_scratch_tables_lie_in_the_named_folder(spark):
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    df = runtime.materialize(spark.range(3).withColumn("x", F.lit(None).cast("string")), "some")
    assert df.inputFiles()[0].removeprefix("file://").startswith(f"{folder}/ravelin/{spark.sparkContext.applicationId}/")
    assert df.count() == 3 and [f.name for f in df.schema] == ["id", "x"]
    assert runtime.materialize(spark.range(0), "none").count() == 0
    assert runtime.fresh_path(spark, "a") != runtime.fresh_path(spark, "a")


def test_batches_are_bounded_in_rows_and_bytes(spark):
    runtime.prepare(spark)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pylist([{"n": b.num_rows, "bytes": b.nbytes}])

    wide = spark.range(1500).coalesce(1).select(F.repeat(F.lit("x"), 20_000).alias("t")).mapInArrow(sizes, "n long, bytes long").collect()
    assert max(r.bytes for r in wide) < 9 << 20 and sum(r.n for r in wide) == 1500
    narrow = spark.range(9000).coalesce(1).mapInArrow(sizes, "n long, bytes long").collect()
    assert max(r.n for r in narrow) == runtime.BATCH_ROWS


def test_a_cluster_must_name_its_shared_folder():
    context = SimpleNamespace(getConf=dict, master="spark://host:7077", getCheckpointDir=lambda: "x")
    with pytest.raises(RuntimeError):
        runtime.scratch(SimpleNamespace(sparkContext=context))
    context.master = "local[4]"
    assert runtime.scratch(SimpleNamespace(sparkContext=context)) == runtime.LOCAL_SCRATCH

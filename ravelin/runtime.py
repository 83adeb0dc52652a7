"""What every job needs from its session: code on the executors, Arrow limits, shared scratch tables."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from contextlib import suppress
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Arrow batches handed to Python hold at most this many rows and bytes, however long the texts are.
BATCH_ROWS, BATCH_BYTES = 4000, "8m"
#: Used only by a local master whose session names no shared folder, as in tests.
LOCAL_SCRATCH = f"{tempfile.gettempdir()}/checkpoints"

_shipped: set[str] = set()
_bases: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches, and send this package to the executors once per application.

    The two limits are set for the whole session and stay: DataFrames are lazy, so what an operator returns needs them after it has returned.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        package = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="ravelin-")  # on the driver, which serves it to the executors
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        archive = os.path.join(folder, f"{package.name}.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for path in sorted(package.rglob("*.py")):
                z.write(path, path.relative_to(package.parent))
        spark.sparkContext.addPyFile(archive)
    return spark


def scratch(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir. Where that is unset, a local master gets a local folder, a cluster RuntimeError."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = LOCAL_SCRATCH
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used; what is there goes when the application ends in order."""
    base = f"{scratch(spark)}/ravelin/{spark.sparkContext.applicationId}"
    if base not in _bases:
        _bases.add(base)
        atexit.register(_sweep, spark, base)
    return f"{base}/{uuid.uuid4().hex}/{label}"


def _sweep(spark: SparkSession, base: str) -> None:
    with suppress(Exception):  # the application may have ended before
        if spark.sparkContext._jsc is not None:
            path = spark._jvm.org.apache.hadoop.fs.Path(base)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and a lost executor costs nothing."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

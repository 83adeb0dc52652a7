"""Vectors, ids and metadata that the driver holds, as a table to build from."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def row_ids(ids: Any, count: int) -> np.ndarray:
    """Ids as 64-bit integers, 0, 1, ... if not given; TypeError unless they are integers, ValueError for a wrong number or range."""
    if ids is None:
        return np.arange(count, dtype=np.int64)
    found = np.asarray(ids)
    if found.dtype.kind not in "iu":
        raise TypeError(f"ids must be integers, not {found.dtype}")
    if found.shape != (count,):
        raise ValueError(f"there are {found.size} ids for {count} vectors")
    if found.dtype.kind == "u" and count and found.max() > np.iinfo(np.int64).max:
        raise ValueError("ids must fit 64-bit signed integers")
    return found.astype(np.int64)


def frame(spark: SparkSession, vectors: Any, ids: Any = None, metadata: Sequence[dict] | None = None) -> DataFrame:
    """(id, embedding, metadata) of a matrix. Whether the numbers are finite and ids unique is told when the index is built."""
    with np.errstate(over="ignore"):
        matrix = np.asarray(vectors, dtype=np.float32)
    if matrix.ndim != 2 or not matrix.size:
        raise ValueError("vectors are a matrix with a row each, and at least one of them")
    count, dim = matrix.shape
    if metadata is not None and len(metadata) != count:
        raise ValueError(f"there are {len(metadata)} entries of metadata for {count} vectors")
    lists = pa.ListArray.from_arrays(pa.array(np.arange(count + 1, dtype=np.int32) * dim), pa.array(np.ascontiguousarray(matrix).ravel()))
    told = pa.nulls(count, pa.string()) if metadata is None else pa.array([json.dumps(x, ensure_ascii=False, allow_nan=False) for x in metadata], pa.string())
    return spark.createDataFrame(pa.table({"id": row_ids(ids, count), "embedding": lists, "metadata": told}))

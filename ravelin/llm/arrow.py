"""Row functions over Arrow batches: bounded memory, one output row per input row."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ravelin.runtime import prepare


def give_back() -> None:
    """Return freed memory to the system: Python workers live on after a task, beside those of other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_columns(df: DataFrame, ddl: str | StructType, start: Callable[[], Callable[..., Sequence]], keep: Sequence[str] = ()) -> DataFrame:
    """Call start() once per task; its result gets each batch's columns as lists and returns the output columns.

    keep: columns passed through unchanged before the new ones; the function gets only the others.
    An output column may be a list or an Arrow array.
    """
    prepare(df.sparkSession)
    new = _parse_datatype_string(ddl) if isinstance(ddl, str) else ddl
    kept = [df.schema[c] for c in keep]
    schema = StructType([*kept, *new.fields])
    arrow = to_arrow_schema(schema)
    names = [c for c in df.columns if c not in keep]
    n_keep = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = start()
        for batch in batches:
            if not batch.num_rows:
                continue
            out = call(*(batch.column(c).to_pylist() for c in names))
            arrays = [batch.column(c) for c in keep]
            arrays += [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, type=arrow.field(n_keep + i).type) for i, x in enumerate(out)]
            del out
            yield pa.RecordBatch.from_arrays([a.cast(arrow.field(i).type) for i, a in enumerate(arrays)], schema=arrow)
            del arrays
        del call
        give_back()

    return df.mapInArrow(run, schema)

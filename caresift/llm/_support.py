"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LIBRARY = ctypes.CDLL(None)
_LIBRARY = _LIBRARY if hasattr(_LIBRARY, "malloc_trim") else None  # of the GNU library alone

#: Text that one pass of the vectorised helpers holds at once, in bytes (one longer text is a slice of its own).
SLICE_BYTES = 500_000
#: Rows up to which a table of a few fixed-width columns is sent to all executors; beyond it the join shuffles.
BROADCAST_ROWS = 2_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; one of our own is set only where that is unset, and only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that its lineage ends there.

    Spark deletes the files when nothing refers to the result any more.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def forget(spark: SparkSession) -> None:
    """Asks the driver to drop what nothing refers to any more.

    Spark deletes a shuffle's and a checkpoint's files when the driver's collector finds them unused, which a small heap
    in use by small jobs seldom does; loops of many rounds would keep the files of all rounds until then.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """``df`` as a new Parquet table in the shared folder, read again; ``instead_of``, a former such table, is deleted then."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.parquet(path)
    out.table_path = path
    if instead_of is not None:
        remove(instead_of)
    return out


def remove(table: DataFrame) -> None:
    """Deletes the files of a result of ``written``; of any other table, none."""
    if (path := getattr(table, "table_path", None)) is not None:
        place = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A checkpointed ``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if df.count() <= rows else df.hint("merge")


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, and where each value starts (one more offset than values).  Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    return body, at - at[0]


def give_back() -> None:
    """Freed memory goes back to the system: a worker stays for the next stage, and others run beside it."""
    pa.default_memory_pool().release_unused()
    if _LIBRARY is not None:
        _LIBRARY.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of the batches in runs of at most ``most`` bytes of text: the rows, their bytes, their offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        body, at = flat(batch.column(batch.schema.get_field_index(text)))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
            yield batch.slice(first, last - first), body[at[first] : at[last]], at[first : last + 1] - at[first]
            first = last
        del batch, body
        give_back()

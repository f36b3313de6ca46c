"""Small helpers that the operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.shared import discard, remove_shared, shared_dir, written  # noqa: F401

T = TypeVar("T")

#: Rows and bytes of text that an operator holds as Python objects at once.
SLICE_ROWS = 2000
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that a text operator reads, as (doc_id, text)."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def partitions_for(rows: DataFrame, target: int = 128 << 20, text_col: str = "text") -> int:
    """How many partitions hold about ``target`` bytes of text each, the session's number at least; one pass over the texts."""
    total = rows.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // target))


def with_own_names(docs: DataFrame) -> DataFrame:
    """The columns renamed by their place, so that those which share a name can be told apart."""
    return docs.toDF(*[f"_{k}" for k in range(len(docs.columns))])


def slices(batches: Iterable[pa.RecordBatch], column: str | int = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each has few rows and, long rows aside, few bytes."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            rows = min(SLICE_ROWS, batch.num_rows - at)
            while rows > 1 and batch.column(column).slice(at, rows).nbytes > SLICE_BYTES:
                rows = (rows + 1) // 2
            yield batch.slice(at, rows)
            at += rows


_held: dict[str, object] = {}


def worker_cache(name: str, make: Callable[[], T] | None = None) -> T | None:
    """What this Python worker keeps between its tasks under a name.

    A worker serves one operator after another and holds only the last one's cache:
    asking under another name drops it and hands its memory back to the system.
    """
    if name not in _held:
        _held.clear()
        _release()
        _held[name] = make() if make is not None else None
    return _held[name]


def _release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library than glibc
        pass

"""Small helpers that the operators share: scratch tables and word splitting."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import scratch_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Lists that gather the tables staged meanwhile.
_gathering: list[list[DataFrame]] = []


@contextmanager
def scratch_tables() -> Iterator[list[DataFrame]]:
    """Gathers the tables that are staged within, for ``discard``."""
    made: list[DataFrame] = []
    _gathering.append(made)
    try:
        yield made
    finally:
        _gathering.remove(made)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and returns the written table, which ``discard`` can delete.

    Cuts the lineage: a lost executor costs a read of the file, not a rerun.
    """
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    done = df.sparkSession.read.schema(df.schema).parquet(path)
    done.scratch = path
    for made in _gathering:
        made.append(done)
    return done


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that no later step reads."""
    for df in tables:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        path = jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; by sorting, which is many times as fast as numpy's own hashing."""
    x = np.sort(x)
    return x[np.concatenate([np.ones(min(len(x), 1), bool), x[1:] != x[:-1]])]


def words(text: str | None) -> list[bytes]:
    """Words in UTF-8; bytes know only the ASCII letters and white space, as is wanted here."""
    return (text or "").encode().lower().split()


#: What drops the caches that operators keep in a worker between their tasks, by operator.
_caches: dict[str, Callable[[], None]] = {}


def keeps(owner: str, forget: Callable[[], None]) -> None:
    _caches[owner] = forget


def drop_others(owner: str) -> None:
    for name, forget in _caches.items():
        if name != owner:
            forget()


def give_back() -> None:
    """Returns unused memory to the system; else a worker holds the most that any of its tasks has used."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def frugal(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], owner: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The task, in a worker that first drops what other operators keep there, and gives back what it has used."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_others(owner)
        try:
            yield from task(batches)
        finally:
            give_back()

    return run

"""Shared pieces of the training-data operators: tables, shared storage, word memos, hashes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.package import ship
from ..sources.storage import shared_dir, written  # noqa: F401  for the operators

#: Rows in one Arrow batch: texts can be very long, so batches stay short.
BATCH_ROWS = 512
#: Entries of one generation of a worker's word memo, unless it says otherwise.
MEMO_WORDS = 100_000
#: Longest word that a memo keeps.
MEMO_CHARS = 200

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read through Spark only, in short Arrow batches."""
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows, as texts can be long; and the package on every executor."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, BATCH_ROWS)


def beside(docs: DataFrame, make, added: str, keep_text: bool = True, more: tuple[str, ...] = ()) -> DataFrame:
    """docs, its columns as they are, with new ones behind them, worked out from `text` in one pass.

    So no join has to find a row again, and rows without an id or with a repeated one keep their own verdict.
    make() gives a function from the texts of a batch, and its values of `more`, to a list of arrays; the new names start with `__`.
    """
    names, at = [x.split()[0] for x in added.split(", ")], docs.columns.index("text")
    read = [at, *map(docs.columns.index, more)]
    kept = [i for i in range(len(docs.columns)) if keep_text or i != at]
    columns = [docs.columns[i] for i in kept]
    schema = T.StructType([docs.schema.fields[i] for i in kept] + T.StructType.fromDDL(added).fields)

    def run(batches):
        made = make()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *made(*(batch.column(i).to_pylist() for i in read))], names=[*columns, *names])

    return docs.mapInArrow(tidied(run), schema)


def tidied(run):
    """run, a function of Arrow batches, whose worker gives back the memory that the task took: workers live on."""

    def tidy(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such call
                ctypes.CDLL(None).malloc_trim(0)

    return tidy


def crc_split(column="doc_id", parts: int = 3):
    """crc32 of an id as text, modulo parts."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ordered pairs of 64-bit hashes."""
    return mix(a * _GOLD + mix(b + _GOLD))


class Memo(dict):
    """word -> value made by `make`, in two generations: what a full one held is kept once more.

    Used as a plain dict for speed.  Results do not depend on its size.
    """

    def __init__(self, make, most: int = MEMO_WORDS):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        if len(word) <= MEMO_CHARS:
            self[word] = value
        return value

    def trim(self) -> None:
        """To be called between documents."""
        if len(self) > self.most:
            self.old = self.copy()
            self.clear()

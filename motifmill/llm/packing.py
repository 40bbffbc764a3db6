"""Best-fit packing by minimum bin slack.

Only the histogram of piece lengths decides the bins, and it has at most `capacity` entries.  Per
bin, a bitset subset-sum over the lengths that are left, longest first and with the longest one
always in, finds the fullest feasible combination.  The combination is taken as often as the
lengths that are left allow, so the number of steps does not grow with the documents; each step
uses up one length at least.

Pieces then get a number within their length, in as many buckets as the length has pieces for, so that no
length is one task and no bucket grows with the table, and find their place in a table with one row per step and length.

Defined results: a null or empty text is the end id alone; repeated rows are packed each; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import short_batches, tidied, written
from .tokens import encoder

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"
#: Pieces of one bucket of a length, in the mean: what one task numbers.  Lengths of fewer pieces are dealt out, too, to
#: at most SPREAD buckets of SPREAD_PIECES, so that a hot length of a small table is not one task either.
BUCKET_PIECES, SPREAD, SPREAD_PIECES = 50_000, 64, 100
#: The driver's tables: buckets of a length, pieces of a length before a bucket, steps of a length by their first piece.
BUCKETS = pa.schema({"length": pa.int32(), "buckets": pa.int32()})
BEFORE = pa.schema({"length": pa.int32(), "bucket": pa.int32(), "before": pa.int64()})
STEP = pa.schema({"first": pa.int64(), "last": pa.int64(), "first_bin": pa.int64(), "times": pa.int32(), "offset": pa.int32()})
STEPS = pa.schema({"length": pa.int32(), "steps": pa.list_(pa.struct(list(STEP)))})


def fullest(lengths: list[int], counts: list[int], capacity: int) -> list[tuple[int, int]]:
    """(length, times) of the fullest combination that has the longest length.

    lengths descend.  Bit s of the bitset says that some lengths so far sum to s.
    """
    full = (1 << capacity - lengths[0] + 1) - 1
    goal = 1 << capacity - lengths[0]
    sums, layers = 1, []
    for i, (length, count) in enumerate(zip(lengths, counts, strict=True)):
        left = min(count - (i == 0), (capacity - lengths[0]) // length)
        size = 1
        while left > 0:  # multiplicities as powers of two
            k = min(size, left)
            layers.append((length, k, sums))
            sums |= sums << length * k & full
            left -= k
            size *= 2
        if sums & goal:
            break
    at = sums.bit_length() - 1
    used = {lengths[0]: 1}
    for length, k, before in reversed(layers):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + k
            at -= length * k
    return sorted(used.items(), reverse=True)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first, last, first_bin, times, offset) rows.

    The pieces numbered first..last of a length go to bins first_bin, first_bin + 1, ..., `times`
    of them in each, from offset on.
    """
    lengths = sorted((n for n, c in histogram.items() if c), reverse=True)
    counts = [histogram[n] for n in lengths]
    taken: dict[int, int] = dict.fromkeys(lengths, 0)
    rows, next_bin = [], 0
    while lengths:
        chosen = fullest(lengths, counts, capacity)
        where = {n: i for i, n in enumerate(lengths)}
        bins = min(counts[where[n]] // times for n, times in chosen)
        offset = 0
        for n, times in chosen:
            rows.append((n, taken[n], taken[n] + bins * times - 1, next_bin, times, offset))
            taken[n] += bins * times
            counts[where[n]] -= bins * times
            offset += n * times
        next_bin += bins
        keep = [i for i, c in enumerate(counts) if c]
        lengths, counts = [lengths[i] for i in keep], [counts[i] for i in keep]
    return rows


def cut_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """One row per piece of every document."""
    short_batches(docs.sparkSession)

    def cut(batches):
        encode, end = encoder(tokenizer_path).encode, np.array([end_id], "<u4").tobytes()
        step = 4 * capacity
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text) + end
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()))],
                names=[x.split()[0] for x in PIECES.split(", ")],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(cut), PIECES)


def small_table(spark: SparkSession, schema: pa.Schema, rows: list[tuple]) -> DataFrame:
    """A table of the driver's rows that the driver itself sends out: no task of an executor, and no Python worker there, makes it."""
    return spark.createDataFrame(pa.Table.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(schema.types)], schema=schema))


def place(spark: SparkSession, pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to pieces, a written table with a column draw: it is read several times."""
    histogram = dict(pieces.groupBy("length").count().collect())  # at most `capacity` rows
    many = [(n, max(math.ceil(c / BUCKET_PIECES), min(SPREAD, math.ceil(c / SPREAD_PIECES)))) for n, c in histogram.items()]
    pieces = pieces.join(F.broadcast(small_table(spark, BUCKETS, many)), "length").withColumn("bucket", F.pmod("draw", F.col("buckets")).cast("int")).drop("buckets")
    cells = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n")).collect()  # at most capacity x SPREAD + pieces / BUCKET_PIECES rows
    first: list[tuple[int, int, int]] = []
    seen: dict[int, int] = {}
    for row in sorted(cells, key=lambda r: (r.length, r.bucket)):
        first.append((row.length, row.bucket, seen.get(row.length, 0)))
        seen[row.length] = seen.get(row.length, 0) + row.n
    # both tables are small: the cells', and a few steps per length, through which a number's range is found
    steps: dict[int, list[dict]] = {}
    for length, *step in plan(histogram, capacity):
        steps.setdefault(length, []).append(dict(zip(STEP.names, step, strict=True)))
    offsets, by_length = small_table(spark, BEFORE, first), small_table(spark, STEPS, list(steps.items()))
    number = F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    numbered = pieces.withColumn("within", number).join(F.broadcast(offsets), ["length", "bucket"]).join(F.broadcast(by_length), "length").withColumn("n", F.col("before") + F.col("within"))
    hit = F.element_at(F.filter("steps", lambda s: (s["first"] <= F.col("n")) & (F.col("n") <= s["last"])), 1)
    turn = F.col("n") - F.col("hit.first")
    return numbered.withColumn("hit", hit).select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
        (F.col("hit.first_bin") + F.floor(turn / F.col("hit.times"))).cast("long").alias("sequence_id"),
        (F.col("hit.offset") + F.pmod(turn, F.col("hit.times")) * F.col("length")).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    # stored with the pieces, as all passes must draw alike
    pieces = written(cut_pieces(docs, tokenizer_path, end_id, capacity).withColumn("draw", F.monotonically_increasing_id()), "pieces")
    return place(docs.sparkSession, pieces, capacity)

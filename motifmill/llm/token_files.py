"""Token-ID files of directly addressable codes.

Every id is split into 8-bit chunks.  Level k holds the k-th chunks of the ids that have one, and
a bitmap that says which of them continue on level k+1; a rank directory holds the number of set
bits before every 512th position.  Token i is read from its level-0 chunk and, while the bitmap
is set, from position rank(i) of the next level: no block is decoded.

A segment holds whole documents in ascending doc_id order, up to SEGMENT_TOKENS tokens and one
document more.  Segments are rows of a Parquet table, because Parquet is what Spark can write to
any shared store.

Defined results: a null or empty text is the end id alone; equal doc_ids are ordered by a hash of their
text, so that one id's rows need not meet in one task; a null doc_id comes first; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import short_batches, tidied, written
from .tokens import encoder

SEGMENT_TOKENS = 1 << 20
RANK_STEP = 512
_MAGIC = b"DAC1"


def encode_codes(ids: np.ndarray) -> bytes:
    """The levels of one array of 32-bit ids."""
    left, levels = ids.astype(np.uint32), []
    while left.size or not levels:
        more = left > 0xFF
        bits = np.packbits(more, bitorder="little")
        # a pad of zero bytes lets every rank step be read as whole 64-bit words
        bits = np.concatenate([bits, np.zeros(-len(bits) % 64 + 64, np.uint8)])
        ones = np.bitwise_count(bits.view("<u8")).astype(np.uint32).reshape(-1, RANK_STEP // 64).sum(1, dtype=np.uint32)
        ranks = np.concatenate([[0], np.cumsum(ones, dtype=np.uint32)]).astype("<u4")
        levels.append((left.astype(np.uint8), bits, ranks))
        left = left[more] >> np.uint32(8)
    head = struct.pack("<4sI", _MAGIC, len(levels)) + b"".join(struct.pack("<III", *map(len, x)) for x in levels)
    return head + b"".join(y.tobytes() for x in levels for y in x)


class Codes:
    """Reads ids from encode_codes() in place."""

    def __init__(self, blob: bytes):
        magic, n = struct.unpack_from("<4sI", blob)
        if magic != _MAGIC:
            raise ValueError("not a code file")
        at, self.levels = 8 + 12 * n, []
        for k in range(n):
            level = []
            for size, kind in zip(struct.unpack_from("<III", blob, 8 + 12 * k), ("u1", "u1", "<u4"), strict=True):
                level.append(np.frombuffer(blob, kind, size, at))
                at += size * np.dtype(kind).itemsize
            self.levels.append(level)

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def rank(self, level: int, at: np.ndarray) -> np.ndarray:
        """Set bits of a level's bitmap before the positions: a directory entry and eight words at most."""
        _, bits, ranks = self.levels[level]
        words = bits.view("<u8")
        block = at // RANK_STEP
        out = ranks[block].astype(np.int64)
        for i in range(RANK_STEP // 64):
            first = block * RANK_STEP + i * 64
            width = np.clip(at - first, 0, 64)
            mask = np.where(width >= 64, ~np.uint64(0), (np.uint64(1) << (width % 64).astype(np.uint64)) - np.uint64(1))
            out += np.bitwise_count(words[first // 64] & mask)
        return out

    def take(self, at: np.ndarray) -> np.ndarray:
        """The ids at any positions."""
        at = np.asarray(at, np.int64)
        out, live = np.zeros(len(at), np.uint32), np.arange(len(at))
        for level, (chunks, bits, _) in enumerate(self.levels):
            out[live] |= chunks[at].astype(np.uint32) << np.uint32(8 * level)
            more = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            live, at = live[more], at[more]
            if not len(at):
                break
            at = self.rank(level, at)
        return out

    def span(self, start: int, stop: int) -> np.ndarray:
        """The ids of a run of positions: one rank at each level, then runs there."""
        out, live = np.zeros(stop - start, np.uint32), None
        for level, (chunks, bits, _) in enumerate(self.levels):
            if start >= stop:
                break
            part = chunks[start:stop].astype(np.uint32) << np.uint32(8 * level)
            if live is None:
                out[:] = part
            else:
                out[live] |= part
            more = np.unpackbits(bits[start >> 3 : (stop + 7) >> 3], bitorder="little")[start & 7 :][: stop - start] == 1
            live = np.flatnonzero(more) if live is None else live[more]
            start = int(self.rank(level, np.array([start]))[0])
            stop = start + len(live)
        return out


SEGMENT = "part int, seq int, n_tokens long, doc_ids binary, null_ids binary, lengths binary, codes binary"


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Writes the files; returns their table.  Its parts and seqs ascend with doc_id."""
    short_batches(docs.sparkSession)

    def encode(batches):
        from pyspark import TaskContext

        part, seq, rows, size = TaskContext.get().partitionId(), 0, [], 0
        encode, end = encoder(tokenizer_path).encode, np.array([end_id], "<u4").tobytes()

        def segment():
            codes = encode_codes(np.frombuffer(b"".join(x[1] for x in rows), "<u4"))
            lengths = np.array([len(x[1]) // 4 for x in rows], "<i8")
            ids = np.array([x[0] or 0 for x in rows], "<i8")
            empty = np.array([x[0] is None for x in rows], "u1")
            values = [part, seq, int(lengths.sum()), ids.tobytes(), empty.tobytes(), lengths.tobytes(), codes]
            kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[x.split()[0] for x in SEGMENT.split(", ")])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows.append((doc_id, encode(text) + end))
                size += len(rows[-1][1]) // 4
                if size >= SEGMENT_TOKENS:
                    yield segment()
                    rows, size, seq = [], 0, seq + 1
        if rows:
            yield segment()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # rows of equal id and text are alike, so their order does not count
    keys = ["doc_id", F.xxhash64("text"), F.monotonically_increasing_id()]
    ordered = ordered.repartitionByRange(*keys).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return written(ordered.mapInArrow(tidied(encode), SEGMENT), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the files."""
    # one row per written partition, then one per segment of a partition: no task sees all documents
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    seqs = files.select("part", "seq", "n_tokens").withColumn("inside", F.sum("n_tokens").over(W.partitionBy("part").orderBy("seq")) - F.col("n_tokens"))
    starts = seqs.join(parts, "part").select("part", "seq", (F.col("before") + F.col("inside")).alias("start"))

    def decode(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
                codes, lengths = Codes(row["codes"]), np.frombuffer(row["lengths"], "<i8")
                begins = np.cumsum(lengths) - lengths
                # all documents are wanted: one span of the segment
                ids = memoryview(codes.span(0, len(codes)).astype("<u4").tobytes())
                sums = [zlib.crc32(ids[4 * a : 4 * (a + n)]) for a, n in zip(begins.tolist(), lengths.tolist(), strict=True)]
                empty = np.frombuffer(row["null_ids"], "u1") == 1
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=empty), pa.array(begins + row["start"]), pa.array(lengths), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    blobs = files.select("part", "seq", "doc_ids", "null_ids", "lengths", "codes")
    return blobs.join(F.broadcast(starts) if small(files) else starts, ["part", "seq"]).select("doc_ids", "null_ids", "lengths", "codes", "start").mapInArrow(tidied(decode), "doc_id long, start long, n_tokens long, ids_crc32 long")


def small(files: DataFrame, most: int = 1_000_000) -> bool:
    """Whether the table has few enough segments to send their starts to every executor."""
    return files.count() <= most

"""Token counts by a linear longest-match automaton.

The vocabulary is a byte trie.  Every node carries a failure link and the number of pieces that
greedy longest match pops on the way along that link, so one pass over the bytes gives the
number of pieces; no piece is ever built.

A text is cut before every space; the space belongs to the segment it starts.  Pieces don't cross
segments.  The vocabulary must hold all 256 single bytes, so that every segment has a match.

Defined results: a null or empty text has 0 bytes, 0 segments and 0 pieces; repeated rows are
counted each; an empty table gives an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

import json
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, short_batches, tidied

SCHEMA = "doc_id long, n_bytes long, n_segments long, n_pieces long, longest_segment long"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: character -> byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary(path: str) -> list[bytes]:
    """Pieces of a byte-level vocabulary file, special tokens left out."""
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    special = {t["content"] for t in data.get("added_tokens", [])}
    to_byte = byte_alphabet()
    return [bytes(to_byte[c] for c in piece) for piece in data["model"]["vocab"] if piece and piece not in special]


class Automaton:
    """Trie with failure links and popped-piece counts."""

    def __init__(self, pieces: list[bytes]):
        self.step: dict[int, int] = {}  # (node << 8 | byte) -> node
        final, parent, byte, by_depth = [False], [0], [0], [[0]]
        step = self.step
        for piece in pieces:
            node = 0
            for depth, b in enumerate(piece, 1):
                key = node << 8 | b
                nxt = step.get(key)
                if nxt is None:
                    nxt = step[key] = len(final)
                    final.append(False)
                    parent.append(node)
                    byte.append(b)
                    if depth == len(by_depth):
                        by_depth.append([])
                    by_depth[depth].append(nxt)
                node = nxt
            final[node] = True
        if any(b not in step or not final[step[b]] for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.fail, self.pops = [-1] * len(final), [0] * len(final)
        fail, pops = self.fail, self.pops
        for level in by_depth[1:]:
            for node in level:
                if final[node]:  # the whole string of the node is a piece
                    fail[node], pops[node] = 0, 1
                    continue
                # longest piece of the parent's string goes, then the rest must take this byte
                at, popped = fail[parent[node]], pops[parent[node]]
                while at >= 0 and (at << 8 | byte[node]) not in step:
                    popped += pops[at]
                    at = fail[at]
                if at >= 0:
                    fail[node], pops[node] = step[at << 8 | byte[node]], popped

    def pieces(self, segment: bytes) -> int:
        """Number of pieces of greedy longest match, in time linear in the segment."""
        step, fail, pops = self.step, self.fail, self.pops
        node = count = 0
        for b in segment:
            nxt = step.get(node << 8 | b)
            while nxt is None:
                count += pops[node]
                node = fail[node]
                nxt = step.get(node << 8 | b)
            node = nxt
        while node:
            count += pops[node]
            node = fail[node]
        return count


@lru_cache(maxsize=2)
def automaton(path: str) -> tuple[Automaton, Memo]:
    """One automaton and one memo per worker."""
    built = Automaton(vocabulary(path))
    return built, Memo(lambda segment: built.pieces(segment.encode()))


def segments(text: str | None) -> list[str]:
    """The text cut before every space."""
    if not text:
        return []
    first, *rest = text.split(" ")
    return ([first] if first else []) + [f" {x}" for x in rest]


def token_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_bytes, n_segments, n_pieces and the most pieces of one segment, for every row."""
    short_batches(docs.sparkSession)

    def count(batches):
        _, memo = automaton(vocabulary_path)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                parts = [memo[x] for x in segments(text)]
                memo.trim()
                rows.append((len(text.encode()) if text else 0, len(parts), sum(parts), max(parts, default=0)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(4))], names=["doc_id", "n_bytes", "n_segments", "n_pieces", "longest_segment"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(count), SCHEMA)

"""Benchmark decontamination by a BM25 index with block-max pruning.

Items of more than SEGMENT words are cut into segments of exactly SEGMENT words, of which the last
two may overlap; each segment is an entry of an inverted index.  Impacts are BM25 weights divided by what the segment scores against itself, so 1 is a
whole match and one threshold serves all segments.  A document is cut into stretches, and two
neighbouring stretches are a passage: a stretch is as long as the longest segment, so some
passage holds any copy whole.

Segments are numbered so that like ones stand side by side, and every list of postings holds the largest
impact of each block of BLOCK segments.  For a passage the block maxima of its terms are added up: a block
whose sum stays below the threshold is dead and none of its postings is read; in live ones the passage is
scored in full.  That is block-max WAND with the pivots of all blocks found at once (live blocks), and without
a heap, as all segments above the threshold are retrieved.  A hit counts when both question and answer are
found in the passage: the answer is the last sentence of an item, the question what stands before it.  Of
each, the demanded share of its shingles of five words must be there, or of its words in their order, so
that an edited word in a short part does not hide a copy.

Defined results: a null or empty text and an item without words match nothing; items with equal
text match each; repeated rows are judged each; empty tables give no pairs; other columns are
ignored.  Tokens made of punctuation alone are no words, in documents as in items.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, beside, short_batches, tidied

SEGMENT = 64
#: Segments of a block: smaller ones make tighter bounds and longer lists of maxima.
BLOCK = 8
#: Numbers of one matrix of passages and blocks.
CELLS = 2_000_000
K1, B = 1.2, 0.75
SHINGLE = 5
#: Words of all items that one index may hold; larger benchmarks are searched in several passes.
MAX_WORDS = 2_000_000
PAIRS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def split_words(text: str | None) -> list[str]:
    """Lower-cased words without the punctuation around them."""
    return [w for w in (x.strip(_EDGE) for x in (text or "").lower().split()) if w]


_EDGE = ".,;:!?\"'()[]{}|*#$%&"


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """The words of an item before its last sentence, and those of the last sentence."""
    parts = [w for w in map(split_words, _SENTENCE.split(text)) if w]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    cut = len(words) * 2 // 3
    return words[:cut], words[cut:]


def shingles(words: list[str], size: int = SHINGLE) -> set[tuple[str, ...]]:
    """Runs of `size` words; fewer words are one run."""
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def in_order(wanted: list[str], seen: list[str]) -> float:
    """Share of the wanted words that are seen in their order: the longest common subsequence, a bit per word."""
    if not wanted:
        return 1.0
    places: dict[str, int] = {}
    for i, w in enumerate(wanted):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(wanted)) - 1
    open_bits = full
    for w in seen:
        hit = open_bits & places.get(w, 0)
        if hit:
            open_bits = (open_bits + hit | open_bits - hit) & full
    return (len(wanted) - open_bits.bit_count()) / len(wanted)


def share(wanted: list[str], seen: list[str]) -> float:
    """How much of a part is there: by shingles, or by words in order where that is more."""
    runs = shingles(wanted)
    if not runs:
        return 1.0
    size = len(next(iter(runs)))
    there = runs.intersection(zip(*(seen[i:] for i in range(size)), strict=False))
    return max(len(there) / len(runs), in_order(wanted, seen))


@dataclass
class Index:
    terms: dict[str, int]
    items: list[int]  # item of each segment
    length: int  # words of a stretch
    parts: list[tuple[list[str], list[str]]]  # question and answer of each segment
    best: np.ndarray  # largest impact of each term
    starts: np.ndarray  # of each term in the lists of block maxima
    blocks: np.ndarray
    maxima: np.ndarray
    block_starts: np.ndarray  # of each block in the postings
    block_terms: np.ndarray
    segments: np.ndarray
    impacts: np.ndarray

    @cached_property
    def memo(self) -> Memo:
        """Raw word -> term, -1 if no item has it, -2 if it is no word."""
        return Memo(lambda word: self.terms.get(w, -1) if (w := word.strip(_EDGE)) else -2)

    def weights(self, segment: int) -> dict[int, float]:
        """Impacts of a segment's terms."""
        at = slice(*self.block_starts[segment // BLOCK : segment // BLOCK + 2])
        mine = self.segments[at] == segment
        return dict(zip(self.block_terms[at][mine].tolist(), self.impacts[at][mine].tolist(), strict=True))


def segments_of(items: list[tuple[int, str | None]]) -> list[tuple[int, list[str], list[str], list[str]]]:
    """Item, words, question and answer of every segment."""
    entries = []
    for item, text in items:
        words = split_words(text)
        # an item of one segment is its question and answer; parts of longer ones stand for themselves
        whole = question_answer(text or "") if len(words) <= SEGMENT else None
        # the last segment of a longer item reaches back to full length: a short tail would match by itself
        last = max(0, len(words) - SEGMENT)
        for at in sorted({*range(0, last, SEGMENT), last}) if words else ():
            own = words[at : at + SEGMENT]
            cut = len(own) * 2 // 3
            entries.append((item, own, *(whole or (own[:cut], own[cut:]))))
    return entries


@dataclass
class Totals:
    """What scores and stretches depend on, over the items of all passes."""

    n: int = 0
    words: int = 0
    longest: int = 1
    seen: dict[str, int] = field(default_factory=dict)  # segments that hold a word

    def add(self, entries: list) -> Totals:
        for e in entries:
            self.n, self.words, self.longest = self.n + 1, self.words + len(e[1]), max(self.longest, len(e[1]))
            for w in set(e[1]):
                self.seen[w] = self.seen.get(w, 0) + 1
        return self


def build(items: list[tuple[int, str | None]], totals: Totals | None = None) -> Index:
    entries = segments_of(items)
    # like segments side by side make tight blocks
    entries.sort(key=lambda e: (e[1], e[0]))
    totals = totals or Totals().add(entries)
    n, mean, seen = totals.n, totals.words / max(totals.n, 1), totals.seen
    terms = {w: i for i, w in enumerate(sorted({w for e in entries for w in e[1]}))}
    term, segment, impact = [], [], []
    for s, (_, words, _, _) in enumerate(entries):
        weight = {}
        for w, tf in Counter(words).items():
            idf = math.log(1 + (n - seen[w] + 0.5) / (seen[w] + 0.5))
            weight[w] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean))
        whole = sum(weight.values())
        for w, x in weight.items():
            term.append(terms[w])
            segment.append(s)
            impact.append(x / whole)
    term, segment, impact = np.array(term, np.int64), np.array(segment, np.int64), np.array(impact, np.float64)
    best = np.zeros(len(terms))
    np.maximum.at(best, term, impact)
    blocks = -(-len(entries) // BLOCK)
    cells, which = np.unique(term * max(blocks, 1) + segment // BLOCK, return_inverse=True)
    maxima = np.zeros(len(cells))
    np.maximum.at(maxima, which, impact)
    by_block = np.lexsort((term, segment // BLOCK))
    return Index(
        terms, [e[0] for e in entries], totals.longest, [(e[2], e[3]) for e in entries], best,
        np.searchsorted(cells, np.arange(len(terms) + 1) * max(blocks, 1)), cells % max(blocks, 1), maxima,
        np.searchsorted((segment // BLOCK)[by_block], np.arange(blocks + 1)), term[by_block], segment[by_block], impact[by_block],
    )


def retrieve(index: Index, ids: np.ndarray, sizes: np.ndarray, groups: np.ndarray, threshold: float) -> list[tuple[int, int, float]]:
    """(stretch, segment, score) of passages at or above the threshold.

    ids: the different terms of every stretch, one after the other; sizes: how many each has;
    groups: its document.  A passage is a stretch and the next one of its document.
    """
    n, width, out = len(sizes), len(index.block_starts) - 1, []
    if not len(ids) or not width:
        return out
    ends, enough = np.cumsum(sizes), threshold - 1e-9
    step = max(1, min(n, CELLS // width))  # bounded memory, whatever the batch and the index
    held = np.zeros(len(index.terms), bool)
    for first in range(0, n, step):
        last = min(n, first + step + 1)  # one more: the second half of the last passage
        mine = ids[ends[first] - sizes[first] : ends[last - 1]]
        where = np.repeat(np.arange(last - first), sizes[first:last])
        follows = np.append(groups[first + 1 : last] == groups[first : last - 1], False)
        # without a pivot even by the maxima of whole lists nothing more is read; a term in both halves counts twice: still a bound
        most = np.bincount(where, index.best[mine], last - first)
        most[:-1] += np.where(follows[:-1], most[1:], 0.0)
        asks = most >= enough
        asks[1:] |= asks[:-1]
        mine, where = mine[asks[where]], where[asks[where]]
        if not len(mine):
            continue
        counts = index.starts[mine + 1] - index.starts[mine]
        at = np.arange(counts.sum()) + np.repeat(index.starts[mine] - np.cumsum(counts) + counts, counts)
        bound = np.bincount(np.repeat(where * width, counts) + index.blocks[at], index.maxima[at], (last - first) * width).reshape(-1, width)
        bound[:-1] += np.where(follows[:-1, None], bound[1:], 0.0)
        passages, live = np.nonzero(bound[: min(step, n - first)] >= enough)
        for i, own in zip(*np.unique(passages, return_index=True), strict=True):
            stretch = int(i) + first
            stop = ends[stretch + 1] if stretch + 1 < n and groups[stretch + 1] == groups[stretch] else ends[stretch]
            terms = ids[ends[stretch] - sizes[stretch] : stop]
            held[terms] = True
            for block in live[own : np.searchsorted(passages, i, "right")].tolist():
                low, high = index.block_starts[block : block + 2]
                hit = held[index.block_terms[low:high]]
                score = np.bincount(index.segments[low:high][hit] - block * BLOCK, index.impacts[low:high][hit], BLOCK)
                out += [(stretch, block * BLOCK + j, float(score[j])) for j in np.flatnonzero(score >= enough).tolist()]
            held[terms] = False
    return out


def search(index: Index, texts: list[str | None], threshold: float, overlap: float) -> list[tuple[int, int, float, float, float]]:
    """(text, item, score, question overlap, answer overlap): the best passage of each pair."""
    step, memo = index.length, index.memo
    ids, sizes, groups, places = [], [], [], []
    for i, text in enumerate(texts):
        codes = list(map(memo.__getitem__, text.lower().split())) if text else []
        if -2 in codes:
            codes = [c for c in codes if c != -2]
        for at in range(0, len(codes), step):
            part = set(codes[at : at + step])
            part.discard(-1)
            ids.extend(part)
            sizes.append(len(part))
            groups.append(i)
            places.append(at)
        memo.trim()
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    words, of = [], -1
    for stretch, segment, score in retrieve(index, np.array(ids, np.int64), np.array(sizes, np.int64), np.array(groups, np.int64), threshold):
        i, at = groups[stretch], places[stretch]
        if i != of:
            words, of = split_words(texts[i]), i
        # shingles that start in the passage, with the words that end them
        seen = words[at : at + 2 * step + SHINGLE]
        shares = [share(part, seen) for part in index.parts[segment]]
        if min(shares) >= overlap:
            key = (i, index.items[segment])
            best[key] = max(best.get(key, (0.0, 0.0, 0.0)), (score, *shares))
    return [(i, item, *x) for (i, item), x in best.items()]


def indexes(docs: DataFrame, benchmark: DataFrame):
    """The broadcast index of each pass: one, unless the benchmark holds more than MAX_WORDS words."""
    short_batches(docs.sparkSession)
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0)).alias("n")).first().n
    passes = max(1, math.ceil(size / MAX_WORDS))
    totals = None

    def rows(turn):
        mine = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == turn) if passes > 1 else items
        return [(r.item_id, r.text) for r in mine.orderBy("item_id", "text").collect()]

    if passes > 1:  # scores do not depend on the passes
        totals = Totals()
        for turn in range(passes):
            totals.add(segments_of(rows(turn)))
    for turn in range(passes):
        yield spark.sparkContext.broadcast(build(rows(turn), totals))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, overlap: float = 0.8) -> DataFrame:
    """doc_id, item_id, score and both overlaps of every document that holds an item."""
    return reduce(DataFrame.unionByName, [_searched(docs, index, threshold, overlap) for index in indexes(docs, benchmark)])


def flagged(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, overlap: float = 0.8) -> DataFrame:
    """The rows of docs with __contaminated behind them: whether the row holds any item."""
    out = docs.withColumn("__contaminated", F.lit(False))
    for index in indexes(docs, benchmark):

        def make(index=index):
            def run(texts):
                hit = np.zeros(len(texts), bool)
                hit[[r[0] for r in search(index.value, texts, threshold, overlap)]] = True
                return [pa.array(hit)]

            return run

        out = beside(out, make, "__hit boolean").withColumn("__contaminated", F.col("__contaminated") | F.col("__hit")).drop("__hit")
    return out


def _searched(docs: DataFrame, index, threshold: float, overlap: float) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            rows = search(index.value, texts, threshold, overlap)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array([r[0] for r in rows], pa.int64())), *(pa.array([r[k] for r in rows], kind) for k, kind in ((1, pa.int64()), (2, pa.float64()), (3, pa.float64()), (4, pa.float64())))],
                names=[x.split()[0] for x in PAIRS.split(", ")],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), PAIRS)

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from motifmill.llm import packing, token_counts, token_files
from motifmill.llm.queries import op1_token_counts, op5_token_files, op8_min_bin_slack, tokenizer_file
from motifmill.llm.tokens import Encoder


def greedy(data, pieces, most):
    n = at = 0
    while at < len(data):
        size = next(s for s in range(most, 0, -1) if data[at : at + s] in pieces)
        at, n = at + min(size, len(data) - at), n + 1
    return n


@pytest.fixture(scope="module")
def encoder():
    return Encoder(tokenizer_file("word_bpe_49k.json"))


def whole_ids(encoder, text, end):
    return np.array([*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_automaton_is_greedy_longest_match():
    pieces = token_counts.vocabulary(tokenizer_file("byte_bpe_50k.json"))
    built, known, most = token_counts.Automaton(pieces), set(pieces), max(map(len, pieces))
    rnd = random.Random(5)
    for _ in range(2000):
        data = bytes(rnd.choice(b" thestringoandr\n\xc3..--  ") if rnd.random() < 0.9 else rnd.randrange(256) for _ in range(rnd.randint(0, 40)))
        assert built.pieces(data) == greedy(data, known, most)


def test_op1_counts_whole_table(spark, sf):
    pieces = token_counts.vocabulary(tokenizer_file("byte_bpe_50k.json"))
    known, most = set(pieces), max(map(len, pieces))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op1_token_counts(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for doc_id, text in texts.items():
        parts = [greedy(x.encode(), known, most) for x in token_counts.segments(text)]
        assert (got[doc_id].n_pieces, got[doc_id].n_segments, got[doc_id].n_bytes) == (sum(parts), len(parts), len(text.encode()))


def test_op1_odd_rows(spark, odd, none):
    rows = token_counts.token_counts(odd, tokenizer_file("byte_bpe_50k.json")).collect()
    assert len(rows) == odd.count() and [r.n_pieces for r in rows if r.doc_id in (0, 1)] == [0, 0]
    assert token_counts.token_counts(none, tokenizer_file("byte_bpe_50k.json")).count() == 0


def test_encoder_is_the_tokenizer(encoder, odd):
    rnd = random.Random(1)
    letters = "".join(map(chr, range(1, 384))) + " 'stremld" * 40
    texts = ["".join(rnd.choice(letters) for _ in range(40)) for _ in range(1500)] + [r.text or "" for r in odd.collect()]
    for text in [*texts, "İ ΣΑΣ Σ", "a\tb c d\x1ce", " ́a", "x\x85\xa0y", "<|startoftext|>a b"]:
        assert encoder.encode(text) == encoder.whole(text), repr(text[:60])


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 20_000])
def test_codes_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.where(rng.random(n) < 0.5, rng.integers(0, 256, n), rng.integers(0, 1 << 31, n)).astype(np.uint32)
    codes = token_files.Codes(token_files.encode_codes(ids))
    assert len(codes) == n and (codes.span(0, n) == ids).all()
    if n:
        at = rng.integers(0, n, 200)
        assert (codes.take(at) == ids[at]).all()
        for a, b in np.sort(rng.integers(0, n + 1, (40, 2))).tolist():
            assert (codes.span(a, b) == ids[a:b]).all()


def check_files(rows, docs, encoder):
    start = 0
    for row, (doc_id, text) in zip(sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id, r.start)), sorted(docs, key=lambda d: (d[0] is not None, d[0], d[1] or "")), strict=True):
        ids = whole_ids(encoder, text, 2)
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op5_round_trip(spark, sf, encoder):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check_files(op5_token_files(spark, sf).collect(), docs, encoder)


def test_op5_odd_rows(spark, odd, none, encoder):
    path = tokenizer_file("word_bpe_49k.json")
    check_files(token_files.read_token_files(token_files.write_token_files(odd, path, 2)).collect(), [(r.doc_id, r.text) for r in odd.collect()], encoder)
    assert token_files.read_token_files(token_files.write_token_files(none, path, 2)).count() == 0


def check_packing(rows, docs, encoder, capacity=4096):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(list)
    for doc_id, text in docs:
        ids = whole_ids(encoder, text, 1)
        want[doc_id] += [(i, a, min(capacity, len(ids) - a), zlib.crc32(ids[a : a + capacity].tobytes())) for i, a in enumerate(range(0, len(ids), capacity))]
    assert {d: sorted(v) for d, v in want.items()} == {d: sorted((r.piece, r.start, r.length, r.ids_crc32) for r in v) for d, v in pieces.items()}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), sum(r.length for r in rows)


def test_op8_packs_all(spark, sf, encoder):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    bins, tokens = check_packing(op8_min_bin_slack(spark, sf).collect(), docs, encoder)
    assert bins <= -(-tokens // 4096) + 1


def test_op8_odd_rows(spark, odd, none, encoder):
    path = tokenizer_file("word_bpe_49k.json")
    check_packing(packing.pack(odd, path).collect(), [(r.doc_id, r.text) for r in odd.collect()], encoder)
    assert packing.pack(none, path).count() == 0


def test_op8_small_tables_take_no_tasks(spark, odd):
    plan = packing.pack(odd, tokenizer_file("word_bpe_49k.json"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("LocalTableScan") == 3 and plan.count("hashpartitioning") == 1
    assert "ExistingRDD" not in plan and "ObjectHashAggregate" not in plan


def test_fullest_combination_is_optimal():
    rnd = random.Random(3)
    for _ in range(200):
        histogram = {rnd.randint(1, 40): rnd.randint(1, 3) for _ in range(rnd.randint(1, 7))}
        lengths = sorted(histogram, reverse=True)
        capacity = rnd.randint(40, 70)
        chosen = packing.fullest(lengths, [histogram[n] for n in lengths], capacity)
        assert chosen[0][0] == lengths[0] and all(times <= histogram[n] for n, times in chosen)
        sums = {lengths[0]}
        for n in lengths:
            for _ in range(histogram[n] - (n == lengths[0])):
                sums |= {s + n for s in sums if s + n <= capacity}
        assert sum(n * t for n, t in chosen) == max(sums)


def test_equal_lengths_take_few_steps():
    assert len(packing.plan({100: 10**9, 7: 10**6}, 4096)) < 20

import zlib
from collections import Counter, defaultdict

from motifmill.llm import sharding
from motifmill.llm.queries import op7_label_propagation


def check(rows, docs, shards=8):
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == sorted((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    sizes = Counter(r.shard for r in rows)
    assert all(0 <= s < shards for s in sizes)
    assert max(sizes[s] for s in range(shards)) - min(sizes[s] for s in range(shards)) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert {(r.law, r.grown_shard) for r in rows} <= {("rows", None)}


def cut(rows, docs):
    """Neighbouring copies of a text that stand in different shards."""
    text, where = dict(docs), defaultdict(Counter)
    for r in rows:
        where[text[r.doc_id]][r.shard] += 1
    return sum(sum(c.values()) - max(c.values()) for t, c in where.items() if t is not None), sum(sum(c.values()) - 1 for t, c in where.items() if t is not None)


def test_op7_keeps_the_law_and_the_groups(spark):
    big = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{big}/documents.parquet").collect()]
    rows = op7_label_propagation(spark, big).collect()
    check(rows, docs)
    apart, links = cut(rows, docs)
    assert apart <= 0.05 * links


def test_op7_splits_a_hot_group(spark):
    docs = [(i, "hot") for i in range(400)] + [(1000 + i, f"pair {i // 2}") for i in range(400)] + [(3000 + i, f"alone {i}") for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = sharding.shard(df).collect()
    check(rows, docs)
    text = dict(docs)
    pairs = defaultdict(set)
    for r in rows:
        if text[r.doc_id].startswith("pair"):
            pairs[text[r.doc_id]].add(r.shard)
    assert sum(len(v) > 1 for v in pairs.values()) <= 0.2 * len(pairs)
    assert max(Counter(r.shard for r in rows if text[r.doc_id] == "hot").values()) >= 100


def test_op7_odd_rows(spark, odd, none):
    check(sharding.shard(odd).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert sharding.shard(none).count() == 0
    few = spark.createDataFrame([(1, "a"), (None, "a"), (2, None)], "doc_id long, text string")
    assert len(sharding.shard(few).collect()) == 3

"""Sharding by balanced label propagation, in DataFrame operations alone.

Documents with a common link (here: equal texts) should share a shard.  A node is a salted piece
of a link: all its documents in one of many buckets by id, so a link with a third of all rows is
many nodes.  Links larger than a shard's quota are cut into parts of at most about that size.

Every round, nodes are joined with the label counts of their part and ask to move to the shard
where the part has most rows.  A table of shards x shards sums the wishes.  Quotas grant as much
of every wish as sizes allow, after single documents, which no link holds, moved the other way to
make room.  Nodes whose hash lies below the granted share move.  After the rounds, documents
beyond a shard's quota go to shards below theirs, single ones first, so that row counts differ by one at
most (law `rows`).

Defined results: a null text has size 1, crc of no bytes and no link; an empty text links with empty
texts; repeated rows are sharded each; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import written

#: Buckets of a link by document id, and of a shard when its rows are numbered.
PIECES, NUMBERING = 64, 512


def nodes_of(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, link (null: none) and bucket of every row."""
    text = F.col(text_column).cast("string")
    raw = F.coalesce(text.cast("binary"), F.lit(b""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.when(text.isNotNull(), F.md5(raw)).alias("link"),
    ).withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(PIECES)).cast("int"))


def propagate(nodes: DataFrame, shards: int, quota: int, rounds: int) -> DataFrame:
    """nodes: part, node, rows, label, single.  Returns them with their labels after the rounds."""
    for _ in range(rounds):
        # label counts of every part, one column per shard; ties go to a shard by the part's hash
        counts = nodes.filter(~F.col("single")).groupBy("part").agg(*[F.sum(F.when(F.col("label") == s, F.col("rows")).otherwise(0)).alias(f"c{s}") for s in range(shards)])
        options = F.array(*[F.struct(F.col(f"c{s}").alias("n"), F.pmod(F.xxhash64("part", F.lit(s)), F.lit(1 << 20)).alias("tie"), F.lit(s).alias("s")) for s in range(shards)])
        target = counts.select("part", F.array_max(options)["s"].alias("target"))
        asked = nodes.join(target, "part", "left").withColumn("target", F.coalesce("target", "label"))
        asked = written(asked.withColumn("draw", F.pmod(F.xxhash64("node", "part"), F.lit(1 << 16))), "asked")
        # shards x shards numbers
        wishes = {(r.label, r.target): r.n for r in asked.filter(F.col("label") != F.col("target")).groupBy("label", "target").agg(F.sum("rows").alias("n")).collect()}
        held = {r.label: (r.n, r.spare) for r in asked.groupBy("label").agg(F.sum("rows").alias("n"), F.sum(F.when(F.col("single"), F.col("rows")).otherwise(0)).alias("spare")).collect()}
        if not wishes:
            nodes = asked.drop("target", "draw")
            break
        share, give = grants(wishes, held, shards, quota)
        limit = F.lit(0)
        for (a, b), part in share.items():
            limit = F.when((F.col("label") == a) & (F.col("target") == b), F.lit(int(part * (1 << 16)))).otherwise(limit)
        moved = F.when(~F.col("single") & (F.col("label") != F.col("target")) & (F.col("draw") < limit), F.col("target"))
        spare = F.lit(None)
        for a, ends in give.items():  # single documents make room: [(draw below, shard)]
            for below, b in reversed(ends):
                spare = F.when((F.col("label") == a) & (F.col("draw") < below), F.lit(b)).otherwise(spare)
        moved = F.when(F.col("single"), spare).otherwise(moved)
        nodes = written(asked.withColumn("label", F.coalesce(moved.cast("int"), "label")).drop("target", "draw"), "labels")
    return nodes


def grants(wishes: dict, held: dict, shards: int, quota: int) -> tuple[dict, dict]:
    """Granted share of every wish, and where single documents go: {shard: [(draw below, shard)]}.

    Sizes after the moves stay within the quota as far as single documents can make room.
    """
    size = [held.get(s, (0, 0))[0] for s in range(shards)]
    spare = [held.get(s, (0, 0))[1] for s in range(shards)]
    into = [sum(n for (_, b), n in wishes.items() if b == s) for s in range(shards)]
    out = [sum(n for (a, _), n in wishes.items() if a == s) for s in range(shards)]
    # a shard takes in what its quota, its own movers and its single documents leave room for
    part = [min(1.0, max(0.0, (quota - size[s] + out[s] + spare[s]) / into[s])) if into[s] else 1.0 for s in range(shards)]
    share = {(a, b): part[b] for a, b in wishes}
    after = [float(size[s]) for s in range(shards)]
    for (a, b), n in wishes.items():
        after[a] -= share[a, b] * n
        after[b] += share[a, b] * n
    room = [max(0.0, quota - x) for x in after]
    give: dict[int, list[tuple[int, int]]] = {}
    for a in range(shards):
        over, done = min(max(0.0, after[a] - quota), spare[a]), 0.0
        for b in range(shards):
            take = min(over - done, room[b])
            if take > 0:
                room[b] -= take
                done += take
                give.setdefault(a, []).append((int(done / spare[a] * (1 << 16)), b))
    return share, give


def shard(docs: DataFrame, shards: int = 8, rounds: int = 4, text_column: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    spark = docs.sparkSession
    base = written(nodes_of(docs, text_column), "nodes")
    n = base.count()
    quota = n // shards
    # cells of a link by bucket; a cell's place in its link says which part it belongs to
    cells = base.filter(F.col("link").isNotNull()).groupBy("link", "bucket").agg(F.count("*").alias("rows"))
    by_link = W.partitionBy("link")  # PIECES rows at most
    before = F.sum("rows").over(by_link.orderBy("bucket")) - F.col("rows")
    cells = cells.withColumn("link_rows", F.sum("rows").over(by_link)).withColumn("before", before)
    part_rows = max(1, quota)
    cells = cells.select(
        F.concat_ws("/", "link", F.floor(F.col("before") / part_rows)).alias("part"),
        F.concat_ws("/", "link", F.col("bucket")).alias("node"),
        "rows", F.pmod(F.xxhash64("link", "bucket"), F.lit(shards)).cast("int").alias("label"), (F.col("link_rows") == 1).alias("single"),
    )
    nodes = propagate(written(cells, "cells"), shards, -(-n // shards), rounds)
    where = nodes.select("node", F.col("label").alias("labelled"), F.col("single"))
    loose = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(shards)).cast("int")
    key = F.when(F.col("link").isNotNull(), F.concat_ws("/", F.col("link"), F.col("bucket"))).otherwise(F.concat(F.lit("-"), F.col("doc_id"))).alias("node")
    placed = base.select("doc_id", "size", "text_crc32", key).join(where, "node", "left").select(
        "doc_id", "size", "text_crc32", F.coalesce("labelled", loose).alias("label"), F.coalesce("single", F.lit(True)).alias("single"),
        F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(NUMBERING)).cast("int").alias("bin"),
    )
    return even(spark, written(placed, "placed"), n, shards)


def even(spark, placed: DataFrame, n: int, shards: int) -> DataFrame:
    """Numbers the rows of every shard, linked ones first, and moves what is beyond its quota."""
    quotas = [n // shards + (s < n % shards) for s in range(shards)]
    cells = placed.groupBy("label", "single", "bin").agg(F.count("*").alias("n")).collect()  # shards x 2 x NUMBERING numbers
    have = [sum(c.n for c in cells if c.label == s) for s in range(shards)]
    # the larger shards keep the odd rows
    order = sorted(range(shards), key=lambda s: (-have[s], s))
    quota = {s: quotas[i] for i, s in enumerate(order)}
    first, at = [], [0] * shards
    for c in sorted(cells, key=lambda c: (c.label, c.single, c.bin)):
        first.append((c.label, c.single, c.bin, at[c.label]))
        at[c.label] += c.n
    offsets = spark.createDataFrame(first, "label int, single boolean, bin int, before long")
    number = F.row_number().over(W.partitionBy("label", "single", "bin").orderBy("doc_id", "text_crc32", "size")) - 1
    rows = placed.withColumn("inside", number).join(F.broadcast(offsets), ["label", "single", "bin"]).withColumn("place", F.col("before") + F.col("inside"))
    # rows beyond a quota, in the order of shards, fill the shards below theirs
    over, spill = F.lit(None).cast("long"), 0
    for s in range(shards):
        over = F.when((F.col("label") == s) & (F.col("place") >= quota[s]), F.col("place") - quota[s] + spill).otherwise(over)
        spill += max(0, have[s] - quota[s])
    rows = rows.withColumn("over", over)
    shard, slot, filled = F.col("label"), F.col("place"), 0
    for s in range(shards):
        room = max(0, quota[s] - have[s])
        mine = (F.col("over") >= filled) & (F.col("over") < filled + room)
        shard, slot = F.when(mine, F.lit(s)).otherwise(shard), F.when(mine, F.col("over") - filled + have[s]).otherwise(slot)
        filled += room
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

"""Near-duplicate documents by circulant MinHash.

One permutation (a hash) puts every shingle on a circle of 2**20 places; coordinate k of the
signature is the least value of a second permutation, shifted circularly by k, over those places.
So a shingle's values for all coordinates stand side by side in one table.  Bands of coordinates
give buckets; pairs from buckets are confirmed by the exact Jaccard similarity of full sets.

Documents with equal sets are one class, named by the first half of its set's 128-bit digest.  Candidate
pairs are never all pairs of a bucket: its class of smallest name is compared with the others, which joins up
groups of copies.  In buckets that hold unconnected classes then, such as those that share one long passage,
the pairs still to compare are found exactly by shared shingles of prefixes, rarest first.  Every such shingle
names a few leaders a round, which are compared with what is not connected with them yet, and
components are joined up after each round.  So every linked pair of a bucket ends up compared or
connected, without a cap.  All buckets are counted; those that hold a large share of all classes are never
shuffled by their key.

Sets hold 64-bit hashes of shingles, and names of classes and rows are 64-bit hashes too.  With the default bands
a pair at similarity 0.8 shares no bucket with a chance of about 1e-5, and less above it.

Defined results: a null, empty or wordless text has an empty set and is alone; rows of one id and different texts
are one document, so what is near either is connected; a null id is no document's name: such a row takes the smallest
id of its group, and is kept by near_duplicates() only if there is none; deduplicated() keeps one row of each
group in any case, and all rows without words; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Memo, mix, pair_hash, short_batches, tidied, written

PLACES = 1 << 20
BANDS, ROWS = 60, 8
#: Most 64-bit keys that are sent to every executor: 8 MB.
BROADCAST_KEYS = 500_000
#: A bucket is hot that holds HOT of every SAMPLED classes, and HOT at least; so at most SAMPLED * BANDS / HOT
#: buckets are hot, which bounds what is sent to every executor.
SAMPLED, HOT = 16_384, 16
_NONE = np.empty(0, np.int64)
SALTS = 16
#: Leaders that a shared shingle names in the first round; in each one after, GROWTH times as many are named in all.
LEADERS, GROWTH = 16, 4
SETS = "doc_id long, row_key long, n_shingles long, class long, set_b long, bands array<bigint>"


def word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


def shingle_set(text: str | None, size: int, memo: Memo) -> np.ndarray:
    """Sorted hashes of the different shingles of a text; A-Z are lower-cased, words end at ASCII space."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    if len(words) < size:  # the whole sequence is one shingle, unlike any of full size
        out = np.full(1, len(words), np.uint64)
        for code in codes:
            out = pair_hash(out, np.array([code]))
        return mix(out)
    out = codes[: len(codes) - size + 1]
    for i in range(1, size):
        out = pair_hash(out, codes[i : len(codes) - size + 1 + i])
    return np.unique(out)


@lru_cache(maxsize=1)
def circle() -> np.ndarray:
    """The second permutation, unrolled: row i is what place i gives coordinates 0, 1, ..."""
    values = np.random.default_rng(20240229).permutation(PLACES).astype(np.int32)
    unrolled = np.concatenate([values, values[: BANDS * ROWS]])
    return np.lib.stride_tricks.sliding_window_view(unrolled, BANDS * ROWS)


def signature(shingles: np.ndarray) -> np.ndarray:
    """All coordinates: least shifted value over the places of the shingles."""
    places = (mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(44)).astype(np.int64)
    table, out = circle(), None
    for i in range(0, len(places), 256):  # bounded memory for long documents
        part = table[places[i : i + 256]].min(axis=0)
        out = part if out is None else np.minimum(out, part)
    return out


def band_hashes(coordinates: np.ndarray) -> np.ndarray:
    rows = coordinates.astype(np.uint64).reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        out = pair_hash(out, rows[:, i])
    return out


def sets_of(docs: DataFrame, size: int) -> DataFrame:
    """Per document: the size and a 128-bit digest of its set, and its bands; no set is kept."""
    short_batches(docs.sparkSession)

    def run(batches):
        memo = Memo(word_hash)
        for batch in batches:
            rows = []
            for doc_id, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = shingle_set(text, size, memo)
                memo.trim()
                a, b = digest(own.tobytes()) if len(own) else (0, 0)
                rows.append((doc_id, key, len(own), a, b, band_hashes(signature(own)).view(np.int64) if len(own) else _NONE))
                if len(rows) == 128:
                    yield out(rows)
                    rows = []
            yield out(rows)

    def out(rows):
        kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in SETS.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), SETS)


def row_key():
    """A hash of id and text, by which a row is found again."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def digest(blob: bytes) -> tuple[int, int]:
    import xxhash

    x = xxhash.xxh3_128_intdigest(blob)
    return tuple(int(v) - (1 << 64) if v >= 1 << 63 else int(v) for v in (x >> 64, x & (1 << 64) - 1))


def full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """class and shingles of the wanted classes (class, row_key), made anew from the texts."""
    chosen = docs.select(row_key().alias("row_key"), F.col("text").cast("string").alias("text")).join(bounded(wanted.select("row_key")), "row_key", "left_semi")

    def run(batches):
        memo = Memo(word_hash)
        for batch in batches:
            sets = []
            for text in batch.column(0).to_pylist():
                sets.append(shingle_set(text, size, memo).tobytes())
                memo.trim()
            yield pa.RecordBatch.from_arrays([pa.array([digest(x)[0] for x in sets], pa.int64()), pa.array(sets, pa.binary())], names=["class", "shingles"])

    # a row may be there several times
    return chosen.select("text").mapInArrow(tidied(run), "class long, shingles binary").dropDuplicates(["class"])


def bounded(keys: DataFrame) -> DataFrame:
    """Keys to be sent to every executor if they are few; else both sides of a join are shuffled."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def salted(rows: DataFrame, few: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """A join of many rows of one key with the few of a table that was grouped by it, dealt out by another column."""
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(few.withColumn("__salt", salt), [key, "__salt"], how).drop("__salt")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes, and whether their sets have 100 * common >= percent * union."""

    def run(batches):
        for batch in batches:
            hit = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if len(p) > len(q):
                    p, q = q, p
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                common = int((q[at] == p).sum())
                hit.append(100 * common >= percent * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hit, pa.bool_())], names=["a", "b", "hit"])

    one = sets.select(F.col("class").alias("a"), F.col("shingles").alias("set_1"))
    two = sets.select(F.col("class").alias("b"), F.col("shingles").alias("set_2"))
    both = pairs.join(two, "b").join(one, "a").select("a", "b", "set_1", "set_2")
    return both.mapInArrow(tidied(run), "a long, b long, hit boolean")


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest node) over links (a, b), by large-star and small-star rounds."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    while True:
        edges = written(edges, "edges")
        # done when every node has one edge down and no node both: stars alone are left
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up = 1 and down = 1").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        # large star: larger neighbours of a node go to its smallest neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = salted(both.filter("v > u"), low, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()


def grouped(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, row_key, n_shingles, component (a class) and component_id of every row; both null without words."""
    sets = written(sets_of(docs, size), "sets")
    worded = sets.filter("n_shingles > 0")
    # the row that stands for a class is the one of smallest key
    classes = written(worded.groupBy("class", "set_b").agg(F.min("row_key").alias("row_key"), F.min("doc_id").alias("low_id"), F.min("n_shingles").alias("n_shingles")), "classes")
    # rows of one id are one document: the classes of its texts are connected
    ids = worded.filter("doc_id is not null").groupBy("doc_id").agg(F.min("class").alias("a"), F.max("class").alias("last")).filter("a <> last").select("doc_id", "a")
    same = worded.join(ids, "doc_id").filter("class <> a").select("a", F.col("class").alias("b")).distinct()
    known = _joined(docs, worded, classes, same, size, percent)
    roots = classes.select("class", "set_b", "low_id").join(known, "class", "left").withColumn("component", F.coalesce("component", "class"))
    ids = roots.groupBy("component").agg(F.min("low_id").alias("component_id"))
    named = salted(roots, ids, "component", "class").select("class", "set_b", "component", "component_id")
    # one class may hold a third of all rows: classes are repeated, rows dealt out
    named = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = sets.select("doc_id", "row_key", "n_shingles", "class", "set_b", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt"))
    # sets of rows without words match no class
    out = out.withColumn("class", F.when(F.col("n_shingles") > 0, F.col("class")))
    return out.join(named, ["class", "set_b", "salt"], "left").select("doc_id", "row_key", "n_shingles", "component", "component_id")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return grouped(docs, size, percent).select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each group one row of its smallest id."""
    rows = written(grouped(docs, size, percent).filter("component is not null"), "grouped")
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    stays = rows.filter(first).groupBy("component").agg(F.min("row_key").alias("stays"))
    both = salted(rows, stays, "component", "row_key")
    gone = both.filter(~first | (F.col("row_key") != F.col("stays"))).select(F.col("row_key").alias("__row")).distinct()
    # rows that are there several times, word for word, among those that stay
    again = both.filter(first & (F.col("row_key") == F.col("stays"))).groupBy(F.col("row_key").alias("__row")).count().filter("count > 1").select("__row")
    keyed = docs.withColumn("__row", row_key()).join(bounded(written(gone, "gone")), "__row", "left_anti")
    again = written(again, "again")
    if not again.isEmpty():
        again = bounded(again)
        one = keyed.join(again, "__row", "left_semi").dropDuplicates(["__row"])
        keyed = keyed.join(again, "__row", "left_anti").unionByName(one)
    return keyed.select(*[F.col(f"`{c}`") for c in docs.columns])


def prefix_rows(full: DataFrame, open_classes: DataFrame, percent: int) -> DataFrame:
    """key, class, n_shingles, place and leads: the shingles by which the open classes can meet.

    Shingles of a class are placed rarest first, ties by hash.  The first common shingle of a linked pair has
    the whole intersection from its place on, in both sets.  So of a set only the places before which enough
    is left matter; fewer of them when it is the smaller of the pair, which leads.
    """

    def run(batches):
        for batch in batches:
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(blob.as_buffer(), np.int64)
                for i in range(0, len(own), 1 << 16):
                    part = own[i : i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), name)), pa.array(np.full(len(part), len(own)))], names=["key", "class", "n_shingles"])

    rows = full.join(open_classes, "class", "left_semi").select("class", "shingles").mapInArrow(tidied(run), "key long, class long, n_shingles long")
    # shingles of one class alone come first and meet nothing
    rows = written(rows, "shingles")
    # a written table is shuffled for the join, so that Spark can split hot keys there
    shared = rows.join(written(rows.groupBy("key").agg(F.count("*").alias("classes")).filter("classes > 1"), "shared"), "key")
    own = W.partitionBy("class")
    place = F.col("n_shingles") - F.count("*").over(own) + F.row_number().over(own.orderBy("classes", "key")) - 1
    rest = F.col("n_shingles") - F.col("place")
    kept = shared.withColumn("place", place).filter(100 * rest >= percent * F.col("n_shingles"))
    return kept.select("key", "class", "n_shingles", "place", ((100 + percent) * rest >= 2 * percent * F.col("n_shingles")).alias("leads"))


def _joined_up(known: DataFrame | None, links: DataFrame) -> DataFrame:
    """class and component after new links (a, b); only components that they touch are joined up."""
    if known is None:
        return components(links).withColumnRenamed("node", "class")
    if links.isEmpty():
        return known
    links = links.join(known.withColumnsRenamed({"class": "a", "component": "ca"}), "a", "left").join(known.withColumnsRenamed({"class": "b", "component": "cb"}), "b", "left")
    joined = components(links.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))).withColumnRenamed("node", "class")
    moved = joined.select(F.col("class").alias("component"), F.col("component").alias("to"))
    both = known.join(moved, "component", "left").select("class", F.coalesce("to", "component").alias("component"))
    return written(both.unionByName(joined.join(known, "class", "left_anti")), "components")


def buckets(own: DataFrame, n: int) -> DataFrame:
    """key, class, n_shingles and first, the smallest class of the bucket, of all its other members.

    own: class, n_shingles and bands of n classes.
    """
    keys = own.select("class", "n_shingles", F.explode("bands").alias("key"))
    by_key = W.partitionBy("key")
    hot = written(keys.groupBy("key").count().filter(F.col("count") >= max(HOT, n * HOT // SAMPLED)).select("key"), "hot")
    cold = keys.join(F.broadcast(hot), "key", "left_anti").withColumn("first", F.min("class").over(by_key))
    out = cold.filter("first <> class")
    if not hot.isEmpty():
        warm = keys.join(F.broadcast(hot), "key")
        out = out.unionByName(warm.join(F.broadcast(warm.groupBy("key").agg(F.min("class").alias("first"))), "key").filter("first <> class").select(out.columns))
    return out


def _joined(docs: DataFrame, sets: DataFrame, classes: DataFrame, same: DataFrame, size: int, percent: int) -> DataFrame:
    """class and component of the classes that confirmed links, or ids they share, join to others."""
    own = sets.select("class", "row_key", "n_shingles", "bands").join(classes.select("class", "row_key"), ["class", "row_key"], "left_semi")
    others = written(buckets(own.select("class", "n_shingles", "bands"), classes.count()).distinct(), "buckets")
    wanted = written(classes.join(others.select(F.explode(F.array("class", "first")).alias("class")).distinct(), "class", "left_semi").select("class", "row_key", "n_shingles"), "wanted")
    full = written(full_sets(docs, wanted, size), "sets")
    # every bucket's class of smallest name is compared with the others
    pairs = others.select(F.col("first").alias("a"), F.col("class").alias("b"), "n_shingles").distinct().join(wanted.select(F.col("class").alias("a"), F.col("n_shingles").alias("n")), "a")
    near = F.lit(100) * F.least("n_shingles", "n") >= F.lit(percent) * F.greatest("n_shingles", "n")
    verdicts = written(linked(pairs.filter(near).select("a", "b"), full, percent), "verdicts")
    tested = verdicts.select("a", "b")
    known = _joined_up(None, verdicts.filter("hit").select("a", "b").unionByName(same))
    # buckets whose other members are not connected yet are open
    state = others.select("key", "class").join(known, "class", "left").withColumn("component", F.coalesce("component", "class"))
    ajar = state.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
    open_classes = written(salted(state, ajar, "key", "class", "left_semi").select("class").distinct(), "open")
    # leaders come from the smallest components: large ones are groups that their first class has joined up
    mates = known.join(known.groupBy("component").count(), "component").select("class", F.col("count").alias("mates"))
    state = prefix_rows(full, open_classes, percent).join(mates, "class", "left").withColumn("mates", F.coalesce("mates", F.lit(1)))
    before, leaders = 0, LEADERS
    while True:
        state = state.join(known, "class", "left").withColumn("component", F.coalesce("component", "class")) if before else written(state.join(known, "class", "left").withColumn("component", F.coalesce("component", "class")), "prefixes")
        keys = state.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count_if("leads").alias("n")).filter((F.col("low") != F.col("high")) & (F.col("n") > before))
        state = written(salted(state, keys.select("key"), "key", "class", "left_semi"), "round")
        if state.isEmpty():
            return known
        rank = F.row_number().over(W.partitionBy("key").orderBy("mates", "class"))
        x = state.filter("leads").withColumn("rank", rank).filter(F.col("rank") <= leaders).filter(F.col("rank") > before)
        x = x.select("key", *(F.col(c).alias(f"{c}_x") for c in ("class", "n_shingles", "place", "component")))
        left = F.least(F.col("n_shingles") - F.col("place"), F.col("n_shingles_x") - F.col("place_x"))
        pairs = salted(state, x, "key", "class").filter(
            (F.col("component") != F.col("component_x")) & (F.struct("n_shingles_x", "class_x") < F.struct("n_shingles", "class"))
            & ((100 + percent) * left >= percent * (F.col("n_shingles") + F.col("n_shingles_x")))
        )
        pairs = pairs.select(F.least("class", "class_x").alias("a"), F.greatest("class", "class_x").alias("b")).distinct()
        verdicts = written(linked(pairs.join(tested, ["a", "b"], "left_anti"), full, percent), "verdicts")
        tested = tested.unionByName(verdicts.select("a", "b"))
        known = _joined_up(known, verdicts.filter("hit").select("a", "b"))
        state, before, leaders = state.drop("component"), leaders, leaders * GROWTH

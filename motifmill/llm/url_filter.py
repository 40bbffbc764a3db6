"""URL filters: host and path rules, and an exact Bloom filter cascade, in DataFrame operations alone.

The cascade holds listed keys against a complete key universe, here all domain suffixes of the
hosts of the corpus.  Level 1 encodes the listed keys; level 2 the keys that level 1 takes for
listed and that aren't; level 3 the listed ones that level 2 holds, and so on until no key errs.
A key of the universe is listed exactly if the first level without it is an even one.  A filter
is one binary literal in the expressions, so no join is needed.  Listed keys of the universe are dealt to parts by
hash, each with filters of at most MAX_BITS; a level holds an array of its parts' filters.  A plan so carries about
one byte per listed key that occurs in the corpus, whatever their number; the driver puts them together from 64-bit words.

Defined results: a null url or one without `://` has an empty host and path, fits no rule and is
allowed; empty paths fit no rule, as every rule's path starts with `/`; repeated rows are judged
each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: (host, path, verdict); a rule fits its host and all subdomains, and paths that start with its own.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Hosts that are listed where no rule fits; all their subdomains are too.
LISTED = ("spam-farm.example.org", "ads-track.example.com", "adult-x.example.com", "free-bets.example.net", "casino-win.example.net", "cheap-pills.example.net")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASHES, BITS_PER_KEY = 4, 8
#: Bits of one filter.
MAX_BITS = 1 << 23


def host_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty without `://`."""
    at = F.locate("://", url)
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(after, r"\A([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(after, r"\A[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def best_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name, verdict = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def suffixes(host: Column) -> Column:
    """A host and its parent domains."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("part")), F.lit(parts)).cast("int")


class Bloom:
    """The filters of one level, one binary literal per part."""

    def __init__(self, keys: DataFrame, level: int, parts: int):
        self.level, self.parts = level, parts
        part = part_of(F.col("key"), parts)
        sizes = dict(keys.groupBy(part.alias("part")).count().collect())  # a row per part
        bits = [64 * max(1, math.ceil(sizes.get(p, 0) * BITS_PER_KEY / 64)) for p in range(parts)]
        self.sizes = [F.lit(b) for b in bits]
        place = F.explode(F.array(*[self.bit(F.col("key"), i) for i in range(HASHES)]))
        words = keys.select(part.alias("part"), place.alias("at")).groupBy("part", F.floor(F.col("at") / 64).cast("int").alias("word"))
        words = words.agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(64)).cast("int"))).alias("v"))
        filters = [bytearray(b // 8) for b in bits]
        for row in words.toLocalIterator():  # bits / 64 numbers at most
            struct.pack_into("<q", filters[row.part], 8 * row.word, row.v)
        self.filters = [F.lit(bytes(x)) for x in filters]

    def bit(self, key: Column, i: int) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(self.level * HASHES + i)), self.own(key, self.sizes))

    def own(self, key: Column, values: list[Column]) -> Column:
        """The value of the key's part."""
        return values[0] if self.parts == 1 else F.element_at(F.array(*values), part_of(key, self.parts) + 1)

    def holds(self, key: Column) -> Column:
        own, out = self.own(key, self.filters), F.lit(True)
        for i in range(HASHES):
            at = self.bit(key, i)
            byte = F.conv(F.hex(F.substring(own, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            out = out & (F.call_function("shiftright", byte, F.pmod(at, F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return out


class Cascade:
    """Exact membership of a universe's keys; `universe` has key and listed, one row per key."""

    def __init__(self, universe: DataFrame):
        inside = universe.filter("listed").select("key")
        outside = universe.filter(~F.col("listed")).select("key")
        self.levels: list[Bloom] = []
        n = inside.count()
        parts = max(1, math.ceil(n * BITS_PER_KEY / MAX_BITS))
        while n:
            level = Bloom(inside, len(self.levels), parts)
            self.levels.append(level)
            # what errs on this level is what the next one holds
            inside, outside = written(outside.filter(level.holds(F.col("key"))), "cascade"), inside
            n = inside.count()

    def lists(self, key: Column) -> Column:
        """True for the listed keys of the universe, false for its others."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i, level in reversed(list(enumerate(self.levels))):
            out = F.when(~level.holds(key), F.lit(i % 2 == 1)).otherwise(out)
        return out


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, url_column: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and listed of every row; `listed` has a column key of hosts."""
    host, path = host_path(F.col(url_column).cast("string"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    keys = urls.select("host").distinct().select(F.explode(suffixes(F.col("host"))).alias("key")).distinct()
    marks = listed.select(F.translate(F.col("key"), UPPER, LOWER).alias("key")).filter("key <> ''").distinct().withColumn("listed", F.lit(True))
    universe = written(keys.join(marks, "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed")), "universe")
    urls = urls.withColumn("listed", F.exists(suffixes(F.col("host")), Cascade(universe).lists))
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return urls.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "listed")

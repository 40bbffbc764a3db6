"""Language ID by interpolated Kneser-Ney character models.

A word is a run of letters, lower-cased, with boundary marks before it and one after it, so a
character's context never crosses words.  Word counts of all training rows are gathered by Spark;
the n-gram counts of the highest order follow from them, and the lower orders from its types.
No n-gram is left out.  Probabilities and back-off weights are worked out by Spark and stored as
sorted arrays of 64-bit hashes in the shared folder, in shards by leading bits, which workers map
into memory: the driver holds the names of the shards and a few numbers per language.

The language of least cross-entropy per character wins (ties: the smaller name).  A text is
rejected when its cross-entropy lies more than `tolerance` standard errors of its length above
what all training rows of that language show (and over half the way from there to a model of equally
likely letters), or when it has no letter.

Defined results: `und`, score 0 and rejected for a null text and one without letters; repeated
rows are judged each; with no training rows every text is `und`; an empty table gives an empty
table; columns beside text are never read for a prediction.
"""

from __future__ import annotations

import math
import re
import unicodedata
import shutil
import tempfile
import uuid
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.fs
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import beside, crc_split, mix, shared_dir, short_batches, tidied, written

ORDER = 5
#: Entries of one shard, about: what a task sorts in memory.
SHARD_ENTRIES = 1 << 20
#: Sets the hashes of contexts apart from those of the n-grams.
CONTEXT = np.uint64(0x5555555555555555)
#: Words whose scores a worker keeps.
SCORED_WORDS = 300_000
#: Turns differences of cross-entropy into the score.
SHARPNESS = 4.0
START, END = "\x02", "\x03"
_RUN, _ASCII_RUN = regex.compile(r"\p{L}+"), re.compile(r"[a-z]+")
JUDGED = "__lang_pred string, __score double, __cross_entropy double, __n_scored long, __rejected boolean"
#: What a worker finds; __own is the summed cross-entropy of a training row in its own language.
SCORED = "__lang_pred string, __score double, __cross_entropy double, __n_scored long, __own double"


def words_of(text: str) -> list[str]:
    """The letter runs (categories L*) of a text, lower-cased; marks and numbers such as ½ or Ⅷ are no letters."""
    text = text.lower()
    return _ASCII_RUN.findall(text) if text.isascii() else _RUN.findall(unicodedata.normalize("NFC", text))


def _hash(codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of rows of characters."""
    out = np.full(len(codes), codes.shape[1], np.uint64)
    for i in range(codes.shape[1]):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + codes[:, i].astype(np.uint64))
    return out


def hashes(grams: list[str], width: int) -> np.ndarray:
    """64-bit hashes of n-grams of one width."""
    return _hash(np.array(grams, f"<U{width}").view(np.uint32).reshape(len(grams), width)) if grams and width else np.zeros(len(grams), np.uint64)


def packed(codes: np.ndarray, columns: np.ndarray, values: np.ndarray) -> bytes:
    """One shard: its sorted different hashes, where the entries of each start, and the entries."""
    by_hash = np.lexsort((columns, codes))
    keys, first = np.unique(codes[by_hash], return_index=True)
    starts = np.append(first, len(codes))
    return b"".join([np.array([len(keys), len(codes)], "<i8").tobytes(), keys.astype("<u8").tobytes(), starts.astype("<i8").tobytes(), values[by_hash].astype("<f8").tobytes(), columns[by_hash].astype("<i4").tobytes()])


def unpacked(shard: bytes | str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts, values and columns of packed bytes, or of the file that holds them."""
    raw = np.frombuffer(shard, np.uint8) if isinstance(shard, bytes) else np.memmap(_local(shard), np.uint8, "r")
    n, m = raw[:16].view("<i8").tolist()
    out, at = [], 16
    for kind, size in (("<u8", n), ("<i8", n + 1), ("<f8", m), ("<i4", m)):
        stop = at + size * np.dtype(kind).itemsize
        out.append(np.asarray(raw[at:stop]).view(kind))
        at = stop
    return tuple(out)


def _local(uri: str):
    """A file that can be mapped: the shared one, or a nameless copy where the store is remote."""
    fs, path = pa.fs.FileSystem.from_uri(uri)
    if isinstance(fs, pa.fs.LocalFileSystem):
        return path
    copy = tempfile.TemporaryFile()
    with fs.open_input_stream(path) as file:
        shutil.copyfileobj(file, copy)
    copy.flush()
    return copy


@lru_cache(maxsize=2)
def opened(shards: tuple[bytes | str, ...]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Shards of one model, mapped once per worker."""
    return [unpacked(x) for x in shards]


def shard_of(codes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each hash, by its leading bits."""
    return ((codes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


@dataclass
class Model:
    """languages; sorted hashes with entries per language; calibration per language."""

    languages: list[str]
    order: int
    #: discounted probabilities of n-grams and back-off weights of contexts: packed bytes or files
    shards: tuple[bytes | str, ...]
    base: np.ndarray  # uniform probability of each language's alphabet
    centre: np.ndarray = field(default_factory=lambda: np.empty(0))
    spread: np.ndarray = field(default_factory=lambda: np.empty(0))

    def log_probs(self, words: list[str]) -> np.ndarray:
        """[len(words), L]: summed log probabilities of every word's characters and its end."""
        if not words:
            return np.empty((0, len(self.languages)))
        n = self.order
        text = "".join([START * (n - 1) + w + END for w in words])
        scored = np.array([len(w) + 1 for w in words])
        first = np.cumsum(scored + n - 1) - (scored + n - 1)  # windows that start and end in one word
        starts = np.cumsum(scored) - scored
        at = np.arange(scored.sum()) + np.repeat(first - starts, scored)
        windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text.encode("utf-32-le"), np.uint32), n)
        # words share most of their n-grams: each different one is looked up once
        _, place, which = np.unique(_hash(windows[at]), return_index=True, return_inverse=True)
        codes = np.ascontiguousarray(windows[at[place]])
        p = np.tile(self.base, (len(codes), 1))
        for k in range(1, n + 1):
            p *= self._look((_hash(codes[:, n - k : n - 1]) if k > 1 else np.zeros(len(codes), np.uint64)) ^ CONTEXT, 1.0)
            p += self._look(_hash(codes[:, n - k :]), 0.0)
        return np.add.reduceat(np.log(p)[which.ravel()], starts, axis=0)

    def _look(self, wanted: np.ndarray, missing: float) -> np.ndarray:
        out = np.full((len(wanted), len(self.languages)), missing)
        parts = opened(self.shards)
        owner = shard_of(wanted, max(len(parts), 1))
        order = np.argsort(owner, kind="stable")
        bounds = np.searchsorted(owner[order], np.arange(len(parts) + 1))
        for (keys, starts, values, columns), low, high in zip(parts, bounds[:-1], bounds[1:], strict=True):
            if low == high or not len(keys):
                continue
            mine = order[low:high]
            at = np.minimum(np.searchsorted(keys, wanted[mine]), len(keys) - 1)
            hit = keys[at] == wanted[mine]
            mine, first, counts = mine[hit], starts[at[hit]], starts[at[hit] + 1] - starts[at[hit]]
            entry = np.arange(counts.sum()) + np.repeat(first - np.cumsum(counts) + counts, counts)
            out[np.repeat(mine, counts), columns[entry]] = values[entry]
        return out


def fit(counts: dict[str, dict[str, int]], order: int = ORDER) -> Model:
    """counts: language -> {n-gram of the highest order -> count}."""
    languages = sorted(counts)
    parts: list[list[tuple[dict, dict]]] = [[] for _ in range(order)]
    base = []
    for language in languages:
        grams = {g: float(c) for g, c in counts[language].items()}
        alphabet = {g[-1] for g in grams}
        base.append(1.0 / (len(alphabet) + 1))
        for k in range(order, 0, -1):
            ones, twos = (sum(c == x for c in grams.values()) for x in (1, 2))
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            total: dict[str, float] = {}
            types: dict[str, int] = {}
            for g, c in grams.items():
                h = g[:-1]
                total[h] = total.get(h, 0.0) + c
                types[h] = types.get(h, 0) + 1
            parts[k - 1].append(({g: max(c - discount, 0.0) / total[g[:-1]] for g, c in grams.items()}, {h: discount * types[h] / total[h] for h in total}))
            # continuation counts: the different left neighbours of each shorter n-gram
            grams = {g: float(c) for g, c in Counter(g[1:] for g in grams).items()}
    codes, columns, values = [], [], []
    for k in range(1, order + 1):
        for column, x in enumerate(parts[k - 1]):
            for which, width, salt in ((0, k, np.uint64(0)), (1, k - 1, CONTEXT)):
                codes.append(hashes(list(x[which]), width) ^ salt)
                columns.append(np.full(len(x[which]), column))
                values.append(np.array(list(x[which].values()), np.float64))
    shards = (packed(*map(np.concatenate, (codes, columns, values))),) if codes else ()
    return Model(languages, order, shards, np.array(base))


def gather(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, gram and n: all n-grams of the highest order, over all rows of docs (text, lang)."""
    short_batches(docs.sparkSession)

    def words(batches):
        seen: dict[str, Counter] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(words_of(text or ""))
            if sum(map(len, seen.values())) > 200_000:
                yield from flush(seen)
                seen = {}
        yield from flush(seen)

    def flush(seen):
        for lang, out in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(out)), pa.array(list(out)), pa.array(list(out.values()), pa.int64())], names=["lang", "word", "n"])

    def grams(batches):
        seen: dict[tuple[str, str], int] = {}
        for batch in batches:
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                padded = START * (order - 1) + word + END
                for i in range(len(padded) - order + 1):
                    key = (lang, padded[i : i + order])
                    seen[key] = seen.get(key, 0) + n
            if len(seen) > 200_000:
                yield out(seen)
                seen = {}
        yield out(seen)

    def out(seen):
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["lang", "gram", "n"])

    counted = docs.select("text", "lang").mapInArrow(tidied(words), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return written(counted.mapInArrow(tidied(grams), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")


def fit_stored(counted: DataFrame, order: int = ORDER, entries: int = SHARD_ENTRIES) -> Model:
    """What fit() makes of gather()'s table, with its numbers in files of the shared folder."""
    spark = counted.sparkSession
    levels = {order: counted}
    for k in range(order - 1, 0, -1):
        # continuation counts: the different left neighbours of each shorter n-gram
        levels[k] = written(levels[k + 1].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n")), "grams")
    # all levels are one table: few stages at a time for the driver to keep
    rows = reduce(DataFrame.unionByName, [x.select("lang", F.lit(k).alias("k"), "gram", "n") for k, x in levels.items()])
    of = rows.groupBy("lang", "k").agg(F.count("*").alias("grams"), F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos"))
    stats = {(r.lang, r.k): r for r in of.collect()}  # languages x orders
    languages = sorted({lang for lang, _ in stats})
    discounts = {key: r.ones / (r.ones + 2 * r.twos) if r.ones and r.twos else 0.5 for key, r in stats.items()}
    # the shortest n-grams are the alphabet
    base = np.array([1.0 / (stats[x, 1].grams + 1) for x in languages])
    parts, place = max(1, math.ceil(2 * sum(r.grams for r in stats.values()) / entries)), {x: i for i, x in enumerate(languages)}
    # a context is followed by no more n-grams than its language has letters
    own = W.partitionBy("lang", "k", "context")
    rows = rows.withColumn("context", F.expr("substring(gram, 1, k - 1)")).select(
        "lang", "k", "gram", "n", F.sum("n").over(own).alias("total"), F.count("*").over(own).alias("types"), (F.row_number().over(own.orderBy("gram")) == 1).alias("leads"))

    def hashed(batches):  # an entry of every n-gram and, beside its first one, of every context
        for batch in batches:
            langs, ks, grams = (batch.column(i).to_pylist() for i in range(3))
            n, total, types = (batch.column(i).to_numpy().astype(np.float64) for i in (3, 4, 5))
            leads = np.flatnonzero(batch.column(6).to_numpy(zero_copy_only=False))
            widths, codes, contexts = np.array(ks, np.int64), np.zeros(len(ks), np.uint64), np.zeros(len(leads), np.uint64)
            for width in set(ks):
                mine = np.flatnonzero(widths == width)
                codes[mine] = hashes([grams[i] for i in mine], width)
                mine = np.flatnonzero(widths[leads] == width)
                contexts[mine] = hashes([grams[i][: width - 1] for i in leads[mine]], width - 1)
            codes = np.concatenate([codes, contexts ^ CONTEXT])
            d, columns = np.array([discounts[key] for key in zip(langs, ks, strict=True)]), np.array([place[x] for x in langs], np.int32)
            values = np.concatenate([np.maximum(n - d, 0.0) / total, (d * types / total)[leads]])
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(codes, parts)), pa.array(codes.view(np.int64)), pa.array(np.append(columns, columns[leads])), pa.array(values)], names=["shard", "code", "language", "value"])

    folder = f"{shared_dir(spark)}/language-model-{uuid.uuid4().hex}"

    def store(batches):
        def flush():
            # a task that runs twice writes two files; the one whose name arrives counts
            name = f"{folder}/{shard}-{uuid.uuid4().hex}"
            with fs.open_output_stream(f"{path}/{name.rsplit('/', 1)[1]}") as file:
                file.write(packed(*(np.concatenate(x) for x in zip(*held, strict=True))))
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([name])], names=["shard", "name"])

        fs, path = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        shard, held = None, []
        for batch in batches:
            shards, codes, columns, values = (c.to_numpy() for c in batch.columns)
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if low == high:
                    continue
                if held and shards[low] != shard:
                    yield flush()
                    held = []
                shard = int(shards[low])
                held.append((codes[low:high].view(np.uint64), columns[low:high], values[low:high]))
        if held:
            yield flush()

    stored = rows.mapInArrow(tidied(hashed), "shard long, code long, language int, value double")
    stored = stored.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(tidied(store), "shard long, name string")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    names = dict(stored.collect())  # one row per shard
    empty = packed(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0))
    return Model(languages, order, tuple(names.get(i, empty) for i in range(parts)), base)


class Scorer:
    """Texts to language, confidence and cross-entropy."""

    def __init__(self, model: Model):
        self.model = model
        self.place = {x: i for i, x in enumerate(model.languages)}
        self.memo: dict[str, int] = {}
        self.rows = np.empty((0, len(model.languages) + 1))

    def sums(self, texts: list[str | None]) -> np.ndarray:
        """[len(texts), L + 1]: log probabilities of each text and the characters scored."""
        split = [words_of(t) if t else () for t in texts]
        if len(self.memo) > SCORED_WORDS:
            self.memo, self.rows = {}, self.rows[:0]
        new = list({w: None for words in split for w in words if w not in self.memo})
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            scores = np.column_stack([self.model.log_probs(part), np.array([len(w) + 1 for w in part])])
            self.memo.update(zip(part, range(len(self.rows), len(self.rows) + len(part)), strict=True))
            self.rows = np.concatenate([self.rows, scores])
        get = self.memo.__getitem__
        return np.array([self.rows[list(map(get, words))].sum(0) if words else np.zeros(self.rows.shape[1]) for words in split]).reshape(len(texts), -1)

    def score(self, texts: list[str | None], learnt: list[str | None]) -> list[pa.Array]:
        """The columns of SCORED; learnt: the language of each text that the model has learnt from."""
        sums, names = self.sums(texts), self.model.languages
        n = sums[:, -1]
        if not names:
            return [pa.array(["und"] * len(n), pa.string()), pa.array(np.zeros(len(n))), pa.nulls(len(n), pa.float64()), pa.array(n.astype(np.int64)), pa.nulls(len(n), pa.float64())]
        entropy = -sums[:, :-1] / np.maximum(n, 1)[:, None]
        best = entropy.argmin(1)
        least = entropy[np.arange(len(best)), best]
        score = 1.0 / np.exp(np.minimum((least[:, None] - entropy) * SHARPNESS, 0.0)).sum(1)
        own = np.array([self.place.get(x, -1) for x in learnt], np.int64)
        return [
            pa.array(np.where(n == 0, "und", np.array(names, object)[best]), pa.string()),
            pa.array(np.where(n == 0, 0.0, score)), pa.array(least, mask=n == 0), pa.array(n.astype(np.int64)),
            pa.array(-sums[np.arange(len(own)), own], mask=own < 0),
        ]


def train(docs: DataFrame) -> Model:
    """A model from the rows of docs that have a lang and a text."""
    labelled = learnable(docs.select("text", "lang")).filter(F.col("__learnt").isNotNull())
    model = fit_stored(gather(labelled))
    return calibrated(model, scored(labelled, model, keep_text=False)) if model.languages else model


def learnable(docs: DataFrame, training: Column | None = None) -> DataFrame:
    """docs with the language that a row teaches as __learnt: null without a text, or where `training` does not hold."""
    known = F.col("text").isNotNull()
    return docs.withColumn("__learnt", F.when(known if training is None else known & training, F.col("lang")))


def calibrated(model: Model, rows: DataFrame) -> Model:
    """Sets centre and spread from all training rows; rows: what scored() makes of them, and of others."""
    own, n = F.col("__own"), F.col("__n_scored")
    # per-character deviation, as deviations of means scale with the root of the length
    found = rows.filter(F.col("__learnt").isNotNull() & (n > 0)).groupBy("__learnt").agg(
        F.sum(own).alias("s"), F.sum(n).alias("n"), F.sum(own * own / n).alias("q"), F.count("*").alias("k"))
    found = {r["__learnt"]: r for r in found.collect()}  # a row per language
    means = {x: r.s / r.n for x, r in found.items()}
    model.centre = np.array([means.get(x, 0.0) for x in model.languages])
    model.spread = np.array([math.sqrt(max(found[x].q - means[x] * found[x].s, 0.0) / found[x].k) if x in found else math.inf for x in model.languages])
    return model


def scored(docs: DataFrame, model: Model, keep_text: bool = True) -> DataFrame:
    """The rows of docs, what learnable() gives, with the columns of SCORED behind them."""
    short_batches(docs.sparkSession)
    # names of shards and a few numbers per language
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return beside(docs, lambda: Scorer(shared.value).score, SCORED, keep_text, ("__learnt",))


def rejecting(rows: DataFrame, model: Model, tolerance: float) -> DataFrame:
    """What scored() gave, with the columns of JUDGED."""
    least, n = F.col("__cross_entropy"), F.col("__n_scored")
    rejected = n == 0 if model.languages else F.lit(True)
    if len(model.centre):
        of = lambda values: F.create_map(*[F.lit(x) for pair in zip(model.languages, values.tolist(), strict=True) for x in pair])[F.col("__lang_pred")]
        # never below half the way to a model that knows the alphabet alone
        floor = (-np.log(model.base) - model.centre) / 2
        above = least > of(model.centre) + F.greatest(tolerance * of(model.spread) / F.sqrt(F.greatest(n, F.lit(1))), of(floor))
        rejected = rejected | F.coalesce(above, F.lit(False))
    return rows.withColumn("__rejected", rejected).drop("__learnt", "__own")


def judged(docs: DataFrame, model: Model, tolerance: float = 8.0, keep_text: bool = True) -> DataFrame:
    """The rows of docs with the columns of JUDGED behind them."""
    return rejecting(scored(docs.withColumn("__learnt", F.lit(None).cast("string")), model, keep_text), model, tolerance)


def learnt_and_judged(docs: DataFrame, training: Column | None = None, tolerance: float = 8.0, keep_text: bool = True) -> DataFrame:
    """judged() by what train() makes of the rows of docs where `training` holds (all: null); every text is scored once."""
    docs = learnable(docs, training)
    model = fit_stored(gather(docs.filter(F.col("__learnt").isNotNull())))
    rows = scored(docs, model, keep_text)
    if model.languages:
        rows = written(rows, "scored")
        model = calibrated(model, rows)
    return rejecting(rows, model, tolerance)


def identify(docs: DataFrame, model: Model | None = None, training: Column | None = None, tolerance: float = 8.0) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy, n_scored and rejected of every row; without a model, by one of the training rows of docs."""
    id, text = F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    if model is None:
        # `lang` is what rows teach: null where they are held out
        rows = docs.select(id, text, F.col("lang") if training is None else F.when(training, F.col("lang")).alias("lang"))
        out = learnt_and_judged(rows, None, tolerance, keep_text=False).drop("lang")
    else:
        out = judged(docs.select(id, text), model, tolerance, keep_text=False)
    return out.withColumnsRenamed({x: x.removeprefix("__") for x in (y.split()[0] for y in JUDGED.split(", "))})


def in_training() -> Column:
    """Whether a row may be learnt from: crc32 of the id as text, modulo 3, is not 1."""
    return F.col("lang").isNotNull() & (crc_split() != 1)


def training_rows(docs: DataFrame) -> DataFrame:
    """The rows that may be learnt from."""
    return docs.filter(in_training())

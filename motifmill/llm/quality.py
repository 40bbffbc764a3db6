"""Quality classifier with hierarchical empirical-Bayes sites.

A logistic model over shape measures and telling words scores each document.  Its soft verdicts
are summed over hosts and over paths of hosts (here: source, and source with language).  A host's
posterior shrinks toward the global rate with the strength that the spread of hosts gives (method
of moments); a path's shrinks toward its host's in the same way; sparse sites so stay near their
priors.  A document's own verdict is left out of the sites that judge it.  The final log-odds are
the document's plus what its path's posterior differs from the global rate.

Toxicity is judged by a model of its own over the same measures, without sites: one insult among much
good prose hardly moves the score above.  A document is rejected by either.

The models are fitted on all labelled rows; for toxicity, on those that say whether they are toxic.  Words are
counted by Spark, and a Newton step adds up gradients and curvatures of tasks, so that no task holds all rows.
Sites count all documents.

Defined results: a null text counts as empty; an empty text is judged by its shape alone; null source and
lang are sites of their own, apart from empty ones; repeated rows count each; of a document that is labelled twice
the worse labels count, of a labelled id with several texts the least one; without labels of both classes nothing is
rejected and scores are 0.5, without labels of toxic and other rows toxic_score is null; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Memo, beside, short_batches, tidied, written

#: Labelled rows of a task that adds up a Newton step, about.
TASK_ROWS = 20_000
#: Bits of the map of labelled ids, for each of them, and of one part of it.
ID_BITS, MAP_BITS = 8, 1 << 20
#: Telling words that the model keeps, and labelled rows that must hold one.
WORDS, MIN_ROWS = 400, 5
SALTS = 32
#: Toxicity above which a document is rejected: as low as held-out labelled rows allow without losing more than
#: this share of the clean ones, within these bounds.
CLEAN_LOSS, TOXIC, FOLDS = 0.005, (0.3, 0.5), 4
#: Measures of shape().
N_SHAPE = 10
SCORED = "__doc_score double, __toxic_score double"
_LINE = re.compile(r"[.!?]\s*$")


def shape(text: str, tokens: list[str]) -> list[float]:
    """Shares that tell prose from junk; each within 0 to 1 but the first."""
    n, lines = max(len(tokens), 1), text.split("\n")
    alone = sum(not any(map(str.isalnum, t)) for t in set(tokens))
    return [
        math.log1p(len(tokens)) / 10,
        1.0 if len(tokens) < 10 else 0.0,
        len(set(tokens)) / n,
        sum(map(str.isupper, tokens)) / n,
        sum(map(text.count, "|#$%&*!")) / max(len(text), 1) * 10,
        alone / max(len(set(tokens)), 1),
        sum(map(text.count, "0123456789")) / max(len(text), 1),
        sum(bool(_LINE.search(x)) for x in lines) / len(lines),
        len(set(lines)) / len(lines),
        min(len(text) / n, 40) / 40,
    ]


@dataclass
class Model:
    words: dict[str, int]
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # shape, words, bias; a column per verdict where there are two
    cutoff: float = TOXIC[1]  # of toxicity

    def rows(self, texts: list[str | None], memo: Memo) -> np.ndarray:
        out = np.zeros((len(texts), len(self.centre) + len(self.words) + 1))
        base = len(self.centre)
        for i, text in enumerate(texts):
            tokens = (text or "").split()
            out[i, :base] = (np.array(shape(text or "", tokens)) - self.centre) / self.scale
            for at in set(map(memo.__getitem__, tokens)):
                if at >= 0:
                    out[i, base + at] = 1.0
            memo.trim()
        out[:, -1] = 1.0
        return out

    def memo(self) -> Memo:
        return Memo(lambda token: self.words.get(normal(token), -1))

    def score(self, texts: list[str | None], memo: Memo) -> np.ndarray:
        return sigmoid(self.rows(texts, memo) @ self.weights)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def normal(token: str) -> str:
    return token.lower().strip(".,;:!?\"'()[]|*#$%&")


def of_ids(ids: DataFrame, slot: Column, bits: int) -> np.ndarray:
    """A packed map of bits with those set that the slots of ids name: about a byte an id."""

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column(0).to_numpy()
            for part in np.unique(at // MAP_BITS).tolist():
                held.setdefault(part, np.zeros(MAP_BITS, bool))[at[at // MAP_BITS == part] % MAP_BITS] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([np.packbits(x).tobytes() for x in held.values()], pa.binary())], names=["part", "bits"])

    parts = math.ceil(bits / MAP_BITS)
    slots = ids.select(slot.alias("slot")).repartition(parts, F.expr(f"slot div {MAP_BITS}"))
    out = np.zeros((parts, MAP_BITS // 8), np.uint8)
    for part, found in slots.mapInArrow(tidied(run), "part long, bits binary").collect():
        out[part] = np.frombuffer(found, np.uint8)
    return out.ravel()


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """kind, shape and words of every labelled document; kind numbers its verdicts and its fold."""
    clean = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    told = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(clean).alias("clean"), F.max(F.col("toxic").cast("int")).alias("toxic"))
    told = written(told, "labels")
    bits = max(1, ID_BITS * told.count())
    hashed = F.xxhash64(F.col("doc_id").cast("string"))
    slot = F.pmod(hashed, F.lit(bits))
    known = docs.sparkSession.sparkContext.broadcast(of_ids(told, slot, bits))

    def run(batches):  # few texts of other documents are left to be shuffled
        for batch in batches:
            at = batch.column(2).to_numpy()
            yield batch.filter(pa.array((known.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool))).select([0, 1])

    rows = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("slot", slot).mapInArrow(tidied(run), rows.schema).groupBy("doc_id").agg(F.min("text").alias("text")).join(told, "doc_id")
    kind = (F.col("clean").cast("int") * 3 + F.when(F.col("toxic").isNull(), 2).otherwise((F.col("toxic") != 0).cast("int"))) * FOLDS + F.pmod(hashed, F.lit(FOLDS))

    def measured(batches):
        memo = Memo(normal)
        for batch in batches:
            shapes, words = [], []
            for text in batch.column(1).to_pylist():
                tokens = (text or "").split()
                shapes.append(shape(text or "", tokens))
                words.append(list(set(map(memo.__getitem__, set(tokens)))))
                memo.trim()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shapes, pa.list_(pa.float64())), pa.array(words, pa.list_(pa.string()))], names=["kind", "shape", "words"])

    return written(rows.select(kind.cast("int").alias("kind"), "text").mapInArrow(tidied(measured), "kind int, shape array<double>, words array<string>"), "labelled")


#: Kinds of rows: clean or not; toxic, not toxic or not told; and the fold.
KINDS = np.arange(2 * 3 * FOLDS)
CLEAN, TOLD, IS_TOXIC, FOLD = KINDS >= 3 * FOLDS, KINDS // FOLDS % 3 < 2, KINDS // FOLDS % 3 == 1, KINDS % FOLDS
#: Each model's rows and its class among them: clean ones, toxic ones, and toxic ones without one fold each.
FITS = [(KINDS >= 0, CLEAN), (TOLD, IS_TOXIC)] + [(TOLD & (FOLD != k), IS_TOXIC) for k in range(FOLDS)]


def telling_words(rows: DataFrame, totals: dict[int, np.ndarray]) -> dict[int, list[str]]:
    """Words of the highest likelihood-ratio statistic of presence against class for each fit."""
    listed = lambda kinds: F.col("kind").isin(KINDS[kinds].tolist())
    counts = []
    for m in totals:
        mine, good = FITS[m]
        counts += [F.count_if(listed(mine & ~good)).alias(f"bad{m}"), F.count_if(listed(mine & good)).alias(f"good{m}")]
    words = rows.select("kind", F.explode("words").alias("word")).filter("word <> ''").groupBy("word").agg(*counts)

    def statistic(m):
        bad, good = totals[m].tolist()
        rate = (F.col(f"bad{m}") + F.col(f"good{m}")) / F.lit(bad + good)
        cells = [(F.col(f"bad{m}"), rate * bad), (F.col(f"good{m}"), rate * good), (bad - F.col(f"bad{m}"), (1 - rate) * bad), (good - F.col(f"good{m}"), (1 - rate) * good)]
        telling = sum((F.when(seen > 0, seen * F.ln(seen / wanted)).otherwise(0.0) for seen, wanted in cells), F.lit(0.0))
        return F.struct(F.lit(m).alias("m"), (F.col(f"bad{m}") + F.col(f"good{m}")).alias("rows"), (2 * telling).alias("telling"))

    strong = words.select("word", F.explode(F.array(*map(statistic, totals))).alias("x")).select("word", "x.*").filter((F.col("rows") >= MIN_ROWS) & (F.col("telling") >= 12))
    strong = strong.withColumn("place", F.row_number().over(W.partitionBy("m").orderBy(F.desc("telling"), "word"))).filter(F.col("place") <= WORDS)
    out = {m: [] for m in totals}
    for r in strong.orderBy("m", "place").collect():  # at most WORDS rows a fit
        out[r.m].append(r.word)
    return out


class Rows:
    """A batch of numbered rows as the fits see them."""

    def __init__(self, batch: pa.RecordBatch):
        self.kind = batch.column(0).to_numpy()
        self.shapes = batch.column(1).flatten().to_numpy().reshape(len(self.kind), -1)
        offsets = batch.column(2).offsets.to_numpy()
        self.row, self.word = np.repeat(np.arange(len(self.kind)), np.diff(offsets)), batch.column(2).flatten().to_numpy()

    def matrix(self, model: Model, column: np.ndarray, mine: np.ndarray) -> np.ndarray:
        """Shapes, words and bias of the rows `mine`; column: each numbered word's place in the model, or -1."""
        base, to = len(model.centre), np.full(len(self.kind), -1)
        to[mine] = np.arange(len(mine))
        out = np.zeros((len(mine), base + len(model.words) + 1))
        out[:, :base] = (self.shapes[mine] - model.centre) / model.scale
        row, at = to[self.row], column[self.word]
        keep = (row >= 0) & (at >= 0)
        out[row[keep], base + at[keep]] = 1.0
        out[:, -1] = 1.0
        return out


def newton(numbered: DataFrame, models: dict[int, Model], columns: dict[int, np.ndarray], totals: dict[int, np.ndarray], rounds: int, ridge: float) -> None:
    """Sets the weights of all models, side by side; numbered: kind, shape and numbers of words."""
    spark = numbered.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    balance = {m: n.sum() / 2 / n for m, n in totals.items()}  # classes weighted alike
    for m, model in models.items():
        model.weights = np.zeros(len(model.centre) + len(model.words) + 1)
    left = set(models)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(({m: models[m] for m in left}, columns, balance))

        def sums(batches):
            models, columns, balance = shared.value
            gradient = {m: np.zeros(len(x.weights)) for m, x in models.items()}
            curve = {m: np.zeros((len(x.weights), len(x.weights))) for m, x in models.items()}
            for batch in batches:
                rows = Rows(batch)
                for m, model in models.items():
                    mine = np.flatnonzero(FITS[m][0][rows.kind])
                    x, good = rows.matrix(model, columns[m], mine), FITS[m][1][rows.kind[mine]]
                    p, weight = sigmoid(x @ model.weights), balance[m][good.astype(int)]
                    gradient[m] += x.T @ (weight * (good - p))
                    # the curvature only steers the steps: single precision will do
                    z = (x * np.sqrt(weight * np.maximum(p * (1 - p), 1e-6))[:, None]).astype(np.float32)
                    curve[m] += z.T @ z
            for m in models:
                cells = [g.tobytes() + row[i:].astype("<f4").tobytes() for i, (g, row) in enumerate(zip(gradient[m], curve[m], strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array([m] * len(cells), pa.int32()), pa.array(range(len(cells)), pa.int32()), pa.array(cells, pa.binary())], names=["m", "i", "cells"])

        def added(batches):
            held: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                for m, i, cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    row = np.append(np.frombuffer(cells, "<f8", 1), np.frombuffer(cells, "<f4", offset=8))
                    held[m, i] = held[m, i] + row if (m, i) in held else row
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.int32()), pa.array([k[1] for k in held], pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["m", "i", "cells"])

        found = numbered.mapInArrow(tidied(sums), "m int, i int, cells binary").repartition(parts, "m", "i").mapInArrow(tidied(added), "m int, i int, cells binary")
        gradient = {m: np.zeros(len(models[m].weights)) for m in left}
        curve = {m: np.zeros((len(models[m].weights),) * 2) for m in left}
        for m, i, cells in found.collect():  # a row per weight of each fit
            row = np.frombuffer(cells, "<f8")
            gradient[m][i], curve[m][i, i:], curve[m][i:, i] = row[0], row[1:], row[1:]
        shared.unpersist()
        for m in sorted(left):
            keep = np.append(np.full(len(gradient[m]) - 1, ridge), 0.0)
            step = np.linalg.solve(curve[m] + np.diag(keep + 1e-9), gradient[m] - keep * models[m].weights)
            models[m].weights = models[m].weights + step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < 1e-6:
                left.discard(m)
        if not left:
            break


def fit(rows: DataFrame, rounds: int = 30, ridge: float = 2.0) -> tuple[DataFrame | None, dict[int, Model], dict[int, np.ndarray]]:
    """Penalised logistic regressions by Newton steps: numbered rows, models of FITS and their columns; without both classes no model."""
    # a row per kind
    by_kind = rows.select("kind", *(F.col("shape")[i].alias(f"s{i}") for i in range(N_SHAPE))).groupBy("kind").agg(
        F.count("*").alias("n"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(N_SHAPE)), *(F.sum(F.col(f"s{i}") * F.col(f"s{i}")).alias(f"q{i}") for i in range(N_SHAPE)))
    moments = np.zeros((len(KINDS), 1 + 2 * N_SHAPE))
    for r in by_kind.collect():
        moments[r.kind] = r[1:]
    n = moments[:, 0]
    totals = {m: np.array([n[mine & ~good].sum(), n[mine & good].sum()]) for m, (mine, good) in enumerate(FITS)}
    totals = {m: x for m, x in totals.items() if x.all()}
    if 0 not in totals:
        return None, {}, {}
    words = telling_words(rows, totals)
    models, columns, number = {}, {}, {w: i for i, w in enumerate(dict.fromkeys(w for ws in words.values() for w in ws))}
    for m, strong in words.items():
        _, s, q = np.split(moments[FITS[m][0]].sum(0) / totals[m].sum(), [1, 1 + N_SHAPE])
        models[m] = Model({w: i for i, w in enumerate(strong)}, s, np.maximum(np.sqrt(np.maximum(q - s * s, 0.0)), 1e-3), np.empty(0))
        columns[m] = np.full(len(number), -1)
        columns[m][[number[w] for w in strong]] = np.arange(len(strong))
    known = pa.array(list(number), pa.string())

    def run(batches):
        for batch in batches:
            listed = batch.column(2)
            row = np.repeat(np.arange(len(listed)), np.diff(listed.offsets.to_numpy()))
            at = pc.index_in(listed.flatten(), value_set=known)
            hit = at.is_valid()
            starts = np.searchsorted(row[hit.to_numpy(zero_copy_only=False)], np.arange(len(listed) + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), at.filter(hit))], names=["kind", "shape", "words"])

    numbered = rows.mapInArrow(tidied(run), "kind int, shape array<double>, words array<int>").repartition(max(1, math.ceil(n.sum() / TASK_ROWS)))
    numbered = written(numbered, "numbered")
    newton(numbered, models, columns, totals, rounds, ridge)
    return numbered, models, columns


def side_by_side(one: Model, two: Model) -> Model:
    """Both models in one pass over a text: their words, and a column of weights each."""
    words = {w: i for i, w in enumerate(dict.fromkeys([*one.words, *two.words]))}
    base = len(one.centre)
    weights = np.zeros((base + len(words) + 1, 2))
    for column, model in enumerate((one, two)):
        slopes = model.weights[:base] / model.scale  # both models see the measures as the first one scales them
        weights[:base, column] = slopes * one.scale
        weights[[base + words[w] for w in model.words], column] = model.weights[base:-1]
        weights[-1, column] = model.weights[-1] + slopes @ (one.centre - model.centre)
    return Model(words, one.centre, one.scale, weights)


def largest(values: DataFrame, place: int) -> float | None:
    """The value at a place, from 0, of a column in descending order; None where it has fewer.  Narrows down by counts of 1,024 bins."""
    low = high = None
    v = F.col(values.columns[0])
    while True:
        bin_of, mine = F.lit(0), values
        if low is not None:
            mine = values.filter(v.between(low, high))
            bin_of = F.least(F.lit(1023), F.floor((v - low) / F.lit(high - low) * 1024))
        found = mine.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"), F.min(v).alias("low"), F.max(v).alias("high")).collect()
        for r in sorted(found, key=lambda r: -r.bin):
            if place < r.n:
                break
            place -= r.n
        else:
            return None
        low, high = r.low, r.high
        if low == high:
            return low


def toxic_cutoff(numbered: DataFrame, models: dict[int, Model], columns: dict[int, np.ndarray]) -> float:
    """The cutoff that clean rows bear when every row is judged by a model that has not seen it."""
    asked = [k for k in range(FOLDS) if 2 + k in models]
    shared = numbered.sparkSession.sparkContext.broadcast((models, columns))

    def run(batches):
        models, columns = shared.value
        for batch in batches:
            rows = Rows(batch)
            for k in asked:
                x = rows.matrix(models[2 + k], columns[2 + k], np.flatnonzero((CLEAN & TOLD & (FOLD == k))[rows.kind]))
                scores = sigmoid(x @ models[2 + k].weights)
                yield pa.RecordBatch.from_arrays([pa.array(scores)], names=["score"])

    judged = KINDS[CLEAN & TOLD & np.isin(FOLD, asked)].tolist()
    n = numbered.filter(F.col("kind").isin(judged)).count()
    if not n:
        return TOXIC[1]
    scores = written(numbered.mapInArrow(tidied(run), "score double").filter(F.col("score") >= TOXIC[0]), "scores")
    found = largest(scores, int(CLEAN_LOSS * n))
    return TOXIC[0] if found is None else min(found, TOXIC[1])


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Models of clean documents, quality 1 and not toxic, and of toxic ones beside it, fitted on all labelled rows."""
    short_batches(docs.sparkSession)
    numbered, models, columns = fit(labelled(docs, labels))
    if not (0 in models and 1 in models):
        return models.get(0)
    model = side_by_side(models[0], models[1])
    model.cutoff = toxic_cutoff(numbered, models, columns)
    return model


def score(docs: DataFrame, model: Model | None, keep_text: bool = False) -> DataFrame:
    """The rows of docs (text, source, lang) with the document classifier's verdicts, and their sites, behind them."""
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value
        memo = model and model.memo()

        def run(texts):
            scores = model.score(texts, memo).reshape(len(texts), -1) if model else np.full((len(texts), 1), 0.5)
            toxic = pa.array(scores[:, 1], pa.float64()) if scores.shape[1] > 1 else pa.nulls(len(texts), pa.float64())
            return [pa.array(scores[:, 0], pa.float64()), toxic]

        return run

    # a mark before every value sets an empty one apart from null
    site = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    return beside(docs, make, SCORED, keep_text).withColumns({"__host": site("source"), "__path": site("lang")})


def strength(groups: DataFrame, rate) -> float:
    """Prior weight in documents by the method of moments: from the spread of group rates around `rate`.

    groups: n, s and the rate that each shrinks toward.
    """
    p = F.col("s") / F.col("n")
    inside = F.sum(F.col("n") * rate * (1 - rate))
    found = groups.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count("*").alias("k"), F.sum(F.col("n") * (p - rate) * (p - rate)).alias("between"), inside.alias("inside")).first()
    if not found.n or found.k < 2:
        return 1.0
    within = max(found.inside / found.n, 1e-6)
    spare = (found.between - within * (found.k - 1)) / max(found.n - found.nn / found.n, 1e-9)
    return float(min(max(within / max(spare, 1e-9) - 1, 1.0), 1e6))


def judge(scored: DataFrame, threshold: float = 0.3, cutoff: float = TOXIC[1]) -> DataFrame:
    """The rows of scored, a written table, with __host_rate, __path_rate, __final and __rejected behind them."""
    paths = scored.groupBy("__host", "__path").agg(F.count("*").alias("n"), F.sum("__doc_score").alias("s"))
    paths = written(paths, "sites")  # sites, not documents
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    rate = (total.s + 0.5) / (total.n + 1) if total.n else 0.5
    hosts = paths.groupBy("__host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    host_weight = strength(hosts, F.lit(rate))
    hosts = hosts.select("__host", F.col("n").alias("host_n"), F.col("s").alias("host_s"), ((F.col("s") + host_weight * rate) / (F.col("n") + host_weight)).alias("host_all"))
    sites = paths.join(hosts, "__host")
    path_weight = strength(sites, F.col("host_all"))
    # one host may hold a third of all documents: its sites are repeated, its documents dealt out
    sites = sites.select("__host", "__path", F.struct("n", "s", "host_n", "host_s").alias("__site"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    out = scored.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(sites, ["__host", "__path", "__salt"])
    own, site = F.col("__doc_score"), lambda name: F.col(f"__site.{name}")
    host_rate = (site("host_s") - own + host_weight * rate) / (site("host_n") - 1 + host_weight)
    out = out.withColumn("__host_rate", host_rate)
    out = out.withColumn("__path_rate", (site("s") - own + path_weight * F.col("__host_rate")) / (site("n") - 1 + path_weight))
    logit = lambda p: F.ln(F.greatest(p, F.lit(1e-9)) / F.greatest(1 - p, F.lit(1e-9)))
    final = 1 / (1 + F.exp(-(logit(own) + logit(F.col("__path_rate")) - logit(F.lit(rate)))))
    out = out.withColumn("__final", final)
    return out.withColumn("__rejected", (F.col("__final") < threshold) | F.coalesce(F.col("__toxic_score") > cutoff, F.lit(False)))


def judged(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, keep_text: bool = True) -> DataFrame:
    """The rows of docs with verdicts behind them."""
    model = train(docs, labels)
    return judge(written(score(docs, model, keep_text), "scored"), threshold, model.cutoff if model else TOXIC[1])


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, doc_score, host_rate, path_rate, score, toxic_score and rejected of every row of docs (doc_id, text, source, lang)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "source", "lang")
    out = judged(rows, labels, threshold, keep_text=False)
    return out.select("doc_id", *(F.col(f"__{a}").alias(b) for a, b in (("doc_score", "doc_score"), ("host_rate", "host_rate"), ("path_rate", "path_rate"), ("final", "score"), ("toxic_score", "toxic_score"), ("rejected", "rejected"))))

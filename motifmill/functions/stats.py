"""Tail probabilities, false-discovery control, rank correlation, entropy.

Order statistics are computed on different values with their counts, so ties cost nothing, and in value
buckets: approximate quantiles cut the values, windows run within a bucket, and a table of one row per
bucket carries counts and minima across.  No window runs over all rows.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from ..sources.storage import written

BUCKETS = 200


@F.pandas_udf(T.DoubleType())
def chi2_sf(x: pd.Series) -> pd.Series:
    """Upper tail of chi-square with one degree of freedom."""
    known = {v: math.erfc(math.sqrt(v / 2)) if v > 0 else 1.0 for v in x.unique()}
    return x.map(known)


def _log_choose(n, k):
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def hypergeom_tail(hits: int, drawn: int, good: int, bad: int) -> float:
    """P(at least `hits` good ones among `drawn`); the shorter tail is summed."""
    low, high = max(0, drawn - bad), min(drawn, good)
    if hits <= low:
        return 1.0
    if hits > high:
        return 0.0

    def term(k):
        return _log_choose(good, k) + _log_choose(bad, drawn - k) - _log_choose(good + bad, drawn)

    mode = (drawn + 1) * (good + 1) // (good + bad + 2)

    def run(first, last, step):
        # the terms fall away from the mode, so the sum ends when they no longer count
        value = math.exp(term(first))
        total, k = value, first
        while k != last:
            ratio = (good - k) * (drawn - k) / ((k + 1) * (bad - drawn + k + 1)) if step > 0 else k * (bad - drawn + k) / ((good - k + 1) * (drawn - k + 1))
            value *= ratio
            total += value
            k += step
            if value < total * 1e-18:
                break
        return total

    if hits > mode:
        return min(1.0, run(hits, high, 1))
    return max(0.0, 1.0 - run(hits - 1, low, -1))


@F.pandas_udf(T.DoubleType())
def hypergeom_sf(hits: pd.Series, drawn: pd.Series, good: pd.Series, bad: pd.Series) -> pd.Series:
    """One-sided Fisher exact test; equal tables are summed once."""
    seen: dict = {}
    out = []
    for key in zip(hits.astype(int), drawn.astype(int), good.astype(int), bad.astype(int), strict=True):
        if key not in seen:
            seen[key] = hypergeom_tail(*key)
        out.append(seen[key])
    return pd.Series(out, dtype=float)


def value_buckets(df: DataFrame, column: str) -> DataFrame:
    """Adds __b, the bucket of a value, ascending with it; equal values share one."""
    cuts = df.agg(F.percentile_approx(column, [i / BUCKETS for i in range(1, BUCKETS)], 10_000).alias("c")).first().c or []
    cuts = sorted({float(c) for c in cuts if not math.isnan(c)})
    bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(column))) if cuts else F.lit(0)
    return df.withColumn("__b", bucket)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """The different non-null values (__v), their rows (__c), bucket (__b), and the rows of lower buckets (__before) and all (__all)."""
    values = written(df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("__v")).agg(F.count("*").alias("__c")), "values")
    cut = value_buckets(values, "__v")
    sizes = cut.groupBy("__b").agg(F.sum("__c").alias("__n"))  # BUCKETS rows at most
    sizes = sizes.withColumn("__before", F.sum("__n").over(W.orderBy("__b")) - F.col("__n")).withColumn("__all", F.sum("__n").over(W.partitionBy()))
    return cut.join(F.broadcast(sizes), "__b")


def benjamini_hochberg(df: DataFrame, p: str = "p_value", q: str = "q_value", tested: Column | None = None) -> DataFrame:
    """Adds false-discovery rates over the tested rows (those with a p); others get null."""
    tested = F.col(p).isNotNull() if tested is None else tested & F.col(p).isNotNull()
    rows = written(df.withColumn("__v", F.when(tested, F.col(p))), "tested")  # read twice
    inside = W.partitionBy("__b").orderBy("__v")
    upto = F.col("__before") + F.sum("__c").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow))
    ranked = written(value_counts(rows, "__v").withColumn("__ratio", F.col("__v") * F.col("__all") / upto), "ratios")
    lows = ranked.groupBy("__b").agg(F.min("__ratio").alias("__low")).withColumn("__later", F.min("__low").over(W.orderBy("__b").rowsBetween(1, W.unboundedFollowing)))
    value = F.least(F.min("__ratio").over(inside.rowsBetween(W.currentRow, W.unboundedFollowing)), F.coalesce("__later", F.lit(1.0)), F.lit(1.0))
    rates = written(ranked.join(F.broadcast(lows), "__b").select("__v", value.alias(q)), "rates")
    return rows.join(rates, "__v", "left").select(*df.columns, q)


def average_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds ranks from 1, ties at their mean; df is read twice, so it should be a written table."""
    before = F.col("__before") + F.sum("__c").over(W.partitionBy("__b").orderBy("__v").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("__c")
    ranks = written(value_counts(df, column).select("__v", (before + (F.col("__c") + 1) / 2).alias(name)), "ranks")
    return df.join(ranks, df[column] == ranks["__v"], "left").drop("__v")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: the rank correlation of two columns and the rows behind it."""
    rows = written(df.select(x, y), "ranked")
    ranked = average_rank(written(average_rank(rows, x, "__rx"), "ranked"), y, "__ry")
    return ranked.agg(F.corr("__rx", "__ry").alias("rho"), F.count("*").alias("n"))


def entropy(df: DataFrame, *keys: str) -> DataFrame:
    """One row: Shannon entropy in nats of the groups, how many, and groups per thousand rows."""
    groups = df.groupBy(*keys).agg(F.count("*").alias("n"))
    sums = groups.agg(F.sum("n").alias("rows"), F.count("*").alias("groups"), F.sum(F.col("n") * F.ln("n")).alias("s"))
    return sums.select("rows", "groups", (F.ln("rows") - F.col("s") / F.col("rows")).alias("entropy"), (F.col("groups") * 1000 / F.col("rows")).alias("per_thousand"))

"""Clusters of combinations that share scaffold keys, and their validation by split halves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import ieee
from ..functions.stats import spearman
from ..sources.storage import numbered, written
from .enrich import mantel_haenszel, stratum_terms, summed


def cluster_key(keys: list[Column]) -> Column:
    """Sorted member keys joined by a bar."""
    return F.array_join(F.array_sort(F.array(*keys)), "|")


def cluster_map(combos: DataFrame, scaffolds: DataFrame, columns: list[str], make_id) -> DataFrame:
    """combos with cluster_key and cluster_id; scaffolds is (frag_id, scaffold), make_id a Column function."""
    out = combos
    for i, c in enumerate(columns):
        out = out.join(scaffolds.select(F.col("frag_id").alias(c), F.col("scaffold").alias(f"__s{i}")), c, "left")
    out = out.withColumn("cluster_key", cluster_key([F.coalesce(F.col(f"__s{i}"), F.col(c).cast("string")) for i, c in enumerate(columns)]))
    return out.withColumn("cluster_id", make_id(F.col("cluster_key"))).drop(*[f"__s{i}" for i in range(len(columns))])


def recount(rows: DataFrame, mapped: DataFrame, columns: list[str]) -> DataFrame:
    """Per stratum and cluster: different compounds by class, as a compound may hold several members."""
    once = rows.join(mapped.select(*columns, "cluster_id"), columns).select("stratum", "compound", "activity", "cluster_id").dropDuplicates(["stratum", "compound", "cluster_id"])
    binder = F.col("activity") == 1
    return once.groupBy("stratum", "cluster_id").agg(
        F.sum(binder.cast("long")).alias("n_binder"), F.sum((~binder).cast("long")).alias("n_nonbinder"), F.min(F.when(binder, F.col("compound"))).alias("example_compound"))


def approximate(per_stratum: DataFrame, mapped: DataFrame, columns: list[str]) -> DataFrame:
    """Sums of member counts: a compound with two members counts twice."""
    return per_stratum.join(mapped.select(*columns, "cluster_id"), columns).groupBy("stratum", "cluster_id").agg(
        F.sum("n_binder").alias("n_binder"), F.sum("n_nonbinder").alias("n_nonbinder"), F.min("example_compound").alias("example_compound"))


def describe(scored: DataFrame, metric: str, columns: list[str], name: Column) -> DataFrame:
    """Per cluster: key, size, its best member and that one's metric, all member names best first."""
    better = F.struct(F.coalesce(F.when(~F.isnan(metric), -F.col(metric)), F.lit(float("inf"))).alias("m"), *columns)
    listed = scored.withColumn("__o", better).withColumn("__n", name).groupBy("cluster_id").agg(
        F.min("cluster_key").alias("cluster_key"), F.count("*").alias("n_members"),
        F.array_sort(F.collect_list(F.struct("__o", "__n", F.col(metric).alias("x"), "n_binder"))).alias("__m"))
    best = F.col("__m")[0]
    return listed.select("cluster_id", "cluster_key", "n_members", best["__n"].alias("best_member"), best["x"].alias("best_member_metric"), best["n_binder"].alias("best_member_n_binder"), F.array_join(F.col("__m")["__n"], ";").alias("members"))


def pooling_gain(clusters: DataFrame, described: DataFrame, metric: str) -> DataFrame:
    """What the cluster's metric gains over its best member's."""
    return clusters.join(described, "cluster_id", "left").withColumn("pooling_gain", ieee.div(F.col(metric), F.col("best_member_metric")))


def order_by_cluster(rows: DataFrame, metric: str, tiebreak: list[str]) -> DataFrame:
    """Rows with their cluster's best metric, size and index; clusters best first, members best first within."""
    mine = W.partitionBy("cluster_id")
    rows = written(rows, "members")  # read for the heads and for the members
    out = rows.withColumn("cluster_best", F.max(F.when(~F.isnan(metric), F.col(metric))).over(mine)).withColumn("cluster_size", F.count("*").over(mine))
    heads = rows.groupBy("cluster_id").agg(F.max(F.when(~F.isnan(metric), F.col(metric))).alias("cluster_best"))
    index = numbered(heads, [F.col("cluster_best").desc_nulls_last(), F.col("cluster_id")], "cluster_index").withColumn("cluster_index", (F.col("cluster_index") + 1).cast("int"))
    return out.join(index.select("cluster_id", "cluster_index"), "cluster_id").orderBy("cluster_index", ieee.nan_last(metric), *tiebreak)


def half_estimates(rows: DataFrame, units: list[str], half: Column, min_binder: int = 3, alpha: float = 1.0) -> DataFrame:
    """unit, half, log enrichment: Mantel-Haenszel per half, over strata of that half that hold positives.

    rows: one per compound and unit.  Totals come from all compounds of a half that have a unit.
    """
    split = rows.withColumn("half", half)
    once = split.select("stratum", "half", "compound", "activity").dropDuplicates(["stratum", "half", "compound"])
    binder = F.col("activity") == 1
    both = [F.sum(binder.cast("long")), F.sum((~binder).cast("long"))]
    totals = once.groupBy("stratum", "half").agg(both[0].alias("n_binders"), both[1].alias("n_nonbinders")).filter("n_binders > 0")
    counted = split.dropDuplicates(["stratum", "half", "compound", *units]).groupBy("stratum", "half", *units).agg(both[0].alias("n_binder"), both[1].alias("n_nonbinder"), F.min("compound").alias("example_compound"))
    # the half joins the stratum, so one table holds both halves
    tag = F.concat_ws("/", "stratum", F.col("half").cast("string"))
    totals = totals.withColumn("stratum", tag)
    # strata of a half without positives say nothing
    terms = stratum_terms(counted.withColumn("stratum", tag).join(totals.select("stratum"), "stratum", "left_semi"), totals)
    found = mantel_haenszel(summed(terms, [*units, "half"]).filter(F.col("n_binder") >= min_binder), alpha, test=False)
    return found.filter(ieee.finite(F.col("enrichment_mh")) & (F.col("enrichment_mh") > 0)).withColumn("log_enrichment", F.ln("enrichment_mh"))


def agreement(estimates: DataFrame, units: list[str]) -> DataFrame:
    """One row: units seen in both halves, their rank correlation and the median gap of their logs."""
    both = estimates.groupBy(*units).agg(F.max(F.when(F.col("half") == 0, F.col("log_enrichment"))).alias("a"), F.max(F.when(F.col("half") == 1, F.col("log_enrichment"))).alias("b")).filter("a is not null and b is not null")
    gap = both.agg(F.median(F.abs(F.col("a") - F.col("b"))).alias("median_gap"))
    return spearman(both, "a", "b").crossJoin(gap)  # one row each


def homogeneity(members: DataFrame, estimates: DataFrame, units: list[str]) -> DataFrame:
    """One row: mean variance of log enrichment within clusters against the noise between halves."""
    both = estimates.groupBy(*units).agg(F.max(F.when(F.col("half") == 0, F.col("log_enrichment"))).alias("a"), F.max(F.when(F.col("half") == 1, F.col("log_enrichment"))).alias("b")).filter("a is not null and b is not null")
    value = both.withColumn("x", (F.col("a") + F.col("b")) / 2).withColumn("noise", (F.col("a") - F.col("b")) * (F.col("a") - F.col("b")) / 4)
    inside = members.join(value, units).groupBy("cluster_id").agg(F.var_samp("x").alias("v"), F.avg("noise").alias("e"), F.count("*").alias("n")).filter("n > 1")
    return inside.agg(F.count("*").alias("n_clusters"), F.avg("v").alias("within"), F.avg("e").alias("noise")).withColumn("ratio", ieee.div(F.col("within"), F.col("noise")))

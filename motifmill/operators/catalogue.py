"""Transfer of hits to an unlabelled catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import ids
from ..sources.storage import numbered


def dictionary(rows: DataFrame, labelled: bool = True) -> DataFrame:
    """Fragments with names by frequency; rows: compound, activity, frag_id, smiles, hac, once per compound."""
    aggs = [F.count("*").alias("n_compounds"), F.min("smiles").alias("frag_smiles"), F.min("hac").alias("hac"), attachments(F.min("smiles")).alias("n_attachments")]
    binder = F.sum((F.col("activity") == 1).cast("long"))
    aggs += [binder.alias("n_binder"), (F.count("*") - binder).alias("n_nonbinder")] if labelled else [F.lit(None).cast("long").alias("n_binder"), F.lit(None).cast("long").alias("n_nonbinder")]
    return named(rows.groupBy("frag_id").agg(*aggs))


def attachments(smiles: Column) -> Column:
    return F.length(smiles) - F.length(F.replace(smiles, F.lit("*")))


def named(fragments: DataFrame) -> DataFrame:
    """Adds frag_name by falling n_compounds, then smiles."""
    return numbered(fragments, [F.desc("n_compounds"), F.col("frag_smiles"), F.col("frag_id")], "frag_name").withColumn("frag_name", ids.frag_name(F.col("frag_name")))


def targets(per_stratum: DataFrame, columns: list[str], min_binder: int) -> DataFrame:
    """Different combinations with support, over all strata."""
    return per_stratum.groupBy(*columns).agg(F.sum("n_binder").alias("n")).filter(F.col("n") >= min_binder).select(*columns)


def search(rows: DataFrame, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """The rows whose combination is wanted."""
    return rows.join(wanted.select(*columns).distinct(), columns, "left_semi")


def overlap(scored: DataFrame, catalogue: DataFrame, columns: list[str], count: str, hit: Column) -> DataFrame:
    """Scored units with their count in a catalogue, whether they occur there, and whether they are hits."""
    other = catalogue.select(*columns, F.col(count).alias("n_catalogue"))
    return scored.join(other, columns, "left").withColumn("n_catalogue", F.coalesce("n_catalogue", F.lit(0)).cast("long")).withColumn("in_catalogue", F.col("n_catalogue") > 0).withColumn("enriched", hit)


def analogues(parents: DataFrame, others: DataFrame) -> DataFrame:
    """Pairs of equal scaffold: (frag_id, scaffold) against (frag_id, scaffold), marked exact or analogue."""
    two = others.select(F.col("frag_id").alias("catalogue_frag_id"), "scaffold")
    return parents.join(two, "scaffold").withColumn("match", F.when(F.col("frag_id") == F.col("catalogue_frag_id"), "exact").otherwise("analogue"))


def capped(hits: DataFrame, unit: list[str], most: int, key: Column) -> DataFrame:
    """At most `most` rows of each unit, those of smallest hash: the buying list is this long by design."""
    return hits.withColumn("__r", F.row_number().over(W.partitionBy(*unit).orderBy(key))).filter(F.col("__r") <= most).drop("__r")


def check_settings(one: DataFrame, two: DataFrame, names: tuple[str, ...] = ("min_hac", "selector"), allow: bool = False) -> bool:
    """Whether two run summaries agree; a mismatch raises unless allowed."""
    a, b = one.select(*names).distinct().collect(), two.select(*names).distinct().collect()
    same = len(a) == 1 and a == b
    if not same and not allow:
        raise ValueError(f"libraries were fragmented differently: {a} and {b}")
    return same


def bands(shared: DataFrame, value: str, cuts: list[int], weight: str) -> DataFrame:
    """Share of types and of instances found elsewhere, by half-open bands; shared: value, weight, in_catalogue."""
    band = F.lit(0)
    for i, c in enumerate(cuts, 1):
        band = F.when(F.col(value) >= c, F.lit(i)).otherwise(band)
    there, w = F.col("in_catalogue"), F.col(weight)
    return shared.withColumn("band", band).groupBy("band").agg(
        F.count("*").alias("n_types"), F.sum(there.cast("long")).alias("n_shared"), F.avg(there.cast("double")).alias("share_types"),
        (F.sum(F.when(there, w).otherwise(0)) / F.sum(w)).alias("share_instances"))


def pair_sample(rows: DataFrame, columns: list[str], one_in: int, key: Column) -> DataFrame:
    """Different combinations whose hash one_in divides: the same everywhere, uniform over types."""
    return rows.filter(F.pmod(key, F.lit(one_in)) == 0).select(*columns).distinct()


def reuse(counted: DataFrame, levels: list[int], n: str = "n_compounds") -> DataFrame:
    """How many units, and which share of instances, have at least each of the counts."""
    one = counted.agg(F.count("*").alias("__t"), F.sum(n).alias("__i"), *[F.sum((F.col(n) >= x).cast("long")).alias(f"t{x}") for x in levels], *[F.sum(F.when(F.col(n) >= x, F.col(n)).otherwise(0)).alias(f"i{x}") for x in levels])
    rows = F.array(*[F.struct(F.lit(x).alias("at_least"), F.col(f"t{x}").alias("n_units"), (F.col(f"i{x}") / F.col("__i")).alias("share_instances")) for x in levels])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def coverage(counted: DataFrame, shares: list[float], n: str = "n_compounds") -> DataFrame:
    """The least number of most frequent units that cover each share; by different counts, not by units."""
    sizes = counted.groupBy(n).agg(F.count("*").alias("u"))
    w = W.orderBy(F.desc(n))
    total = F.sum(F.col("u") * F.col(n)).over(W.partitionBy())
    run = sizes.withColumn("units", F.sum("u").over(w) - F.col("u")).withColumn("sum", F.sum(F.col("u") * F.col(n)).over(w) - F.col("u") * F.col(n)).withColumn("all", total)
    rows = run.withColumn("share", F.explode(F.array(*map(F.lit, shares))))
    need = F.ceil((F.col("share") * F.col("all") - F.col("sum")) / F.col(n))
    return rows.filter((need >= 1) & (need <= F.col("u"))).groupBy("share").agg(F.min(F.col("units") + need).alias("n_units"))


def discovery(rows: DataFrame, columns: list[str], shard: str) -> DataFrame:
    """New and cumulative different units by shard."""
    first = rows.groupBy(*columns).agg(F.min(shard).alias(shard)).groupBy(shard).agg(F.count("*").alias("n_new"))
    return first.withColumn("n_seen", F.sum("n_new").over(W.orderBy(shard)))


def shared_compounds(one: DataFrame, two: DataFrame, pairs: DataFrame, columns: list[str]) -> DataFrame:
    """Compounds of both libraries: those that hold a shared pair, then equal multisets, then equal canonical form.

    one, two: compound, canonical, set_key and the pair columns, one row per pair.  A lower bound, as
    compounds of a single fragment hold no pair.
    """
    left, right = (search(x, pairs, columns).select("compound", "canonical", "set_key").distinct() for x in (one, two))
    left = left.join(right.select("set_key").distinct(), "set_key", "left_semi").filter("canonical is not null")
    return left.select("canonical", F.col("compound").alias("compound_1")).join(right.select("canonical", F.col("compound").alias("compound_2")), "canonical").dropDuplicates(["canonical", "compound_1", "compound_2"])


def parent_overlap(one: DataFrame, two: DataFrame, unit: str, similarity: Column, most: int, key_1: Column, key_2: Column) -> DataFrame:
    """Per shared unit: parents on both sides (capped by hash, as the comparison samples them), best similarity, identical ones."""
    a, b = capped(one, [unit], most, key_1), capped(two, [unit], most, key_2)
    pairs = a.join(b, unit).withColumn("__s", similarity)
    return pairs.groupBy(unit).agg(F.countDistinct("compound_1").alias("n_1"), F.countDistinct("compound_2").alias("n_2"), F.max("__s").alias("best"), F.sum((F.col("__s") == 1.0).cast("long")).alias("n_identical"))

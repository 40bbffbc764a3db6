"""The whole analysis over files, stage by stage: every stage reads what earlier ones left in a work folder.

fragment, combine, score, inspect, cluster, validate for a labelled library; targets, and catalogue against
a second work folder, for an unlabelled one; report for a page that stands by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import ids
from ..operators import catalogue, chemistry, cluster, enrich, graph, reports
from ..sources import library
from ..sources.package import ship
from ..sources.storage import written

NESTED = "compound string, text string, activity tinyint, frag_ids array<bigint>, frag_smiles array<string>, hac array<smallint>, n_attachments array<smallint>, edge_src array<smallint>, edge_dst array<smallint>, stratum string"


def here(spark: SparkSession, path: str) -> bool:
    return bool(library.file_names(spark, path, "*"))


def put(df: DataFrame, path: str) -> DataFrame:
    """df as a table of the work folder, read back, so that nothing is worked out twice."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def nested(spark: SparkSession, work: str) -> DataFrame:
    """Compounds with their fragments; strata keep their spelling."""
    rows = spark.read.schema(NESTED).parquet(f"{work}/fragmented")
    return rows.withColumn("activity", F.when(F.col("activity") >= 0, F.col("activity")))


def labelled(totals: DataFrame) -> bool:
    """Whether every stratum has labels for all of its compounds."""
    return bool(totals.agg(F.bool_and("labelled").alias("l")).first().l)


def fragment(spark: SparkSession, source: str, work: str, pattern: str = "*.parquet", floor: int = 5, selector: str = "balanced", first_files: int | None = None, shard: str | None = None, resume: bool = False, reduce_only: bool = False) -> dict:
    """Fragments of all compounds, the ones that cannot be read, totals by stratum, the dictionary, and a summary."""
    ship(spark)
    if not reduce_only:
        rows = library.read_library(spark, source, pattern, first_files, shard)
        cut = chemistry.fragment_library(library.stored_activity(rows), "text", floor, selector)
        library.write_strata(cut.select(*[c.split()[0] for c in NESTED.split(", ")]), f"{work}/fragmented", "append" if resume or shard else "overwrite")
    fine, bad = library.failed(nested(spark, work), "frag_ids")
    bad = put(bad.select("stratum", "compound", "text"), f"{work}/failed")
    count = fine.groupBy("stratum").agg(
        F.count("*").alias("n_compounds"), F.sum("activity").cast("long").alias("n_binders"),
        F.sum(1 - F.col("activity")).cast("long").alias("n_nonbinders"), F.bool_and(F.col("activity").isNotNull()).alias("labelled"))
    totals = put(count, f"{work}/totals")
    # a fragment counts once per compound, so repeats go within the row
    once = F.array_distinct(F.arrays_zip("frag_ids", "frag_smiles", "hac"))
    each = fine.select("compound", "activity", F.explode(once).alias("f")).select("compound", "activity", F.col("f.frag_ids").alias("frag_id"), F.col("f.frag_smiles").alias("smiles"), F.col("f.hac").alias("hac"))
    known = put(catalogue.dictionary(each, labelled(totals)), f"{work}/dictionary")
    whole = totals.agg(F.sum("n_compounds").alias("c"), F.sum("n_binders").alias("b")).first()
    summary = {"min_hac": floor, "selector": selector, "n_compounds": whole.c or 0, "n_binders": whole.b, "n_failed": bad.count(), "n_fragments": known.count()}
    library.write_summary(spark, f"{work}/summary", summary)
    return summary


def combine(spark: SparkSession, work: str, sizes: tuple[int, ...] = (2,), targets: str | None = None, keep_rows: bool = True) -> None:
    """Connected combinations of each size: their rows, unless not wanted, and counts by stratum."""
    if min(sizes) < 2:
        raise ValueError("combinations have two members at least")
    compounds = nested(spark, work).filter("frag_ids is not null").select("compound", "activity", "stratum", "frag_ids", "edge_src", "edge_dst")
    has_labels = labelled(spark.read.parquet(f"{work}/totals"))
    for size in sizes:
        keys = graph.combo_columns(size)
        rows = graph.combinations(compounds, size)
        if targets:
            rows = catalogue.search(rows, spark.read.parquet(f"{targets}/targets_{size}"), keys)
        if keep_rows:
            rows = put(rows, f"{work}/rows_{size}")
        put(enrich.counts(rows, keys, has_labels), f"{work}/counts_{size}")


def with_names(spark: SparkSession, work: str, rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the names of their fragments, joined."""
    known = spark.read.parquet(f"{work}/dictionary").select("frag_id", "frag_name")
    for i, k in enumerate(keys):
        rows = rows.join(known.select(F.col("frag_id").alias(k), F.col("frag_name").alias(f"__n{i}")), k, "left")
    names = [F.col(f"__n{i}") for i in range(len(keys))]
    return rows.withColumn("combo", ids.combo_name(names, [F.col(k) for k in keys])).drop(*[f"__n{i}" for i in range(len(keys))])


def score(spark: SparkSession, work: str, sizes: tuple[int, ...] = (2,), alpha: float = 1.0, min_binder: int = 1, min_count: int = 5, stratify: bool = True, rank: str = "mh_lo95", top: int = 1500) -> None:
    """Enrichment of all combinations with support, in full and as a list of the best, and of single fragments."""
    totals = spark.read.parquet(f"{work}/totals")
    if not labelled(totals):
        raise ValueError("an unlabelled library cannot be scored")
    for size in sizes:
        keys = graph.combo_columns(size)
        found = enrich.score(spark.read.parquet(f"{work}/counts_{size}"), totals, keys, alpha, min_binder, min_count, stratify, stratify)
        found = put(with_names(spark, work, found, keys), f"{work}/scored_{size}")
        enrich.ranked(found, rank if stratify or rank == "ratio" else "pooled_lo95", keys).limit(top).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{work}/top_{size}.csv")
    whole = totals.agg(F.sum("n_binders").alias("b"), F.sum("n_nonbinders").alias("n")).first()
    single = spark.read.parquet(f"{work}/dictionary").filter(enrich.support(min_binder, min_count))
    put(enrich.pooled(single, whole.b, whole.n, alpha, test=True), f"{work}/scored_1")


def inspect(spark: SparkSession, work: str, size: int = 2, top: int = 200, rank: str = "mh_lo95") -> DataFrame:
    """The best combinations, drawn as they stand in an example: the connected piece of the example that holds them."""
    keys, settings = graph.combo_columns(size), library.read_summary(spark, f"{work}/summary")
    best = enrich.ranked(spark.read.parquet(f"{work}/scored_{size}"), rank, keys).limit(top)
    found = written(best, "best")  # `top` rows
    example = nested(spark, work).select(F.col("compound").alias("example_compound"), "text", "frag_ids", "edge_src", "edge_dst")
    both = found.join(example.join(F.broadcast(found.select("example_compound").distinct()), "example_compound", "left_semi"), "example_compound", "left")
    fits = lambda s: F.array_sort(F.transform(s, lambda i: F.element_at("frag_ids", i + 1))) == F.array_sort(F.array(*keys))
    both = both.withColumn("members", F.element_at(F.filter(graph.connected_sets(size), fits), 1))
    drawn = both.withColumn("combo_smiles", chemistry.merged_text("text", "members", settings["min_hac"], settings["selector"]))
    drawn = drawn.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy("text"))).filter("__r = 1")  # one text of a compound whose id repeats
    return put(drawn.select(*found.columns, "combo_smiles"), f"{work}/inspected_{size}")


def scaffolds(spark: SparkSession, work: str, mode: str, max_strip: int | None) -> DataFrame:
    known = spark.read.parquet(f"{work}/dictionary").select("frag_id", "frag_smiles")
    return written(known.select("frag_id", chemistry.scaffold_key("frag_smiles", mode, max_strip).alias("scaffold")), "scaffolds")


def cluster_rows(spark: SparkSession, work: str, size: int = 2, mode: str = "substituent", max_strip: int | None = None, alpha: float = 1.0, approximate: bool = False, rank: str = "mh_lo95", top: int = 500) -> DataFrame:
    """Combinations of equal scaffolds as clusters: counted over compounds, scored, described by their members."""
    ship(spark)
    keys, totals = graph.combo_columns(size), spark.read.parquet(f"{work}/totals")
    scored, counts = spark.read.parquet(f"{work}/scored_{size}"), spark.read.parquet(f"{work}/counts_{size}")
    mapped = put(cluster.cluster_map(counts.select(*keys).distinct(), scaffolds(spark, work, mode, max_strip), keys, ids.md5_60), f"{work}/clusters_{size}_{mode}_map")
    if approximate or not here(spark, f"{work}/rows_{size}"):
        counted = cluster.approximate(counts, mapped, keys)
    else:
        counted = cluster.recount(spark.read.parquet(f"{work}/rows_{size}"), mapped, keys)
    found = enrich.score(counted, totals, ["cluster_id"], alpha)
    members = written(scored.join(mapped, keys), "members")
    described = cluster.describe(members, "enrichment_mh_lo95", keys, F.col("combo"))
    out = put(cluster.pooling_gain(found, described, "enrichment_mh_lo95"), f"{work}/clusters_{size}_{mode}")
    enrich.ranked(out, rank, ["cluster_id"]).limit(top).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{work}/clusters_{size}_{mode}.csv")
    put(cluster.order_by_cluster(members, "enrichment_mh_lo95", keys), f"{work}/members_{size}_{mode}")
    return out


def validate(spark: SparkSession, work: str, size: int = 2, modes: tuple[str, ...] = ("substituent", "series", "murcko", "generic"), max_strip: int | None = 2, min_binder: int = 3) -> DataFrame:
    """Per grouping: units, rank agreement of two halves of the compounds and the median gap; combinations themselves first."""
    ship(spark)
    keys, rows = graph.combo_columns(size), spark.read.parquet(f"{work}/rows_{size}")
    half = ids.md5_half(F.col("compound"))
    own = written(cluster.half_estimates(rows, keys, half, min_binder), "halves")
    out = cluster.agreement(own, keys).withColumn("grouping", F.lit("combo")).withColumn("within_over_noise", F.lit(None).cast("double"))
    for mode in modes:
        mapped = written(cluster.cluster_map(rows.select(*keys).distinct(), scaffolds(spark, work, mode, max_strip), keys, ids.md5_60), "map")
        units = written(cluster.half_estimates(rows.join(mapped.select(*keys, "cluster_id"), keys), ["cluster_id"], half, min_binder), "halves")
        spread = cluster.homogeneity(mapped.select(*keys, "cluster_id"), own, keys).select(F.col("ratio").alias("within_over_noise"))
        out = out.unionByName(cluster.agreement(units, ["cluster_id"]).withColumn("grouping", F.lit(mode)).crossJoin(spread))  # one row each
    return put(out.select("grouping", "n", "rho", "median_gap", "within_over_noise"), f"{work}/validation_{size}")


def targets(spark: SparkSession, work: str, sizes: tuple[int, ...] = (2,), min_binder: int = 5) -> None:
    """Combinations worth looking for in a catalogue."""
    for size in sizes:
        put(catalogue.targets(spark.read.parquet(f"{work}/counts_{size}"), graph.combo_columns(size), min_binder), f"{work}/targets_{size}")


def transfer(spark: SparkSession, work: str, other: str, out: str, size: int = 2, rank: str = "mh", alpha: float = 0.05, min_ratio: float = 0.01, min_binder: int = 5, min_lo95: float = 1.0, mode: str = "series", most: int = 1000, compounds: bool = True, allow: bool = False) -> dict:
    """What of a scored library a catalogue (`other`, fragmented and combined) holds: fragments, combinations, analogues, compounds."""
    ship(spark)
    one, two = (spark.createDataFrame([(s["min_hac"], s["selector"])], "min_hac int, selector string") for s in (library.read_summary(spark, f"{w}/summary") for w in (work, other)))
    catalogue.check_settings(one, two, allow=allow)
    keys = graph.combo_columns(size)
    single, known = spark.read.parquet(f"{work}/scored_1"), spark.read.parquet(f"{other}/dictionary")
    by_ratio = enrich.enriched("ratio", min_ratio=min_ratio, min_binder=min_binder)
    hit = by_ratio if rank == "ratio" else enrich.enriched("mh", alpha, min_lo95, q="q_value", lo95="enrichment_factor_lo95")
    fragments = put(catalogue.overlap(single, known, ["frag_id"], "n_compounds", hit), f"{out}/fragments")
    counted = spark.read.parquet(f"{other}/counts_{size}").groupBy(*keys).agg(F.sum("n_compounds").alias("n_compounds"))
    hit = by_ratio if rank == "ratio" else enrich.enriched("mh", alpha, min_lo95)
    combos = put(catalogue.overlap(spark.read.parquet(f"{work}/scored_{size}"), counted, keys, "n_compounds", hit), f"{out}/combos_{size}")
    parents = scaffolds(spark, work, mode, None).join(fragments.filter("enriched").select("frag_id"), "frag_id", "left_semi")
    links = put(catalogue.analogues(parents, scaffolds(spark, other, mode, None)), f"{out}/analogues")
    made = {"fragments": fragments.filter("enriched and in_catalogue").count(), "combos": combos.filter("enriched and in_catalogue").count(), "analogues": links.count()}
    if compounds:
        wanted = combos.filter("enriched and in_catalogue").select(*keys, "combo", "n_binder", "n_nonbinder")
        rows = spark.read.parquet(f"{other}/rows_{size}").join(wanted, keys)
        held = catalogue.capped(rows, keys, most, F.struct(F.md5(F.col("compound").cast("binary")), "compound", "stratum"))
        held = reports.lookup(held.select("compound", "stratum", *keys, "combo", "n_binder", "n_nonbinder"), "compound", nested(spark, other).groupBy("compound").agg(F.min("text").alias("smiles")), ["smiles"])
        made["compounds"] = put(reports.public(held), f"{out}/compounds_{size}").count()
    library.write_summary(spark, f"{out}/summary", made)
    return made


def report(spark: SparkSession, work: str, size: int = 2, mode: str = "series", top: int = 60, min_enrichment: float | None = None) -> str:
    """The page of the best members, cluster by cluster."""
    rows = spark.read.parquet(f"{work}/members_{size}_{mode}")
    if min_enrichment is not None:
        rows = rows.filter(F.col("enrichment_mh") >= min_enrichment)
    shown = ["cluster_index", "cluster_size", "cluster_key", "combo", "n_binder", "n_nonbinder", "enrichment_mh", "enrichment_mh_lo95", "q_value_mh"]
    page = reports.html(rows.orderBy("cluster_index", F.desc("enrichment_mh_lo95"), "combo").select(*shown), f"Enriched combinations of {size}", top)
    spark.createDataFrame([(page,)], "value string").coalesce(1).write.mode("overwrite").text(f"{work}/report_{size}_{mode}.html")
    return page

"""python -m motifmill STAGE ...: one stage of the analysis, on whatever Spark the session finds."""

from __future__ import annotations

import argparse

from .operators.enrich import RANKINGS

MODES = ("substituent", "series", "murcko", "generic")


def parser() -> argparse.ArgumentParser:
    """stages' flags and defaults, as users of other tools know them."""
    top = argparse.ArgumentParser(prog="motifmill")
    stages = top.add_subparsers(dest="stage", required=True)

    def stage(name: str, about: str) -> argparse.ArgumentParser:
        made = stages.add_parser(name, help=about)
        made.add_argument("--work-dir", required=name != "shard")
        return made

    def sizes(p, many: bool = True) -> None:
        p.add_argument("--sizes" if many else "--size", type=int, default=[2] if many else 2, **({"nargs": "+"} if many else {}))

    p = stage("shard", "deal a library out in even files")
    p.add_argument("--input-dir", required=True)
    p.add_argument("--out-dir", required=True)
    p.add_argument("--pattern", default="*.parquet")
    p.add_argument("--rows", type=int, default=90_000)

    p = stage("fragment", "break compounds into fragments")
    p.add_argument("--input-dir", required=True)
    p.add_argument("--pattern", default="*.parquet")
    p.add_argument("--min-hac", type=int, default=5)
    p.add_argument("--selector", choices=("balanced", "greedy"), default="balanced")
    p.add_argument("--limit", type=int, help="first files only")
    p.add_argument("--shard", help="i/N of the files, from 0")
    p.add_argument("--reduce-only", action="store_true")
    p.add_argument("--resume", action="store_true")

    p = stage("combine", "enumerate connected combinations")
    sizes(p)
    p.add_argument("--target-combos", help="work folder whose targets are the only combinations wanted")
    p.add_argument("--no-long-table", action="store_true")

    p = stage("score", "enrichment of combinations")
    sizes(p)
    p.add_argument("--alpha", type=float, default=1.0)
    p.add_argument("--min-binder", type=int, default=1)
    p.add_argument("--min-count", type=int, default=5)
    p.add_argument("--stratify", choices=("file", "none"), default="file")
    p.add_argument("--rank", choices=tuple(RANKINGS), default="mh_lo95")
    p.add_argument("--top", type=int, default=1500)

    p = stage("inspect", "draw the best combinations")
    sizes(p, False)
    p.add_argument("--top", type=int, default=200)

    p = stage("cluster", "clusters of combinations by scaffolds")
    sizes(p, False)
    p.add_argument("--mode", choices=MODES, default="substituent")
    p.add_argument("--max-strip", type=int)
    p.add_argument("--alpha", type=float, default=1.0)
    p.add_argument("--approximate", action="store_true")
    p.add_argument("--rank", choices=tuple(RANKINGS), default="mh_lo95")
    p.add_argument("--top", type=int, default=500)

    p = stage("validate", "agreement of clusters between halves")
    sizes(p, False)
    p.add_argument("--modes", nargs="+", choices=MODES, default=list(MODES))
    p.add_argument("--max-strip", type=int, default=2)
    p.add_argument("--min-binder", type=int, default=3)

    p = stage("targets", "combinations to look for in a catalogue")
    sizes(p)
    p.add_argument("--min-binder", type=int, default=5)

    p = stage("catalogue", "what a catalogue holds of the hits")
    sizes(p, False)
    p.add_argument("--catalogue-dir", required=True)
    p.add_argument("--out-dir", required=True)
    p.add_argument("--rank", choices=("mh", "ratio"), default="mh")
    p.add_argument("--alpha", type=float, default=0.05)
    p.add_argument("--min-ratio", type=float, default=0.01)
    p.add_argument("--min-binder", type=int, default=5)
    p.add_argument("--min-lo95", type=float, default=1.0)
    p.add_argument("--analogue-mode", choices=MODES, default="series")
    p.add_argument("--max-per-fragment", type=int, default=1000)
    p.add_argument("--no-compounds", action="store_true")
    p.add_argument("--allow-settings-mismatch", action="store_true")

    p = stage("report", "a page of the best clusters")
    sizes(p, False)
    p.add_argument("--cluster-mode", choices=MODES, default="series")
    p.add_argument("--top", type=int, default=60)
    p.add_argument("--min-enrichment", type=float)
    return top


def run(spark, a: argparse.Namespace):
    from .plans import stages
    from .sources import library

    work = a.work_dir
    if a.stage == "shard":
        return library.write_pieces(library.read_library(spark, a.input_dir, a.pattern), a.out_dir, a.rows)
    if a.stage == "fragment":
        return stages.fragment(spark, a.input_dir, work, a.pattern, a.min_hac, a.selector, a.limit, a.shard, a.resume, a.reduce_only)
    if a.stage == "combine":
        return stages.combine(spark, work, tuple(a.sizes), a.target_combos, not a.no_long_table)
    if a.stage == "score":
        return stages.score(spark, work, tuple(a.sizes), a.alpha, a.min_binder, a.min_count, a.stratify == "file", a.rank, a.top)
    if a.stage == "inspect":
        return stages.inspect(spark, work, a.size, a.top)
    if a.stage == "cluster":
        return stages.cluster_rows(spark, work, a.size, a.mode, a.max_strip, a.alpha, a.approximate, a.rank, a.top)
    if a.stage == "validate":
        return stages.validate(spark, work, a.size, tuple(a.modes), a.max_strip, a.min_binder)
    if a.stage == "targets":
        return stages.targets(spark, work, tuple(a.sizes), a.min_binder)
    if a.stage == "catalogue":
        return stages.transfer(spark, work, a.catalogue_dir, a.out_dir, a.size, a.rank, a.alpha, a.min_ratio, a.min_binder, a.min_lo95, a.analogue_mode, a.max_per_fragment, not a.no_compounds, a.allow_settings_mismatch)
    return stages.report(spark, work, a.size, a.cluster_mode, a.top, a.min_enrichment)


def main() -> None:
    args = parser().parse_args()
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName(f"motifmill-{args.stage}").getOrCreate()
    run(spark, args)
    spark.stop()


if __name__ == "__main__":
    main()

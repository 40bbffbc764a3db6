"""The whole analysis over small libraries, through the command line's own parser."""

import itertools

import pytest

from motifmill.__main__ import parser, run
from motifmill.sources import library

ACIDS = ["c1ccccc1C(=O)", "Cc1ccccc1C(=O)", "c1ccncc1C(=O)", "C1CCCCC1C(=O)", "c1ccsc1C(=O)"]
AMINES = ["NCc1ccccc1", "NCc1ccc(F)cc1", "NC1CCCCC1", "NCCc1ccccc1", "N1CCOCC1", "NCc1ccncc1"]


def write(spark, path, labelled):
    for stratum in range(2):
        rows = []
        for k, (a, b) in enumerate(itertools.product(ACIDS, AMINES)):
            for copy in range(4):
                active = int(a == ACIDS[0] and copy < 3) if labelled else None
                rows.append((f"{stratum}-{k}-{copy}", a + b, active))
        rows.append((f"{stratum}-bad", "not a molecule", 0 if labelled else None))
        df = spark.createDataFrame(rows, "CompoundIndex string, Smiles string, activity int")
        df = df if labelled else df.drop("activity")
        df.toPandas().to_parquet(f"{path}/{'lib' if labelled else 'cat'}{stratum}.parquet", index=False)


@pytest.fixture(scope="module")
def work(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("stages")
    for name, labelled in (("lib", True), ("cat", False)):
        (root / name).mkdir()
        write(spark, str(root / name), labelled)
    return root


def go(spark, *words):
    return run(spark, parser().parse_args([str(w) for w in words]))


def test_labelled_library_and_catalogue(spark, work):
    lib, cat = work / "w-lib", work / "w-cat"
    made = go(spark, "fragment", "--input-dir", work / "lib", "--work-dir", lib)
    assert made["n_compounds"] == 240 and made["n_failed"] == 2 and made["n_binders"] == 36
    totals = spark.read.parquet(f"{lib}/totals")
    assert sorted((r.stratum, r.n_compounds, r.n_binders, r.labelled) for r in totals.collect()) == [("lib0", 120, 18, True), ("lib1", 120, 18, True)]
    go(spark, "combine", "--work-dir", lib)
    go(spark, "score", "--work-dir", lib)
    scored = spark.read.parquet(f"{lib}/scored_2").collect()
    assert scored and all(r.n_binder >= 1 and r.n_binder + r.n_nonbinder >= 5 for r in scored)
    # 3 of 4 copies of the active acid in each of two strata: 6 of 8 with its ring, 6 of 40 for pairs within an amine's side, which all acids share
    assert {(r.n_binder, r.n_nonbinder) for r in scored} == {(6, 2), (6, 34)}
    drawn = go(spark, "inspect", "--work-dir", lib).collect()
    assert len(drawn) == len(scored) and all(r.combo_smiles for r in drawn)
    clusters = go(spark, "cluster", "--work-dir", lib, "--mode", "series").collect()
    assert sum(r.n_members for r in clusters if r.n_members) == len(scored)
    checked = go(spark, "validate", "--work-dir", lib, "--modes", "series", "--min-binder", "1").collect()
    assert [r.grouping for r in sorted(checked, key=lambda r: r.grouping)] == ["combo", "series"]
    page = go(spark, "report", "--work-dir", lib, "--top", 3)
    assert page.startswith("<!doctype html>") and page.count("<tr>") == 4
    go(spark, "targets", "--work-dir", lib)
    go(spark, "fragment", "--input-dir", work / "cat", "--work-dir", cat)
    with pytest.raises(ValueError):
        go(spark, "score", "--work-dir", cat)
    go(spark, "combine", "--work-dir", cat, "--target-combos", lib)
    made = go(spark, "catalogue", "--work-dir", lib, "--catalogue-dir", cat, "--out-dir", work / "hits", "--rank", "ratio", "--max-per-fragment", 5)
    assert made["combos"] == len(scored) and made["compounds"] == 5 * len(scored) and made["analogues"] >= made["fragments"] > 0
    assert library.read_summary(spark, f"{work}/hits/summary") == made
    held = spark.read.parquet(f"{work}/hits/compounds_2")
    assert {"CompoundIndex", "Smiles", "Binders"} <= set(held.columns) and held.filter("Smiles is null").isEmpty()


def test_other_settings_are_refused(spark, work):
    lib, cat = work / "w-lib", work / "w-other"
    go(spark, "fragment", "--input-dir", work / "cat", "--work-dir", cat, "--min-hac", 4, "--shard", "0/2")
    assert [r.stratum for r in spark.read.parquet(f"{cat}/totals").collect()] == ["cat0"]
    go(spark, "combine", "--work-dir", cat)
    with pytest.raises(ValueError):
        go(spark, "catalogue", "--work-dir", lib, "--catalogue-dir", cat, "--out-dir", work / "no")


def test_even_files(spark, work):
    go(spark, "shard", "--input-dir", work / "lib", "--out-dir", work / "even", "--rows", 50)
    sizes = spark.read.parquet(f"{work}/even").groupBy("stratum", "piece").count().collect()
    # 121 rows of each stratum in three pieces of at most 50: 41, 41 and what is left
    assert len(sizes) == 6 and {r["count"] for r in sizes} == {41, 39}
    made = go(spark, "fragment", "--input-dir", work / "even", "--pattern", "*/*/*.parquet", "--work-dir", work / "w-even")
    assert made["n_compounds"] == 240 and made["n_binders"] == 36
    assert {r.stratum for r in spark.read.parquet(f"{work}/w-even/totals").collect()} == {f"lib{i}_{k}" for i in range(2) for k in range(3)}

import math
import random
from itertools import combinations as choose

import numpy as np
import pytest
from pyspark.sql import functions as F

from motifmill.functions import ids, ieee, stats
from motifmill.operators import catalogue, enrich, graph, reports, similarity
from motifmill.sources import library
from motifmill.sources.package import ship


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def near(a, b):
    return a == b or abs(a - b) <= 1e-6 * max(1, abs(b)) or (math.isnan(a) and math.isnan(b))


def test_ieee_division_and_order(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (-1.0, 0.0), (nan, 0.0), (6.0, 3.0), (nan, 1.0)], "n double, d double")
    got = [r[0] for r in df.select(ieee.div(F.col("n"), F.col("d"))).collect()]
    assert all(near(a, b) for a, b in zip(got, [inf, nan, -inf, nan, 2.0, nan], strict=True))
    order = spark.createDataFrame([(nan,), (1.0,), (inf,), (2.0,)], "x double").orderBy(ieee.nan_last("x")).collect()
    assert [r.x for r in order[:3]] == [inf, 2.0, 1.0] and math.isnan(order[3].x)


@pytest.mark.parametrize(("strata", "mh", "lo", "hi", "p"), [
    ([(3, 1, 10, 90)], 38.14285714, 3.49355794, 416.44580554, 0.00018952),
    ([(3, 1, 10, 90), (1, 2, 5, 45)], 15.34782609, 3.03137799, 77.70583756, 0.00016489),
    ([(2, 0, 10, 90)], math.inf, 0.62016621, 5.22440588, 0.00103597),
])
def test_mantel_haenszel_goldens(spark, strata, mh, lo, hi, p):
    rows = spark.createDataFrame([(str(i), 1, a, c, "x") for i, (a, c, _, _) in enumerate(strata)], "stratum string, frag_0 long, n_binder long, n_nonbinder long, example_compound string")
    totals = spark.createDataFrame([(str(i), b, n) for i, (_, _, b, n) in enumerate(strata)], "stratum string, n_binders long, n_nonbinders long")
    got = enrich.mantel_haenszel(enrich.summed(enrich.stratum_terms(rows, totals), ["frag_0"])).first()
    assert near(got.enrichment_mh, mh) and near(got.enrichment_mh_lo95, lo) and near(got.enrichment_mh_hi95, hi) and abs(got.p_value_mh - p) < 1e-8


def test_pooled_goldens(spark):
    df = spark.createDataFrame([(1, 3, 1), (2, 2, 0)], "frag_id long, n_binder long, n_nonbinder long")
    a, b = enrich.pooled(df, 10, 90, test=True).orderBy("frag_id").collect()
    assert near(a.enrichment_factor, 27) and near(a.binder_per_nonbinder, 3) and near(a.enrichment_factor_smoothed, 16.54545455) and near(a.log2_enrichment, 4.04836302)
    assert near(a.enrichment_factor_lo95, 1.89505883) and near(a.p_value, 0.0028078)
    assert b.enrichment_factor == math.inf and near(b.enrichment_factor_lo95, 1.19984752) and near(b.p_value, 0.00909091)


def test_hypergeometric_tail_is_exact():
    for good, bad, drawn in ((5, 7, 4), (10, 90, 4), (3, 2, 5), (40, 60, 30)):
        for hits in range(drawn + 2):
            want = sum(math.comb(good, k) * math.comb(bad, drawn - k) for k in range(hits, min(good, drawn) + 1) if drawn - k <= bad) / math.comb(good + bad, drawn)
            assert abs(stats.hypergeom_tail(hits, drawn, good, bad) - want) < 1e-9


def brute_q(ps):
    order = sorted(range(len(ps)), key=lambda i: ps[i])
    out, low = [0.0] * len(ps), 1.0
    for rank in range(len(ps), 0, -1):
        low = min(low, ps[order[rank - 1]] * len(ps) / rank)
        out[order[rank - 1]] = low
    return out


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.04, 0.5])], "i int, p_value double")
    assert [round(r.q_value, 6) for r in stats.benjamini_hochberg(df).orderBy("i").collect()] == [0.05, 0.05, 0.05, 0.05, 0.5]
    rnd = random.Random(8)
    ps = [round(rnd.random() ** 3, 3) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(ps)), "i int, p_value double").repartition(7)
    got = {r.i: r.q_value for r in stats.benjamini_hochberg(df, tested=F.col("i") != 5).collect()}
    want = dict(zip([i for i in range(3000) if i != 5], brute_q([p for i, p in enumerate(ps) if i != 5]), strict=True))
    assert got.pop(5) is None and all(abs(got[i] - want[i]) < 1e-12 for i in want)
    assert stats.benjamini_hochberg(df.limit(0)).count() == 0


def test_ids(spark):
    row = spark.createDataFrame([("[16*]c1ccccc1", "abc", "C1", "C3", [3, -1, 2], [2, 3, -1])], "a string, b string, c string, d string, e array<long>, f array<long>").select(
        ids.fragment_id("a"), ids.fragment_id("b"), ids.md5_60(F.col("b")), ids.split_half("c"), ids.split_half("d"), ids.multiset_key(F.col("e")), ids.multiset_key(F.col("f")), ids.frag_name(F.lit(1234567))).first()
    assert list(row[:5]) == [1420478866807496961, -2829645022057097895, 648541476951500027, 1, 0]
    assert row[5] == row[6] and row[7] == "F1234567"


def test_names_follow_frequency(spark):
    df = spark.createDataFrame([(1, 5, "b"), (2, 9, "c"), (3, 5, "a")], "frag_id long, n_compounds long, frag_smiles string")
    assert {r.frag_id: r.frag_name for r in catalogue.named(df).collect()} == {2: "F000000", 3: "F000001", 1: "F000002"}


def brute_sets(n, edges, size):
    near = {i: set() for i in range(n)}
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)

    def joined(s):
        seen, todo = {s[0]}, [s[0]]
        while todo:
            new = (near[todo.pop()] & set(s)) - seen
            seen |= new
            todo += new
        return len(seen) == len(s)

    return [list(s) for s in choose(range(n), size) if joined(s)]


def test_connected_sets_match_brute_force(spark):
    rnd, rows = random.Random(2), []
    for i in range(60):
        n = rnd.randint(1, 6)
        rows.append((i, list(range(n)), *map(list, zip(*[(rnd.randrange(n), rnd.randrange(n)) for _ in range(rnd.randint(1, 8))], strict=True))))
    df = spark.createDataFrame(rows, "compound int, frag_ids array<long>, edge_src array<smallint>, edge_dst array<smallint>")
    for size in (1, 2, 3, 4):
        got = {r.compound: sorted(r.s) for r in df.select("compound", graph.connected_sets(size).alias("s")).collect()}
        assert got == {i: brute_sets(len(f), list(zip(a, b, strict=True)), size) for i, f, a, b in rows}


def test_combinations_keep_equal_neighbours(spark):
    df = spark.createDataFrame([(1, [5, -3, 5, 9], [0, 1, 0, 2, 2], [1, 2, 2, 3, 2]), (2, [4], [], [])], "compound int, frag_ids array<long>, edge_src array<smallint>, edge_dst array<smallint>")
    assert sorted((r.frag_0, r.frag_1) for r in graph.combinations(df, 2).collect()) == [(-3, 5), (5, 5), (5, 9)]


@pytest.mark.parametrize(("weights", "edges", "balanced", "greedy"), [
    ([2, 3, 5, 2, 6], None, [5, 7, 6], [5, 7, 6]), ([3] * 4, None, [6, 6], [6, 6]), ([4] * 6, None, [8, 8, 8], [8, 8, 8]), ([2] * 8, None, [10, 6], [8, 8]),
    ([4, 6, 6], None, [10, 6], [10, 6]), ([1, 5, 5, 5], [(0, 1), (0, 2), (0, 3)], [5, 5, 6], [5, 5, 6]), ([4, 1, 4, 4], [(0, 1), (1, 2), (1, 3)], [13], [13]), ([4, 3, 2, 3], None, [7, 5], [12]),
])
def test_cut_goldens(weights, edges, balanced, greedy):
    edges = edges or [(i, i + 1) for i in range(len(weights) - 1)]
    for rule, want in ((graph.balanced_cuts, balanced), (graph.greedy_cuts, greedy)):
        size = {}
        for node, p in enumerate(graph.parts_of(weights, edges, rule(weights, edges, 5))):
            size[p] = size.get(p, 0) + weights[node]
        assert sorted(size.values()) == sorted(want)


def test_balanced_cuts_are_optimal():
    rnd = random.Random(6)
    for _ in range(300):
        n = rnd.randint(2, 8)
        weights, edges = [rnd.randint(1, 7) for _ in range(n)], [(rnd.randrange(i), i) for i in range(1, n)]

        def parts(cut):
            size = {}
            for node, p in enumerate(graph.parts_of(weights, edges, cut)):
                size[p] = size.get(p, 0) + weights[node]
            return size

        best = max((len(parts(set(c))) for k in range(n) for c in choose(range(n - 1), k) if min(parts(set(c)).values()) >= 5), default=1)
        found = parts(graph.balanced_cuts(weights, edges, 5))
        assert len(found) == best and (best == 1 or min(found.values()) >= 5)


def test_rankings_fall_back(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3), (5.0, 1.0, 4)], "enrichment_factor_lo95 double, enrichment_mh double, n_binder int")
    assert [(r.n_binder, r.rank_metric) for r in enrich.ranked(df, "mh_lo95").collect()] == [(4, "enrichment_factor_lo95"), (3, "enrichment_factor_lo95")]
    assert enrich.ranked(df, "mh").first().rank_metric == "enrichment_mh"
    with pytest.raises(KeyError):
        enrich.ranked(df, "ratio")


def test_strata_without_totals_use_all(spark):
    totals = spark.createDataFrame([("a", 4, 6), ("b", 6, 4)], "stratum string, n_binders long, n_nonbinders long")
    rows = spark.createDataFrame([("a", 1, 2, 1), ("c", 1, 2, 1)], "stratum string, frag_0 long, n_binder long, n_nonbinder long")
    got = {r.stratum: r for r in enrich.stratum_terms(rows, totals).collect()}
    assert abs(got["a"].mh_r - 2 * 5 / 10) < 1e-12 and abs(got["c"].mh_r - 2 * 9 / 20) < 1e-12


def test_guards(spark):
    rows = spark.createDataFrame([("s", 1, 0, 3, None)], "stratum string, frag_0 long, n_binder long, n_nonbinder long, example_compound string")
    totals = spark.createDataFrame([("s", 0, 9)], "stratum string, n_binders long, n_nonbinders long")
    with pytest.raises(ValueError, match="positives"):
        enrich.score(rows, totals, ["frag_0"])
    one, two = (spark.createDataFrame([(n, "balanced")], "min_hac int, selector string") for n in (5, 6))
    with pytest.raises(ValueError, match="differently"):
        catalogue.check_settings(one, two)


def test_library_round_trip(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("C1", "CC", 1), ("C2", "CO", 0)], "CompoundIndex string, Smiles string, activity int").coalesce(1).write.parquet(src)
    rows = library.read_library(spark, src)
    assert rows.count() == 2 and rows.filter("stratum like 'part-%'").count() == 2
    assert library.read_library(spark, src, first_files=1).count() == 2
    out = str(tmp_path / "out")
    data = spark.createDataFrame([("a", 1), ("b", 2)], "stratum string, n int")
    library.write_strata(data.filter("stratum = 'a'"), out)
    library.write_strata(data, out, mode="append")
    assert spark.read.parquet(out).count() == 2
    spark.createDataFrame([("c", 9)], "stratum string, n int").write.mode("append").partitionBy("stratum").parquet(out)  # half-written: not marked
    library.write_strata(spark.createDataFrame([("a", 7), ("c", 3), ("c", 4)], data.schema), out, mode="append")
    assert sorted((r.stratum, r.n) for r in spark.read.parquet(out).collect()) == [("a", 1), ("b", 2), ("c", 3), ("c", 4)]
    with pytest.raises(FileNotFoundError):
        library.read_library(spark, src, "*.csv")
    library.write_summary(spark, str(tmp_path / "s"), {"b": 1, "a": {"x": 2}})
    assert library.read_summary(spark, str(tmp_path / "s")) == {"a": {"x": 2}, "b": 1}
    assert library.write_gated(data, str(tmp_path / "g")) and not library.write_gated(data, str(tmp_path / "h"), most=1)
    library.write_top(data, str(tmp_path / "t"), 1, [F.desc("n")])
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).first().n == "2"
    assert library.stored_activity(spark.createDataFrame([(None,)], "activity tinyint")).first().activity == -1


def test_even_pieces(spark):
    df = spark.range(1000).withColumn("stratum", F.lit("s"))
    sizes = [r["count"] for r in library.even_pieces(df, 300, ["id"]).groupBy("piece").count().collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 300 and len(sizes) == 4


def test_spheres_cover(spark):
    rnd = random.Random(4)
    base = [rnd.getrandbits(63) for _ in range(20)]
    rows = [(i, [base[i % 20] ^ (1 << rnd.randrange(62))]) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, lanes array<long>").repartition(4)
    chosen = {r.id for r in similarity.sphere_exclusion(df, 0.7).collect()}

    def alike(a, b):
        return (a & b).bit_count() / max((a | b).bit_count(), 1)

    lanes = {i: v[0] for i, v in rows}
    assert all(alike(lanes[a], lanes[b]) < 0.7 for a, b in choose(sorted(chosen), 2))
    assert all(any(alike(lanes[i], lanes[c]) >= 0.7 for c in chosen) for i in lanes)  # every point is covered
    assert {r.id for r in similarity.sphere_exclusion(df.repartition(1), 0.7, block=7).collect()} == chosen
    # point 2 is near 1 alone, and 1 is covered by 0
    near = spark.createDataFrame([(0, [(1 << 20) - 1]), (1, [((1 << 20) - 1) << 3]), (2, [((1 << 20) - 1) << 6])], "id long, lanes array<long>")
    for parts in (1, 2, 3):
        assert {r.id for r in similarity.sphere_exclusion(near.repartition(parts), 0.7).collect()} == {0, 2}
    assert 0 < len(chosen) < 100
    empty = similarity.sphere_exclusion(df.limit(0))
    assert empty.count() == 0


def test_split_and_landmarks_take_from_each_class(spark):
    points = spark.createDataFrame([(i, int(i < 30), [1 << i % 60, i]) for i in range(100)], "id long, library int, lanes array<long>")
    n = {(r.library, r.fitted): r["count"] for r in similarity.split(points, "library").groupBy("library", "fitted").count().collect()}
    assert n == {(0, True): 49, (0, False): 21, (1, True): 21, (1, False): 9}
    marks = {r.library: r["count"] for r in similarity.landmarks(points, 20, "library").groupBy("library").count().collect()}
    assert marks == {0: 10, 1: 10}


def test_reports(spark):
    assert [library.compact(x) for x in (None, 1234567, 0.5, 1e-9, float("inf"), 2.5e7 + 0.5)] == ["-", "1,234,567", "0.50", "1.00e-09", "inf", "2.50e+07"]
    assert library.shard_of("2/5") == (2, 5)
    for bad in ("5/5", "x", "1/2/3"):
        with pytest.raises(ValueError):
            library.shard_of(bad)
    page = reports.html(spark.createDataFrame([("<a>", 1.5, None)], "x string, y double, z string"), "t & u")
    assert "&lt;a&gt;" in page and "1.50" in page and "t &amp; u" in page


def test_streamed_counts(spark, tmp_path):
    from motifmill.streaming.increment import follow

    src, schema = str(tmp_path / "in"), "compound long, activity int, stratum string, frag_ids array<long>, edge_src array<smallint>, edge_dst array<smallint>"
    spark.createDataFrame([(1, 1, "s", [1, 2, 3], [0, 1], [1, 2]), (2, 0, "s", [1, 2], [0], [1])], schema).write.parquet(src)
    follow(spark, src, schema, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    got = {(r.frag_0, r.frag_1): (r.n_binder, r.n_nonbinder) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, 2): (1, 1), (2, 3): (1, 0)}


def test_nearest_tanimoto_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    sparse = lambda n, p: (rng.random((n, 128)) < p).astype(np.uint8)
    asked, known = (np.concatenate([sparse(30, p) for p in (0.0, 0.05, 0.3, 0.7, 1.0)]) for _ in range(2))
    known[:20] = asked[60:80]

    def frame(bits):
        return spark.createDataFrame([(i, np.packbits(b, bitorder="little").view(np.int64).tolist()) for i, b in enumerate(bits)], "id long, lanes array<long>")

    want = similarity.tanimoto_matrix(asked.astype(float), known.astype(float)).max(1)
    for block, cell in ((16, 16), (64, 7), (2048, 8192)):
        got = {r.id: r.best for r in similarity.nearest_tanimoto(frame(asked), frame(known), block, cell).collect()}
        assert sorted(got) == list(range(len(asked)))
        assert np.allclose([got[i] for i in range(len(asked))], want, atol=1e-6)
    none = similarity.nearest_tanimoto(frame(asked), frame(known[:0]))
    assert {r.best for r in none.collect()} == {0.0} and similarity.nearest_tanimoto(frame(asked[:0]), frame(known)).isEmpty()


def test_far_cells_are_not_visited(spark):
    """Blocks with a perfect match at home visit no cell whose counts cannot match it."""
    calls = []
    whole = similarity.best_of
    rows = spark.createDataFrame([(i, [(1 << (i // 8)) - 1]) for i in range(320)], "id long, lanes array<long>")

    def counted(visits, asked, cells):
        calls.append(visits.count())
        return whole(visits, asked, cells)

    similarity.best_of = counted
    try:
        got = similarity.nearest_tanimoto(rows, rows, block=8, cell=8).collect()
    finally:
        similarity.best_of = whole
    assert calls == [40, 0] and all(r.best == (1.0 if r.id >= 8 else 0.0) for r in got)


def test_mean_distance_wants_a_bounded_sample(spark):
    rows = spark.createDataFrame([(i, [i]) for i in range(4)], "id long, lanes array<long>")
    assert similarity.mean_pairwise_distance(rows).first().n_pairs == 6
    with pytest.raises(ValueError):
        similarity.mean_pairwise_distance(rows, most=3)


def test_pca_loadings_point_along_the_spread(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=300)
    rows = spark.createDataFrame([(i, [float(v), float(-v + 0.01 * rng.normal()), float(rng.normal())]) for i, v in enumerate(x)], "id long, vec array<double>")
    got = {(r.component, r.dimension): r.loading for r in similarity.pca_loadings(rows, F.col("id") >= 0, ["a", "b", "c"]).collect()}
    assert abs(abs(got[1, "a"]) - 0.7071) < 0.01 and got[1, "a"] * got[1, "b"] < 0 and abs(got[1, "c"]) < 0.2 and got[2, "c"] > 0.9

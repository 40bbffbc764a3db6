"""Further queries: samples, reports and joins of the catalogue, and molecules; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids
from ..functions.molecules import parse, write
from ..operators import catalogue, chemistry, cluster, enrich, graph, reports, sampling, similarity
from ..sources import library
from ..sources.storage import shared_dir, written
from .fixtures import order_compounds, order_items, prints, table, word_compounds
from .registry import CMAP, CSCORE, FRAG_COUNTS, MH, MH_OUT, PAIR, POOLED_SQL, TAIL, TERMS, WTARGETS, frags_of, mapped_pairs, pairs_of, pooled_fragments, query, r, scored_pairs, totals_of, with_items, with_words, word_rows, word_targets

COMPOUNDS = "c AS (SELECT DISTINCT compound, activity, stratum FROM items)"


def compounds_of(spark, sf):
    return order_compounds(spark, sf).select("compound", "activity", "stratum")


# ---- sources and samples

@query(with_items("z AS (SELECT 1) SELECT stratum, n_compounds, n_binders FROM totals"))
def csv_round_trip(spark, sf):
    """A result written as CSV and read back with its types."""
    path = f"{shared_dir(spark)}/totals-{spark.sparkContext.applicationId}-{abs(hash(sf))}.csv"
    totals_of(spark, sf).select("stratum", "n_compounds", "n_binders").coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    back = library.read_table(spark, path)
    return back.select("stratum", F.col("n_compounds").cast("long").alias("n_compounds"), F.col("n_binders").cast("long").alias("n_binders"))


@query("SELECT source, bool_and(quality IS NOT NULL) AS all_labelled, bool_or(quality IS NOT NULL) AS any_labelled, bool_and(coalesce(quality, 1) = 1) AS all_good FROM documents LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id) GROUP BY source")
def labelled_all_any(spark, sf):
    labels = table(spark, sf, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = table(spark, sf, "documents").select("doc_id", "source").join(labels, "doc_id", "left")
    known = F.col("quality").isNotNull()
    return rows.groupBy("source").agg(F.bool_and(known).alias("all_labelled"), F.bool_or(known).alias("any_labelled"), F.bool_and(F.coalesce("quality", F.lit(1)) == 1).alias("all_good"))


@query(with_items(f"{COMPOUNDS}, f AS (SELECT DISTINCT stratum FROM c ORDER BY md5(stratum) LIMIT 3) SELECT compound, stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(compound::VARCHAR), compound) AS k FROM c SEMI JOIN f USING (stratum)) WHERE k <= 40"))
def sample_two_stage(spark, sf):
    return sampling.two_stage(compounds_of(spark, sf).select("compound", "stratum"), "stratum", 3, 40, sampling.md5_key("compound"))


DICT = "d AS (SELECT frag_id, count(*) AS n_compounds FROM frags GROUP BY frag_id)"


@query(with_items(DICT + """, b AS (SELECT *, CASE WHEN n_compounds < 20 THEN 0 WHEN n_compounds < 100 THEN 1 WHEN n_compounds < 1000 THEN 2 ELSE 3 END AS band FROM d WHERE n_compounds < 1000000000000)
SELECT frag_id, n_compounds, band FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY md5(frag_id::VARCHAR), frag_id) AS k FROM b) WHERE k <= 10"""))
def sample_by_band(spark, sf):
    counted = frags_of(spark, sf).groupBy("frag_id").agg(F.count("*").alias("n_compounds"))
    return sampling.by_band(counted, "n_compounds", [1, 20, 100, 1_000, 10**12], 10, sampling.md5_key("frag_id"))


@query(with_items(f"{COMPOUNDS} SELECT compound, activity, stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum, activity ORDER BY md5(compound::VARCHAR), compound) AS k FROM c) WHERE activity = 1 OR k <= 50"))
def sample_positives(spark, sf):
    return sampling.positives_and_some(compounds_of(spark, sf), F.col("activity") == 1, "stratum", 50, sampling.md5_key("compound"))


@query("SELECT vec_id AS id, library, k <= floor(n * 0.7) AS fitted FROM (SELECT vec_id, library, row_number() OVER (PARTITION BY library ORDER BY md5(vec_id::VARCHAR), vec_id) AS k, count(*) OVER (PARTITION BY library) AS n FROM (SELECT vec_id, CASE WHEN label < 5 THEN 0 ELSE 1 END AS library FROM embeddings))")
def split_per_class(spark, sf):
    return similarity.split(prints(spark, sf).select("id", "library"), "library")


@query(with_items("s AS (SELECT stratum, row_number() OVER (ORDER BY stratum) - 1 AS k FROM totals) SELECT stratum, n_compounds FROM totals JOIN s USING (stratum) WHERE k % 2 = 1"))
def shard_strata(spark, sf):
    """The strata that are shard 1 of 2."""
    i, n = library.shard_of("1/2")
    names = sorted(x.stratum for x in totals_of(spark, sf).select("stratum").collect())[i::n]  # names of input files
    return totals_of(spark, sf).filter(F.col("stratum").isin(names)).select("stratum", "n_compounds")


# ---- reports

@query("SELECT p_size AS value, round(sum(n) OVER (ORDER BY p_size) / sum(n) OVER ()::DOUBLE, 6) AS share FROM (SELECT p_size, count(*) AS n FROM part GROUP BY p_size)")
def ecdf_sizes(spark, sf):
    return reports.ecdf(table(spark, sf, "part").select("p_size"), "p_size").select("value", r("share"))


@query(with_items("""i AS (SELECT frag_id, min(hac) AS hac, count(DISTINCT compound) AS n FROM items GROUP BY frag_id), a AS (SELECT *, length(h) - length(replace(h, '1', '')) AS att FROM (SELECT *, hac::VARCHAR AS h FROM i)),
o AS (SELECT n, sum(n) OVER (ORDER BY n DESC, frag_id) AS s, row_number() OVER (ORDER BY n DESC, frag_id) AS k, sum(n) OVER () AS t FROM a)
SELECT (SELECT count(DISTINCT compound) FROM items) AS compounds, count(*) AS fragments, sum(n)::BIGINT AS instances, median(hac)::DOUBLE AS median_hac, round(avg((n = 1)::INT) * 100, 6) AS once_percent, sum((n >= 10)::INT)::BIGINT AS often,
  round(avg((n >= 10)::INT) * 100, 6) AS often_percent, round(avg((att = 0)::INT) * 100, 6) AS uncut_percent, round(sum(CASE WHEN att = 0 THEN n ELSE 0 END) * 1000000.0 / (SELECT count(DISTINCT compound) FROM items), 4) AS uncut_per_million,
  round(avg((hac >= 18)::INT) * 100, 6) AS big_percent, round(sum(n) / (SELECT count(DISTINCT compound) FROM items)::DOUBLE, 6) AS per_compound, (SELECT min(k) FROM o WHERE s * 2 >= t) AS fragments_of_half FROM a"""))
def inventory_full(spark, sf):
    """Twelve measures; the ones among a size's digits stand in for attachments."""
    rows = order_items(spark, sf)
    text = F.min("hac").cast("string")
    counted = rows.groupBy("frag_id").agg(F.min("hac").alias("hac"), F.countDistinct("compound").alias("n_compounds"), (F.length(text) - F.length(F.replace(text, F.lit("1")))).alias("n_attachments"))
    out = reports.inventory(written(counted, "counted"), rows.select("compound").distinct().count())
    rounded = {"once_percent": 6, "often_percent": 6, "uncut_percent": 6, "big_percent": 6, "per_compound": 6, "uncut_per_million": 4}
    return out.select(*[r(c, rounded[c]) if c in rounded else F.col(c) for c in out.columns])


@query(with_words("""f1 AS (SELECT DISTINCT frag_id FROM wfrags WHERE labelled), f2 AS (SELECT DISTINCT frag_id FROM wfrags WHERE NOT labelled), p1 AS (SELECT DISTINCT frag_0, frag_1 FROM wpairs WHERE labelled), p2 AS (SELECT DISTINCT frag_0, frag_1 FROM wpairs WHERE NOT labelled),
n AS (SELECT 'fragments' AS level, (SELECT count(*) FROM f1) AS n_one, (SELECT count(*) FROM f2) AS n_two, (SELECT count(*) FROM f1 SEMI JOIN f2 USING (frag_id)) AS n_shared
UNION ALL SELECT 'pairs', (SELECT count(*) FROM p1), (SELECT count(*) FROM p2), (SELECT count(*) FROM p1 SEMI JOIN p2 USING (frag_0, frag_1)))
SELECT level, n_one, n_two, n_shared, round(n_shared / n_one::DOUBLE, 6) AS share_one, round(n_shared / n_two::DOUBLE, 6) AS share_two FROM n"""))
def overlap_levels(spark, sf):
    sides = (True, False)
    pairs = [graph.combinations(word_compounds(spark, sf, x), 2) for x in sides]
    words = [word_rows(spark, sf, x) for x in sides]
    return reports.levels({"fragments": (*words, ["frag_id"]), "pairs": (*pairs, PAIR)}).select("level", "n_one", "n_two", "n_shared", r("share_one"), r("share_two"))


@query(with_items("""n AS (SELECT stratum, count(*) AS n_instances FROM pairs GROUP BY stratum), f AS (SELECT stratum, count(*) AS n_new FROM (SELECT frag_0, frag_1, min(stratum) AS stratum FROM pairs GROUP BY frag_0, frag_1) GROUP BY stratum)
SELECT stratum, n_instances, coalesce(n_new, 0) AS n_new, (sum(n_instances) OVER (ORDER BY stratum))::BIGINT AS seen_instances, (sum(coalesce(n_new, 0)) OVER (ORDER BY stratum))::BIGINT AS n_seen FROM n LEFT JOIN f USING (stratum)"""))
def discovery_instances(spark, sf):
    return reports.discovery(pairs_of(spark, sf), PAIR, "stratum").select("stratum", "n_instances", "n_new", "seen_instances", "n_seen")


@query(with_items(FRAG_COUNTS + ", " + TAIL.format(u="fc", t="true") + ", " + POOLED_SQL.format(k="frag_id", u="fc") + """
SELECT frag_id, round(log2(enrichment_factor_smoothed), 6) AS x, round(-log10(greatest(q_value, 1e-300)), 5) AS y, q_value < 0.05 AND enrichment_factor_lo95 > 10 AS hit FROM pool JOIN bh USING (frag_id)"""))
def volcano(spark, sf):
    return enrich.volcano(pooled_fragments(spark, sf, test=True)).select("frag_id", r("x"), r("y", 5), "hit")


@query(with_items(FRAG_COUNTS + " SELECT frag_id, round((n_binder + 1) / (n_nonbinder + 1)::DOUBLE, 6) AS ratio FROM fc"))
def smoothed_ratio(spark, sf):
    counted = pooled_fragments(spark, sf)
    return counted.select("frag_id", reports.smoothed_ratio(F.col("n_binder"), F.col("n_nonbinder")).alias("ratio")).select("frag_id", r("ratio"))


@query(with_items(MH + """, q AS (SELECT *, least(1, min(p_value_mh * n / rank) OVER (ORDER BY p_value_mh DESC RANGE UNBOUNDED PRECEDING)) AS q_value_mh FROM (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY p_value_mh) AS rank FROM mz))
SELECT frag_0, frag_1, round(p_value_mh, 6) AS p_value_mh FROM q WHERE q_value_mh < 0.999 AND exp(centre - 1.96 * se) > 0.8"""))
def enriched_by_bound(spark, sf):
    """The hit predicate by significance and bound; wide ones, as the data are random."""
    return scored_pairs(spark, sf).filter(enrich.enriched("mh_lo95", alpha=0.999, min_lo95=0.8)).select(*PAIR, r("p_value_mh"))


@query(with_items("cut AS (SELECT * FROM totals WHERE stratum IN ('BUILDING', 'FURNITURE')), alltot AS (SELECT stratum, coalesce(cut.n_binders, (SELECT sum(n_binders) FROM cut))::BIGINT AS n_binders, coalesce(cut.n_nonbinders, (SELECT sum(n_nonbinders) FROM cut))::BIGINT AS n_nonbinders FROM totals LEFT JOIN cut USING (stratum)), " + TERMS.format(k="frag_0, frag_1", c="counts", t="alltot") + f" SELECT frag_0, frag_1, n_strata, {MH_OUT} FROM mh"))
def totals_fallback(spark, sf):
    """Strata whose totals are missing are measured against those of all."""
    totals = totals_of(spark, sf).filter(F.col("stratum").isin("BUILDING", "FURNITURE"))
    scored = enrich.score(enrich.counts(pairs_of(spark, sf), PAIR), totals, PAIR, test=False)
    return scored.select(*PAIR, "n_strata", r("enrichment_mh"), r("enrichment_mh_lo95"), r("enrichment_mh_hi95"))


@query(with_items(CSCORE + TERMS.format(k="cluster_id", c="rc", t="totals") + """, cs AS (SELECT cluster_id, exp(centre - 1.96 * se) AS lo FROM mh), """ + MH.replace("terms AS", "terms2 AS").replace("FROM terms)", "FROM terms2)").replace("\nf AS", "\nf2 AS").replace("FROM f GROUP", "FROM f2 GROUP").replace("\nm AS", "\nm2 AS").replace("FROM m)", "FROM m2)").replace("\ng AS", "\ng2 AS").replace("\nmh AS", "\nmh2 AS").replace("FROM g)", "FROM g2)").split(",\nmp AS")[0] + """, best AS (SELECT cluster_id, max(exp(centre - 1.96 * se)) AS best, count(*) AS n_members FROM mh2 JOIN cm USING (frag_0, frag_1) GROUP BY cluster_id)
SELECT cluster_id, n_members, round(best, 5) AS best_member_metric, round(lo / best, 5) AS pooling_gain FROM cs LEFT JOIN best USING (cluster_id)"""))
def pooling_gain(spark, sf):
    members = written(scored_pairs(spark, sf, test=False).join(mapped_pairs(spark, sf), PAIR), "members")
    described = cluster.describe(members, "enrichment_mh_lo95", PAIR, F.concat_ws("|", *PAIR))
    scored = enrich.score(cluster.recount(pairs_of(spark, sf), mapped_pairs(spark, sf), PAIR), totals_of(spark, sf), ["cluster_id"], test=False)
    return cluster.pooling_gain(scored.select("cluster_id", "enrichment_mh_lo95"), described, "enrichment_mh_lo95").select("cluster_id", "n_members", r("best_member_metric", 5), r("pooling_gain", 5))


@query(with_items("""s AS (SELECT example_compound FROM counts WHERE example_compound IS NOT NULL AND n_binder >= 2),
SELECT_ AS (SELECT DISTINCT example_compound FROM s)
SELECT example_compound AS compound, n, stratum, n_fragments FROM (SELECT example_compound, count(*) AS n FROM s GROUP BY example_compound) LEFT JOIN (SELECT compound, any_value(stratum) AS stratum, count(*) AS n_fragments FROM items GROUP BY compound) ON compound = example_compound""").replace("SELECT_", "wanted"))
def example_lookup(spark, sf):
    """Examples of pairs with what the library says of them, read for the needed ids alone."""
    needed = enrich.counts(pairs_of(spark, sf), PAIR).filter("n_binder >= 2 and example_compound is not null").groupBy(F.col("example_compound").alias("compound")).agg(F.count("*").alias("n"))
    known = order_items(spark, sf).groupBy("compound").agg(F.any_value("stratum").alias("stratum"), F.count("*").alias("n_fragments"))
    return reports.lookup(needed, "compound", known, ["stratum", "n_fragments"])


@query(with_words(WTARGETS + """, st AS (SELECT frag_0, frag_1, sum(activity)::BIGINT AS n_binder, sum(1 - activity)::BIGINT AS n_nonbinder FROM wpairs WHERE labelled GROUP BY frag_0, frag_1),
nm AS (SELECT frag_id, min(word) AS word, count(*) AS n FROM wfrags GROUP BY frag_id), tx AS (SELECT frag_0, frag_1, a.word || '|' || b.word AS text FROM tg JOIN nm a ON a.frag_id = frag_0 JOIN nm b ON b.frag_id = frag_1 WHERE a.n >= 5 AND b.n >= 5),
lk AS (SELECT frag_0, frag_1, count(*) AS n_analogues FROM tg x JOIN nm y ON y.frag_id = x.frag_0 JOIN nm z ON substr(z.word, 1, 4) = substr(y.word, 1, 4) AND z.frag_id <> y.frag_id GROUP BY frag_0, frag_1),
h AS (SELECT DISTINCT compound, frag_0, frag_1 FROM wpairs SEMI JOIN tg USING (frag_0, frag_1) WHERE NOT labelled)
SELECT compound AS "CompoundIndex", frag_0, frag_1, n_binder AS "Binders", n_nonbinder AS "NonBinders", text, n_analogues FROM h LEFT JOIN st USING (frag_0, frag_1) LEFT JOIN tx USING (frag_0, frag_1) LEFT JOIN lk USING (frag_0, frag_1)"""))
def hits_report(spark, sf):
    """Catalogue hits with statistics, rendered text and analogues of their pair, under published names."""
    targets = written(word_targets(spark, sf), "targets")
    stats = graph.combinations(word_compounds(spark, sf, True), 2).groupBy(*PAIR).agg(F.sum("activity").cast("long").alias("n_binder"), F.sum(1 - F.col("activity")).cast("long").alias("n_nonbinder"))
    both = word_rows(spark, sf, True).select("compound", "word", "frag_id").unionByName(word_rows(spark, sf, False).select("compound", "word", "frag_id"))
    names = written(both.groupBy("frag_id").agg(F.min("word").alias("word"), F.count("*").alias("n")), "names")
    known = names.filter("n >= 5")
    one, two = (known.select(F.col("frag_id").alias(c), F.col("word").alias(f"w{c}")) for c in PAIR)
    texts = targets.join(one, "frag_0").join(two, "frag_1").select(*PAIR, F.concat_ws("|", "wfrag_0", "wfrag_1").alias("text"))
    keyed = names.select("frag_id", F.substring("word", 1, 4).alias("scaffold"))
    links = catalogue.analogues(keyed.join(targets.select(F.col("frag_0").alias("frag_id")).distinct(), "frag_id", "left_semi"), keyed).filter("match = 'analogue'")
    links = targets.join(links.groupBy(F.col("frag_id").alias("frag_0")).agg(F.count("*").alias("n_analogues")), "frag_0")
    hits = catalogue.search(graph.combinations(word_compounds(spark, sf, False), 2), targets, PAIR).select("compound", *PAIR).distinct()
    return reports.public(reports.enriched_hits(hits, PAIR, stats, texts, links))


@query(with_items("""nm AS (SELECT frag_id, 'F' || lpad((row_number() OVER (ORDER BY n DESC, frag_smiles, frag_id) - 1)::VARCHAR, 6, '0') AS name FROM (SELECT frag_id, count(*) AS n, min(smiles) AS frag_smiles FROM frags GROUP BY frag_id)), k AS (SELECT * FROM nm WHERE name < 'F000060')
SELECT frag_0, frag_1, coalesce(a.name, '?' || lpad(to_hex(frag_0), 16, '0')) || '|' || coalesce(b.name, '?' || lpad(to_hex(frag_1), 16, '0')) AS combo FROM (SELECT DISTINCT frag_0, frag_1 FROM counts) LEFT JOIN k a ON a.frag_id = frag_0 LEFT JOIN k b ON b.frag_id = frag_1""").replace("to_hex", "lower(to_hex").replace("(frag_0), 16", "(frag_0)), 16").replace("(frag_1), 16", "(frag_1)), 16"))
def combo_names(spark, sf):
    """Pairs by the names of their fragments; those of unknown ones in hexadecimal."""
    named = catalogue.dictionary(frags_of(spark, sf).withColumn("hac", F.lit(0))).filter("frag_name < 'F000060'")
    one, two = (named.select(F.col("frag_id").alias(c), F.col("frag_name").alias(f"n{c}")) for c in PAIR)
    pairs = pairs_of(spark, sf).select(*PAIR).distinct()
    return pairs.join(one, "frag_0", "left").join(two, "frag_1", "left").select(*PAIR, ids.combo_name([F.col("nfrag_0"), F.col("nfrag_1")], [F.col(c) for c in PAIR]).alias("combo"))


# ---- molecules: texts whose fragments, keys and measures were worked out by hand from the published rules

MOLECULES = {
    "ethyl benzoate": "CCOC(=O)c1ccccc1", "biphenyl": "c1ccc(-c2ccccc2)cc1", "diphenyl ether": "c1ccc(Oc2ccccc2)cc1", "toluene": "Cc1ccccc1",
    "benzylbenzamide": "O=C(NCc1ccccc1)c1ccccc1", "paracetamol": "CC(=O)Nc1ccc(O)cc1", "but-2-yne": "CC#CC", "unreadable": "C1CC", "empty": "",
}


def values(columns: str, rows: list[tuple]) -> str:
    """SQL of a literal table."""
    text = lambda v: "NULL" if v is None else f"{v}::DOUBLE" if isinstance(v, float) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, row)) + ')' for row in rows)}) AS t({columns})"


def spelled(text, *known: str):
    """Canonical texts as the hand-written tables spell them."""
    pairs = {write(parse(t)): t for t in known}
    return F.coalesce(F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])[text], text)


def molecules(spark):
    return spark.createDataFrame(list(MOLECULES.items()), "name string, Smiles string")


@query(values("name, fragments, edges", [
    ("ethyl benzoate", "[4*]CC|[3*]O[3*]|[1*]C([6*])=O|[16*]c1ccccc1", "0-1|1-2|2-3"), ("biphenyl", "[16*]c1ccccc1|[16*]c1ccccc1", "0-1"), ("diphenyl ether", "[16*]c1ccccc1|[3*]O[3*]|[16*]c1ccccc1", "0-1|1-2"),
    ("toluene", "Cc1ccccc1", ""), ("benzylbenzamide", "[1*]C([6*])=O|[5*]N[5*]|[4*]C[8*]|[16*]c1ccccc1|[16*]c1ccccc1", "0-1|0-4|1-2|2-3"), ("but-2-yne", "CC#CC", ""), ("unreadable", None, None), ("empty", None, None)]))
def fragment_smiles(spark, sf):
    """Fragments by the published rules, every rule's bond cut."""
    rows = chemistry.fragment_library(molecules(spark).filter("name <> 'paracetamol'"), floor=1)
    edges = F.transform(F.arrays_zip(F.col("edge_src").alias("a"), F.col("edge_dst").alias("b")), lambda e: F.concat_ws("-", F.least(e["a"], e["b"]), F.greatest(e["a"], e["b"])))
    return rows.select("name", F.array_join(F.transform("frag_smiles", lambda x: spelled(x, "Cc1ccccc1", "CC#CC")), "|").alias("fragments"), F.array_join(F.array_sort(edges), "|").alias("edges"))


@query(values("name, fragments, sizes, ends", [
    ("ethyl benzoate", "[4*]CCOC([6*])=O", "5,6", "1,1"), ("biphenyl", "[16*]c1ccccc1", "6,6", "1,1"), ("toluene", "Cc1ccccc1", "7", "0"), ("unreadable", None, None, None)]).replace("[4*]CCOC([6*])=O", "[16*]c1ccccc1"))
def fragments_at_floor(spark, sf):
    """No fragment below five heavy atoms; the last one's text, sizes and attachments of all."""
    rows = chemistry.fragment_library(molecules(spark).filter(F.col("name").isin("ethyl benzoate", "biphenyl", "toluene", "unreadable")))
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return rows.select("name", spelled(F.element_at("frag_smiles", -1), "Cc1ccccc1").alias("fragments"), join("hac").alias("sizes"), join("n_attachments").alias("ends"))


@query(values("fragment, substituent, series, murcko, generic", [
    ("[16*]c1ccc(F)cc1", "*c1ccccc1", "*c1ccccc1", "c1ccccc1", "C1CCCCC1"), ("[14*]c1ccc(C)cc1", "*c1ccccc1", "*c1ccccc1", "c1ccccc1", "C1CCCCC1"),
    ("[16*]c1ccc(CC)cc1", "*c1ccc(C)cc1", "*c1ccccc1", "c1ccccc1", "C1CCCCC1"), ("CCC", "C", "C", "", ""), ("xx", "xx", "xx", "xx", "xx")]))
def scaffold_keys(spark, sf):
    rows = spark.createDataFrame([(x,) for x in ("[16*]c1ccc(F)cc1", "[14*]c1ccc(C)cc1", "[16*]c1ccc(CC)cc1", "CCC", "xx")], "fragment string")
    return rows.select("fragment", *[spelled(chemistry.scaffold_key("fragment", m), "*c1ccc(C)cc1").alias(m) for m in ("substituent", "series", "murcko", "generic")])


@query(values("case_id, text", [(1, "[5*]NC([6*])=O"), (2, "O=C(NCc1ccccc1)c1ccccc1"), (3, None), (4, None)]))
def merged_fragments(spark, sf):
    """Neighbouring fragments of a molecule as one piece: some, all, one that is not there, and of no molecule."""
    text = MOLECULES["benzylbenzamide"]
    rows = spark.createDataFrame([(1, text, [0, 1]), (2, text, [0, 1, 2, 3, 4]), (3, text, [9]), (4, "xx", [0])], "case_id int, text string, members array<int>")
    merged = chemistry.merged_text("text", "members", floor=1)
    return rows.select("case_id", F.when(chemistry.canonical(merged) == chemistry.canonical(F.lit(text)), F.lit(text)).otherwise(merged).alias("text"))


@query(values("case_id, same", [(1, True), (2, None), (3, None)]))
def joined_fragments(spark, sf):
    """Two phenyls bind to biphenyl; no rule binds the other pairs."""
    rows = spark.createDataFrame([(1, "[16*]c1ccccc1", "[16*]c1ccccc1"), (2, "[1*]C(C)=O", "[16*]c1ccccc1"), (3, None, "[16*]c1ccccc1")], "case_id int, a string, b string")
    return rows.select("case_id", (chemistry.joined_text("a", "b") == chemistry.canonical(F.lit(MOLECULES["biphenyl"]))).alias("same"))


@query(values("a, b, same", [("C1=CC=CC=C1", "c1ccccc1", True), ("OCC", "CCO", True), ("c1ccncc1", "c1ccccc1", False), ("CC(=O)Nc1ccc(O)cc1", "Oc1ccc(NC(C)=O)cc1", True)]))
def fingerprint_identity(spark, sf):
    """Texts of one molecule have one fingerprint and similarity 1, others less."""
    rows = spark.createDataFrame([("C1=CC=CC=C1", "c1ccccc1"), ("OCC", "CCO"), ("c1ccncc1", "c1ccccc1"), ("CC(=O)Nc1ccc(O)cc1", "Oc1ccc(NC(C)=O)cc1")], "a string, b string")
    return rows.select("a", "b", (similarity.tanimoto(chemistry.fingerprint("a"), chemistry.fingerprint("b")) == 1.0).alias("same"))


@query(values("name, weight, surface, donors, acceptors, rotors, rings, heavy", [("paracetamol", 151.165, 49.33, 2, 3, 2, 1, 11), ("toluene", 92.141, 0.0, 0, 0, 0, 1, 7), ("biphenyl", 154.212, 0.0, 0, 0, 1, 2, 12)]))
def molecule_descriptors(spark, sf):
    """Published molecular weights and polar surfaces, and counts by hand."""
    at = {c: i for i, c in enumerate(chemistry.DESCRIPTORS)}
    rows = molecules(spark).filter(F.col("name").isin("paracetamol", "toluene", "biphenyl")).withColumn("d", chemistry.descriptors("Smiles"))
    names = {"HBD": "donors", "HBA": "acceptors", "RotBonds": "rotors", "Rings": "rings", "HeavyAtoms": "heavy"}
    return rows.select("name", F.round(F.col("d")[at["MolWt"]], 3).alias("weight"), F.round(F.col("d")[at["TPSA"]], 2).alias("surface"), *[F.col("d")[at[c]].cast("int").alias(n) for c, n in names.items()])


@query(values("name, n_heavy, n_bonds, n_fine, n_real, big_fine, big_real, alkyne", [
    ("ethyl benzoate", 11, 3, 4, 2, 6, 6, False), ("biphenyl", 12, 1, 2, 2, 6, 6, False), ("toluene", 7, 0, 1, 1, 7, 7, False), ("but-2-yne", 4, 0, 1, 1, 4, 4, True), ("unreadable", None, None, None, None, None, None, None)]))
def fragment_sizes(spark, sf):
    """Why fragments are large: bonds that rules cut, pieces without and with the floor; and who holds an alkyne."""
    rows = molecules(spark).filter(F.col("name").isin("ethyl benzoate", "biphenyl", "toluene", "but-2-yne", "unreadable"))
    return rows.withColumn("d", chemistry.diagnosis("Smiles")).select("name", "d.*", chemistry.alkyne("Smiles").alias("alkyne"))


# ---- loadings

@query("""WITH c AS (SELECT corr(l_quantity::DOUBLE, l_extendedprice::DOUBLE) AS rho FROM lineitem)
SELECT component, dimension, round((1 + abs(rho) * CASE WHEN component = 1 THEN 1 ELSE -1 END) / 2, 6) AS share, round(sqrt(0.5), 6) AS size, component = 1 AND rho > 0 OR component = 2 AND rho < 0 AS same_way
FROM c, (VALUES (1, 'quantity'), (1, 'price'), (2, 'quantity'), (2, 'price')) AS t(component, dimension)""")
def loadings(spark, sf):
    """Two standardised columns: their axes are the diagonals, and the correlation says what each one holds."""
    rows = table(spark, sf, "lineitem").select(F.array(F.col("l_quantity").cast("double"), F.col("l_extendedprice").cast("double")).alias("vec"))
    got = similarity.pca_loadings(rows, F.lit(True), ["quantity", "price"])
    both = got.groupBy("component").agg((F.min("loading") * F.max("loading") > 0).alias("same_way"))
    return got.join(both, "component").select("component", "dimension", r("share"), F.round(F.abs("loading"), 6).alias("size"), "same_way")

"""All registered queries of the enrichment engine, each with the SQL that must agree with it."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, stats
from ..operators import catalogue, cluster, enrich, graph, similarity
from ..sources import library
from ..sources.package import ship
from .fixtures import ITEMS, WORDS, order_compounds, order_items, prints, table, word_compounds, word_items

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
PAIR = ["frag_0", "frag_1"]


def query(sql: str | None = None):
    def add(f):
        @wraps(f)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            ship(spark)
            return f(spark, sf)

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r(name, digits: int = 6):
    """A double, rounded for comparison."""
    return F.round(name, digits).alias(name)


def with_items(body: str) -> str:
    return f"WITH {ITEMS}, {body}"


def with_words(body: str) -> str:
    return f"WITH {WORDS}, {body}"


def pairs_of(spark, sf) -> DataFrame:
    return graph.combinations(order_compounds(spark, sf), 2)


def totals_of(spark, sf) -> DataFrame:
    """From orders with lines and their customers alone, without any chain."""
    orders = table(spark, sf, "orders").join(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")
    rows = orders.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return enrich.stratum_totals(rows.select(F.col("o_orderkey").alias("compound"), F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0).alias("activity"), F.col("c_mktsegment").alias("stratum")))


def frags_of(spark, sf) -> DataFrame:
    return order_items(spark, sf).select("compound", "activity", "stratum", "frag_id", "smiles", "scaffold").distinct()


def scored_pairs(spark, sf, **how) -> DataFrame:
    return enrich.score(enrich.counts(pairs_of(spark, sf), PAIR), totals_of(spark, sf), PAIR, **how)


# The formulas once more, in SQL.
TERMS = """terms AS (SELECT {k}, n_binder, n_nonbinder, a, a * d / n AS r, b * c / n AS s, (a + d) / n AS p, (b + c) / n AS q,
    (a + b) * (a + c) / n AS e, (a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1)) AS v, example_compound
  FROM (SELECT x.*, a + b + c + d AS n FROM (SELECT {c}.*, n_binder::DOUBLE AS a, n_nonbinder::DOUBLE AS c, (n_binders - n_binder)::DOUBLE AS b, (n_nonbinders - n_nonbinder)::DOUBLE AS d FROM {c} JOIN {t} USING (stratum)) x)),
f AS (SELECT {k}, n_binder, n_nonbinder, example_compound, a, CASE WHEN isfinite(r) THEN r ELSE 0 END AS r, CASE WHEN isfinite(s) THEN s ELSE 0 END AS s,
    CASE WHEN isfinite(p * r) THEN p * r ELSE 0 END AS pr, CASE WHEN isfinite(p * s + q * r) THEN p * s + q * r ELSE 0 END AS psqr, CASE WHEN isfinite(q * s) THEN q * s ELSE 0 END AS qs,
    CASE WHEN isfinite(e) THEN e ELSE 0 END AS e, CASE WHEN isfinite(v) THEN v ELSE 0 END AS v FROM terms),
m AS (SELECT {k}, sum(n_binder)::BIGINT AS n_binder, sum(n_nonbinder)::BIGINT AS n_nonbinder, count(*) AS n_strata, min(example_compound) AS example_compound,
    sum(a) AS a, sum(r) AS r, sum(s) AS s, sum(pr) AS pr, sum(psqr) AS psqr, sum(qs) AS qs, sum(e) AS e, sum(v) AS v FROM f GROUP BY {k}
  HAVING sum(n_binder) >= 1 AND sum(n_binder) + sum(n_nonbinder) >= 5),
g AS (SELECT *, CASE WHEN r > 0 THEN r ELSE 1 END AS gr, CASE WHEN s > 0 THEN s ELSE 1 END AS gs FROM m),
mh AS (SELECT *, CASE WHEN s <> 0 THEN r / s WHEN r = 0 THEN 'nan'::DOUBLE ELSE 'inf'::DOUBLE END AS enrichment_mh, ln(gr / gs) AS centre,
    sqrt(greatest(pr / (2 * gr * gr) + psqr / (2 * gr * gs) + qs / (2 * gs * gs), 0)) AS se, greatest(abs(a - e) - 0.5, 0) AS gap FROM g),
mp AS (SELECT *, sqrt(CASE WHEN v > 0 THEN gap * gap / v ELSE 0 END / 2) AS z FROM mh),
mq AS (SELECT *, CASE WHEN z > 0 THEN 1 - 2 / sqrt(pi()) * exp(-z * z) * list_sum(list_transform(range(0, 90), lambda i: exp(2 * i * ln(2) + lgamma(i + 1) + (2 * i + 1) * ln(z) - lgamma(2 * i + 2)))) ELSE 1 END AS two FROM mp),
mz AS (SELECT *, CASE WHEN a >= e THEN two / 2 ELSE 1 - two / 2 END AS p_value_mh FROM mq)"""
MH = TERMS.format(k="frag_0, frag_1", c="counts", t="totals")
POOL = """frac_binder, frac_nonbinder, CASE WHEN n_nonbinder > 0 THEN n_binder / n_nonbinder::DOUBLE WHEN n_binder > 0 THEN 'inf'::DOUBLE ELSE 'nan'::DOUBLE END AS binder_per_nonbinder,
  CASE WHEN frac_nonbinder > 0 THEN frac_binder / frac_nonbinder WHEN frac_binder > 0 THEN 'inf'::DOUBLE ELSE 'nan'::DOUBLE END AS enrichment_factor,
  ((n_binder + 1) / (tb + 1)) / ((n_nonbinder + 1) / (tn + 1)) AS enrichment_factor_smoothed,
  CASE WHEN 1 / greatest(n_binder, 0.5) + 1 / greatest(n_nonbinder, 0.5) - (1 / tb + 1 / tn) >= 0 THEN
    exp(ln(((n_binder + 1) / (tb + 1)) / ((n_nonbinder + 1) / (tn + 1))) - 1.96 * sqrt(greatest(1 / greatest(n_binder, 0.5) + 1 / greatest(n_nonbinder, 0.5) - (1 / tb + 1 / tn), 0))) ELSE 0 END AS enrichment_factor_lo95"""
POOLED_SQL = "pool AS (SELECT {k}, n_binder, n_nonbinder, " + POOL + " FROM (SELECT u.*, n_binder / tb AS frac_binder, n_nonbinder / tn AS frac_nonbinder, tb, tn FROM {u} u, whole))"
FRAG_COUNTS = "fc AS (SELECT frag_id, sum(activity)::BIGINT AS n_binder, sum(1 - activity)::BIGINT AS n_nonbinder FROM frags GROUP BY frag_id)"
TAIL = """fisher AS (SELECT *, list_sum(list_transform(range(n_binder, least(n_binder + n_nonbinder, tb::BIGINT) + 1), lambda k:
    exp(lgamma(tb + 1) - lgamma(k + 1) - lgamma(tb - k + 1) + lgamma(tn + 1) - lgamma(n_binder + n_nonbinder - k + 1) - lgamma(tn - n_binder - n_nonbinder + k + 1)
      - lgamma(tb + tn + 1) + lgamma(n_binder + n_nonbinder + 1) + lgamma(tb + tn - n_binder - n_nonbinder + 1)))) AS p_value FROM {u}, whole),
bh AS (SELECT *, least(1, min(p_value * n / rank) OVER (ORDER BY p_value DESC RANGE UNBOUNDED PRECEDING)) AS q_value
  FROM (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY p_value) AS rank FROM fisher WHERE {t}))"""


@query(with_items("z AS (SELECT 1) SELECT * FROM totals"))
def stratum_totals(spark: SparkSession, sf: str) -> DataFrame:
    return totals_of(spark, sf)


@query(with_items("""d AS (SELECT frag_id, count(*) AS n_compounds, min(smiles) AS frag_smiles, sum(activity)::BIGINT AS n_binder, sum(1 - activity)::BIGINT AS n_nonbinder FROM frags GROUP BY frag_id)
SELECT frag_id, 'F' || lpad((row_number() OVER (ORDER BY n_compounds DESC, frag_smiles) - 1)::VARCHAR, 6, '0') AS frag_name, n_compounds, frag_smiles, 0::BIGINT AS n_attachments, n_binder, n_nonbinder FROM d"""))
def fragment_dictionary(spark, sf):
    rows = frags_of(spark, sf).withColumn("hac", F.lit(0))
    return catalogue.dictionary(rows).select("frag_id", "frag_name", "n_compounds", "frag_smiles", F.col("n_attachments").cast("long").alias("n_attachments"), "n_binder", "n_nonbinder")


def pooled_fragments(spark, sf, **how):
    whole = totals_of(spark, sf).agg(F.sum("n_binders"), F.sum("n_nonbinders")).first()
    counted = frags_of(spark, sf).groupBy("frag_id").agg(F.sum("activity").cast("long").alias("n_binder"), F.sum(1 - F.col("activity")).cast("long").alias("n_nonbinder"))
    return enrich.pooled(counted, whole[0], whole[1], **how)


@query(with_items(FRAG_COUNTS + ", " + POOLED_SQL.format(k="frag_id", u="fc") + """
SELECT frag_id, n_binder, n_nonbinder, round(frac_binder, 6) AS frac_binder, round(enrichment_factor, 6) AS enrichment_factor, round(enrichment_factor_smoothed, 6) AS enrichment_factor_smoothed,
  round(log2(enrichment_factor_smoothed), 6) AS log2_enrichment, round(binder_per_nonbinder, 6) AS binder_per_nonbinder, round(enrichment_factor_lo95, 6) AS enrichment_factor_lo95 FROM pool"""))
def fragment_enrichment_pooled(spark, sf):
    return pooled_fragments(spark, sf).select("frag_id", "n_binder", "n_nonbinder", r("frac_binder"), r("enrichment_factor"), r("enrichment_factor_smoothed"), r("log2_enrichment"), r("binder_per_nonbinder"), r("enrichment_factor_lo95"))


@query(with_items(FRAG_COUNTS + ", " + TAIL.format(u="fc", t="n_binder + n_nonbinder >= 5") + """
SELECT frag_id, round(fisher.p_value, 6) AS p_value, n_binder + n_nonbinder >= 5 AS tested, round(q_value, 6) AS q_value FROM fisher LEFT JOIN (SELECT frag_id, q_value FROM bh) USING (frag_id)"""))
def fragment_fisher_bh(spark, sf):
    tested = F.col("n_total") >= 5
    return pooled_fragments(spark, sf, test=True, tested=tested).select("frag_id", r("p_value"), "tested", r("q_value"))


@query(with_items("z AS (SELECT 1) SELECT * FROM counts"))
def pair_counts(spark, sf):
    return enrich.counts(pairs_of(spark, sf), PAIR)


@query(with_items("z AS (SELECT 1) SELECT * FROM pairs"))
def pair_long_table(spark, sf):
    return pairs_of(spark, sf)


@query(with_items("""t3 AS (SELECT DISTINCT compound, activity, stratum, list_sort([frag_id, a, b]) AS l FROM (SELECT *, lead(frag_id) OVER w AS a, lead(frag_id, 2) OVER w AS b FROM items WINDOW w AS (PARTITION BY compound ORDER BY pos)) WHERE b IS NOT NULL)
SELECT stratum, l[1] AS frag_0, l[2] AS frag_1, l[3] AS frag_2, sum(activity)::BIGINT AS n_binder, sum(1 - activity)::BIGINT AS n_nonbinder, min(CASE WHEN activity = 1 THEN compound END) AS example_compound FROM t3 GROUP BY ALL"""))
def triple_counts(spark, sf):
    return enrich.counts(graph.combinations(order_compounds(spark, sf), 3), graph.combo_columns(3))


@query("""SELECT * FROM (VALUES (1, 2, '1,2'), (1, 2, '1,3'), (1, 2, '1,4'), (1, 3, '1,2,3'), (1, 3, '1,2,4'), (1, 3, '1,3,4'), (1, 4, '1,2,3,4'), (2, 2, '-3,5'), (2, 2, '5,5'), (2, 2, '5,9'), (2, 3, '-3,5,5'), (2, 3, '-3,5,9'), (2, 3, '5,5,9'), (2, 4, '-3,5,5,9')) AS t(compound, size, combo)""")
def star_graph_combos(spark, sf):
    rows = [(1, [1, 2, 3, 4], [0, 0, 0], [1, 2, 3]), (2, [5, -3, 5, 9], [0, 1, 0, 2, 2], [1, 2, 2, 3, 2]), (3, [7], [], [])]
    df = spark.createDataFrame(rows, "compound int, frag_ids array<bigint>, edge_src array<smallint>, edge_dst array<smallint>")
    parts = [graph.combinations(df, k).select("compound", F.lit(k).alias("size"), F.concat_ws(",", *graph.combo_columns(k)).alias("combo")) for k in (2, 3, 4)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


MH_OUT = "round(enrichment_mh, 6) AS enrichment_mh, round(exp(centre - 1.96 * se), 6) AS enrichment_mh_lo95, round(exp(centre + 1.96 * se), 6) AS enrichment_mh_hi95"


@query(with_items(MH + f" SELECT frag_0, frag_1, n_binder, n_nonbinder, n_strata, example_compound, {MH_OUT} FROM mh ORDER BY exp(centre - 1.96 * se) DESC, frag_0, frag_1 LIMIT 1500"))
def mh_pairs(spark, sf):
    best = enrich.ranked(scored_pairs(spark, sf, test=False), "mh_lo95", PAIR).limit(1500)
    return best.select(*PAIR, "n_binder", "n_nonbinder", "n_strata", "example_compound", r("enrichment_mh"), r("enrichment_mh_lo95"), r("enrichment_mh_hi95"))


@query(with_items(MH + f" SELECT frag_0, frag_1, n_binder, n_nonbinder, n_strata, example_compound, {MH_OUT} FROM mh"))
def mh_pairs_all(spark, sf):
    """Every scored pair; mh_pairs is its report of the best 1,500."""
    return scored_pairs(spark, sf, test=False).select(*PAIR, "n_binder", "n_nonbinder", "n_strata", "example_compound", r("enrichment_mh"), r("enrichment_mh_lo95"), r("enrichment_mh_hi95"))


@query(with_items(MH + """, q AS (SELECT *, least(1, min(p_value_mh * n / rank) OVER (ORDER BY p_value_mh DESC RANGE UNBOUNDED PRECEDING)) AS q_value_mh FROM (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY p_value_mh) AS rank FROM mz))
SELECT frag_0, frag_1, round(p_value_mh, 6) AS p_value_mh, round(q_value_mh, 6) AS q_value_mh FROM q"""))
def mh_pairs_pq(spark, sf):
    return scored_pairs(spark, sf).select(*PAIR, r("p_value_mh"), r("q_value_mh"))


FLAT = "flat AS (SELECT frag_0, frag_1, sum(n_binder)::BIGINT AS n_binder, sum(n_nonbinder)::BIGINT AS n_nonbinder FROM counts GROUP BY frag_0, frag_1 HAVING sum(n_binder) >= 1 AND sum(n_binder) + sum(n_nonbinder) >= 5)"


@query(with_items(FLAT + ", " + TAIL.format(u="flat", t="true") + ", " + POOLED_SQL.format(k="frag_0, frag_1", u="flat") + """
SELECT frag_0, frag_1, round(enrichment_factor_lo95, 6) AS enrichment_factor_lo95, round(p_value, 6) AS p_value, round(q_value, 6) AS q_value, 'enrichment_factor_lo95' AS rank_metric FROM pool JOIN bh USING (frag_0, frag_1)"""))
def rank_fallback_unstratified(spark, sf):
    scored = enrich.ranked(scored_pairs(spark, sf, stratify=False), "mh_lo95", PAIR)
    return scored.select(*PAIR, r("enrichment_factor_lo95"), r("p_value"), r("q_value"), "rank_metric")


@query(with_items(FLAT + ", " + POOLED_SQL.format(k="frag_0, frag_1", u="flat") + " SELECT frag_0, frag_1, n_binder, round(binder_per_nonbinder, 6) AS binder_per_nonbinder FROM pool ORDER BY pool.binder_per_nonbinder DESC, n_binder DESC, frag_0, frag_1 LIMIT 500"))
def ratio_ranking(spark, sf):
    return enrich.ranked(scored_pairs(spark, sf, test=False), "ratio", PAIR).limit(500).select(*PAIR, "n_binder", r("binder_per_nonbinder"))


@query(with_items(FLAT + ", " + POOLED_SQL.format(k="frag_0, frag_1", u="flat") + " SELECT frag_0, frag_1, n_binder, round(binder_per_nonbinder, 6) AS binder_per_nonbinder FROM pool"))
def ratio_all(spark, sf):
    """Every scored pair; ratio_ranking is its report of the best 500."""
    return scored_pairs(spark, sf, test=False).select(*PAIR, "n_binder", r("binder_per_nonbinder"))


def word_rows(spark, sf, labelled):
    rows = word_items(spark, sf).filter(F.col("labelled") == labelled)
    return rows.select("compound", "activity", "stratum", "word", "frag_id").distinct()


def word_totals(spark, sf):
    return enrich.stratum_totals(word_rows(spark, sf, True).select("compound", "activity", "stratum").distinct())


WORD_MH = "wcounts AS (SELECT stratum, {k}, sum(activity)::BIGINT AS n_binder, sum(1 - activity)::BIGINT AS n_nonbinder, min(CASE WHEN activity = 1 THEN compound END) AS example_compound FROM {u} WHERE labelled GROUP BY stratum, {k}), "


@query(with_words(WORD_MH.format(k="word", u="wfrags") + TERMS.format(k="word", c="wcounts", t="wtotals") + f" SELECT word, n_binder, n_nonbinder, n_strata, {MH_OUT} FROM mh"))
def word_enrichment(spark, sf):
    scored = enrich.score(enrich.counts(word_rows(spark, sf, True), ["word"]), word_totals(spark, sf), ["word"], test=False)
    return scored.select("word", "n_binder", "n_nonbinder", "n_strata", r("enrichment_mh"), r("enrichment_mh_lo95"), r("enrichment_mh_hi95"))


@query(with_words(WORD_MH.format(k="frag_0, frag_1", u="wpairs") + TERMS.format(k="frag_0, frag_1", c="wcounts", t="wtotals") + f" SELECT frag_0, frag_1, n_binder, n_nonbinder, n_strata, {MH_OUT} FROM mh"))
def bigram_mh(spark, sf):
    rows = graph.combinations(word_compounds(spark, sf, True), 2)
    scored = enrich.score(enrich.counts(rows, PAIR), word_totals(spark, sf), PAIR, test=False)
    return scored.select(*PAIR, "n_binder", "n_nonbinder", "n_strata", r("enrichment_mh"), r("enrichment_mh_lo95"), r("enrichment_mh_hi95"))


WTARGETS = "tg AS (SELECT frag_0, frag_1 FROM wpairs WHERE labelled GROUP BY frag_0, frag_1 HAVING sum(activity) >= 3)"


def word_targets(spark, sf):
    return catalogue.targets(enrich.counts(graph.combinations(word_compounds(spark, sf, True), 2), PAIR), PAIR, 3)


@query(with_words(WTARGETS + " SELECT * FROM tg"))
def target_combos(spark, sf):
    return word_targets(spark, sf)


@query(with_words(WTARGETS + " SELECT stratum, frag_0, frag_1, count(*) AS n_compounds, min(compound) AS example_compound FROM wpairs SEMI JOIN tg USING (frag_0, frag_1) WHERE NOT labelled GROUP BY ALL"))
def catalogue_search(spark, sf):
    rows = catalogue.search(graph.combinations(word_compounds(spark, sf, False), 2), word_targets(spark, sf), PAIR)
    return enrich.counts(rows, PAIR, labelled=False)


def mapped_pairs(spark, sf):
    scaffolds = frags_of(spark, sf).select("frag_id", "scaffold").distinct()
    return cluster.cluster_map(enrich.counts(pairs_of(spark, sf), PAIR).select(*PAIR).distinct(), scaffolds, PAIR, ids.md5_60)


CMAP = """sc AS (SELECT DISTINCT frag_id, scaffold FROM frags),
cm AS (SELECT frag_0, frag_1, least(a.scaffold, b.scaffold) || '|' || greatest(a.scaffold, b.scaffold) AS cluster_key, ('0x' || substr(md5(least(a.scaffold, b.scaffold) || '|' || greatest(a.scaffold, b.scaffold)), 1, 15))::BIGINT AS cluster_id
  FROM (SELECT DISTINCT frag_0, frag_1 FROM counts) JOIN sc a ON a.frag_id = frag_0 JOIN sc b ON b.frag_id = frag_1)"""


@query(with_items(CMAP + """ SELECT stratum, cluster_id, sum(activity)::BIGINT AS n_binder, sum(1 - activity)::BIGINT AS n_nonbinder, min(CASE WHEN activity = 1 THEN compound END) AS example_compound
FROM (SELECT DISTINCT stratum, compound, activity, cluster_id FROM pairs JOIN cm USING (frag_0, frag_1)) GROUP BY ALL"""))
def cluster_recount(spark, sf):
    return cluster.recount(pairs_of(spark, sf), mapped_pairs(spark, sf), PAIR)


@query(with_items(CMAP + " SELECT stratum, cluster_id, sum(n_binder)::BIGINT AS n_binder, sum(n_nonbinder)::BIGINT AS n_nonbinder, min(example_compound) AS example_compound FROM counts JOIN cm USING (frag_0, frag_1) GROUP BY ALL"))
def cluster_approximate(spark, sf):
    return cluster.approximate(enrich.counts(pairs_of(spark, sf), PAIR), mapped_pairs(spark, sf), PAIR)


CSCORE = CMAP + """, rc AS (SELECT stratum, cluster_id, sum(activity)::BIGINT AS n_binder, sum(1 - activity)::BIGINT AS n_nonbinder, min(CASE WHEN activity = 1 THEN compound END) AS example_compound
  FROM (SELECT DISTINCT stratum, compound, activity, cluster_id FROM pairs JOIN cm USING (frag_0, frag_1)) GROUP BY ALL), """


@query(with_items(MH + ", " + CMAP + """, o AS (SELECT cluster_id, cluster_key, frag_0 || '|' || frag_1 AS name, n_binder, exp(centre - 1.96 * se) AS lo, frag_0, frag_1, row_number() OVER (PARTITION BY cluster_id ORDER BY round(exp(centre - 1.96 * se), 6) DESC, frag_0, frag_1) AS k FROM mh JOIN cm USING (frag_0, frag_1))
SELECT cluster_id, min(cluster_key) AS cluster_key, count(*) AS n_members, min(CASE WHEN k = 1 THEN name END) AS best_member, round(min(CASE WHEN k = 1 THEN lo END), 6) AS best_member_metric,
  min(CASE WHEN k = 1 THEN n_binder END) AS best_member_n_binder, string_agg(name, ';' ORDER BY k) AS members FROM o GROUP BY cluster_id"""))
def cluster_describe(spark, sf):
    scored = scored_pairs(spark, sf, test=False).join(mapped_pairs(spark, sf), PAIR).withColumn("enrichment_mh_lo95", F.round("enrichment_mh_lo95", 6))
    return cluster.describe(scored, "enrichment_mh_lo95", PAIR, F.concat_ws("|", *PAIR))


@query(with_items(CSCORE + TERMS.format(k="cluster_id", c="rc", t="totals") + f" SELECT cluster_id, n_binder, n_nonbinder, n_strata, example_compound, {MH_OUT} FROM mh"))
def cluster_enrichment(spark, sf):
    scored = enrich.score(cluster.recount(pairs_of(spark, sf), mapped_pairs(spark, sf), PAIR), totals_of(spark, sf), ["cluster_id"], test=False)
    return scored.select("cluster_id", "n_binder", "n_nonbinder", "n_strata", "example_compound", r("enrichment_mh"), r("enrichment_mh_lo95"), r("enrichment_mh_hi95"))


HALF = "(('0x' || substr(md5(compound::VARCHAR), 1, 15))::BIGINT % 2)::INT"
HALVES = f"""hp AS (SELECT *, {HALF} AS half FROM pairs), hpair AS (SELECT stratum || '/' || half AS stratum, frag_0, frag_1, half, sum(activity)::BIGINT AS n_binder, sum(1 - activity)::BIGINT AS n_nonbinder, min(compound) AS example_compound FROM hp GROUP BY ALL),
ht AS (SELECT stratum || '/' || half AS stratum, sum(activity)::BIGINT AS n_binders, sum(1 - activity)::BIGINT AS n_nonbinders FROM (SELECT DISTINCT stratum, half, compound, activity FROM hp) GROUP BY ALL HAVING sum(activity) > 0), """
HALF_EST = HALVES + TERMS.format(k="frag_0, frag_1, half", c="hpair", t="ht").replace("HAVING sum(n_binder) >= 1 AND sum(n_binder) + sum(n_nonbinder) >= 5", "HAVING sum(n_binder) >= 2") + ", es AS (SELECT frag_0, frag_1, half, ln(enrichment_mh) AS x FROM mh WHERE isfinite(enrichment_mh) AND enrichment_mh > 0), ab AS (SELECT frag_0, frag_1, max(CASE WHEN half = 0 THEN x END) AS a, max(CASE WHEN half = 1 THEN x END) AS b FROM es GROUP BY ALL HAVING count(*) = 2)"


def halves(spark, sf):
    return cluster.half_estimates(pairs_of(spark, sf), PAIR, ids.md5_half(F.col("compound").cast("string")), min_binder=2)


@query(with_items(HALF_EST + " SELECT frag_0, frag_1, half, round(x, 6) AS log_enrichment FROM es"))
def split_half(spark, sf):
    return halves(spark, sf).select(*PAIR, "half", r("log_enrichment"))


@query(with_items(HALF_EST + """, rk AS (SELECT round(a, 9) AS a, round(b, 9) AS b FROM ab), rr AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM rk)
SELECT round(corr(ra, rb), 6) AS rho, count(*) AS n, round(median(abs(a - b)), 6) AS median_gap FROM rr"""))
def split_half_agreement(spark, sf):
    rows = halves(spark, sf).withColumn("log_enrichment", F.round("log_enrichment", 9))
    return cluster.agreement(rows, PAIR).select(r("rho"), "n", r("median_gap"))


@query(with_items(HALF_EST + ", " + CMAP + """, v AS (SELECT cluster_id, var_samp((a + b) / 2) AS v, avg((a - b) * (a - b) / 4) AS e FROM ab JOIN cm USING (frag_0, frag_1) GROUP BY cluster_id HAVING count(*) > 1)
SELECT count(*) AS n_clusters, round(avg(v), 6) AS within, round(avg(e), 6) AS noise, round(avg(v) / avg(e), 6) AS ratio FROM v"""))
def homogeneity(spark, sf):
    return cluster.homogeneity(mapped_pairs(spark, sf), halves(spark, sf), PAIR).select("n_clusters", r("within"), r("noise"), r("ratio"))


WCAT = "cat AS (SELECT frag_id, count(*) AS n FROM wfrags WHERE NOT labelled GROUP BY frag_id), "


@query(with_words(WCAT + """lab2 AS (SELECT frag_id, sum(activity)::BIGINT AS n_binder, sum(1 - activity)::BIGINT AS n_nonbinder FROM wfrags WHERE labelled GROUP BY frag_id)
SELECT frag_id, n_binder, n_nonbinder, coalesce(n, 0)::BIGINT AS n_catalogue, coalesce(n, 0) > 0 AS in_catalogue, n_binder >= 5 AND (n_nonbinder = 0 OR n_binder / n_nonbinder::DOUBLE >= 0.01) AS enriched FROM lab2 LEFT JOIN cat USING (frag_id)"""))
def catalogue_overlap_fragments(spark, sf):
    scored = word_rows(spark, sf, True).groupBy("frag_id").agg(F.sum("activity").cast("long").alias("n_binder"), F.sum(1 - F.col("activity")).cast("long").alias("n_nonbinder"))
    whole = scored.withColumn("binder_per_nonbinder", enrich.ieee.div(F.col("n_binder"), F.col("n_nonbinder")))
    other = word_rows(spark, sf, False).groupBy("frag_id").agg(F.count("*").alias("n"))
    return catalogue.overlap(whole, other, ["frag_id"], "n", enrich.enriched("ratio")).drop("binder_per_nonbinder")


@query(with_words("""pc AS (SELECT frag_0, frag_1, count(*) AS n, min(compound) AS e FROM wpairs WHERE NOT labelled GROUP BY ALL), pl AS (SELECT frag_0, frag_1, sum(activity)::BIGINT AS n_binder FROM wpairs WHERE labelled GROUP BY ALL)
SELECT frag_0, frag_1, n_binder, coalesce(n, 0)::BIGINT AS n_catalogue, coalesce(n, 0) > 0 AS in_catalogue, n_binder >= 5 AS enriched FROM pl LEFT JOIN pc USING (frag_0, frag_1)"""))
def catalogue_overlap_combos(spark, sf):
    scored = graph.combinations(word_compounds(spark, sf, True), 2).groupBy(*PAIR).agg(F.sum("activity").cast("long").alias("n_binder"))
    other = graph.combinations(word_compounds(spark, sf, False), 2).groupBy(*PAIR).agg(F.count("*").alias("n"))
    return catalogue.overlap(scored, other, PAIR, "n", F.col("n_binder") >= 5)


@query(with_words("""hit AS (SELECT frag_id, substr(min(word), 1, 4) AS scaffold FROM wfrags WHERE labelled GROUP BY frag_id HAVING sum(activity) >= 20), oth AS (SELECT DISTINCT frag_id AS catalogue_frag_id, substr(word, 1, 4) AS scaffold FROM wfrags WHERE NOT labelled)
SELECT frag_id, scaffold, catalogue_frag_id, CASE WHEN frag_id = catalogue_frag_id THEN 'exact' ELSE 'analogue' END AS match FROM hit JOIN oth USING (scaffold)"""))
def analogues(spark, sf):
    key = F.substring("word", 1, 4).alias("scaffold")
    parents = word_rows(spark, sf, True).groupBy("frag_id").agg(F.min("word").alias("word"), F.sum("activity").alias("n")).filter("n >= 20").select("frag_id", key)
    others = word_rows(spark, sf, False).select("frag_id", key).distinct()
    return catalogue.analogues(parents, others).select("frag_id", "scaffold", "catalogue_frag_id", "match")


@query(with_words("""hit AS (SELECT frag_id FROM wfrags WHERE labelled GROUP BY frag_id HAVING sum(activity) >= 20), k AS (SELECT frag_id, compound, row_number() OVER (PARTITION BY frag_id ORDER BY md5(compound::VARCHAR), compound) AS r FROM wfrags SEMI JOIN hit USING (frag_id) WHERE NOT labelled)
SELECT frag_id, compound, md5(text) AS text_md5 FROM k JOIN documents ON doc_id = compound WHERE r <= 10"""))
def compounds_with_hits_capped(spark, sf):
    units = word_rows(spark, sf, True).groupBy("frag_id").agg(F.sum("activity").alias("n")).filter("n >= 20").select("frag_id")
    hits = catalogue.search(word_rows(spark, sf, False).select("frag_id", "compound"), units, ["frag_id"])
    few = catalogue.capped(hits, ["frag_id"], 10, F.struct(F.md5(F.col("compound").cast("string").cast("binary")), "compound"))
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("compound"), "text").dropDuplicates(["compound"])
    return few.join(texts, "compound", "left").select("frag_id", "compound", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("SELECT true AS same, false AS other")
def exact_settings_guard(spark, sf):
    one = spark.createDataFrame([(5, "balanced"), (5, "balanced")], "min_hac int, selector string")
    two = spark.createDataFrame([(6, "greedy")], "min_hac int, selector string")
    return spark.createDataFrame([(catalogue.check_settings(one, one), catalogue.check_settings(one, two, allow=True))], "same boolean, other boolean")


@query(with_words(WCAT + """u AS (SELECT frag_id, count(*) AS n FROM wfrags WHERE labelled GROUP BY frag_id), j AS (SELECT u.n, cat.n IS NOT NULL AS there, CASE WHEN u.n >= 100 THEN 3 WHEN u.n >= 10 THEN 2 WHEN u.n >= 2 THEN 1 ELSE 0 END AS band FROM u LEFT JOIN cat USING (frag_id))
SELECT band, count(*) AS n_types, sum(there::INT)::BIGINT AS n_shared, round(avg(there::INT), 6) AS share_types, round(sum(CASE WHEN there THEN n ELSE 0 END) / sum(n)::DOUBLE, 6) AS share_instances FROM j GROUP BY band"""))
def overlap_bands(spark, sf):
    own = word_rows(spark, sf, True).groupBy("frag_id").agg(F.count("*").alias("n"))
    other = word_rows(spark, sf, False).groupBy("frag_id").agg(F.count("*").alias("c"))
    shared = catalogue.overlap(own, other, ["frag_id"], "c", F.lit(False))
    return catalogue.bands(shared, "n", [2, 10, 100], "n").select("band", "n_types", "n_shared", r("share_types"), r("share_instances"))


@query(with_items("z AS (SELECT 1) SELECT DISTINCT frag_0, frag_1 FROM pairs WHERE ('0x' || substr(md5(frag_0 || '|' || frag_1), 1, 15))::BIGINT % 16 = 0"))
def pair_hash_sample(spark, sf):
    return catalogue.pair_sample(pairs_of(spark, sf), PAIR, 16, ids.md5_60(F.concat_ws("|", *PAIR)))


def pair_sizes(spark, sf):
    return pairs_of(spark, sf).groupBy(*PAIR).agg(F.count("*").alias("n_compounds"))


PC = "pc AS (SELECT frag_0, frag_1, count(*) AS n FROM pairs GROUP BY frag_0, frag_1)"


@query(with_items(PC + " SELECT at_least, sum((n >= at_least)::INT)::BIGINT AS n_units, round(sum(CASE WHEN n >= at_least THEN n ELSE 0 END) / sum(n)::DOUBLE, 6) AS share_instances FROM pc, (SELECT unnest([1, 2, 5, 10, 50]) AS at_least) GROUP BY at_least"))
def reuse_table(spark, sf):
    return catalogue.reuse(pair_sizes(spark, sf), [1, 2, 5, 10, 50]).select("at_least", "n_units", r("share_instances"))


@query(with_items(PC + """, o AS (SELECT row_number() OVER (ORDER BY n DESC, frag_0, frag_1) AS k, sum(n) OVER (ORDER BY n DESC, frag_0, frag_1) / (sum(n) OVER ())::DOUBLE AS c FROM pc)
SELECT share, min(k) AS n_units FROM o, (SELECT unnest([0.25, 0.5, 0.75, 0.9])::DOUBLE AS share) WHERE c >= share GROUP BY share"""))
def coverage_curve(spark, sf):
    return catalogue.coverage(pair_sizes(spark, sf), [0.25, 0.5, 0.75, 0.9])


@query(with_items("fs AS (SELECT frag_0, frag_1, min(stratum) AS stratum FROM pairs GROUP BY ALL), c AS (SELECT stratum, count(*) AS n_new FROM fs GROUP BY stratum) SELECT stratum, n_new, (sum(n_new) OVER (ORDER BY stratum))::BIGINT AS n_seen FROM c"))
def discovery_curve(spark, sf):
    return catalogue.discovery(pairs_of(spark, sf), PAIR, "stratum")


@query(with_items("""n AS (SELECT compound, activity, count(*) AS k FROM items GROUP BY ALL)
SELECT activity AS library, count(*) AS n_compounds, sum(k)::BIGINT AS n_instances, (SELECT count(DISTINCT frag_id) FROM frags f WHERE f.activity = n.activity) AS n_fragments, round(avg(k), 6) AS per_compound, max(k) AS largest, sum((k = 1)::INT)::BIGINT AS n_whole FROM n GROUP BY activity"""))
def inventory(spark, sf):
    c = order_compounds(spark, sf)
    size = F.size("frag_ids").cast("long")
    one = c.groupBy(F.col("activity").alias("library")).agg(F.count("*").alias("n_compounds"), F.sum(size).alias("n_instances"), F.avg(size).alias("per_compound"), F.max(size).alias("largest"), F.sum((size == 1).cast("long")).alias("n_whole"))
    distinct = c.select(F.col("activity").alias("library"), F.explode("frag_ids").alias("f")).distinct().groupBy("library").agg(F.count("*").alias("n_fragments"))
    return one.join(distinct, "library").select("library", "n_compounds", "n_instances", "n_fragments", r("per_compound"), "largest", "n_whole")


@query(with_items("""e AS (SELECT *, (CASE WHEN pos > 1 THEN 1 ELSE 0 END + CASE WHEN pos < max(pos) OVER (PARTITION BY compound) THEN 1 ELSE 0 END) AS ends FROM items)
SELECT ends, count(*) AS n_instances, count(DISTINCT frag_id) AS n_fragments, round(avg(hac), 6) AS mean_hac, round(count(*) / (sum(count(*)) OVER ())::DOUBLE, 6) AS share FROM e GROUP BY ends"""))
def attachments_profile(spark, sf):
    from pyspark.sql import Window as W

    last = F.max("pos").over(W.partitionBy("compound"))
    ends = (F.col("pos") > 1).cast("int") + (F.col("pos") < last).cast("int")
    grouped = order_items(spark, sf).withColumn("ends", ends).groupBy("ends").agg(F.count("*").alias("n_instances"), F.countDistinct("frag_id").alias("n_fragments"), F.avg("hac").alias("mean_hac"))
    return grouped.withColumn("share", F.col("n_instances") / F.sum("n_instances").over(W.partitionBy())).select("ends", "n_instances", "n_fragments", r("mean_hac"), r("share"))


@query(with_items("z AS (SELECT least(hac, 30) AS bin, count(*) AS n FROM items GROUP BY bin) SELECT bin, n, round(n / (sum(n) OVER ())::DOUBLE, 6) AS share, round((SELECT sum(bin * n) / sum(n)::DOUBLE FROM z), 6) AS weighted_mean FROM z"))
def size_histogram_weighted(spark, sf):
    from pyspark.sql import Window as W

    hist = order_items(spark, sf).groupBy(F.least("hac", F.lit(30)).alias("bin")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy())
    return hist.withColumn("share", F.col("n") / total).withColumn("weighted_mean", F.sum(F.col("bin") * F.col("n")).over(W.partitionBy()) / total).select("bin", "n", r("share"), r("weighted_mean"))


@query(with_items("v AS (SELECT least(hac, 20) AS bin, pos::DOUBLE AS x FROM items) SELECT bin, count(*) AS n, round(median(x), 6) AS median, round(quantile_cont(x, 0.9), 6) AS p90 FROM v GROUP BY bin HAVING count(*) >= 30"))
def median_by_bin(spark, sf):
    rows = order_items(spark, sf).groupBy(F.least("hac", F.lit(20)).alias("bin")).agg(F.count("*").alias("n"), F.median(F.col("pos").cast("double")).alias("median"), F.percentile(F.col("pos").cast("double"), F.lit(0.9)).alias("p90"))
    return rows.filter("n >= 30").select("bin", "n", r("median"), r("p90"))


@query(with_items("""k AS (SELECT compound, list_sort(list(frag_id)) AS s, compound % 2 AS lib FROM items GROUP BY compound HAVING count(*) > 1)
SELECT a.compound AS compound_1, b.compound AS compound_2 FROM k a JOIN k b ON a.s = b.s WHERE a.lib = 0 AND b.lib = 1"""))
def shared_compounds(spark, sf):
    c = order_compounds(spark, sf).withColumn("canonical", F.concat_ws("|", F.array_sort(F.col("frag_ids").cast("array<string>")))).withColumn("set_key", F.xxhash64(F.array_sort("frag_ids")))
    rows = graph.combinations(c, 2)
    one, two = rows.filter("compound % 2 = 0"), rows.filter("compound % 2 = 1")
    pairs = one.select(*PAIR).intersect(two.select(*PAIR))
    return catalogue.shared_compounds(one, two, pairs, PAIR).select("compound_1", "compound_2")


@query(with_items("""s AS (SELECT compound, activity, list_sort(list(DISTINCT frag_id)) AS s FROM items GROUP BY ALL),
x AS (SELECT activity, frag_id, compound, row_number() OVER (PARTITION BY activity, frag_id ORDER BY md5(compound::VARCHAR), compound) AS r FROM frags), y AS (SELECT x.activity, frag_id, compound, s FROM x JOIN s USING (compound) WHERE r <= 8),
j AS (SELECT a.frag_id, a.compound AS c1, b.compound AS c2, len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))::DOUBLE AS t FROM y a JOIN y b ON a.frag_id = b.frag_id WHERE a.activity = 1 AND b.activity = 0)
SELECT frag_id, count(DISTINCT c1) AS n_1, count(DISTINCT c2) AS n_2, round(max(t), 6) AS best, sum((t = 1)::INT)::BIGINT AS n_identical FROM j GROUP BY frag_id"""))
def parent_overlap(spark, sf):
    c = order_compounds(spark, sf).select("compound", "activity", F.array_distinct("frag_ids").alias("s"))
    rows = c.select("compound", "activity", "s", F.explode("s").alias("frag_id"))
    one, two = (rows.filter(F.col("activity") == a).select("frag_id", F.col("compound").alias(f"compound_{n}"), F.col("s").alias(f"s{n}")) for a, n in ((1, 1), (0, 2)))
    common = F.size(F.array_intersect("s1", "s2"))
    keys = [F.struct(F.md5(F.col(f"compound_{n}").cast("string").cast("binary")), f"compound_{n}") for n in (1, 2)]
    return catalogue.parent_overlap(one, two, "frag_id", common / (F.size("s1") + F.size("s2") - common), 8, *keys).select("frag_id", "n_1", "n_2", r("best"), "n_identical")


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT l_returnflag AS stratum, floor((k - 1) / ceil(n / ceil(n / 900.0)))::BIGINT AS piece, count(*) AS n_rows FROM n GROUP BY ALL""")
def even_reshard(spark, sf):
    rows = table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "stratum")
    cut = library.even_pieces(rows, 900, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])
    return cut.groupBy("stratum", "piece").agg(F.count("*").alias("n_rows"))


@query(with_items(MH + ", " + CMAP + """, o AS (SELECT frag_0, frag_1, cluster_id, round(exp(centre - 1.96 * se), 6) AS lo FROM mh JOIN cm USING (frag_0, frag_1)), b AS (SELECT cluster_id, max(lo) AS best, count(*) AS n FROM o GROUP BY cluster_id), i AS (SELECT *, dense_rank() OVER (ORDER BY best DESC, cluster_id) AS cluster_index FROM b)
SELECT frag_0, frag_1, cluster_id, n AS cluster_size, cluster_index::INT AS cluster_index, best AS cluster_best FROM o JOIN i USING (cluster_id)"""))
def cluster_order(spark, sf):
    rows = scored_pairs(spark, sf, test=False).join(mapped_pairs(spark, sf), PAIR).withColumn("lo", F.round("enrichment_mh_lo95", 6))
    return cluster.order_by_cluster(rows, "lo", PAIR).select(*PAIR, "cluster_id", "cluster_size", "cluster_index", "cluster_best")


@query(with_items("g AS (SELECT smiles, count(*) AS n FROM items GROUP BY smiles) SELECT sum(n)::BIGINT AS rows, count(*) AS groups, round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 6) AS entropy, round(count(*) * 1000 / sum(n)::DOUBLE, 6) AS per_thousand FROM g"))
def entropy(spark, sf):
    return stats.entropy(order_items(spark, sf), "smiles").select("rows", "groups", r("entropy"), r("per_thousand"))


BITS = "bits AS (SELECT vec_id AS id, CASE WHEN label < 5 THEN 0 ELSE 1 END AS library, list_transform(embedding, lambda x: (x > 0)::INT) AS b FROM embeddings)"
TANI = "CASE WHEN list_sum(list_transform(list_zip(x.b, y.b), lambda z: greatest(z[1], z[2]))) > 0 THEN list_sum(list_transform(list_zip(x.b, y.b), lambda z: z[1] * z[2])) / list_sum(list_transform(list_zip(x.b, y.b), lambda z: greatest(z[1], z[2])))::DOUBLE ELSE 0 END"


@query(f"WITH {BITS} SELECT x.id, round(max({TANI}), 6) AS best FROM bits x, bits y WHERE x.library = 0 AND y.library = 1 GROUP BY x.id")
def nn_tanimoto(spark, sf):
    p = prints(spark, sf)
    return similarity.nearest_tanimoto(p.filter("library = 0"), p.filter("library = 1")).select("id", r("best"))


@query(f"WITH {BITS}, s AS (SELECT * FROM bits ORDER BY md5(id::VARCHAR) LIMIT 150) SELECT round(avg(1 - {TANI}), 6) AS mean_distance, count(*) AS n_pairs FROM s x JOIN s y ON x.id < y.id")
def mean_pairwise_distance(spark, sf):
    sample = similarity.hash_sample(prints(spark, sf), 150, F.md5(F.col("id").cast("string").cast("binary")))
    return similarity.mean_pairwise_distance(sample).select(r("mean_distance"), "n_pairs")


@query(f"""WITH RECURSIVE {BITS}, o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY id) AS k FROM bits), e AS MATERIALIZED (SELECT x.k, list(y.id) AS l FROM o x JOIN o y ON y.k < x.k AND {TANI} >= 0.45 GROUP BY x.k),
n AS MATERIALIZED (SELECT o.k, o.id, l FROM o LEFT JOIN e USING (k)),
g AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS chosen UNION ALL SELECT n.k, CASE WHEN l IS NOT NULL AND list_has_any(chosen, l) THEN chosen ELSE list_append(chosen, n.id) END FROM g JOIN n ON n.k = g.k + 1)
SELECT unnest(chosen) AS id FROM (SELECT chosen FROM g ORDER BY k DESC LIMIT 1)""")
def sphere_exclusion(spark, sf):
    """Leaders at 0.45: signs of random vectors are hardly ever as alike as 0.7."""
    return similarity.sphere_exclusion(prints(spark, sf), 0.45)


@query()
def landmark_mds(spark, sf):
    return similarity.landmark_mds(prints(spark, sf), library="library").select("id", "mds_1", "mds_2")


@query()
def pca(spark, sf):
    return similarity.pca(prints(spark, sf), F.col("library") == 1).select("id", "pca_1", "pca_2")


@query()
def domain_auc(spark, sf):
    return spark.createDataFrame([(similarity.domain_auc(prints(spark, sf), "library"),)], "auc double")


@query("SELECT * FROM (VALUES (1, '1,3', '5,7,6', '1,3'), (2, '1', '6,6', '1'), (3, '1,3', '8,8,8', '1,3'), (4, '4', '10,6', '3'), (5, '1', '10,6', '1'), (6, '0,1', '6,5,5', NULL), (7, '', '13', ''), (8, '1', '7,5', '')) AS t(tree, balanced, parts, greedy) WHERE tree <> 6")
def balanced_cuts(spark, sf):
    chains = {1: [2, 3, 5, 2, 6], 2: [3] * 4, 3: [4] * 6, 4: [2] * 8, 5: [4, 6, 6], 8: [4, 3, 2, 3]}
    rows = [(k, w, list(range(len(w) - 1)), list(range(1, len(w)))) for k, w in chains.items()] + [(7, [4, 1, 4, 4], [0, 1, 1], [1, 2, 3])]
    trees = spark.createDataFrame(rows, "tree int, weights array<int>, edge_src array<int>, edge_dst array<int>")
    text = lambda c: F.concat_ws(",", F.col(c).cast("array<string>"))
    a = graph.select_cuts(trees, 5, "balanced").select("tree", text("cuts").alias("balanced"), text("part_weights").alias("parts"))
    return a.join(graph.select_cuts(trees, 5, "greedy").select("tree", text("cuts").alias("greedy")), "tree")

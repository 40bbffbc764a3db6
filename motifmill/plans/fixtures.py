"""Stand-ins that bring the driver's tables into the shape of compounds and fragments.

A: orders are compounds, their lines a chain of fragments (brand and type of the part), urgent
orders positives, market segments strata.  B: labelled documents against the others, words as
fragments.  C: signs of embeddings as fingerprints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.ids import md5_60
from ..operators.graph import chain


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def order_items(spark: SparkSession, sf: str) -> DataFrame:
    """compound, activity, stratum, pos, frag_id, smiles, hac, scaffold: one row per order line."""
    part = table(spark, sf, "part").select("p_partkey", F.concat_ws("/", "p_brand", "p_type").alias("smiles"), F.col("p_size").alias("hac"), F.col("p_type").alias("scaffold"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0).alias("activity"))
    customer = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("stratum"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", *LINE)
    rows = lines.join(part, lines.l_partkey == part.p_partkey).join(orders, lines.l_orderkey == orders.o_orderkey).join(customer, orders.o_custkey == customer.c_custkey)
    pos = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*LINE)).alias("pos")
    return rows.select(F.col("l_orderkey").alias("compound"), "activity", "stratum", pos, md5_60(F.col("smiles")).alias("frag_id"), "smiles", "hac", "scaffold")


def order_compounds(spark: SparkSession, sf: str) -> DataFrame:
    return chain(order_items(spark, sf), ["compound", "activity", "stratum"], "pos")


ITEMS = """items AS (
  SELECT l_orderkey AS compound, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS activity, c_mktsegment AS stratum,
    p_brand || '/' || p_type AS smiles, ('0x' || substr(md5(p_brand || '/' || p_type), 1, 15))::BIGINT AS frag_id, p_size AS hac, p_type AS scaffold,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey),
compounds AS (SELECT DISTINCT compound, activity, stratum FROM items),
totals AS (SELECT stratum, count(*) AS n_compounds, sum(activity)::BIGINT AS n_binders, sum(1 - activity)::BIGINT AS n_nonbinders FROM compounds GROUP BY stratum),
whole AS (SELECT sum(n_binders)::DOUBLE AS tb, sum(n_nonbinders)::DOUBLE AS tn FROM totals),
pairs AS (SELECT DISTINCT compound, activity, stratum, least(frag_id, nxt) AS frag_0, greatest(frag_id, nxt) AS frag_1
  FROM (SELECT *, lead(frag_id) OVER (PARTITION BY compound ORDER BY pos) AS nxt FROM items) WHERE nxt IS NOT NULL),
counts AS (SELECT stratum, frag_0, frag_1, sum(activity)::BIGINT AS n_binder, sum(1 - activity)::BIGINT AS n_nonbinder,
  min(CASE WHEN activity = 1 THEN compound END) AS example_compound FROM pairs GROUP BY stratum, frag_0, frag_1),
frags AS (SELECT DISTINCT compound, activity, stratum, frag_id, smiles, scaffold FROM items)"""


def word_items(spark: SparkSession, sf: str) -> DataFrame:
    """compound, labelled, activity, stratum, pos, word, frag_id: words of at least three letters."""
    docs = table(spark, sf, "documents").select("doc_id", "source", F.posexplode(F.split(F.lower("text"), "[^a-z]+")).alias("pos", "word"))
    labels = table(spark, sf, "labels").select("doc_id", "quality").dropDuplicates(["doc_id"])
    rows = docs.filter(F.length("word") >= 3).join(labels, "doc_id", "left")
    return rows.select(F.col("doc_id").alias("compound"), F.col("quality").isNotNull().alias("labelled"), F.col("quality").alias("activity"), F.col("source").alias("stratum"), "pos", "word", md5_60(F.col("word")).alias("frag_id"))


WORDS = """cut AS (SELECT doc_id, source, string_split_regex(lower(text), '[^a-z]+') AS w FROM documents),
words AS (SELECT doc_id AS compound, source AS stratum, unnest(w) AS word, unnest(range(0, len(w)))::INT AS pos FROM cut),
lab AS (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id),
witems AS (SELECT compound, lab.quality IS NOT NULL AS labelled, quality AS activity, stratum, pos, word, ('0x' || substr(md5(word), 1, 15))::BIGINT AS frag_id
  FROM words LEFT JOIN lab ON lab.doc_id = compound WHERE length(word) >= 3),
wfrags AS (SELECT DISTINCT compound, labelled, activity, stratum, word, frag_id FROM witems),
wpairs AS (SELECT DISTINCT compound, labelled, activity, stratum, least(frag_id, nxt) AS frag_0, greatest(frag_id, nxt) AS frag_1
  FROM (SELECT *, lead(frag_id) OVER (PARTITION BY compound ORDER BY pos) AS nxt FROM witems) WHERE nxt IS NOT NULL),
wtotals AS (SELECT stratum, sum(activity)::BIGINT AS n_binders, sum(1 - activity)::BIGINT AS n_nonbinders FROM (SELECT DISTINCT compound, activity, stratum FROM witems WHERE labelled) GROUP BY stratum)"""


def word_compounds(spark: SparkSession, sf: str, labelled: bool) -> DataFrame:
    rows = word_items(spark, sf).filter(F.col("labelled") == labelled)
    return chain(rows, ["compound", "activity", "stratum"], "pos")


def prints(spark: SparkSession, sf: str) -> DataFrame:
    """id, library (0 or 1), vec, lanes."""
    from ..operators.similarity import sign_lanes

    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("label") < 5, 0).otherwise(1).alias("library"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    return rows.withColumn("lanes", sign_lanes(F.col("vec")))

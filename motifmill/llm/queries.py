"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language_id, near_dedup, packing, quality, sharding, token_counts, token_files, url_filter, vp_tree
from .common import table


def tokenizer_file(name: str) -> str:
    """Where the public tokenizer files are; every operator takes another path as well."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import crc_split

    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, training=language_id.in_training())
    return found.select("doc_id", F.coalesce(crc_split() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op4_vp_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vp_tree.nearest(table(spark, sf_dir, "embeddings"))


def vp_tree_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search of op4 at factor 1, which leaves out nothing that could be nearer, so that SQL can say the same."""
    found = vp_tree.nearest(table(spark, sf_dir, "embeddings"), factor=1.0)
    return found.withColumn("score", F.round("score", 9))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_token_files(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=2)
    return token_files.read_token_files(files)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op8_min_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op9_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(x,) for x in url_filter.LISTED], "key string")
    return url_filter.judge(table(spark, sf_dir, "pages"), listed)


def op10_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


def _op9_sql() -> str:
    fits = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[0] + r[1]))
    rule = " ".join(f"WHEN {fits.format(h, p)} THEN '{h}{p}'" for h, p, _ in rules)
    verdict = " ".join(f"WHEN {fits.format(h, p)} THEN '{v}'" for h, p, v in rules)
    listed = " OR ".join(f"host = '{h}' OR ends_with(host, '.{h}')" for h in url_filter.LISTED)
    return f"""
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut)
SELECT page_id, host, path, CASE {rule} END AS rule,
  CASE {verdict} WHEN {listed} THEN 'block' ELSE 'allow' END AS verdict, ({listed}) AS listed
FROM parts"""


VP_TREE_EXACT_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
fine AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) / (q.norm * c.norm) AS score
  FROM fine q JOIN fine c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, round(score, 9) AS score
FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM pairs) WHERE rank <= 5"""

#: Equal texts stand for one another; links of the others by counts of common shingles, components by what can be reached.
OP10_SQL = r"""
WITH RECURSIVE texts AS (SELECT text, min(doc_id) AS id FROM documents WHERE text IS NOT NULL GROUP BY text),
words AS (SELECT text, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM texts),
sets AS (SELECT text, id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || ' ' || p[2])) END AS s FROM words),
sizes AS (SELECT text, id, len(s) AS n FROM sets),
shingles AS (SELECT id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (SELECT a.id AS a, b.id AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.id <> b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT id, id AS other FROM sizes UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a),
low AS (SELECT id, min(other) AS least FROM reach GROUP BY id),
named AS (SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, CASE WHEN n > 0 THEN least ELSE d.doc_id END AS component_id
  FROM documents d LEFT JOIN sizes USING (text) LEFT JOIN low USING (id))
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM named"""

QUERIES = {f.__name__: f for f in (op1_token_counts, op2_decontamination, op3_language_id, op4_vp_tree, vp_tree_exact, op5_token_files, op6_quality, op7_label_propagation, op8_min_bin_slack, op9_bloom_cascade, op10_circulant_minhash)}
ORACLE_SQL = {"vp_tree_exact": VP_TREE_EXACT_SQL, "op9_bloom_cascade": _op9_sql(), "op10_circulant_minhash": OP10_SQL}

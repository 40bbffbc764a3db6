from pyspark.sql import functions as F

import corpus_pipeline
from motifmill.llm import near_dedup, packing
from motifmill.llm.queries import tokenizer_file

from .test_search import classes, leaks


def test_stages_take_effect(spark):
    big = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{big}/documents.parquet")
    kept, frames = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, big)
        assert kept.columns == docs.columns
        frames[name] = (before, kept)
        kept = spark.createDataFrame(kept.collect(), docs.schema)
    labels = {r.doc_id: r.quality == 1 and r.toxic == 0 for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    for name in ("language ID", "quality classifier"):
        before, after = ({r.doc_id for r in f.collect()} for f in frames[name])
        gone = before - after
        assert sum(labels.get(d, False) for d in gone) <= 0.02 * sum(labels.values())
    before, after = ([(r.doc_id, r.text) for r in f.collect()] for f in frames["MinHash near-dedup"])
    assert {d for d, _ in after} == {c for _, c in classes(before, 5).values()}
    before, after = ([(r.doc_id, r.text) for r in f.collect()] for f in frames["benchmark decontamination"])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{big}/benchmark.parquet").collect()]
    assert {d for d, _ in before} - {d for d, _ in after} == {d for d, _ in leaks(before, items)}


def test_run_packs_what_is_left(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and len({r.doc_id for r in rows}) < spark.read.parquet(f"{sf}/documents.parquet").count()


def test_odd_rows_pass_every_stage(spark, sf, odd):
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
    assert packing.pack(docs, tokenizer_file("word_bpe_49k.json")).filter("piece = 0").count() == docs.count()
    assert near_dedup.near_duplicates(odd).count() == odd.count()


def test_odd_rows_are_judged_each(spark, sf, none):
    """Rows without an id, repeated rows and ids with good and bad texts; and an empty table."""
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(300)
    good = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("quality = 1 and toxic = 0").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id").filter("lang = 'en'").select(big.columns).limit(1).collect()[0]
    junk = "xqzj wvkq qqxz jjkw zzqx " * 20
    odd = [(None, junk, None, "s", 1), (None, good.text, "en", "s", 1), (77_777, junk, None, "s", 1), (77_777, good.text, "en", "s", 1), (77_777, good.text, "en", "s", 1)]
    docs = big.unionByName(spark.createDataFrame(odd, big.schema))
    kept = corpus_pipeline.language(spark, docs, sf)
    mine = [(r.doc_id, r.text == junk) for r in kept.filter("doc_id is null or doc_id = 77777").collect()]
    assert sorted(mine, key=str) == sorted([(None, False), (77_777, False), (77_777, False)], key=str)
    same = spark.createDataFrame([*odd[1:2], *odd[3:], *odd[3:]], big.schema)
    left = corpus_pipeline.dedup(spark, same, sf).collect()
    assert [(r.doc_id, r.text) for r in left] == [(77_777, good.text)]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, none.select(big.columns), sf).count() == 0
    assert corpus_pipeline.pack(spark, none.select(big.columns), sf).count() == 0


def test_clashing_columns_stay(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("rejected", F.lit("x")).withColumn("component", F.col("doc_id")).withColumn("class", F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf)
        assert kept.columns == docs.columns and kept.filter("rejected <> 'x' or component <> doc_id").count() == 0 and kept.count() > 0


def test_language_stage_learns_from_every_document(spark, sf):
    from motifmill.llm.common import crc_split

    # the only documents of one language are those that op3 holds out
    docs = spark.createDataFrame([(i, "ñandú über çedilla " * 20, "aa") for i in range(200)], "doc_id long, text string, lang string").filter(crc_split() == 1)
    others = spark.createDataFrame([(i, "plain words that another language has " * 20, "bb") for i in range(1000, 1200)], docs.schema)
    both = docs.unionByName(others).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text"))
    kept = corpus_pipeline.language(spark, both, sf)
    assert docs.count() > 0 and kept.filter("lang = 'aa'").count() == docs.count()


def test_language_stage_calibrates_on_every_document(spark, sf):
    """300 rows of varied words, behind 700 plain ones by hash of id, are as much of their language as those."""
    import random

    ids = [r.i for r in spark.range(1000).select(F.col("id").alias("i")).orderBy(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 40))).collect()]
    draw = random.Random(3)
    varied = lambda: " ".join("".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(30))
    docs = spark.createDataFrame([(i, "aaaa aaaa aaaa" if k < 700 else varied(), "xx", "s", 1) for k, i in enumerate(ids)], "doc_id long, text string, lang string, source string, n_chars int")
    assert corpus_pipeline.language(spark, docs, sf).count() == 1000


def test_quality_stage_learns_from_every_label(spark, tmp_path):
    """300 bad rows, the last of 3,300 by hash of id, show what they are by a word that no other row has."""
    ids = [r.i for r in spark.range(6600).select(F.col("id").alias("i")).orderBy(F.xxhash64(F.col("id").cast("string"))).collect()]
    good, bad = ids[::2], ids[1::2]
    text = {i: "plain words of a text that says much." for i in good} | {i: f"plain words of a text that says {'junk' if k < 3000 else 'marker'}." for k, i in enumerate(bad)}
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in text.items()], "doc_id long, text string, lang string, source string, n_chars int")
    spark.createDataFrame([(i, int(i in set(good)), None) for i in ids], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r.doc_id for r in corpus_pipeline.quality_stage(spark, docs, str(tmp_path)).collect()}
    assert kept == set(good)

import math

import numpy as np

from motifmill.llm import language_id, quality
from motifmill.llm.common import crc_split
from motifmill.llm.queries import op3_language_id, op6_quality


def test_kneser_ney_sums_to_one():
    grams = {"xx": {}, "yy": {}}
    for lang, words in (("xx", {"aab": 3, "abc": 2, "b": 1}), ("yy", {"ccb": 2, "ba": 4})):
        for word, n in words.items():
            padded = language_id.START * 2 + word + language_id.END
            for i in range(len(padded) - 2):
                grams[lang][padded[i : i + 3]] = grams[lang].get(padded[i : i + 3], 0) + n
    model = language_id.fit(grams, order=3)
    # word probabilities over all words up to a length, by brute force, stay below one and sum near it
    words, total = [""], np.zeros(2)
    for _ in range(7):
        words = [w + c for w in words for c in "abc"]
        total += np.exp(model.log_probs(words)).sum(0)
    alphabet_share = 1 - np.exp(model.log_probs(["q"]))
    assert (total < 1).all() and (total > 0.5).all() and (alphabet_share > 0.5).all()
    # one step by hand: the highest order interpolates with the continuation counts
    p = {c: math.exp(model.log_probs([c])[0, 0]) for c in ("aab", "abc")}
    assert p["aab"] > p["abc"]


def test_op3_learns_and_holds_out(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").withColumn("part", crc_split()).collect()}
    rows = op3_language_id(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (docs[r.doc_id].part == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.98 * len(held)
    assert sum(r.rejected for r in rows) <= 0.01 * len(rows)


def test_op3_odd_rows(spark, sf, odd, none):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.train(language_id.training_rows(docs))
    rows = {r.doc_id: r for r in language_id.identify(odd, model).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 and rows[i].rejected for i in (0, 1, 2, 8))
    assert rows[5].lang_pred in model.languages
    assert language_id.identify(none, model).count() == 0
    untrained = language_id.train(none)
    assert {r.lang_pred for r in language_id.identify(odd, untrained).collect()} == {"und"}
    assert language_id.train(odd).languages == ["en"]


def test_op3_keeps_every_gram(spark):
    # 160,000 words of letters of their own each give a 5-gram that no other has, and one more of count 2
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [letters[i // 17576 % 26] + letters[i // 676 % 26] + letters[i // 26 % 26] + letters[i % 26] for i in range(160_000)]
    rows = [(i, " ".join(words[i : i + 1000]), "xx") for i in range(0, len(words), 1000)] + [(-1, "öö ab ab", "yy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = {"xx": {}, "yy": {}}
    for _, text, lang in rows:
        for word in text.split():
            padded = language_id.START * 4 + word + language_id.END
            for i in range(len(padded) - 4):
                counts[lang][padded[i : i + 5]] = counts[lang].get(padded[i : i + 5], 0) + 1
    assert len(counts["xx"]) > 150_000
    whole = language_id.fit(counts)
    tried = [*words[::997], "zzzz", "öö", "ab", "q", "éa"]
    assert (language_id.train(docs).log_probs(tried) == whole.log_probs(tried)).all()
    counted = language_id.gather(docs)
    assert counted.count() == sum(map(len, counts.values()))
    for entries in (1 << 20, 30_000):  # one shard, and many
        stored = language_id.fit_stored(counted, entries=entries)
        assert stored.languages == whole.languages and (stored.base == whole.base).all()
        assert (stored.log_probs(tried) == whole.log_probs(tried)).all()
    assert len(stored.shards) > 10


def test_op3_rejects_gibberish(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.train(language_id.training_rows(docs))
    odd = spark.createDataFrame([(1, "xqzj wvkq qqxz jjkw zzqx " * 20), (2, "The and of the with that")], "doc_id long, text string")
    assert {r.doc_id: r.rejected for r in language_id.identify(odd, model).collect()} == {1: True, 2: False}


def test_op6_separates_held_labels(spark):
    big = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    from pyspark.sql import functions as F

    part = labels.withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0)
    found = {r.doc_id: r for r in quality.classify(docs, part.filter("not held").drop("held")).collect()}
    held = [(r.quality == 1 and r.toxic == 0, found[r.doc_id].rejected) for r in part.filter("held").collect()]
    assert sum(rejected for good, rejected in held if good) <= 0.05 * sum(good for good, _ in held)
    assert sum(rejected for good, rejected in held if not good) >= 0.6 * sum(not good for good, _ in held)


def test_op6_finds_toxic_and_low_rows(spark):
    """Each recall by itself, on labelled rows that were held out."""
    from pyspark.sql import functions as F

    big = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    part = labels.withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0)
    rows = quality.classify(docs.join(part.select("doc_id"), "doc_id"), part.filter("not held").drop("held")).join(part.filter("held"), "doc_id").collect()
    share = lambda some: sum(r.rejected for r in some) / len(some)
    found = [share([r for r in rows if r.toxic == 1]), share([r for r in rows if r.quality == 0]), share([r for r in rows if r.quality == 1 and r.toxic == 0])]
    print("held out: toxic, low quality, clean rejected", found, len(rows))
    assert found[0] >= 0.94 and found[1] >= 0.97 and found[2] <= 0.015


def test_op6_whole_table(spark, sf):
    rows = op6_quality(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.score <= 1 for r in rows)


def test_sites_shrink(spark):
    # a host of many good rows, one of many bad ones, and a sparse one
    rows = [(i, "good", "p", 0.9) for i in range(300)] + [(1000 + i, "bad", "p", 0.1) for i in range(300)] + [(5000, "rare", "p", 0.5)]
    rows += [(6000 + i, None if i % 2 else "", None if i % 3 else "", 0.2 + i / 50) for i in range(30)]
    schema = "doc_id long, host string, path string, __doc_score double"
    scored = spark.createDataFrame(rows, schema).selectExpr("doc_id", "coalesce('=' || host, '') as __host", "coalesce('=' || path, '') as __path", "__doc_score", "cast(null as double) as __toxic_score")
    got = {r.doc_id: r for r in quality.judge(scored).collect()}
    rate = lambda i: got[i]["__path_rate"]
    assert rate(0) > 0.85 and rate(1000) < 0.15 and abs(rate(5000) - 0.5) < 0.1
    assert got[0]["__final"] > 0.9 and got[1000]["__final"] < 0.1
    want = posteriors(rows)
    assert len(got) == len(rows) and all(abs(rate(r[0]) - want[i]) < 1e-9 for i, r in enumerate(rows))


def posteriors(rows):
    """Path posteriors by loops over all pairs of rows and sites, null apart from empty."""
    total = sum(r[3] for r in rows)
    rate = (total + 0.5) / (len(rows) + 1)

    def weight(groups):  # method of moments; groups: n, s, prior
        n = sum(g[0] for g in groups)
        within = max(sum(k * p * (1 - p) for k, _, p in groups) / n, 1e-6)
        between = sum(k * (s / k - p) ** 2 for k, s, p in groups)
        spare = (between - within * (len(groups) - 1)) / max(n - sum(k * k for k, _, _ in groups) / n, 1e-9)
        return min(max(within / max(spare, 1e-9) - 1, 1.0), 1e6)

    hosts = {r[1]: [x[3] for x in rows if x[1] == r[1]] for r in rows}
    sites = {r[1:3]: [x[3] for x in rows if x[1:3] == r[1:3]] for r in rows}
    w = weight([(len(v), sum(v), rate) for v in hosts.values()])
    v = weight([(len(x), sum(x), (sum(hosts[h]) + w * rate) / (len(hosts[h]) + w)) for (h, _), x in sites.items()])
    out = []
    for _, host, path, own in rows:
        prior = (sum(hosts[host]) - own + w * rate) / (len(hosts[host]) - 1 + w)
        out.append((sum(sites[host, path]) - own + v * prior) / (len(sites[host, path]) - 1 + v))
    return out


def test_op6_null_sites_are_their_own(spark, sf):
    docs = spark.createDataFrame([(i, "plain words of a text. " * 5, ["", None][i % 2], "") for i in range(40)], "doc_id long, text string, source string, lang string")
    sites = quality.score(docs, None).select("__host", "__path").distinct().collect()
    assert len(sites) == 2


def kneser_ney(words, order, letters):
    """Interpolated Kneser-Ney of one language by recursion over all n-grams that were seen."""
    from collections import Counter

    levels = {order: Counter(g for w, n in words.items() for p in [language_id.START * (order - 1) + w + language_id.END] for i in range(len(p) - order + 1) for g in [p[i : i + order]] * n)}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])

    def p(context, c, k):
        if k == 0:
            return 1 / (letters + 1)
        grams = levels[k]
        ones, twos = (sum(n == x for n in grams.values()) for x in (1, 2))
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        mine = {g: n for g, n in grams.items() if g[:-1] == context}
        lower = p(context[1:], c, k - 1)
        if not mine:
            return lower
        return (max(mine.get(context + c, 0) - d, 0) + d * len(mine) * lower) / sum(mine.values())

    def score(word):
        text = language_id.START * (order - 1) + word + language_id.END
        return sum(math.log(p(text[i - order + 1 : i], text[i], order)) for i in range(order - 1, len(text)))

    return score


def test_op3_matches_recursion(spark):
    """Probabilities, choice, score and calibration against a brute-force model."""
    texts = {"xx": ["aab abc aab", "b abc", "caab bb abc"], "yy": ["ccb ba", "ba ba cb", "dcb ccb"]}
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang, ts in texts.items() for t in ts)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    brute = {}
    for lang, ts in texts.items():
        words = {w: sum(t.split().count(w) for t in ts) for t in ts for w in t.split()}
        brute[lang] = kneser_ney(words, 5, len({c for w in words for c in w + language_id.END}))
    tried = ["aab", "ccb", "q", "abcba", "b"]
    assert np.allclose(model.log_probs(tried), [[brute[x](w) for x in ("xx", "yy")] for w in tried], atol=1e-9)
    for i, (lang, ts) in enumerate(texts.items()):
        sums = np.array([[-sum(brute[lang](w) for w in t.split()), sum(len(w) + 1 for w in t.split())] for t in ts])
        mean = sums[:, 0].sum() / sums[:, 1].sum()
        assert abs(model.centre[i] - mean) < 1e-9
        assert abs(model.spread[i] - math.sqrt((((sums[:, 0] / sums[:, 1]) - mean) ** 2 * sums[:, 1]).mean())) < 1e-6
    asked = spark.createDataFrame([(1, "abc ba"), (2, "dcb cc")], "doc_id long, text string")
    for r in language_id.identify(asked, model).collect():
        words = {1: ["abc", "ba"], 2: ["dcb", "cc"]}[r.doc_id]
        entropy = {x: -sum(brute[x](w) for w in words) / sum(len(w) + 1 for w in words) for x in brute}
        best = min(entropy, key=entropy.get)
        assert r.lang_pred == best and abs(r.cross_entropy - entropy[best]) < 1e-9
        assert abs(r.score - 1 / sum(math.exp((entropy[best] - e) * language_id.SHARPNESS) for e in entropy.values())) < 1e-9


def test_op3_calibrates_on_all_rows(spark):
    """Centre and spread against sums over every training row of a language with 1,500 of them; one pass judges as two do."""
    rows = [(i, ("plain words of many rows " * (i % 7 + 1) + "rare ending")[: 20 + i % 90] if i % 50 else "zqxj kvw", "xx") for i in range(1500)]
    rows += [(2000 + i, "andere w\u00f6rter stehen hier", "yy") for i in range(5)] + [(3000, "qqj xzv kkw jjq " * 9, None), (3001, "", "xx"), (3002, None, "yy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    for i, lang in enumerate(model.languages):
        sums = language_id.Scorer(model).sums([t for _, t, x in rows if x == lang and t])
        s, n = -sums[:, i], sums[:, -1]
        mean = s.sum() / n.sum()
        assert abs(model.centre[i] - mean) < 1e-9 and abs(model.spread[i] - math.sqrt(((s / n - mean) ** 2 * n).mean())) < 1e-6
    once = {r.doc_id: r for r in language_id.identify(docs).collect()}
    for r in language_id.identify(docs, model).collect():
        assert r == once[r.doc_id]
    assert once[3000].rejected and not once[1].rejected
    held = language_id.training_rows(docs)
    two = {r.doc_id: r for r in language_id.identify(docs, language_id.train(held)).collect()}
    assert {r.doc_id: r for r in language_id.identify(docs, training=language_id.in_training()).collect()} == two


def test_op3_numbers_are_no_letters(spark, sf):
    model = language_id.train(language_id.training_rows(spark.read.parquet(f"{sf}/documents.parquet")))
    odd = spark.createDataFrame([(i, t) for i, t in enumerate(["½ ²", "Ⅷ ①", "\u0301 12_3", "ª", "é"])], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred == "und", r.score) for r in language_id.identify(odd, model).collect()}
    assert all(got[i] == (True, 0.0) for i in (0, 1, 2)) and not got[3][0] and not got[4][0]


def test_op6_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, None), (9, 1, 1), (None, 1, 0), (10, None, 0)], "doc_id long, quality int, toxic int")
    assert quality.classify(odd, labels).count() == odd.count()
    assert {(r.score, r.rejected) for r in quality.classify(odd, labels.limit(0)).select("doc_score", "rejected").withColumnRenamed("doc_score", "score").collect()} == {(0.5, False)}
    assert quality.classify(none, labels).count() == 0


def brute_fit(rows, good):
    """Words and weights of a penalised logistic regression on all rows in memory; rows: texts."""
    words = [{quality.normal(t) for t in text.split()} for text in rows]
    n, telling = [int((~good).sum()), int(good.sum())], {}
    for word in set().union(*words) - {""}:
        have = [sum(word in w for w, g in zip(words, good, strict=True) if g == side) for side in (False, True)]
        both = sum(have) / len(rows)
        cells = [(have[i], both * n[i]) for i in (0, 1)] + [(n[i] - have[i], (1 - both) * n[i]) for i in (0, 1)]
        telling[word] = 2 * sum(a * math.log(a / b) for a, b in cells if a), sum(have)
    strong = [w for w, _ in sorted(((w, t) for w, (t, k) in telling.items() if k >= quality.MIN_ROWS and t >= 12), key=lambda x: (-x[1], x[0]))][: quality.WORDS]
    shapes = np.array([quality.shape(t, t.split()) for t in rows])
    centre, scale = shapes.mean(0), np.maximum(shapes.std(0), 1e-3)
    x = np.column_stack([(shapes - centre) / scale, np.array([[w in mine for w in strong] for mine in words], float).reshape(len(rows), -1), np.ones(len(rows))])
    weight, beta, keep = np.where(good, len(rows) / 2 / n[1], len(rows) / 2 / n[0]), np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, 2.0), 0.0)
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ beta))
        step = np.linalg.solve((x.T * (weight * np.maximum(p * (1 - p), 1e-6))) @ x + np.diag(keep + 1e-9), x.T @ (weight * (good - p)) - keep * beta)
        beta += step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
    return strong, centre, scale, beta


def brute_score(model, text):
    strong, centre, scale, beta = model
    x = [*((np.array(quality.shape(text, text.split())) - centre) / scale), *(w in {quality.normal(t) for t in text.split()} for w in strong), 1.0]
    return 1 / (1 + math.exp(-float(np.dot(x, beta))))


def test_op6_fits_on_all_labelled_rows(spark):
    """Scores and the cutoff of toxicity against regressions in memory on 8,000 labelled rows, over 3,000 of either class."""
    from pyspark.sql import functions as F

    draw = np.random.default_rng(5)
    rows = []
    for i in range(8000):
        clean, toxic = i % 2 == 0, i % 8 == 1
        words = [f"w{k}" for k in draw.integers(0, 40, 12)] + [f"{'good' if clean ^ (draw.random() < 0.2) else 'bad'}{k}" for k in draw.integers(0, 8, 2)]
        words += [f"insult{k}" for k in draw.integers(0, 4, 1)] if toxic ^ (draw.random() < 0.004 + 0.1 * toxic) else []
        rows.append((i, " ".join(words) + ("." if clean else ""), clean, None if i % 10 == 9 else int(toxic)))
    docs = spark.createDataFrame([(i, t, "s", "en") for i, t, _, _ in rows] + [(9000, "not labelled good1", "s", "en"), (None, "w1", "s", "en"), (0, "zz later text", "s", "en")], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(c or t == 1), t) for i, _, c, t in rows] + [(70_000, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    folds = {r.doc_id: r.fold for r in docs.select("doc_id", F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(quality.FOLDS)).alias("fold")).collect()}
    whole = brute_fit([t for _, t, _, _ in rows], np.array([c for _, _, c, _ in rows]))
    told = [r for r in rows if r[3] is not None]
    other = brute_fit([t for _, t, _, _ in told], np.array([x == 1 for _, _, _, x in told]))
    assert set(model.words) == set(whole[0]) | set(other[0])
    tried = [t for _, t, _, _ in rows[::97]]
    got = model.score(tried, model.memo())
    assert np.abs(got - [[brute_score(whole, t), brute_score(other, t)] for t in tried]).max() < 1e-6
    scores = []
    for k in range(quality.FOLDS):
        seen = [r for r in told if folds[r[0]] != k]
        held = brute_fit([t for _, t, _, _ in seen], np.array([x == 1 for _, _, _, x in seen]))
        scores += [brute_score(held, t) for i, t, c, _ in told if folds[i] == k and c]
    scores.sort()
    assert abs(model.cutoff - min(max(scores[len(scores) - 1 - int(quality.CLEAN_LOSS * len(scores))], quality.TOXIC[0]), quality.TOXIC[1])) < 1e-6
    values = spark.createDataFrame([(float(x),) for x in [*scores, *scores[:50], 0.5, 0.5]], "v double")
    ordered = sorted([*scores, *scores[:50], 0.5, 0.5], reverse=True)
    assert [quality.largest(values, k) for k in (0, 1, 500, len(ordered) - 1, len(ordered))] == [*(ordered[k] for k in (0, 1, 500, len(ordered) - 1)), None]


def test_op3_model_is_stored_in_few_jobs(spark):
    """Every exchange is a job, and takes memory of the driver: their number does not follow the orders and their contexts."""
    docs = spark.createDataFrame([("some plain words of a text", "aa"), ("other words there are", "bb")], "text string, lang string")
    counted = language_id.gather(docs)
    spark.sparkContext.setJobGroup("fit", "fit")
    try:
        language_id.fit_stored(counted)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("fit")) <= 20


def test_driver_memory_is_released_as_the_heap_grows(spark):
    from motifmill.sources import storage

    application = spark.sparkContext.applicationId
    storage._HEAP[application] = 0 - spark.sparkContext._jvm.java.lang.Runtime.getRuntime().maxMemory()
    assert storage.released(spark) and storage._HEAP[application] > 0
    assert not storage.released(spark)
    storage._HEAP[application] = 0 - spark.sparkContext._jvm.java.lang.Runtime.getRuntime().maxMemory()
    storage.written(spark.range(3), "small")
    assert storage._HEAP[application] > 0

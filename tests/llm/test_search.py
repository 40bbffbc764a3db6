import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from motifmill.llm import decontaminate, near_dedup, url_filter, vp_tree
from motifmill.llm.queries import ORACLE_SQL, QUERIES, op2_decontamination, op4_vp_tree, op9_bloom_cascade, op10_circulant_minhash


EDGE = ".,;:!?\"'()[]{}|*#$%&"


def plain(text):
    """Words by a loop over characters: lower case, cut at space, without punctuation at their ends."""
    out, word = [], ""
    for c in (text or "").lower() + " ":
        if c.isspace():
            while word and word[0] in EDGE:
                word = word[1:]
            while word and word[-1] in EDGE:
                word = word[:-1]
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out


def subsequence(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def halves(text):
    parts = [w for w in map(plain, re.split(r"(?<=[.!?])\s+", text)) if w]
    if len(parts) > 1:
        return sum(parts[:-1], []), parts[-1]
    words = sum(parts, [])
    return words[: len(words) * 2 // 3], words[len(words) * 2 // 3 :]


def leaks(docs, items, overlap=0.8):
    """All pairs by brute force: shingles, or words in order, of whole documents."""
    out = set()
    for doc_id, text in docs:
        words = plain(text)
        for item, item_text in items:
            share = []
            for part in halves(item_text or ""):
                runs = {tuple(part[i : i + 5]) for i in range(max(1, len(part) - 4))} if part else set()
                size = min(5, len(part))
                have = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
                share.append(len(runs & have) / len(runs) if runs else 1.0)
                if share[-1] < overlap and runs and len(set(part) & set(words)) >= overlap * len(set(part)):
                    share[-1] = max(subsequence(part, words[i : i + 128]) for i in range(0, max(1, len(words)), 16)) / len(part)
                if share[-1] < overlap:
                    break
            if item_text and plain(item_text) and min(share) >= overlap:
                out.add((doc_id, item))
    return out


def test_op2_finds_all_leaks(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in op2_decontamination(spark, sf).collect()}
    assert got and got == leaks(docs, items)


def test_op2_odd_rows(spark, odd, none):
    long = " ".join(f"w{i}" for i in range(500))
    items = spark.createDataFrame([(1, None), (2, ""), (3, "One two three four five six. Seven eight nine."), (3, "One two three four five six. Seven eight nine."), (4, long)], "item_id long, text string")
    assert decontaminate.contaminated(odd, items).count() == 0
    assert decontaminate.contaminated(none, items).count() == 0
    assert decontaminate.contaminated(odd, items.limit(0)).count() == 0
    held = spark.createDataFrame([(7, "junk " * 100 + "one TWO three four five six. seven eight nine " + "more " * 100), (8, f"x y {long} z"), (9, "one two three four five six and other words")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(held, items).collect()} == {(7, 3), (8, 4)}


def test_op2_tails_of_long_items_match_nothing(spark):
    sizes = [*range(65, 70), 128, 129, 133, 200]
    texts = {n: [f"i{n}w{i}" for i in range(n)] for n in sizes}
    items = spark.createDataFrame([(n, " ".join(w)) for n, w in texts.items()], "item_id long, text string")
    rows = [(n, "clean words " * 20 + " ".join(w[n // 64 * 64 :] or w[-5:]) + " and more") for n, w in texts.items()]
    rows += [(1000 + n, f"x y {' '.join(w)} z") for n, w in texts.items()]
    held = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(held, items).collect()} == {(1000 + n, n) for n in sizes}
    for n, words in texts.items():
        index = decontaminate.build([(n, " ".join(words))])
        assert {len(index.weights(s)) for s in range(len(index.items))} == {64}


def test_op2_free_standing_punctuation_hides_nothing(spark):
    words = [f"q{i}" for i in range(60)]
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    rows = [(at + 1000 * k, "pad " * at + mark.join(words) + " more" * 40) for k, mark in enumerate((" | ", ' * " ', "\n#\n")) for at in range(0, 70, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in decontaminate.contaminated(docs, items).collect()} == {r[0] for r in rows}
    assert decontaminate.flagged(docs, items).filter("__contaminated").count() == len(rows)
    marked = spark.createDataFrame([(1, " | ".join(words))], "item_id long, text string")
    assert decontaminate.contaminated(docs, marked).count() == len(rows)


def test_op2_finds_edited_copies(spark):
    words = [f"q{i}" for i in range(20)]
    text = " ".join(words[:13]) + ". " + " ".join(words[13:])
    edited = [(i, "some other words " * 9 + " ".join([*words[:i], "other", *words[i + 1 :]]) + " and more " * 9) for i in range(20)]
    docs = spark.createDataFrame([*edited, (90, " ".join(words[:13])), (91, " ".join(words[13:])), (92, " ".join(reversed(words)))], "doc_id long, text string")
    items = spark.createDataFrame([(1, text)], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.contaminated(docs, items).collect()} == set(range(20))


def test_op2_scores_do_not_depend_on_passes(spark, sf, monkeypatch):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    # a low threshold, so that scores other than whole matches count
    one = {tuple(r) for r in decontaminate.contaminated(docs, items, 0.2, 0.0).collect()}
    monkeypatch.setattr(decontaminate, "MAX_WORDS", 500)
    many = {tuple(r) for r in decontaminate.contaminated(docs, items, 0.2, 0.0).collect()}
    near = lambda rows: sorted((d, i, round(s, 9), round(q, 9), round(a, 9)) for d, i, s, q, a in rows)
    assert one and near(one) == near(many)


def test_retrieval_matches_full_scores():
    rng = np.random.default_rng(4)
    items = [(i, " ".join(f"t{w}" for w in rng.zipf(1.4, 30) % 60)) for i in range(40)]
    index = decontaminate.build(items)
    ids, sizes, groups = [], [], []
    for g in range(30):
        for _ in range(3):
            part = np.unique(rng.zipf(1.4, 25) % len(index.terms))
            ids += part.tolist()
            sizes.append(len(part))
            groups.append(g)
    got = {(a, b) for a, b, _ in decontaminate.retrieve(index, np.array(ids), np.array(sizes), np.array(groups), 0.4)}
    ends, want = np.cumsum(sizes), set()
    for i in range(len(sizes)):
        stop = ends[i + 1] if i + 1 < len(sizes) and groups[i] == groups[i + 1] else ends[i]
        terms = set(ids[ends[i] - sizes[i] : stop])
        want |= {(i, s) for s in range(len(index.items)) if sum(index.weights(s).get(t, 0) for t in terms) >= 0.4}
    assert want and got == want


def test_op4_recall(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = defaultdict(list)
    for r in op4_vp_tree(spark, sf).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score, r.rank))
    right = 0
    for q in np.flatnonzero(ids % 50 == 0):
        score = vp_tree.cosines(np.broadcast_to(x[q], x.shape), x)
        best = [i for i in np.lexsort((ids, -score)) if ids[i] != ids[q]][:5]
        mine = got[ids[q]]
        assert [m[2] for m in mine] == [1, 2, 3, 4, 5]
        assert all(abs(m[1] - score[ids == m[0]][0]) < 1e-12 for m in mine)
        right += len({m[0] for m in mine} & set(ids[best]))
    assert right >= 0.9 * 5 * len(got) and len(got) == (ids % 50 == 0).sum()


def test_tree_with_factor_one_is_exact():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 16)) + rng.integers(0, 5, 3000)[:, None]
    x /= np.linalg.norm(x, axis=1)[:, None]
    found = vp_tree.Tree(x).search(x[:200], 5, 1.0)
    truth = np.sort(-(x[:200] @ x.T), 1)[:, :5]
    assert np.allclose(-(x[:200, None] * x[found]).sum(2), truth)


def test_op4_recall_of_deep_trees(spark, monkeypatch):
    """24,000 vectors in trees of several levels, searched in several turns, at the factor of production; and exact at factor 1."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(300, 32))
    x = (centres[rng.integers(0, 300, 24_000)] + 0.5 * rng.normal(size=(24_000, 32))).astype(np.float64)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(8)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    asked = np.arange(0, 24_000, 200)
    truth = {}
    for q in asked:
        score = unit @ unit[q]
        score[q] = -2
        truth[q] = set(np.lexsort((np.arange(24_000), -score))[:5].tolist())
    monkeypatch.setattr(vp_tree, "SHARDS", 4)
    monkeypatch.setattr(vp_tree, "BLOCK_QUERIES", 16)
    monkeypatch.setattr(vp_tree, "TASK_BLOCKS", 4)
    for factor, least in ((0.3, 0.9), (1.0, 1.0)):
        got = defaultdict(set)
        for r in vp_tree.nearest(df, every=200, factor=factor).collect():
            got[r.query_id].add(r.vec_id)
        assert sum(len(got[q] & truth[q]) for q in asked) >= least * 5 * len(asked)


def test_op4_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (7, [1.0, 0.0]), (3, [1.0, 0.0]), (9, [0.0, 1.0]), (100, None), (150, [0.0, 0.0]), (200, [float("nan"), 1.0]), (250, [None, 1.0]), (300, [float("inf"), 1.0]), (350, [1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id) for r in vp_tree.nearest(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 3), (0, 2, 7), (0, 3, 50), (0, 4, 9), (50, 1, 0), (50, 2, 3), (50, 3, 7), (50, 4, 9)]
    assert vp_tree.nearest(df.limit(0)).count() == 0
    # components beyond the range of their squares, and columns of clashing names
    far = [(0, [1e200, 1e200], 1, 2.0), (50, [1e-200, 0.0], 1, 2.0), (1, [3.0, 3.0], 1, 2.0), (2, [0.0, 1e-300], 1, 2.0), (3, [5e-324, 5e-324], 1, 2.0), (4, [-1e308, 0.0], 1, 2.0)]
    df = spark.createDataFrame(far, "vec_id long, embedding array<double>, rank int, score double")
    got = [(r.query_id, r.vec_id, round(r.score, 12)) for r in vp_tree.nearest(df).orderBy("query_id", "rank").collect()]
    half = round(0.5**0.5, 12)
    assert got == [(0, 1, 1.0), (0, 3, 1.0), (0, 2, half), (0, 50, half), (0, 4, -half), (50, 0, half), (50, 1, half), (50, 3, half), (50, 2, 0.0), (50, 4, -1.0)]
    many = spark.createDataFrame([(i, [0.5, 0.25]) for i in range(300)], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in vp_tree.nearest(many).filter("query_id = 50").orderBy("rank").collect()] == [0, 1, 2, 3, 4]


def judge(url):
    host = path = ""
    if url is not None and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    under = lambda h: host == h or host.endswith("." + h)
    fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if under(h) and path.startswith(p)]
    listed = any(under(h) for h in url_filter.LISTED)
    return (host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "block" if listed else "allow")


def test_op9_judges_every_url(spark, sf):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op9_bloom_cascade(spark, sf).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows} == {i: judge(u) for i, u in urls.items()}


def test_op9_odd_urls(spark):
    urls = [None, "", "x", "://", "http://", "http://A.Spam-Farm.example.org/x", "http://net", "http://net/", "http://a.net?x", "http://x.ORG/fr/\nq#z", "ftp://example.net/en/?y", "http://É.org/fr/", "http://xadult-x.example.com/", "http://u:p@adult-x.example.com/de/"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, key string")
    listed = spark.createDataFrame([(x,) for x in (*url_filter.LISTED, "not.there", None, "")], "key string")
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, listed).collect()} == {i: judge(u) for i, u in enumerate(urls)}
    assert url_filter.judge(pages.limit(0), listed).count() == 0
    assert {r.listed for r in url_filter.judge(pages, listed.limit(0)).collect()} == {False}


def test_cascade_is_exact(spark):
    universe = spark.range(4000).selectExpr("concat('k', id) as key", "id % 7 = 0 as listed")
    cascade = url_filter.Cascade(universe)
    assert len(cascade.levels) > 1
    assert universe.filter(cascade.lists(universe["key"]) != universe["listed"]).count() == 0


def test_split_cascades_are_exact(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_BITS", 512)
    universe = spark.range(3000).selectExpr("concat('k', id) as key", "id % 3 = 0 as listed")
    cascade = url_filter.Cascade(universe)
    assert cascade.levels[0].parts > 8 and len(cascade.levels) > 1
    assert universe.filter(cascade.lists(universe["key"]) != universe["listed"]).count() == 0


def classes(docs, size):
    sets = {}
    for doc_id, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc_id] = frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_shingle = defaultdict(list)
    for d in sorted(sets):
        common = Counter(e for s in sets[d] for e in by_shingle[s])
        for e, n in common.items():
            if 100 * n >= 80 * (len(sets[d]) + len(sets[e]) - n):
                a, b = sorted((find(d), find(e)))
                parent[b] = a
        for s in sets[d]:
            by_shingle[s].append(d)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def check_classes(rows, docs, size):
    want = classes(docs, size)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_op10_matches_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check_classes(op10_circulant_minhash(spark, sf).collect(), docs, 2)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_match_their_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in df.collect())


def test_op10_chains_and_hot_groups(spark):
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(150):  # a drifting chain: neighbours are alike, the ends are not
        base[int(rng.integers(0, 60))] = f"n{i}"
        docs.append((1000 - i, " ".join(base)))
    docs += [(5000 + i, "all the same words in every copy") for i in range(200)]
    shared = " ".join(f"p{i}" for i in range(30))
    docs += [(7000 + i, shared + " " + " ".join(f"o{i}x{j}" for j in range(int(rng.integers(3, 30))))) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    check_classes(near_dedup.near_duplicates(df, 2).collect(), docs, 2)
    check_classes(near_dedup.near_duplicates(df, 5).collect(), docs, 5)


def test_op10_ids_with_several_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    docs = spark.createDataFrame([(5, a), (5, b), (8, a + " x"), (9, b + " y"), (None, c), (12, c + " z"), (None, None), (None, "one of no id"), (None, "one of no id"), (3, "")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, 2).collect())
    assert [g for g in got if g[0] > 0] == [(3, 0, 3, True), (5, 39, 5, True), (5, 39, 5, True), (8, 40, 5, False), (9, 40, 5, False), (12, 40, 12, True)]
    assert [g[1:] for g in got if g[0] < 0] == [(0, None, True), (3, None, True), (3, None, True), (39, 12, False)]
    kept = [(r.doc_id, r.text) for r in near_dedup.deduplicated(docs, 2).collect()]
    assert len(kept) == 5 and {d for d, _ in kept} == {5, 12, None, 3} and (None, None) in kept and (None, "one of no id") in kept


def test_op10_hot_buckets_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(50)]
    docs = []
    for i in range(300):  # a hot group of near copies, and others
        words = list(base) if i % 2 else [f"v{i}x{j}" for j in range(50)]
        words[int(rng.integers(0, 50))] = f"n{i}"
        docs.append((i, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for sampled, hot in ((16_384, 16), (64, 2), (16_384, 10**9)):
        monkeypatch.setattr(near_dedup, "SAMPLED", sampled)
        monkeypatch.setattr(near_dedup, "HOT", hot)
        check_classes(near_dedup.near_duplicates(df, 2).collect(), docs, 2)


def test_op10_counts_buckets_of_every_class(spark, monkeypatch):
    """A hot bucket of classes that one of four by hash would miss."""
    monkeypatch.setattr(near_dedup, "SAMPLED", 64)
    monkeypatch.setattr(near_dedup, "HOT", 4)
    held, write = {}, near_dedup.written
    monkeypatch.setattr(near_dedup, "written", lambda df, what: held.setdefault(what, write(df, what)))
    drawn = F.pmod(F.xxhash64("class", F.lit(1)), F.lit(4)) == 0
    ids = spark.range(1000).select(F.col("id").alias("class"), F.lit(9).alias("n_shingles"))
    hot = ids.filter(~drawn).limit(100).withColumn("bands", F.array(F.lit(-7).cast("long"), F.col("class")))
    own = write(hot.unionByName(ids.join(hot, "class", "left_anti").limit(156).withColumn("bands", F.array("class"))), "own")
    rows = near_dedup.buckets(own, 256).collect()
    assert [r.key for r in held["hot"].collect()] == [-7]
    low = min(r["class"] for r in hot.collect())
    assert len(rows) == 99 and {(r.key, r.first) for r in rows} == {(-7, low)}


def test_op10_odd_rows(spark, odd, none):
    rows = near_dedup.near_duplicates(odd, 2).collect()
    assert len(rows) == odd.count()
    check_classes(rows, [(r.doc_id, r.text) for r in odd.collect()], 2)
    assert near_dedup.near_duplicates(none, 2).count() == 0


def test_op10_linked_pairs_meet_in_prefixes(spark):
    """Every linked pair has a shingle where its smaller set leads and enough is left of both."""
    rng = np.random.default_rng(12)
    passage, sets = rng.integers(1, 1 << 60, 40), {}
    for i in range(160):  # one common passage, families within it, and own shingles
        family = np.random.default_rng(i % 8).integers(1, 1 << 60, 30)
        own = rng.integers(1, 1 << 60, int(rng.integers(0, 8)))
        sets[i] = np.unique(np.concatenate([passage[: int(rng.integers(20, 41))], family[: int(rng.integers(15, 31))], own])).astype(np.uint64)
    full = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in sets.items()], "class long, shingles binary")
    places = defaultdict(dict)
    for r in near_dedup.prefix_rows(full, full.select("class"), 80).collect():
        places[r["class"]][r.key] = (r.place, r.leads)
    links = met = 0
    for a in sets:
        for b in sets:
            na, nb = len(sets[a]), len(sets[b])
            common = len(set(sets[a].tolist()) & set(sets[b].tolist()))
            if (na, a) < (nb, b) and 100 * common >= 80 * (na + nb - common):
                links += 1
                met += any(places[a][k][1] and 180 * min(na - places[a][k][0], nb - places[b][k][0]) >= 80 * (na + nb) for k in places[a].keys() & places[b].keys())
    assert links > 100 and met == links

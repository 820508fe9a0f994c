"""Operators over whole corpora against brute force, and their defined results on odd input."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlode.llm import decontam, jaccard_join, katz, mixing, oracles, warc
from siftlode.llm.components import connected_components


def words(text):
    return (text or "").encode().lower().split()


# --- connected components ---


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(50)] + [(500, 500), (-5, 7)]
    edges += [(1000, 1000 + i) for i in range(1, 30)] + edges[:5]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- n-gram Jaccard join ---


def shingles(text, size):
    w = words(text)
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute_components(rows, size, num):
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= num * len(a | b):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    out = [None] * len(rows)
    for g in groups.values():
        ids = [rows[i][0] for i in g if rows[i][0] is not None]
        for i in g:
            out[i] = min(ids, default=None) if sets[i] else rows[i][0]
    return [(i, len(s), c) for (i, _), s, c in zip(rows, sets, out)]


def near_corpus(seed, n=160):
    """Families of edited copies around the threshold, with short texts, common passages and case variants."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [f"common{i}" for i in range(50)]
    rows = []
    for k in range(n // 8):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 5, 8, 11, 12, 20, 60, 150, 400]))] + (passage if k % 3 == 0 else [])
        for j in range(8):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, len(w) // 40, len(w) // 25])):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if j == 5:
                w = w[: max(1, len(w) - len(w) // 20)]
            rows.append((len(rows), (" " if j % 2 else "\n").join(w).upper() if j == 3 else " ".join(w)))
    return rows


@pytest.mark.parametrize(("size", "num"), [(3, 90), (5, 80), (1, 50)])
def test_join_equals_all_pairs(spark, monkeypatch, size, num):
    rows = near_corpus(size)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    want = sorted(brute_components(rows, size, num), key=key)
    assert sorted((tuple(r) for r in jaccard_join.join(docs, size, num).select("doc_id", "n_shingles", "component_id").collect()), key=key) == want
    # the same in small blocks: lists and components over many tasks
    monkeypatch.setattr(jaccard_join, "LIST_MEMBERS", 2)
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 60)
    monkeypatch.setattr(jaccard_join, "BLOCK_CELLS", 50)
    assert sorted((tuple(r) for r in jaccard_join.join(docs, size, num).select("doc_id", "n_shingles", "component_id").collect()), key=key) == want
    kept = {r.doc_id for r in jaccard_join.deduplicate(docs, size, num).collect()}
    assert kept == {c for _, _, c in want}


@pytest.mark.parametrize(("num", "den"), [(90, 100), (80, 100), (50, 100)])
def test_linked_sets_always_share_a_cell(num, den):
    """Pairs of every size at the very edge of the threshold, with bands of all kinds."""
    rng = np.random.default_rng(num)
    scheme = jaccard_join.Scheme(num, den)
    for n in [*range(1, 60), 100, 333, 1000]:
        for _ in range(8):
            a = np.unique(rng.integers(0, 1 << 63, n).astype("u8"))
            common = rng.integers(0, n + 1)
            union = len(a)
            for extra in (0, (union - 0) // 7, union // 3):
                drop = common % max(1, union // 2)
                b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 63, extra).astype("u8")]))
                both = len(np.intersect1d(a, b))
                if len(b) and both < max(len(a), len(b)) and den * both >= num * (len(a) + len(b) - both):
                    assert np.intersect1d(scheme.cells(a), scheme.cells(b)).size, (len(a), len(b), both)


def test_tree_finds_all_that_the_bounds_allow():
    rng = np.random.default_rng(2)
    scheme = jaccard_join.Scheme(80, 100)
    sizes = rng.integers(1, 300, 3000)
    vectors = np.stack([np.bincount(rng.integers(0, jaccard_join.GROUPS, n), minlength=jaccard_join.GROUPS) for n in sizes])
    tree = jaccard_join.CountTree(vectors, sizes)
    assert len(tree.levels) == 2
    for i in range(0, 3000, 97):
        bound = np.minimum(vectors, vectors[i]).sum(axis=1)
        want = np.flatnonzero(bound >= scheme.need(sizes, sizes[i]))
        found, bounds = tree.search(vectors[i], int(sizes[i]), scheme)
        assert sorted(found.tolist()) == want.tolist() and (bound[found] == bounds).all()


def test_join_on_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    got = sorted((tuple(r) for r in jaccard_join.join_query(odd_docs).collect()), key=key)
    assert got == sorted(brute_components(rows, 3, 90), key=key)
    once = jaccard_join.deduplicate(odd_docs)
    assert once.columns == odd_docs.columns and once.count() == odd_docs.count() - 3  # one equal text, two equal rows
    assert jaccard_join.join_query(no_docs).count() == 0 and jaccard_join.deduplicate(no_docs).count() == 0


# --- Katz scores ---


def brute_katz(rows):
    tokens = [[*words(t), "</s>"] for _, t in rows]
    out = [zlib.crc32(("null" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    uni, bi, after = Counter(), Counter(), Counter()
    for w, h in zip(tokens, out):
        if not h:
            for a, b in zip(["<s>", *w], w):
                uni[b] += 1
                bi[a, b] += 1
                after[a] += 1
    n, v = sum(uni.values()), len(uni)
    of = lambda c: [0] + [sum(x == r for x in c.values()) for r in range(1, katz.K + 2)]
    d2, d1 = katz.discounts(of(bi)), katz.discounts(of(uni))
    keep = lambda d, r: (d[r] if r <= katz.K else 1) * r
    freed = sum(r - keep(d1, r) for r in uni.values())
    norm = n if freed > 0 else n + 1
    unseen = (freed if freed > 0 else 1) / norm if n else 1.0
    p1 = lambda w: keep(d1, uni[w]) / norm if uni[w] else unseen
    follow = defaultdict(list)
    for (a, b), r in bi.items():
        follow[a].append((b, r))
    size = {a: after[a] + (0 if any(r <= katz.K for _, r in f) else 1) for a, f in follow.items()}
    alpha = {a: (1 - sum(keep(d2, r) for _, r in f) / size[a]) / (1 - sum(p1(b) for b, _ in f)) for a, f in follow.items()}
    for a, f in list(follow.items())[:25]:  # every history's probabilities sum to 1
        seen = {b for b, _ in f}
        total = sum(keep(d2, r) / size[a] for _, r in f) + alpha[a] * (sum(p1(w) for w in uni if w not in seen) + unseen)
        assert abs(total - 1) < 1e-9
    res = []
    for (i, _), w, h in zip(rows, tokens, out):
        score = sum(math.log10(keep(d2, bi[a, b]) / size[a]) if bi[a, b] else math.log10(alpha.get(a, 1.0) * p1(b)) for a, b in zip(["<s>", *w], w))
        res.append((i, h, len(w), sum(uni[x] > 0 for x in w), n, sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w), score))
    return res


def same_scores(got, want):
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], round(r[6], 6))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9, atol=1e-9)


def zipf_corpus(n, seed):
    rng = random.Random(seed)
    return [(i, " ".join(f"w{min(int(rng.paretovariate(0.7)), 500)}" for _ in range(rng.randrange(0, 60)))) for i in range(n)]


@pytest.mark.parametrize("partition_bytes", [1 << 30, 1_500])
def test_katz_equals_brute_force(spark, monkeypatch, partition_bytes):
    monkeypatch.setattr(katz, "PARTITION_BYTES", partition_bytes)  # few or many partitions and frequent histories
    rows = zipf_corpus(300, 1) + [(1000 + i, "the the the of the") for i in range(40)] + [(2000 + i, f"once{i // 3} again{i // 3} only held{i}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    if partition_bytes < 1 << 30:
        hot = katz._hot(docs, katz.partitions_for(docs, partition_bytes))
        assert len(hot.words) > 10 and len(hot.h) > 3  # both kinds of frequent things are met
    same_scores([tuple(r) for r in katz.score(docs).collect()], brute_katz(rows))


def test_katz_with_every_bigram_frequent(spark, monkeypatch):
    """Bigrams seen never, seldom and often in training, all kept with their blocks; most histories have no others."""
    rows = zipf_corpus(120, 4) + [(1000 + i, "") for i in range(5)] + [(5000 + i, f"rare{i}") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    monkeypatch.setattr(katz, "HOT_DOCS", 1)
    monkeypatch.setattr(katz, "partitions_for", lambda d, b: 4000)
    hot = katz._hot(docs, 4000)
    assert len(hot.h) > 500
    monkeypatch.setattr(katz, "_hot", lambda d, b: hot)
    monkeypatch.setattr(katz, "partitions_for", lambda d, b: 5)
    same_scores([tuple(r) for r in katz.score(docs).collect()], brute_katz(rows))


def test_katz_on_odd_rows(spark, odd_docs, no_docs):
    same_scores([tuple(r) for r in katz.score(odd_docs).collect()], brute_katz([(r.doc_id, r.text) for r in odd_docs.collect()]))
    assert katz.score(no_docs).count() == 0
    none = spark.createDataFrame([(i, "a b") for i in range(200) if katz.held_out(i)], "doc_id long, text string")
    assert {r.score for r in katz.score(none).collect()} == {0.0}


# --- decontamination ---


def test_templates_and_slots(spark):
    item = "When the train from Paris leaves at 9 with 120 people and travels 300 km to Lyon how many people reach Lyon by 12"
    changed = item.replace("Paris", "Madrid").replace("Lyon", "Sevilla").replace("300", "450").replace("km", "miles").replace("120", "80")
    docs = {
        1: f"Some words before it. {item}. And after it.", 2: changed, 3: changed.replace("Sevilla", "Cadiz", 1).replace("450", "7"),
        4: "A clean text about a train from somewhere that leaves at 9 and has nothing else in common with it at all", 5: item.upper(), 6: " ".join(item.split()[:9]), 7: "###".join(item.split(" ")) + "!!", 8: None, 9: "",
    }
    d = spark.createDataFrame(list(docs.items()) + [(1, docs[1])], "doc_id long, text string")
    b = spark.createDataFrame([(10, item), (11, None), (12, ""), (None, item), (13, "short item here")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.leaks_query(d, b).collect()}
    assert {i for i, _ in got} >= {1, 2, 7} and not {i for i, _ in got} & {3, 4, 6, 8, 9}
    assert got[1, 10].coverage == 1.0 and not got[1, 10].changed and got[2, 10].changed
    left = decontam.decontaminate(d.withColumn("item_id", F.lit(1)), b)
    assert left.columns == ["doc_id", "text", "item_id"] and {r.doc_id for r in left.collect()} == set(docs) - {i for i, _ in got}
    assert decontam.leaks_query(d.where("false"), b).count() == 0 and decontam.decontaminate(d, b.where("false")).count() == d.count()


def test_items_of_numbers_are_found_verbatim(spark):
    items = [(1, "Compute 12 + 35 - 7 * 3 + 8."), (2, "What is 17 * 23?")]
    docs = [(1, "First some text. Compute 12 + 35 - 7 * 3 + 8. Then more text."), (2, "so what is 17 * 23? nobody knows"), (3, "Compute 12 + 35 - 7 * 3 + 9."), (4, "What is 17 * 24?")]
    found = decontam.leaks_query(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 1), (2, 2)}


def test_very_long_numbers_are_one_token(spark):
    docs = [(1, "1." * 200_000), (2, "1,22." * 100_000 + " one two three four"), (3, ".\n" * 200_000), (4, "q" * 400_000)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    n = {r.doc_id: r.n for r in d.select("doc_id", F.size(decontam.tokens(F.col("text"))).alias("n")).collect()}
    assert n == {1: 1, 2: 5, 3: 0, 4: 1}
    found = decontam.leaks_query(d, spark.createDataFrame([(9, docs[1][1])], "item_id long, text string"))
    assert {r.doc_id for r in found.collect()} == {2}


@pytest.mark.parametrize("seed", range(3))
def test_token_patterns_agree(spark, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(["1", "22", ".", ",", "a", "É", " ", "\n", "!", "b c", "-"]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = F.regexp_extract_all(F.concat(F.lit("\n"), F.col("text")), F.lit(decontam.TOKEN), F.lit(0))
    assert d.where(decontam.tokens(F.col("text")) != plain).isEmpty()


def test_excerpts_of_long_items_are_found(spark):
    rng = random.Random(5)
    w = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(500)]
    docs = [(1, " ".join(["before", *w[100:300], "after"])), (2, " ".join(w[7:20])), (3, " ".join(w[7:19])), (4, " ".join(w[7:15] + ["other"] + w[16:24]))]
    found = decontam.leaks_query(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(w))], "item_id long, text string"))
    assert {r.doc_id: (r.matched, r.windows) for r in found.collect()} == {1: (193, 493), 2: (6, 493)}


def test_copies_in_other_letters_are_found(spark):
    item = "When the train from Paris leaves at 9 with 120 people and travels 300 km to Lyon how many people reach Lyon by 12"
    docs = [(1, item), (5, item.upper()), (6, item.lower()), (7, item.title()), (8, item.upper().replace("300", "450")), (9, item.lower().replace("by 12", "by 9"))]
    found = decontam.leaks_query(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(10, item)], "item_id long, text string"))
    got = {r.doc_id: r.changed for r in found.collect()}
    assert set(got) == {1, 5, 6, 7, 8, 9} and not got[5] and got[8]


def test_short_items_and_shuffled_windows(spark, monkeypatch, odd_docs):
    b = spark.createDataFrame([(13, "short item here")], "item_id long, text string")
    d = spark.createDataFrame([(1, "a short item, here we are"), (2, "short here item")], "doc_id long, text string")
    assert [r.doc_id for r in decontam.leaks_query(d, b).collect()] == [1]
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", -1)
    for hashes in (1_000_000, 0):  # hashes alone broadcast, then shuffled too
        monkeypatch.setattr(decontam, "BROADCAST_HASHES", hashes)
        assert [r.doc_id for r in decontam.leaks_query(d, b).collect()] == [1]
        sf = "/root/testdata/sf0.001"
        docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
        docs = docs.union(docs.limit(20))  # equal rows are one document
        got = sorted(map(tuple, decontam.leaks_query(docs, items).collect()))
        with monkeypatch.context() as m:
            m.setattr(decontam, "BROADCAST_BYTES", 1 << 30)
            assert got == sorted(map(tuple, decontam.leaks_query(docs, items).collect())) and got
    assert decontam.decontaminate(odd_docs, b).count() == odd_docs.count()


# --- mixing ---


def test_raking_reaches_the_targets(spark):
    rng = random.Random(1)
    cells = [(s, l, t, rng.randrange(1, 1000)) for s in "abc" for l in ("en", "de") for t in ("x", "y", "z")]
    targets = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": {"en": 0.6, "de": 0.4}, "topic": 0.5}
    w = {r[:3]: r.w for r in mixing.rake(spark.createDataFrame(cells, "_source string, _lang string, _topic string, t long"), targets).collect()}
    for k, name in enumerate(("source", "lang")):
        for value, share in targets[name].items():
            assert sum(x for c, x in w.items() if c[k] == value) == pytest.approx(share, abs=1e-6)
    assert sum(w.values()) == pytest.approx(1)
    mass = Counter()
    for *c, t in cells:
        mass[c[2]] += t
    roots = {t: math.sqrt(m) for t, m in mass.items()}
    for t in "xyz":
        assert sum(x for c, x in w.items() if c[2] == t) == pytest.approx(roots[t] / sum(roots.values()), abs=1e-6)


@pytest.mark.parametrize("fraction", [0.1, 0.6, 0.95, 1.0])
def test_probabilities_are_calibrated(spark, fraction):
    cells = [("a", "en", "x", 100, 0.7), ("b", "en", "x", 5000, 0.2), ("c", "en", "x", 900, 0.1), ("d", "en", "x", 0, 0.0)]
    p = {r._source: r.p for r in mixing.probabilities(spark.createDataFrame(cells, "_source string, _lang string, _topic string, t long, w double"), fraction).collect()}
    assert sum(p.get(s, 0) * t for s, _, _, t, _ in cells) == pytest.approx(fraction * 6000, rel=1e-4) and all(0 <= x <= 1 for x in p.values())
    free = [(s, w / t / p[s]) for s, _, _, t, w in cells if t and p[s] < 1]
    assert all(r == pytest.approx(free[0][1], rel=1e-3) for _, r in free)


def test_shares_of_the_rest(spark):
    cells = [("a", l, "x", t) for l, t in (("en", 10), ("de", 30), ("fr", 20), ("it", 40))]
    targets = {"lang": {"en": 0.5, "de": 0.3, mixing.REST: 0.2}}
    w = {r._lang: r.w for r in mixing.rake(spark.createDataFrame(cells, "_source string, _lang string, _topic string, t long"), targets).collect()}
    assert w == pytest.approx({"en": 0.5, "de": 0.3, "fr": 0.2 / 3, "it": 0.4 / 3})


def test_topics_follow_from_the_words(spark):
    texts = ["tree tree river", "tree stone stone", "stone river river", "road"] + ["common word here"] * 16 + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "other other")], "doc_id long, text string")
    terms = mixing.anchors(docs)
    assert terms == ["river", "stone", "tree", "road"]  # in 2 to 20 of 100 documents; by frequency, then alphabet
    got = {(r.doc_id, r.topic) for r in docs.select("doc_id", mixing.topic(mixing.words(F.col("text")), terms).alias("topic")).collect()}
    assert {(0, "tree"), (1, "stone"), (2, "river"), (3, "road"), (4, mixing.OTHER), (20, mixing.OTHER), (21, mixing.OTHER), (None, mixing.OTHER)} <= got
    assert mixing.anchors(docs.where("false")) == []


@pytest.fixture(scope="module")
def many_docs(spark):
    """More documents than ``ANCHOR_DOCS``: one word stands in 2 of 100, but in none of the sample; ids that repeat, and null ids."""
    n = mixing.ANCHOR_DOCS + 500
    order = sorted(range(n), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    edge = set(order[-n // 50 :])
    rows = [(i, ("edge " if i in edge else "") + "common words " * (1 + i % 7), "en" if i % 3 else "de", f"s{i % 2}") for i in range(n)]
    rows += [(order[0], "zebra zebra", "en", "s0")] * 60  # its smallest text is another
    rows += [(order[-1], "edge", "en", "s1")] * 600 + [(None, "edge zebra", "en", "s1")] * 60
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(7)


def test_anchor_terms_are_counted_over_all_documents(spark, many_docs):
    assert mixing.anchors(many_docs) == ["edge"]
    assert mixing.anchors(many_docs.where("doc_id is not null").dropDuplicates(["doc_id"])) == ["edge"]
    topics = {r.doc_id: r.topic for r in mixing.mixed(many_docs).where("text like 'edge%'").collect()}
    assert len(topics) == 51 and set(topics.values()) == {"edge"}


def test_the_mixing_query_counts_what_its_sql_counts(spark, many_docs):
    duck, documents = duckdb.connect(), many_docs.toPandas().astype({"doc_id": "Int64"})
    duck.register("documents", documents)
    want = duck.execute(oracles.ORACLE_SQL["op4_mixing"]).fetchall()
    got = [tuple(r) for r in mixing.mixing_query(many_docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and {r[3] for r in got} == {mixing.OTHER}


def test_mixing_on_odd_rows(spark, odd_docs, no_docs):
    m = mixing.mixed(odd_docs.withColumn("topic", F.lit("mine")))
    assert m.count() == odd_docs.count() and m.select("topic").distinct().where("topic = 'mine'").count() == 0
    rows = m.collect()
    for r in rows:
        u = int(hashlib.md5(f"{'(none)' if r.doc_id is None else r.doc_id}:{mixing.SEED}".encode()).hexdigest()[:13], 16) / 2**52
        assert r.drawn == (u < r.p) and r.tokens == len(words(r.text))
    s = mixing.sampled(odd_docs)
    assert s.columns == odd_docs.columns and s.count() == sum(r.drawn for r in rows)
    assert mixing.mixed(no_docs).count() == 0 and mixing.sampled(odd_docs, fraction=1.0).count() > 0


# --- WARC ---


def test_archives(spark):
    html = ["<p>é</p>", "<p>é</p>", "", None, "other", "<p>é</p>", "x" * 100_000]
    pages = [(5, "http://a/1"), (3, "http://b/\r\nX: y"), (7, None), (8, "u"), (None, "n"), (3, "http://b/again"), (9, "big")]
    d = spark.createDataFrame([(i, u, h) for (i, u), h in zip(pages, html)], "page_id long, url string, html string")
    for small in (1, 1 << 20):
        listed = warc.write_archives(d, archive_bytes=small)
        got = warc.read_archives(listed).collect()
        assert len(got) == len(pages)
        by = {(r.page_id, r.payload_bytes): r for r in got}
        assert (by[3, 9].record_type, by[5, 9].record_type, by[5, 9].refers_to) == ("response", "revisit", 3)
        assert sum(r.page_id == 3 and r.record_type == "response" for r in got) == 2  # both have the smallest id
        assert (by[7, 0].record_type, by[8, 0].refers_to, by[None, 5].record_type) == ("response", 7, "response")
        assert by[5, 9].payload_digest == __import__("base64").b32encode(hashlib.sha1("<p>é</p>".encode()).digest()).decode()
    kept = {(r.page_id, r.payload_bytes): r.record_type for r in warc.read_archives(warc.write_archives(d, min_bytes=1)).collect()}
    assert kept[8, 0] == "response" and kept[5, 9] == "revisit"
    uris = [r.uri for r in warc.write_archives(d.where("page_id in (3, 5)")).collect()]
    heads = [h for uri in uris for h, _ in warc.records(warc.read_file(uri))]
    assert heads[0]["warc-type"] == "warcinfo" and all(h["warc-record-id"].startswith("<urn:uuid:") for h in heads)
    ids = {h["warc-record-id"] for h in heads if h["warc-type"] == "response"}
    revisits = [h for h in heads if h["warc-type"] == "revisit"]
    assert revisits and all(h["warc-refers-to"] in ids and h["warc-profile"] == warc.PROFILE and h["warc-refers-to-date"] == warc.DATE for h in revisits)
    twice = warc.write_archives(d.union(d))  # fully equal rows: record ids stay unique, revisits name no one record
    heads = [h for r in twice.collect() for h, _ in warc.records(warc.read_file(r.uri))]
    assert len({h["warc-record-id"] for h in heads}) == len(heads) and not any("warc-refers-to" in h for h in heads)
    assert warc.archives_query(d.where("false")).count() == 0


def test_archives_by_a_shuffled_join(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = spark.createDataFrame([(i, f"u{i}", f"<p>{i % 7}</p>") for i in range(100)], "page_id long, url string, html string")
        rows = warc.archives_query(d).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r.page_id: r.refers_to for r in rows} == {i: None if i < 7 else i % 7 for i in range(100)}


def test_reading_an_archive_takes_linear_time():
    import time

    def seconds(n):
        data = b"".join(warc.record(i, f"http://a/{i}", bytes([65 + i % 26]) * 800, "A" * 32, warc._fresh_id()) for i in range(n))
        began = time.perf_counter()
        assert sum(1 for _ in warc.records(data)) == n
        return time.perf_counter() - began

    seconds(100)
    assert seconds(16_000) < 10 * seconds(4_000) + 0.2
    with pytest.raises(ValueError):
        list(warc.records(warc.record(1, None, b"x", "A" * 32, "i")[:-9]))

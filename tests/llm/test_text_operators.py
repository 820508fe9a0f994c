"""Operators on single texts against plain versions, and their defined results on odd input."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftlode.llm import encoding, pii, quality, token_scan, urlfilter, wavelet

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    w = WORD.findall(text or "")
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_odd_rows(spark, odd_docs, no_docs):
    trusted = spark.createDataFrame([(6,)], "doc_id long")
    extra = ["a b c d e a b c d e f", "l\nl\n \nl", "# a * b", "a b c d e f g " * 3, "a a a a a a a"]
    docs = odd_docs.unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"), allowMissingColumns=True)
    for judged in (quality.judge(docs, trusted), quality.verdicts(docs, trusted)):
        rows = judged.join(docs.select("doc_id", "text").distinct(), "doc_id").collect()
        assert rows
        for r in rows:
            assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == counts(r.text), r.text
            assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.kept and r.base_failed)
            assert (r.llr is None) == (r.n_words == 0)
        assert judged.count() == docs.count()
    assert quality.judge(no_docs, trusted).count() == 0
    assert {r.llr for r in quality.judge(docs, trusted.where("false")).where("n_words > 0").collect()} == {0.0}
    assert {"source", "lang", "kept"} <= set(quality.judge(docs, trusted).columns)


def test_quality_ratio_is_that_of_two_multinomials(spark):
    rows = [(1, "alpha beta gamma delta alpha"), (2, "alpha beta epsilon"), (3, "noise noise noise")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    size = 512

    def grams(t):
        h = [int(hashlib.md5(w.lower().encode()).hexdigest()[:7], 16) for w in t.split()]
        return [x % size for x in h] + [(a * 31 + b * 17 + 7) % size for a, b in zip(h, h[1:])]

    raw, good = Counter(g for _, t in rows for g in grams(t)), Counter(grams(rows[0][1]) + grams(rows[1][1]))
    r = lambda g: math.log((good[g] + 1) / (sum(good.values()) + size)) - math.log((raw[g] + 1) / (sum(raw.values()) + size))
    got = {x.doc_id: x.llr for x in quality.judge(docs, spark.createDataFrame([(1,), (2,)], "doc_id long"), buckets=size).collect()}
    for i, t in rows:
        assert got[i] == pytest.approx(sum(map(r, grams(t))) / len(grams(t)), abs=1e-6)
    assert got[1] > 0 > got[3]


def test_symbol_junk_is_rejected_and_good_rows_stay(spark):
    """Labelled rows of the given tables: words with symbols stuck to them pass the counting rules, so the ratio must reject them."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.judge(docs, quality.trusted_ids(labels)).join(labels, "doc_id", "left").where("not base_failed").collect()
    junk = [r for r in rows if sum(bool(re.search(r"[#*$%&|<>@]{3}", w)) for w in WORD.findall(r.text)) > 0.3 * r.n_words]
    good = [r for r in rows if r.quality == 1]
    assert len(junk) >= 20 and sum(r.kept for r in junk) <= 0.05 * len(junk)
    assert len(good) >= 200 and sum(not r.kept for r in good) <= 0.01 * len(good)


PII = [
    "write to a.b+c@mail.example.com, x@y, q@z.org_x@d.org now",
    "from 10.0.0.1 and 300.1.1.1 or 1.2.3.4.5.6.7.8 and 001.2.3.004",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112 or 5500000000000004, 12 34",
    "call +1 (555) 123-4567 or +12 or +1234567890123456789",
    "iban GB82 WEST 1234 5698 7654 32 and account DE89370400440532013000, DE89370400440532013001",
    'token = "0123456789abcdef0123456789abcdef01234567" and 0123456789abcdef0123456789abcdef01234567',
    "é😀 漢 é a@b.co 😀 +49 30 1234567",
    "", None, "@@@@ ....  ++++", "a" * 20_000 + "@" + "b" * 20_000, "1." * 20_000, "1-" * 20_000, "a@" + "b.c" * 10_000,
]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    ok = {
        "email": lambda m: True,
        "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m)),
        "phone": lambda m: 8 <= len(digits(m)) <= 15,
    }
    kinds = [k for k in pii.KINDS if k.always]
    return [(k.name, m.start(), m.end()) for k in kinds for m in re.finditer(k.plain, text or "") if ok[k.name](m.group())]


def test_personal_data(spark, odd_docs, no_docs):
    docs = spark.createDataFrame(list(enumerate(PII)), "doc_id long, text string")
    for r in pii.spans_query(docs).collect():
        want = base_spans(PII[r.doc_id])
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest(), (PII[r.doc_id] or "")[:80]
        assert r.spans.startswith(line)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _, _ in want) for x in ("email", "ip", "card", "phone"))
    got = {r.doc_id: r for r in pii.spans_query(docs).collect()}
    assert got[4].n_iban == 2 and got[5].n_secret == 1 + ("token" in PII[5][-80:-40])
    text = pii.redact(docs).where("doc_id = 6").first().text
    assert text == "é😀 漢 é [EMAIL] 😀 [PHONE]"
    assert pii.spans_query(odd_docs).count() == odd_docs.count() and pii.spans_query(no_docs).count() == 0
    assert pii.find_spans(odd_docs.withColumn("spans", F.lit(1))).count() == odd_docs.count()


def test_long_texts_take_linear_time(spark):
    """Ten MB of proposals that fail, and a hundred thousand spans that stand."""
    import time

    numbers, mails = "12 x " * 2_000_000, "a@b.co, " * 100_000
    docs = spark.createDataFrame([(1, numbers), (2, mails)], "doc_id long, text string")
    began = time.perf_counter()
    got = {r.doc_id: r for r in pii.spans_query(docs).collect()}
    assert time.perf_counter() - began < 60
    assert got[1].n_spans == 0 and not got[1].has_pii and got[2].n_email == got[2].n_spans == 100_000
    line = ",".join(f"email:{8 * i}:{8 * i + 6}" for i in range(100_000))
    assert got[2].spans == line and got[2].base_sha256 == hashlib.sha256(line.encode()).hexdigest()


def test_context_crosses_matches(spark):
    token = "0123456789abcdef" * 2
    text = f"token 12.34 {token} and then much later, after more than forty characters {token} key {token} {token}"
    r = pii.spans_query(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    at = [m.start() for m in re.finditer(token, text)]
    near = [i for i in at if any(w in text[max(0, i - pii.CONTEXT) : i] for w in ("token", "secret", "key", "password"))]
    assert r.spans == ",".join(f"secret:{i}:{i + 32}" for i in near) and 0 < len(near) < len(at) and r.best_score == 0.6


def test_mod_97(spark):
    rows = [("GB82WEST12345698765432", True), ("GB82WEST12345698765433", False), ("DE89370400440532013000", True), ("FR1420041010050500013M02606", True)]
    d = spark.createDataFrame(rows, "i string, ok boolean")
    assert all(r[0] == r[1] for r in d.select(pii.mod97(F.col("i")), "ok").collect())


URLS = [
    "http://a.example.com/en/x?q", "https://www.example.com/en/", "https://www.example.com/en", "HTTP://NET/es/1", "http://x.net/fr/", "http://xnet/fr/", "http://foo.com", "http://foo.com?x=/",
    "no scheme", "", None, "://", "http://Ü.Example.COM/en/ü", "http://spam-farm.example.org/", "http://a.spam-farm.example.org/x", "a://b://c.com/", "http://example.com/EN/",
]


def plain_judge(url, entries):
    """(host, path, entry, verdict) by going through all (entry, verdict, first)."""
    _, found, rest = (url or "").partition("://")
    host = re.match(r"[^/?#]*", rest)[0] if found else ""
    path = re.match(r"[^?#]*", rest[len(host) :])[0] if found else ""
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = []
    for e, v, first in entries:
        h, slash, p = e.partition("/")
        if (host or path) and (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            fits.append((first, len(e), len(h), e, v))
    best = max(fits, default=(None, 0, 0, None, "allow"))
    return host, path, best[3], best[4]


def test_url_rules(spark):
    tracked = ["http://foo.org/a?utm_source=x", "http://foo.org/a/b", "https://www.foo.org/ab#utm_x", "http://bar.org/?a=1&utm_x=", "http://bar.org", "http://sub.bar.org/c#?utm_", "http://example.com/en/x?utm_a"]
    urls = URLS + tracked
    pages = spark.createDataFrame([*enumerate(urls), (None, urls[0]), (0, urls[0])], "page_id long, url string")
    listed = {"foo.org/a", "bar.org/", "example.com/en/x"}
    assert {r.entry for r in urlfilter.tracked(pages).collect()} == listed
    entries = [(r, v, True) for r, v in urlfilter.RULES] + [(e, "block", False) for e in listed]
    got = urlfilter.urls_query(pages).collect()
    assert len(got) == len(urls) + 2 and sum(r.blocklist_entry is not None for r in got) == 5
    for r in got:
        host, path, entry, verdict = plain_judge(urls[r.page_id or 0], entries)
        ruled = entry in dict(urlfilter.RULES)
        assert (r.host, r.path, r.rule, r.verdict, r.blocklist_entry) == (host, path, entry if ruled else None, verdict, None if ruled else entry)
    assert urlfilter.urls_query(pages.where("false")).count() == 0
    none = spark.createDataFrame([], "entry string, verdict string")
    judged = urlfilter.judge_urls(pages.select("*", F.lit(1).alias("rule"), F.lit("x").alias("_of"), F.lit("y").alias("entry")), none)
    assert {(r.verdict, r.rule, r._of, r.entry) for r in judged.collect()} == {("allow", None, "x", "y")} and judged.count() == len(urls) + 2


@pytest.mark.parametrize("shard_entries", [1_000_000, 10])
def test_lists_of_one_and_many_shards(spark, monkeypatch, shard_entries):
    import random

    rng = random.Random(2)
    hosts = [f"{a}.h{i}.example" for i in range(30) for a in ("a", "b.a")] + [f"h{i}.example" for i in range(30)]
    url_paths = ["", "/", "/x", "/x/y", "/x/yz/1", "/é/漢"]
    entries = [(rng.choice(hosts) + rng.choice(url_paths), rng.choice(["block", "allow"]), rng.random() < 0.2) for _ in range(300)]
    entries = list({e: (e, v, f) for e, v, f in entries}.values()) + [("example/", "allow", False)]
    monkeypatch.setattr(urlfilter, "SHARD_ENTRIES", shard_entries)
    urls = ["http://" + rng.choice(["", "www.", "WWW."]) + rng.choice(hosts) + rng.choice(url_paths) + rng.choice(["", "?q", "#/x"]) for _ in range(400)] + URLS
    pages = spark.createDataFrame([(i, u, "kept") for i, u in enumerate(urls)], "page_id long, url string, _hits string").repartition(3)
    got = {r.page_id: r for r in urlfilter.judge_urls(pages, spark.createDataFrame(entries, "entry string, verdict string, first boolean")).collect()}
    assert len(got) == len(urls) and {r._hits for r in got.values()} == {"kept"}
    for i, u in enumerate(urls):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == plain_judge(u, entries), u


def test_equal_digests_are_told_apart_by_strings(monkeypatch, tmp_path):
    monkeypatch.setattr(urlfilter, "digest", lambda e: 7)
    (tmp_path / "f").write_bytes(urlfilter.DigestArray.pack([(b"a/", 1), (b"b/", 0), (b"c/", 3)]))
    found = urlfilter.DigestArray(str(tmp_path / "f")).find(np.full(4, 7, "<u8"), [b"a/", b"b/", b"c/", b"d/"])
    assert found.tolist() == [1, 0, 3, -1]


def test_digests_are_those_of_spark(spark):
    names = ["a/", "net/es/", "é漢😀/x", "x" * 100]
    d = spark.createDataFrame([(n,) for n in names], "n string").select("n", F.xxhash64("n").alias("h"))
    assert all(urlfilter.digest(r.n.encode()) == r.h & (1 << 64) - 1 for r in d.collect())


def test_a_million_entries_over_shards(spark):
    entries = spark.range(1_200_000).select(F.concat(F.lit("h"), F.col("id").cast("string"), F.lit(".example/")).alias("entry"), F.when(F.col("id") % 2 == 0, "block").otherwise("allow").alias("verdict"))
    pages = spark.createDataFrame([(i, f"http://www.h{i}.example/x") for i in range(1_199_000, 1_201_000, 7)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge_urls(pages, entries).collect()}
    assert got == {i: (f"h{i}.example/", "block" if i % 2 == 0 else "allow") if i < 1_200_000 else (None, "allow") for i in range(1_199_000, 1_201_000, 7)}


TEXTS = [
    "a<|endoftext|>b <|ENDOFTEXT|> c", "<|startoftext|><|endoftext|>", "x <|endoftext|", "The <|startoftext|>\n É<|endoftext|>'s END",
    "It's a Test, isn't it? 42 x2!!", "naïve Ünïcode\u00a0nbsp\u2003em e\u0301 İstanbul ΣΑΣ ς", "<|endoftext|> tail", "###$$$ word### 'quoted' don't o'clock", "", None, "漢字 かな 😀😀", "a\tb\r\nc\x0bd\x0ce", "x" * 3000,
]


@pytest.mark.parametrize("special_as_text", [False, True])
def test_encoding_by_words_equals_encoding_whole_texts(special_as_text):
    tok = Tokenizer.from_file(encoding.default_path())
    tok.encode_special_tokens = special_as_text
    enc = encoding.WordEncoder(encoding.default_path(), special_as_text)
    for _ in range(2):  # again with known words
        ids, lengths = enc.encode(pa.array(TEXTS), 2)
        want = [[*e.ids, 2] for e in tok.encode_batch([t or "" for t in TEXTS], add_special_tokens=False)]
        assert lengths.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    assert enc.encode(pa.array([], pa.string()), 2)[0].tolist() == []


@pytest.mark.parametrize("block", [64, 4096, wavelet.BLOCK_BITS])
@pytest.mark.parametrize("size", [0, 1, 2, 7, 64, 4096, 5000])
def test_wavelet_matrix(size, block, monkeypatch):
    monkeypatch.setattr(wavelet, "BLOCK_BITS", block)
    rng = np.random.default_rng(size)
    ids = np.minimum(rng.geometric(0.01, size), 400).astype("<u2") * 123
    built = wavelet.WaveletMatrix.build(ids)
    shard = wavelet.Shard.of(built.to_bytes([5, None], np.array([1, 2])))
    docs, lengths = shard.documents()
    assert docs == [5, None] and lengths.tolist() == [1, 2]
    for x in (built, shard.matrix()):
        assert x.decode().tolist() == ids.tolist()
        at = rng.integers(0, size, 50) if size else np.zeros(0, int)
        assert x.access(at).tolist() == ids[at].tolist()
        for token in (int(ids[0]) if size else 3, 123, 124, 65535):
            for a, b in ((size // 4, size - size // 5), (0, size)):
                assert x.count(token, a, b) == (ids[a:b] == token).sum()
                assert x.occurrences(token, a, b).tolist() == (np.flatnonzero(ids[a:b] == token) + a).tolist()


def test_one_token_reads_a_bounded_part():
    ids = np.random.default_rng(1).zipf(1.2, 3_000_000).clip(0, 40_000).astype("<u2")
    data = wavelet.WaveletMatrix.build(ids).to_bytes([1], np.array([len(ids)]))
    read = []
    m = wavelet.Shard(lambda offset, n: read.append(n) or data[offset : offset + n]).matrix()
    assert m.access([1_234_567]).tolist() == [ids[1_234_567]]
    # a block for each level, besides the header, the directory and the alphabet
    assert sum(read) < 0.15 * len(data) and len(read) <= m.levels + 6
    at = np.flatnonzero(ids == 17)
    assert m.count(17, 1000, 2000) == (ids[1000:2000] == 17).sum() and m.occurrences(17, int(at[5]), int(at[5]) + 1).tolist() == [at[5]]


def test_shards_and_flat_files(spark, odd_docs, no_docs, monkeypatch):
    tok = Tokenizer.from_file(encoding.default_path())  # the library's default: special strings become special tokens
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string"))
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    ids = [[*e.ids, 2] for e in tok.encode_batch([t or "" for _, t in rows], add_special_tokens=False)]
    want, start = [], 0
    for (i, _), x in zip(rows, ids):
        want.append((i, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    small = wavelet.read_shards(wavelet.write_shards(docs, shard_tokens=50))
    for got in (small, wavelet.shards_query(docs)):
        assert [tuple(r) for r in got.orderBy("start").collect()] == want
    assert wavelet.shards_query(no_docs).count() == 0
    listed = wavelet.write_shards(docs, shard_tokens=50)
    asked = [ids[-1][0], 2, 65535]
    assert {r.token: r.n for r in wavelet.count_tokens(listed, asked).collect()} == {t: sum(x.count(t) for x in ids) for t in asked}
    found = sorted((-1 if r.doc_id is None else r.doc_id, r["at"]) for r in wavelet.find_token(listed, asked[0]).collect())
    assert found == sorted((-1 if i is None else i, k) for (i, _), x in zip(rows, ids) for k, t in enumerate(x) if t == asked[0])
    monkeypatch.setattr(wavelet, "GROUP_PARTS", 1)  # starts over many groups of partitions
    assert [tuple(r) for r in wavelet.read_shards(listed).orderBy("start").collect()] == want
    tok.encode_special_tokens = True  # nothing but its own end may end a document of a flat file
    ids = [[*e.ids, 2] for e in tok.encode_batch([t or "" for _, t in rows], add_special_tokens=False)]
    want_n = sorted((-1 if i is None else i, len(x) - 1) for (i, _), x in zip(rows, ids))
    counted = lambda d: sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in d.collect())
    assert counted(token_scan.scan_query(docs)) == want_n and token_scan.scan_query(no_docs).count() == 0
    listed = token_scan.write_flat(docs, file_tokens=400)
    for block in (1, 2, 3, 7, 64, 1000):  # documents over many blocks, blocks with many documents
        found = token_scan.scan(listed, block_tokens=block)
        assert sorted(r.n_tokens for r in found.collect()) == sorted(n for _, n in want_n)
        assert all(r.start >= 0 and r.n_tokens >= 0 for r in found.collect())


def test_flat_file_with_an_open_end(spark, tmp_path):
    for tokens, want in (([1, 2, 9, 9, 3], [2, 0, 1]), ([9], [0]), ([4, 4], [2]), ([], [])):
        np.array(tokens, "<u2").tofile(tmp_path / "f.tokens")
        listed = spark.createDataFrame([(str(tmp_path / "f.tokens"), len(tokens))], "uri string, tokens long")
        for block in (1, 2, 100):
            assert [r.n_tokens for r in token_scan.scan(listed, end=9, block_tokens=block).orderBy("ordinal").collect()] == want

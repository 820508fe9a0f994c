"""LM scoring with a Katz back-off bigram model, trained and applied over a whole corpus.

Tokens are a text's words in lower case (A-Z) and one end.  Bigram and unigram counts are discounted by Good and
Turing's estimate up to ``K``; what the discounts free goes to the words not seen after a history, in proportion to
their unigram probabilities, with a weight that makes every history's probabilities sum to 1 exactly; an unseen word
has the mass that the unigram discounts free.  A token is scored recursively: by its bigram if that was seen in
training, else by the history's weight times its unigram probability.

The model is a table partitioned by a hash of the history: history counts, the bigrams with their counts, and which
words they lead to.  Tokens travel as packed arrays, sorted and combined per block of documents: a block's bigrams go to
the partition of their history, which counts them and adds up what each document's tokens contribute.  Histories that a
sample shows to be very frequent are dealt out by the following word too; their few totals are combined after.  Bigrams
that it shows to be very frequent do not travel at all: their block counts them, and scores them when their totals are
known.  Counts of the words that follow (needed for the weights) are asked from groups of words, once per partition;
there are about as many groups as the root of the number of partitions.  What is known about a block's documents travels
packed too and is added up per block.  All totals are summed by Spark; the driver gets those of frequent words and
bigrams and a few dozen numbers.  Words are told apart by 64-bit hashes.

Defined results: null or empty text is one end; null ids are hashed as the text ``null`` and reported as null; repeated
rows are scored each; an empty table gives an empty result; without training documents every token has the unseen
word's probability 1 (score 0) and the base score uses counts of 0; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlode.llm.common import let, partitions_for, scratch, words
from siftlode.llm.encoding import forget, plain
from siftlode.llm.packing import by_bucket, pack, release, small, unpack

#: Counts up to this one are discounted.
K = 5
#: The sample that shows very frequent histories and bigrams: documents, or a share where that is more.  It steers where
#: rows go, never a result.
SAMPLE_DOCS, SAMPLE_SHARE = 2_000, 0.0005
#: Documents of the sample that a very frequent bigram stands in at least, and entries of both lists at most.
HOT_DOCS, HOT_LIST = 8, 1 << 20
#: Documents packed together before their bigrams leave a task.
BLOCK_DOCS = 8_000
BLOCK_TOKENS = 1_500_000
#: Input bytes to a partition of the model: bounds what a task gathers.
PARTITION_BYTES = 10 << 20
FOLDS, HELD_OUT = 7, 2
_U = np.uint64
_BEGIN, _END = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)


def _spread(x: np.ndarray, n: int, salt: int = 1) -> np.ndarray:
    x = (x ^ _U(salt * 0x5851F42D4C957F2D & 0xFFFFFFFFFFFFFFFF)) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return (((x >> _U(32)) * _U(n)) >> _U(32)).astype("i8")


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()) % FOLDS == HELD_OUT


def discounts(n: list[int], k: int = K) -> np.ndarray:
    """d[r] for r = 0..k from the numbers n[r] of types with count r (r up to k + 1).

    Good-Turing with Katz's correction up to the largest count that gives discounts in (0, 1), (r - 1/2) / r above.
    """
    for top in range(k, 0, -1):
        if all(n[r] > 0 for r in range(1, top + 1)):
            common = (top + 1) * n[top + 1] / n[1]
            d = [((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common) if common < 1 else -1.0 for r in range(1, top + 1)]
            if all(0 < x < 1 for x in d):
                return np.array([1.0, *d, *[(r - 0.5) / r for r in range(top + 1, k + 1)]])
    return np.array([1.0, *[(r - 0.5) / r for r in range(1, k + 1)]])


class Hot:
    """Very frequent words and bigrams; both words of such a bigram are such words."""

    def __init__(self, words_: list[int], pairs: list[tuple[int, int]]):
        inner = {w for p in pairs for w in p} - {int(_BEGIN), int(_END)}
        self.words = np.sort(np.array(list({*words_, *inner, int(_BEGIN)}), "u8"))
        h, w = np.array([p[0] for p in pairs], "u8"), np.array([p[1] for p in pairs], "u8")
        order = np.argsort(self.code(h, w), kind="stable")
        self.h, self.w = h[order], w[order]
        self.codes = self.code(self.h, self.w)

    @staticmethod
    def code(h: np.ndarray, w: np.ndarray) -> np.ndarray:
        return (h * _U(0x9FB21C651E98DF25)) ^ w

    def place(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The place of each bigram in the list, -1 for others."""
        if not len(self.codes):
            return np.full(len(h), -1, "i8")
        at = np.minimum(np.searchsorted(self.codes, self.code(h, w)), len(self.codes) - 1)
        return np.where((self.h[at] == h) & (self.w[at] == w), at, -1)


def _hot(docs: DataFrame, buckets: int) -> Hot:
    """Words and bigrams that make up over an eighth of a partition's share in a sample: at most 8 * buckets of each."""
    n = docs.count()
    share = max(SAMPLE_DOCS / max(n, SAMPLE_DOCS), SAMPLE_SHARE)
    sample = docs.select("text").sample(share, seed=1) if share < 1 else docs.select("text")
    split = words(F.lower("text"))
    most = min(8 * buckets, HOT_LIST)

    def frequent(items: Column, least: int) -> list:
        counts = sample.select(F.explode(items).alias("w")).groupBy("w").count().persist()
        total = counts.agg(F.sum("count")).first()[0] or 0
        top = counts.where((F.col("count") >= least) & (F.col("count") * 8 * buckets > total)).orderBy(F.desc("count"), "w").limit(most).collect()
        counts.unpersist()
        return [r["w"] for r in top]

    ends = F.array(F.lit("\t")), F.array(F.lit("\n"))  # no word has white space
    joined = lambda s: F.transform(F.sequence(F.lit(0), F.size(s) - 2), lambda i: F.concat_ws(" ", F.get(s, i), F.get(s, i + 1)))
    pairs = F.array_distinct(let(F.concat(ends[0], split, ends[1]), joined))
    of = lambda w: int(_BEGIN) if w == "\t" else int(_END) if w == "\n" else xxhash.xxh64_intdigest(w)
    return Hot([of(w) for w in frequent(split, 1)], [tuple(map(of, p.split(" "))) for p in frequent(pairs, HOT_DOCS)])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, pa.Array]]:
    """Ids and texts, cut so that a block has a bounded number of documents and, but for one long text, of bytes."""
    for batch in batches:
        texts = pc.fill_null(batch["text"], "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy())
        at = 0
        while at < batch.num_rows:
            stop = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + 4 * BLOCK_TOKENS, side="right"))
            stop = min(max(stop, at + 1), at + BLOCK_DOCS, batch.num_rows)
            yield batch["doc_id"].slice(at, stop - at).to_pylist(), texts.slice(at, stop - at)
            at = stop


def _scatter(docs: DataFrame, buckets: int, hot: Hot) -> DataFrame:
    """Rows (bucket, data): a block's bigrams of one partition; bucket -1 - k holds the documents of block k."""

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int64()), ("data", pa.binary())])
        forget()
        part = TaskContext.get().partitionId()
        serial = 0
        for ids, texts in _blocks(batches):
            split = pc.split_pattern(plain(texts), " ")
            coded = split.flatten().dictionary_encode()
            names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            real = np.fromiter((w != "" for w in names), bool, len(names))
            known = np.fromiter((xxhash.xxh64_intdigest(w) for w in names), "u8", len(names))
            at = coded.indices.to_numpy() if len(coded) else np.zeros(0, "i4")
            counts = pc.list_value_length(split).to_numpy()
            owner = np.repeat(np.arange(len(counts)), counts)
            keep = real[at]
            at, owner = at[keep].astype("u8"), owner[keep]
            counts = np.bincount(owner, minlength=len(counts))
            # every document's sequence: begin, words, end
            table = np.concatenate([known, [_BEGIN, _END]]).astype("u8")
            begin, end = len(known), len(known) + 1
            stops = np.cumsum(counts + 1)
            following = np.full(len(at) + len(counts), end, "u8")
            following[np.arange(len(at)) + owner] = at
            history = np.full(len(following), begin, "u8")
            inner = np.ones(len(following), bool)
            inner[stops - counts - 1] = False
            history[inner] = following[np.flatnonzero(inner) - 1]
            doc = np.repeat(np.arange(len(counts)), counts + 1).astype("u8")
            where = _spread(table, buckets)
            is_hot = np.isin(table, hot.words)
            place = np.full(len(history), -1, "i8")  # frequent bigrams stay with their block
            maybe = np.flatnonzero(is_hot[history])
            place[maybe] = hot.place(table[history[maybe]], table[following[maybe]])
            here, others = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
            stay, stay_n = np.unique((place[here].astype("u8") << _U(13)) | doc[here], return_counts=True)
            bucket = where[history]
            mixed = np.flatnonzero(is_hot[history])
            bucket[mixed] = _spread(table[history[mixed]] * _U(31) + table[following[mixed]], buckets, 2)
            uid = (part << 40) + (serial << 20)
            serial += 1
            train = np.array([not held_out(i) for i in ids], bool)
            null = np.array([i is None for i in ids])
            known_docs = dict(ids=np.array([0 if i is None else i for i in ids], "i8"), null=null, train=train, n=counts + 1)
            out = [(-1 - (uid >> 20), pack(**known_docs, hp=small(stay >> _U(13)), hd=small(stay & _U(8191)), hn=small(stay_n)))]
            order = others[np.argsort(bucket[others], kind="stable")]
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            bits = max(1, int(len(table) - 1).bit_length())
            for b in range(buckets):
                own = order[cuts[b] : cuts[b + 1]]
                if not len(own):
                    continue
                if 2 * bits + 13 <= 64:  # BLOCK_DOCS fit 13 bits
                    key, n = np.unique((history[own] << _U(bits + 13)) | (following[own] << _U(13)) | doc[own], return_counts=True)
                    h, w, d = key >> _U(bits + 13), (key >> _U(13)) & _U((1 << bits) - 1), key & _U(8191)
                else:
                    key, n = np.unique(np.stack([history[own], following[own], doc[own]]), axis=1, return_counts=True)
                    h, w, d = key
                hs, h = np.unique(h, return_inverse=True)
                ws, w = np.unique(w, return_inverse=True)
                step = np.diff(h, prepend=0)
                out.append((b, pack(uid=np.array([uid]), hs=table[hs], ws=table[ws], step=small(step), w=small(w), d=small(d), n=small(n), train=np.packbits(train))))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], schema=schema)
            del split, coded, names, known, at, owner, following, history, inner, doc, bucket, place, here, others, order, out
            release()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scatter, "bucket long, data binary")


def _by_block(blocks: np.ndarray, doc: np.ndarray, src: int, **values: np.ndarray) -> list[tuple[int, int, bytes]]:
    """(block, src, data) of what is known about ascending documents, numbered through ``blocks``."""
    cuts = np.searchsorted(doc, np.arange(len(blocks) + 1) * BLOCK_DOCS)
    out = []
    for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if i < j:
            part = {name: x[..., i:j] for name, x in values.items()}
            out.append((int(blocks[k]), src, pack(d=small(doc[i:j] - k * BLOCK_DOCS), **{n: small(x) if x.dtype.kind in "iu" and n != "h" else x for n, x in part.items()})))
    return out


_ROW = "kind string, bucket long, src long, data binary"


def _stats(**sums: tuple[np.ndarray, np.ndarray]) -> bytes:
    """Keys and values of totals to be summed, by name."""
    return pack(**{f"{name}.{part}": x for name, (k, v) in sums.items() for part, x in (("k", np.asarray(k, "u8")), ("v", np.asarray(v)))})


def _summed(rows: DataFrame, kind: str) -> dict[str, dict[int, float]]:
    """The totals of all rows' :func:`_stats`; numbers of Spark's type ``kind``."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sums: dict[str, list] = {}
            for data in pdf["data"]:
                x = unpack(data)
                for name in {k[:-2] for k in x}:
                    sums.setdefault(name, []).append((x[f"{name}.k"], x[f"{name}.v"]))
            for name, parts in sums.items():
                keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                values = np.zeros(len(keys), "i8" if kind == "long" else "f8")
                np.add.at(values, at, np.concatenate([v for _, v in parts]).astype(values.dtype))
                yield pd.DataFrame({"what": name, "key": keys.view("i8"), "value": values})

    out: dict[str, dict[int, float]] = {}
    totals = rows.select("data").mapInPandas(part, f"what string, key long, value {kind}").groupBy("what", "key").agg(F.sum("value").alias("value"))
    for r in totals.collect():  # frequent words and bigrams, and a few dozen counts
        out.setdefault(r["what"], {})[r["key"] & 0xFFFFFFFFFFFFFFFF] = r["value"]
    return out


def _groups(buckets: int) -> int:
    """Groups of words that counts are asked from: rows of questions grow with the power 1.5 of the partitions."""
    return max(1, min(buckets, int(2 * buckets**0.5)))


def _block_place(block: Column) -> Column:
    """A partition for a block's number, which holds a partition and a serial number."""
    return F.shiftright(block, 20) + block.bitwiseAND(F.lit((1 << 20) - 1)) * 7919


def _count(scattered: DataFrame, buckets: int, hot: Hot) -> DataFrame:
    """Rows (kind, bucket, src, data): the model's partitions and what they know of the documents."""
    groups = _groups(buckets)

    def count(b: int, rows: pd.DataFrame) -> pd.DataFrame:
        if b < 0:
            out = []
            for data in rows["data"]:
                x = unpack(data)
                trained = x["train"][x["hd"]]
                stats = _stats(train=([0], [int(x["train"].sum())]), pair=(x["hp"], np.where(trained, x["hn"].astype("i8"), 0)))
                out += [("docs", -1 - b, -1, data), ("stats", -1 - b, -1, stats)]
            return pd.DataFrame(out, columns=["kind", "bucket", "src", "data"])
        parts = [unpack(x) for x in rows["data"]]
        sizes = np.array([len(p["w"]) for p in parts])
        words_, at = np.unique(np.concatenate([x for p in parts for x in (p["hs"], p["ws"])]), return_inverse=True)
        cuts = np.cumsum([0, *[len(x) for p in parts for x in (p["hs"], p["ws"])]])
        h = np.concatenate([at[cuts[2 * i] : cuts[2 * i + 1]][np.cumsum(p["step"], dtype="i8")] for i, p in enumerate(parts)]).astype("u4")
        w = np.concatenate([at[cuts[2 * i + 1] : cuts[2 * i + 2]][p["w"]] for i, p in enumerate(parts)]).astype("u4")
        n = np.concatenate([p["n"].astype("u4") for p in parts])
        blocks, first = np.unique([int(p["uid"][0]) >> 20 for p in parts], return_inverse=True)
        doc = np.concatenate([p["d"].astype("u4") + np.uint32(k * BLOCK_DOCS) for k, p in zip(first, parts, strict=True)])
        train = np.concatenate([np.unpackbits(p["train"])[p["d"]] for p in parts]).astype(bool)
        parts.clear()
        del at
        order = np.argsort((h.astype("u8") << _U(32)) | w, kind="stable").astype("u4")
        h, w, n, doc, train = h[order], w[order], n[order], doc[order], train[order]
        del order
        first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])]))
        lengths = np.diff(first, append=len(h))
        r = np.add.reduceat(np.where(train, n, 0), first).astype("i8")
        del train
        ph, pw = h[first], w[first]
        total = np.bincount(ph, weights=r, minlength=len(words_)).astype("i8")
        is_history = np.bincount(ph, minlength=len(words_)) > 0
        is_hot = np.isin(words_, hot.words)
        seen = r > 0
        rt = np.repeat(r, lengths).astype("u4")  # training count of each row's bigram
        # rows of histories that are counted here alone: what they add to their documents
        low = np.bincount(ph[seen & (r <= K)], minlength=len(words_)) > 0
        count_of = total + np.where((total > 0) & ~low, 1, 0)  # no discounted bigram: one more leaves mass for the rest
        own = ~is_hot[h]
        own &= words_[h] != _BEGIN
        docs = len(blocks) * BLOCK_DOCS
        live = np.flatnonzero(np.bincount(doc, minlength=docs))
        add = lambda x: np.bincount(doc, weights=x, minlength=docs)[live]
        log_r, log_c = np.log10(np.maximum(r, 1)), np.log10(np.maximum(count_of, 1))
        log_c[is_hot] = 0
        a = add((np.repeat(log_r, lengths) - np.where(rt > 0, log_c[h], 0)) * n)
        base = add(np.where(own, np.log10(total + 1.0)[h], 0.0) * n)
        known = add(np.where(own & (total[h] > 0), n, 0))
        m = np.stack([add(np.where(rt == k, n, 0)) for k in range(1, K + 1)]).astype("u4")
        out = [("partial", *x) for x in _by_block(blocks, live, b, a=a, base=base, known=known.astype("i8"), m=m)]
        del a, base, known, m, own
        mine = np.flatnonzero(is_history & ~is_hot)
        uni = mine[words_[mine] != _BEGIN]
        to = _spread(words_[uni], groups)
        for t in np.unique(to):
            own = uni[to == t]
            out.append(("uni", int(t), b, pack(w=words_[own], c=small(total[own]))))
        # which words' counts are needed: those seen after a history here, and those of unseen bigrams
        need = np.zeros(len(words_), bool)
        need[pw] = True
        need &= ~(words_ == _END)
        asked = np.flatnonzero(need & ~is_hot)
        target = _spread(words_[asked], groups)
        asked = asked[np.argsort(target, kind="stable")]
        target = np.sort(target)
        place = np.full(len(words_), -1, "i8")  # of each word in the answers; below -1: hot words and the end, by value
        place[asked] = np.arange(len(asked))
        cut = np.searchsorted(target, np.arange(groups + 1))
        for t in range(groups):
            if cut[t] < cut[t + 1]:
                out.append(("ask", t, b, pack(w=words_[asked[cut[t] : cut[t + 1]]])))
        special = np.flatnonzero((need & is_hot) | (words_ == _END))
        place[special] = -2 - np.arange(len(special))
        new = np.flatnonzero(rt == 0)
        hist = np.unique(ph)
        number = np.zeros(len(words_), "i8")
        number[hist] = np.arange(len(hist))
        out.append(
            (
                "model",
                b,
                -1,
                pack(
                    h=words_[hist], c=small(total[hist]), low=low[hist], hot=is_hot[hist], special=words_[special], cut=cut,
                    ph=small(np.diff(number[ph[seen]], prepend=0)), pw=place[pw[seen]].astype("i4"), r=small(r[seen]),
                    nh=small(number[h[new]]), nw=place[w[new]].astype("i4"), nd=small(doc[new]), nn=small(n[new]), blocks=blocks,
                ),
            )
        )
        hh = np.flatnonzero(is_hot[h])
        if len(hh):  # (document, hot history): how many of its tokens were seen and not
            code, inv = np.unique((doc[hh].astype("u8") << _U(32)) | h[hh], return_inverse=True)
            tally = lambda x: small(np.bincount(inv, weights=x, minlength=len(code)).astype("i8"))
            seen_n, new_n = tally(np.where(rt[hh] > 0, n[hh], 0)), tally(np.where(rt[hh] == 0, n[hh], 0))
            out += [("hotdoc", *x) for x in _by_block(blocks, (code >> _U(32)).astype("i8"), b, h=words_[code & _U(0xFFFFFFFF)], seen=seen_n, new=new_n)]
        hw = np.flatnonzero(is_history & is_hot)
        ranks = np.arange(K + 2)  # counts of counts up to K + 1, exactly
        stats = _stats(
            tokens=([0], [total[uni].sum()]),
            types=([0], [int((total[uni] > 0).sum())]),
            pairs=(ranks, [int((r == k).sum()) for k in ranks]),
            unis=(ranks, [int((total[uni] == k).sum()) for k in ranks]),
            hot=(words_[hw], total[hw]),
            low=(words_[hw], low[hw].astype("i8")),
        )
        out.append(("stats", b, -1, stats))
        del h, w, n, doc, rt
        release()
        return pd.DataFrame(out, columns=["kind", "bucket", "src", "data"])

    b = F.col("bucket")
    return by_bucket(scattered, buckets, count, _ROW, F.when(b >= 0, b).otherwise(_block_place(-1 - b)))


class Totals:
    """What all partitions share: sizes, discounts, and the counts of frequent words and bigrams."""

    def __init__(self, sums: dict[str, dict[int, int]], pairs: Hot):
        of = lambda name, key=0: sums.get(name, {}).get(key, 0)
        docs = of("train")
        self.pair_r = np.array([of("pair", k) for k in range(len(pairs.h))], "i8")
        hot = dict(sums.get("hot", {}))
        self.low = {w for w, n in sums.get("low", {}).items() if n > 0}
        for h, r in zip(pairs.h.tolist(), self.pair_r.tolist(), strict=True):
            hot[h] = hot.get(h, 0) + r
            if 1 <= r <= K:
                self.low.add(h)
        self.hot = hot
        counts = [c for w, c in hot.items() if w != int(_BEGIN) and c > 0]
        self.end = docs
        self.tokens = of("tokens") + sum(counts) + docs
        self.types = of("types") + len(counts) + (docs > 0)
        unis = [of("unis", r) + sum(c == r for c in counts) + (docs == r) for r in range(K + 2)]
        twos = [of("pairs", r) + int((self.pair_r == r).sum()) for r in range(K + 2)]
        self.d2 = discounts(twos)
        self.d1 = discounts(unis)
        freed = sum(unis[r] * r * (1 - self.d1[r]) for r in range(1, K + 1))
        self.norm = self.tokens if freed > 0 else self.tokens + 1  # nothing freed: one more leaves mass for unseen words
        self.unseen = (freed if freed > 0 else 1.0) / self.norm if self.tokens else 1.0

    def unigram(self, c: np.ndarray) -> np.ndarray:
        """Probability of words with training counts ``c``; 0 is an unseen word."""
        c = np.asarray(c, "f8")
        d = self.d1[np.minimum(c, K).astype("i8")]
        return np.where(c > 0, np.where(c <= K, d, 1.0) * c / max(self.norm, 1), self.unseen)

    def kept(self, r: np.ndarray) -> np.ndarray:
        """Discounted bigram counts."""
        r = np.asarray(r, "i8")
        return np.where(r <= K, self.d2[np.minimum(r, K)], 1.0) * r

    def of(self, w: int) -> int:
        return self.end if w == int(_END) else self.hot.get(w, 0)


def _answer(asked: DataFrame, buckets: int) -> DataFrame:
    """For each question (group, src) the training counts of its words, addressed to who asked."""

    def answer(group: int, rows: pd.DataFrame) -> pd.DataFrame:
        own = [unpack(x) for x in rows["data"][rows["kind"] == "uni"]]
        w = np.concatenate([np.zeros(0, "u8"), *[x["w"] for x in own]])
        c = np.concatenate([np.zeros(0, "i8"), *[x["c"].astype("i8") for x in own]])
        order = np.argsort(w, kind="stable")
        w, c = w[order], c[order]
        out = []
        for kind, src, data in zip(rows["kind"], rows["src"], rows["data"], strict=True):
            if kind == "ask":
                q = unpack(data)["w"]
                at = np.minimum(np.searchsorted(w, q), max(len(w) - 1, 0))
                found = np.where(w[at] == q, c[at], 0) if len(w) else np.zeros(len(q), "i8")
                out.append(("told", src, group, pack(c=small(found))))
        return pd.DataFrame(out, columns=["kind", "bucket", "src", "data"])

    return by_bucket(asked, _groups(buckets), answer, _ROW)


def _weigh(rows: DataFrame, buckets: int, totals: Totals) -> DataFrame:
    """Back-off weights of a partition's histories and what unseen bigrams add to documents.

    Rows (kind, bucket, src, data): ``more`` (by block: document, a) and ``weights`` (parts of hot histories' sums).
    """

    def weigh(bucket: int, own: pd.DataFrame) -> pd.DataFrame:
        m = unpack(own["data"][own["kind"] == "model"].iloc[0])
        told = own[own["kind"] == "told"].sort_values("src")
        counts = np.concatenate([np.zeros(0, "i8"), *[unpack(x)["c"].astype("i8") for x in told["data"]]])
        special = np.array([totals.of(w) for w in m["special"].tolist()], "i8")
        p = totals.unigram(np.concatenate([counts, special[::-1]]))  # place -2 - i is special[i] from the back
        at = lambda x: p[np.where(x >= 0, x, len(p) + 1 + x)]
        h = np.cumsum(m["ph"], dtype="i8")
        mass = np.bincount(h, weights=totals.kept(m["r"]), minlength=len(m["h"]))
        cover = np.bincount(h, weights=at(m["pw"]), minlength=len(m["h"]))
        c = m["c"].astype("f8")
        alpha = back_off(c, m["low"], mass, cover)
        nh, hot = m["nh"].astype("i8"), m["hot"]
        extra = (np.where(hot[nh], 0.0, np.log10(alpha[nh])) + np.log10(at(m["nw"]))) * m["nn"]
        doc, inv = np.unique(m["nd"].astype("i8"), return_inverse=True)
        out = [("more", *x) for x in _by_block(m["blocks"], doc, bucket, a=np.bincount(inv, weights=extra, minlength=len(doc)))]
        if hot.any():
            out.append(("weights", bucket, -1, _stats(mass=(m["h"][hot], mass[hot]), cover=(m["h"][hot], cover[hot]))))
        return pd.DataFrame(out, columns=["kind", "bucket", "src", "data"])

    return by_bucket(rows, buckets, weigh, _ROW)


def back_off(c: np.ndarray, low: np.ndarray, mass: np.ndarray, cover: np.ndarray) -> np.ndarray:
    """Weight of each history from its count, whether it has a discounted bigram, kept mass and covered unigram mass."""
    size = c + np.where((c > 0) & ~low, 1, 0)
    left = np.maximum(1 - mass / np.maximum(size, 1), 1e-300)
    return np.where(c > 0, left / np.maximum(1 - cover, 1e-300), 1.0)


class Frequent:
    """What a token adds whose history is a frequent word, by the history (``h``), and what a frequent bigram adds, by its place."""

    def __init__(self, totals: Totals, hot: Hot, parts: dict[str, dict[int, float]]):
        mass, cover = dict(parts.get("mass", {})), dict(parts.get("cover", {}))
        p = totals.unigram(np.array([totals.of(w) for w in hot.w.tolist()], "i8"))
        kept = totals.kept(totals.pair_r)
        for h, r, k, q in zip(hot.h.tolist(), totals.pair_r.tolist(), kept.tolist(), p.tolist(), strict=True):
            mass[h] = mass.get(h, 0.0) + k
            cover[h] = cover.get(h, 0.0) + (q if r > 0 else 0.0)
        self.h = np.array(sorted(mass), "u8")
        names = self.h.tolist()
        c = np.array([totals.hot.get(h, 0) for h in names], "f8")
        low, word = np.array([h in totals.low for h in names], bool), np.array([h != int(_BEGIN) for h in names], bool)
        self.size = np.log10(np.maximum(c + np.where((c > 0) & ~low, 1, 0), 1))
        self.alpha = np.log10(back_off(c, low, np.array([mass[h] for h in names]), np.array([cover[h] for h in names])))
        self.plain, self.known = np.where(word, np.log10(c + 1), 0.0), (word & (c > 0)).astype("f8")
        at = np.searchsorted(self.h, hot.h)
        self.pair_a = np.where(totals.pair_r > 0, np.log10(np.maximum(kept, 1e-300)) - self.size[at], self.alpha[at] + np.log10(p))
        self.pair_plain, self.pair_known = self.plain[at], self.known[at]


def _finish(rows: DataFrame, buckets: int, totals: Totals, hot: Frequent) -> DataFrame:
    """The scores of every block's documents from all that is known about them, one block at a time."""
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    logs = np.log10(totals.d2[1:])
    share, end = float(np.log10(totals.tokens + totals.types + 1)), float(np.log10(totals.end + 1))
    all_tokens, ended = totals.tokens, int(totals.end > 0)

    def finish(block: int, own: pd.DataFrame) -> pd.DataFrame:
        docs = unpack(own["data"][own["kind"] == "docs"].iloc[0])
        n = docs["n"].astype("i8")
        a, base, known = np.zeros(len(n)), np.zeros(len(n)), np.full(len(n), ended)
        own = own.sort_values(["kind", "src"])  # sums in one order, whatever order rows arrive in
        for kind, data in zip(own["kind"], own["data"], strict=True):
            if kind == "docs":
                continue
            x = unpack(data)
            d = x["d"].astype("i8")
            if kind == "partial":
                a[d] += x["a"] + logs @ x["m"]
                base[d] += x["base"]
                known[d] += x["known"]
            elif kind == "more":
                a[d] += x["a"]
            else:
                at = np.searchsorted(hot.h, x["h"])
                seen, new = x["seen"].astype("f8"), x["new"].astype("f8")
                add = lambda v: np.bincount(d, weights=v, minlength=len(n))  # noqa: B023, E731
                a += add(new * hot.alpha[at] - seen * hot.size[at])
                base += add((seen + new) * hot.plain[at])
                known += add((seen + new) * hot.known[at]).astype("i8")
        at, d, times = docs["hp"], docs["hd"].astype("i8"), docs["hn"].astype("f8")
        if len(at):
            add = lambda v: np.bincount(d, weights=v, minlength=len(n))
            a += add(times * hot.pair_a[at])
            base += add(times * hot.pair_plain[at])
            known += add(times * hot.pair_known[at]).astype("i8")
        ids = pd.array(docs["ids"], "Int64")
        ids[docs["null"]] = pd.NA
        return pd.DataFrame(
            {"doc_id": ids, "held_out": ~docs["train"], "n_tokens": n, "n_known": known, "train_tokens": all_tokens, "base_score": base + end - n * share, "score": a}
        )

    return by_bucket(rows, buckets, finish, schema, _block_place(F.col("bucket")))


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    own = docs.select("doc_id", "text")
    buckets = partitions_for(own, PARTITION_BYTES)
    hot = _hot(own, buckets)
    path = scratch(spark, "katz-model")
    _count(_scatter(own, buckets, hot), buckets, hot).write.partitionBy("kind").parquet(path)
    schema = "bucket long, src long, data binary, kind string"
    model = spark.read.schema(schema).parquet(path).select("kind", "bucket", "src", "data")
    kind = lambda *k: model.where(F.col("kind").isin(*k))
    totals = Totals(_summed(kind("stats"), "long"), hot)

    weighed = scratch(spark, "katz-weights")
    _weigh(_answer(kind("uni", "ask"), buckets).union(kind("model")), buckets, totals).write.partitionBy("kind").parquet(weighed)
    back = spark.read.schema(schema).parquet(weighed).select("kind", "bucket", "src", "data")
    frequent = Frequent(totals, hot, _summed(back.where("kind = 'weights'"), "double"))
    return _finish(kind("docs", "partial", "hotdoc").union(back.where("kind = 'more'")), buckets, totals, frequent)

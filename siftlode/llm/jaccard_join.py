"""N-gram Jaccard join: count-vector R-trees over sets of word shingles, exact for every pair of different texts.

A document's set holds the 64-bit hashes of its distinct word shingles.  Its count vector says how many of them fall
into each of ``GROUPS`` hash groups; the intersection of two sets is at most the sum of their vectors' coordinate
minima, and of a vector and a box at most that with the box's upper corner.  An R-tree over the vectors (packed by size,
then by coordinates) therefore finds every set that can still reach the wanted similarity, and the survivors are
verified on the sets themselves.

One tree over a whole corpus cannot be dealt out: boxes of unrelated texts overlap almost everywhere.  So the trees are
built in cells.  The hash space is cut into bands, more than two linked sets can differ in: with a difference of at most
k, of k + 1 + t bands t + 1 or more are equal, and if at most t bands of a set are empty an equal band that is not
empty remains.  Sets with more empty bands are also dealt out by a second cut of the hash space (up to
``LEVELS``), the last of which has cells for empty bands too.  The number of bands depends on the size class; a set
also enters the classes of the smaller sets that it may link with.  So two linked sets always meet in a cell.

Steps: equal sets are one set from the start; cells with two or more sets keep their members; equal member lists are
taken once; in each list an R-tree joins what its bounds cannot part, giving a spanning forest, never all pairs; the
components of these forests are verified, again along a spanning forest.  Lists and components beyond a fixed size are
first compared with one of their members, a row each and gathered nowhere: what links with it is one part already.  Only
members that do not are compared with all others, block by block; where even these are many, every two blocks are
joined.  So no task holds more than two blocks, and a large group of near copies takes time in proportion to its size.

Defined results: null or empty text, or white space only: empty set, linked with nothing, its own component; fewer words than a
shingle: the whole sequence is the one shingle; null ids are linked but never name a component that has another id;
repeated rows are copies; an empty table gives an empty result; other columns are ignored.  Sets are told apart by 64
bits, so among 10^9 different sets two are taken for equal with a probability of about 3 %.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from math import ceil, exp

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlode.llm.common import Carried, free_shuffles, materialise, partitions_for
from siftlode.llm.components import connected_components
from siftlode.llm.encoding import forget, plain
from siftlode.llm.packing import ascending, back, by_bucket, pack, release, small, unpack

#: Least and most hash groups of a count vector; in between a set of n shingles has about n / 4 groups, a power of two,
#: since fewer cannot part long unrelated texts.  A longer vector folds into a shorter one.
GROUPS, MOST_GROUPS = 64, 8192
#: Points of an R-tree leaf, and children of an inner node.
FANOUT = 32
#: Width of a size class.
CLASS_RATIO = 1.25
LEVELS = 4
#: Members of a list, and shingles of a block of a component, that one task takes.
LIST_MEMBERS = 4096
BLOCK_SHINGLES = 1_000_000
#: Cells that a task packs at once, and input bytes to a partition of cells.
BLOCK_CELLS = 1_000_000
PARTITION_BYTES = 10 << 20
_U = np.uint64


def _mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x ^ _U(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    split = pc.split_pattern(plain(texts), " ")
    coded = split.flatten().dictionary_encode()
    names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in names), "u8", len(names))
    real = np.fromiter((w != "" for w in names), bool, len(names))
    at = coded.indices.to_numpy()
    per_text = pc.list_value_length(split).to_numpy()
    keep = real[at] if len(names) else np.zeros(0, bool)
    owner = np.repeat(np.arange(len(per_text)), per_text)[keep]
    words = hashes[at[keep]] if len(names) else np.zeros(0, "u8")
    counts = np.bincount(owner, minlength=len(per_text))
    stop = np.cumsum(counts)
    rolled = words
    for k in range(1, size):
        rolled = _mix(rolled[:-1], k) + words[k:] if len(rolled) > 1 else rolled[:0]
    rolled = _mix(rolled, 77)
    for b, n in zip(stop.tolist(), counts.tolist(), strict=True):
        if n >= size:
            yield np.unique(rolled[b - n : b - size + 1])
        elif n:
            h = words[b - n : b - n + 1]
            for k in range(1, n):
                h = _mix(h, k) + words[b - n + k]
            yield _mix(h, 1000 + n)
        else:
            yield np.zeros(0, "u8")


class Scheme:
    """Size classes, bands and bounds for the similarity num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def need(self, a, b):
        """The least intersection of linked sets of sizes a and b."""
        total = (np.asarray(a, "i8") + b) * self.num
        return -(-total // (self.num + self.den))

    def linked(self, common, a, b):
        return self.den * common >= self.num * (a + b - common)

    @lru_cache(maxsize=None)  # noqa: B019
    def start(self, c: int) -> int:
        return 1 if c == 0 else max(self.start(c - 1) + 1, ceil(self.start(c - 1) * CLASS_RATIO))

    @lru_cache(maxsize=100_000)  # noqa: B019
    def class_of(self, n: int) -> int:
        c = 0
        while self.start(c + 1) <= n:
            c += 1
        return c

    @lru_cache(maxsize=None)  # noqa: B019
    def bands(self, c: int) -> tuple[int, int]:
        """Number of bands and of bands that may be empty, for pairs whose smaller set is of class c; 0: only equal sets link."""
        a = self.start(c + 1) - 1
        b = a * self.den // self.num
        k = (a + b) * (self.den - self.num) // (self.den + self.num)
        if k == 0:
            return 0, 0
        spare = 0
        for _ in range(4):
            m = k + 1 + spare
            spare = ceil(1.5 * m * exp(-self.start(c) / m)) + (k >= 3)
        return k + 1 + spare, spare

    def cells(self, s: np.ndarray) -> np.ndarray:
        """The cells of a set."""
        if not len(s):
            return np.zeros(0, "u8")
        lowest = self.class_of(-(-len(s) * self.num // self.den))
        out = []
        for c in range(lowest, self.class_of(len(s)) + 1):
            m, spare = self.bands(c)
            for level in range(LEVELS if m else 0):
                mixed = _mix(s, 5 + level)
                band = ((mixed >> _U(32)) * _U(m)) >> _U(32)
                order = np.argsort(band, kind="stable")
                band, value = band[order], _mix(mixed[order], 3)
                first = np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1]]))
                out.append(_mix(np.add.reduceat(value, first) + band[first] * _U(0x100000001B3), 1 + c * LEVELS + level))
                if m - len(first) <= spare:
                    break
                if level == LEVELS - 1:
                    empty = np.setdiff1d(np.arange(m).astype("u8"), band[first])
                    out.append(_mix(empty, 1_000_000 + c))
        return np.concatenate(out) if out else np.zeros(0, "u8")


def count_vector(s: np.ndarray) -> np.ndarray:
    """How many shingles fall into each group; the groups are ranges of the hash."""
    bits = min(max(GROUPS, len(s) // 4), MOST_GROUPS).bit_length() - 1
    return np.bincount((s >> _U(64 - bits)).astype("i8"), minlength=1 << bits)


def folded(vectors: list[np.ndarray]) -> np.ndarray:
    """Count vectors of one length: the shortest one's."""
    n = min(map(len, vectors))
    return np.stack([v.reshape(n, -1).sum(axis=1) for v in vectors]).astype("i4")


class CountTree:
    """R-tree over count vectors, packed by size, then along the widest coordinates."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray):
        order = np.argsort(sizes, kind="stable")
        slab = FANOUT * FANOUT
        widest = int(np.argmax(vectors.std(axis=0))) if len(sizes) > FANOUT else 0
        order = np.concatenate([x[np.argsort(vectors[x, widest], kind="stable")] for x in np.split(order, range(slab, len(order), slab))])
        self.order, self.points, self.sizes = order, vectors[order], sizes[order]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        high, low, top = self.points, self.sizes, self.sizes
        while len(low) > FANOUT:
            cut = np.arange(0, len(low), FANOUT)
            high, low, top = np.maximum.reduceat(high, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(top, cut)
            self.levels.append((high, low, top))

    def search(self, vector: np.ndarray, size: int, scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
        """Points that the bounds cannot part from the query, and their bounds."""
        at = np.arange(len(self.levels[-1][1]) if self.levels else len(self.sizes))
        for high, low, top in reversed(self.levels):
            # the smallest size of the box needs the least; its largest must be able to reach the query's size
            fits = (np.minimum(high[at], vector).sum(axis=1) >= scheme.need(np.maximum(low[at], -(-size * scheme.num // scheme.den)), size)) & (
                (low[at] * scheme.num <= size * scheme.den) & (top[at] * scheme.den >= size * scheme.num)
            )
            at = (at[fits][:, None] * FANOUT + np.arange(FANOUT)).ravel()
            below = len(self.sizes) if high is self.levels[0][0] else len(self.levels[[x[0] is high for x in self.levels].index(True) - 1][1])
            at = at[at < below]
        bound = np.minimum(self.points[at], vector).sum(axis=1)
        fits = bound >= scheme.need(self.sizes[at], size)
        return self.order[at[fits]], bound[fits]


class Forest:
    """Union-find; remembers the edges that joined two parts."""

    def __init__(self, n: int):
        self.parent, self.edges = list(range(n)), []

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.edges.append((x, y))


def bound_forest(vectors: np.ndarray, sizes: np.ndarray, scheme: Scheme) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that the vectors' bounds cannot part."""
    forest = Forest(len(sizes))
    if len(sizes) == 2:
        return [(0, 1)] if np.minimum(vectors[0], vectors[1]).sum() >= scheme.need(sizes[0], sizes[1]) else []
    tree = CountTree(vectors, sizes)
    for i in range(len(sizes)):
        for j in tree.search(vectors[i], int(sizes[i]), scheme)[0].tolist():
            if j < i:
                forest.join(i, j)
    return forest.edges


def verified_forest(sets: list[np.ndarray], scheme: Scheme) -> list[tuple[int, int]]:
    """A spanning forest of the linked pairs; a pair within one part already needs no verification."""
    sizes = np.array([len(s) for s in sets], "i8")
    forest = Forest(len(sets))
    if len(sets) == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if scheme.linked(common, len(sets[0]), len(sets[1])) else []
    vectors = folded([count_vector(s) for s in sets])
    tree = CountTree(vectors, sizes)
    every, where = np.unique(np.concatenate(sets), return_inverse=True)
    stops = np.cumsum(sizes)
    codes = [where[b - n : b] for b, n in zip(stops.tolist(), sizes.tolist(), strict=True)]
    post = np.argsort(where, kind="stable")
    owners = np.repeat(np.arange(len(sets)), sizes)[post]
    heads = np.concatenate([[0], np.cumsum(np.bincount(where, minlength=len(every)))])
    for i in range(len(sets)):
        near, bound = tree.search(vectors[i], int(sizes[i]), scheme)
        near = near[np.argsort(-bound, kind="stable")]
        near = [j for j in near.tolist() if j < i]
        common = None
        tries = 0
        for j in near:
            if forest.root(j) == forest.root(i):
                continue
            tries += 1
            if common is None and tries > 8:  # all intersections at once, through the inverted lists
                rows = np.concatenate([np.arange(heads[c], heads[c + 1]) for c in codes[i].tolist()])
                common = np.bincount(owners[rows], minlength=len(sets))
            n = int(common[j]) if common is not None else len(np.intersect1d(codes[i], codes[j], assume_unique=True))
            if scheme.linked(n, int(sizes[i]), int(sizes[j])):
                forest.join(i, j)
    return forest.edges


def _sid(s: np.ndarray) -> int | None:
    """64 bits that tell different sets apart; null for the empty set."""
    return int(_mix(np.array([_mix(s, 11).sum(), _mix(s, 12).sum() + _U(len(s))], "u8"), 1).view("i8").sum()) if len(s) else None


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("row"), "text")


def _profiles(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, row, sid, n, counts) of every row."""
    arrow = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("sid", pa.int64()), ("n", pa.int64()), ("counts", pa.binary())])

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sids, ns, counts = [], [], []
                for s in shingle_sets(part["text"], size):
                    ns.append(len(s))
                    sids.append(_sid(s))
                    counts.append(count_vector(s).astype("<u2").tobytes())
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["row"], pa.array(sids, pa.int64()), pa.array(ns, pa.int64()), pa.array(counts, pa.binary())], schema=arrow)
            release()

    return _rows(docs).mapInArrow(profile, "doc_id long, row long, sid long, n long, counts binary")


def _members(docs: DataFrame, size: int, scheme: Scheme) -> DataFrame:
    """(cell, sid) of the cells that hold two or more different sets.

    The cells of a block of documents leave a task as one packed row for each partition of cells, equal sets of a block
    once, so a cell costs 5 to 7 bytes in the shuffle and nothing is read twice.
    """
    buckets = partitions_for(docs, PARTITION_BYTES)
    arrow = pa.schema([("bucket", pa.int32()), ("data", pa.binary())])

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        release()
        sids: dict[int, int] = {}
        cells: list[np.ndarray] = []

        def rows() -> pa.RecordBatch:
            names = np.fromiter(sids, "i8", len(sids))
            owner = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
            flat = np.concatenate(cells) if cells else np.zeros(0, "u8")
            order = np.argsort(flat, kind="stable")  # a bucket is a range of cells
            flat, owner = flat[order], owner[order]
            cuts = np.searchsorted(flat, np.array([(b << 64) // buckets for b in range(1, buckets)], "u8")) if buckets > 1 else []
            out = []
            for b, (c, o) in enumerate(zip(np.split(flat, cuts), np.split(owner, cuts), strict=True)):
                if len(c):
                    used, o = np.unique(o, return_inverse=True)
                    out.append((b, pack(cells=ascending(c), owner=small(o), sids=names[used])))
            sids.clear(), cells.clear()
            del flat, owner, order
            release()
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], schema=arrow)

        total = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                for s in shingle_sets(batch["text"].slice(at, 500), size):
                    sid = _sid(s)
                    if sid is not None and sid not in sids:
                        sids[sid] = len(sids)
                        cells.append(scheme.cells(s))
                        total += len(cells[-1])
                if total >= BLOCK_CELLS:
                    yield rows()
                    total = 0
        if sids:
            yield rows()

    def gather(bucket: int, packed: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack(x) for x in packed["data"]]
        cells = np.concatenate([back(p["cells"]) for p in parts])
        sids = np.concatenate([p["sids"][p["owner"]] for p in parts])
        parts.clear()
        order = np.lexsort((sids, cells))
        cells, sids = cells[order], sids[order]
        new = np.concatenate([[True], (cells[1:] != cells[:-1]) | (sids[1:] != sids[:-1])])
        cells, sids = cells[new], sids[new]
        same = cells[1:] == cells[:-1]
        keep = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        out = pd.DataFrame({"cell": cells[keep].view("i8"), "sid": sids[keep]})
        del cells, sids, order, new
        release()
        return out

    return by_bucket(docs.select("text").mapInArrow(scatter, "bucket int, data binary"), buckets, gather, "cell long, sid long")


def _forests(tasks: DataFrame, solve: Callable[[list, list], list[tuple[int, int]]]) -> DataFrame:
    """Edges (a, b) of the forests that ``solve`` finds in the rows' ``members`` (sid, n, data), each tree as a star around
    its smallest sid, which leaves little to do for the components."""
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for k in range(batch.num_rows):
                members = batch["members"].slice(k, 1).flatten()
                sid = members.field("sid").to_numpy(zero_copy_only=False)
                if len(sid) < 2:
                    continue
                order = np.argsort(sid, kind="stable")
                place = np.empty(len(sid), "i8")
                place[order] = np.arange(len(sid))
                forest = Forest(len(sid))
                for x, y in solve(members.field("n").to_numpy(zero_copy_only=False), members.field("data").to_pylist()):
                    forest.join(int(place[x]), int(place[y]))
                for x in {x for e in forest.edges for x in e}:
                    if (root := forest.root(x)) != x:
                        a.append(sid[order[x]]), b.append(sid[order[root]])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=arrow)

    return tasks.select("members").mapInArrow(run, "a long, b long")


def _gathered(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.collect_list(F.struct("sid", "n", "data")).alias("members"))


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Tasks of at most two blocks: rows (key, sid, n, data, blocks) gathered by key and pair of blocks."""
    own = F.pmod(F.xxhash64("sid"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = rows.withColumn("_own", own).withColumn("_other", other)
    return _gathered(dealt.withColumns({"_i": F.least("_own", "_other"), "_j": F.greatest("_own", "_other")}), "key", "_i", "_j")


def _with_seeds(rows: DataFrame, pair: Callable[[int, bytes, int, bytes], bool], name: str) -> DataFrame:
    """(key, sid, seed, linked) of rows (key, sid, n, data): whether each member links with the one of the smallest sid."""
    seeds = rows.groupBy("key").agg(F.min_by(F.struct("sid", "n", "data"), "sid").alias("s"))
    seeds = materialise(seeds.select("key", F.col("s.sid").alias("seed"), F.col("s.n").alias("seed_n"), F.col("s.data").alias("seed_data")), f"{name}-seeds")
    arrow = pa.schema([("key", pa.int64()), ("sid", pa.int64()), ("seed", pa.int64()), ("linked", pa.bool_())])

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch[c].to_pylist() for c in ("n", "data", "seed_n", "seed_data"))
            linked = [pair(*x) for x in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["key"], batch["sid"], batch["seed"], pa.array(linked, pa.bool_())], schema=arrow)

    both = rows.join(seeds, "key").select("key", "sid", "n", "data", "seed", "seed_n", "seed_data")
    return materialise(both.mapInArrow(test, "key long, sid long, seed long, linked boolean"), f"{name}-tested")


def _edges(keyed: DataFrame, load: Callable[[DataFrame], DataFrame], solve: Callable, pair: Callable, name: str) -> DataFrame:
    """Edges (a, b) that connect what ``solve`` would connect among the members of each key.

    ``load`` makes rows (key, sid, n, data, blocks) of some rows of ``keyed`` (with key, sid, blocks).
    """
    edges = _forests(_gathered(load(keyed.where("blocks = 1")), "key"), solve)
    if keyed.where("blocks > 1").isEmpty():
        return edges
    large = materialise(load(keyed.where("blocks > 1")), f"{name}-large")
    tested = _with_seeds(large, pair, name)
    star = tested.where("linked and sid <> seed").select(F.col("sid").alias("a"), F.col("seed").alias("b"))
    rest = tested.where("not linked").select("key", "sid")
    rests = rest.groupBy("key").agg(F.count(F.lit(1)).alias("rest"))
    few = large.join(rests.where(F.col("rest") <= LIST_MEMBERS).select("key"), "key")
    own = few.join(rest, ["key", "sid"], "left_anti").withColumn("_b", F.pmod(F.xxhash64("sid"), F.col("blocks")))
    copies = few.join(rest, ["key", "sid"], "left_semi").withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tasks = _gathered(own.unionByName(copies), "key", "_b").select("members")
    many = large.join(rests.where(F.col("rest") > LIST_MEMBERS).select("key"), "key")
    return edges.union(star).union(_forests(tasks.union(_in_blocks(many).select("members")), solve))


def join(docs: DataFrame, size: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """(doc_id, row, n_shingles, component_id, keeper) of every row of ``docs`` (doc_id, text).

    component_id is the smallest id that links of similarity num / den or more reach; keeper tells whether the row is the
    one (with the smallest id, then row hash; fully equal rows share it) that stands for its component.
    """
    scheme = Scheme(num, den)
    profiles = materialise(_profiles(docs, size), "profiles")
    real = profiles.where(F.col("sid").isNotNull())
    reps = real.groupBy("sid").agg(F.min("row").alias("row"), F.first("n").alias("n"))

    members = materialise(_members(docs, size, scheme), "members")
    free_shuffles(docs.sparkSession)
    # cells beyond the limit first, so that their members are not gathered with the others
    sizes = members.groupBy("cell").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > LIST_MEMBERS)
    beyond = materialise(sizes.select("cell", F.ceil(F.col("count") * 2 / LIST_MEMBERS).alias("blocks")), "large-cells")
    lists = members.join(beyond, "cell", "left_anti").groupBy("cell").agg(F.sort_array(F.collect_list("sid")).alias("sids"))
    lists = lists.select("sids").distinct().select(F.xxhash64("sids").alias("key"), F.explode("sids").alias("sid"), F.lit(1).cast("long").alias("blocks"))
    keyed = materialise(lists.union(members.join(beyond, "cell").select(F.col("cell").alias("key"), "sid", "blocks")), "lists")
    vectors = real.join(members.select("sid").distinct(), "sid", "left_semi").groupBy("sid").agg(F.first("n").alias("n"), F.first("counts").alias("data"))

    def by_bounds(n: np.ndarray, data: list[bytes]) -> list[tuple[int, int]]:
        return bound_forest(folded([np.frombuffer(x, "<u2") for x in data]), n, scheme)

    def bound_pair(n: int, data: bytes, m: int, other: bytes) -> bool:
        a, b = folded([np.frombuffer(data, "<u2"), np.frombuffer(other, "<u2")])
        return bool(np.minimum(a, b).sum() >= scheme.need(n, m))

    near = connected_components(_edges(keyed, lambda k: k.join(vectors.hint("merge"), "sid"), by_bounds, bound_pair, "near"), "near").select(F.col("node").alias("sid"), F.col("root").alias("key"))
    near = materialise(near, "near-sets")
    free_shuffles(docs.sparkSession)

    # the sets of what is left, from the texts themselves
    wanted = near.join(reps, "sid")
    weight = wanted.groupBy("key").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("blocks"))
    wanted = materialise(wanted.join(weight, "key").select("row", "sid", "key", "n", "blocks"), "wanted-sets")
    arrow = pa.schema([("sid", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("blocks", pa.int64()), ("data", pa.binary())])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                data = pa.array([s.tobytes() for s in shingle_sets(part["text"], size)], pa.binary())
                yield pa.RecordBatch.from_arrays([*[part[c] for c in ("sid", "key", "n", "blocks")], data], schema=arrow)

    def sets(some: DataFrame) -> DataFrame:
        # texts are shuffled at every size: what they are joined with grows with them
        texts = _rows(docs).select("text", "row").join(some.hint("merge"), "row").dropDuplicates(["sid"])
        return texts.select("text", "sid", "key", "n", "blocks").mapInArrow(load, "sid long, key long, n long, blocks long, data binary")

    def by_sets(n: np.ndarray, data: list[bytes]) -> list[tuple[int, int]]:
        return verified_forest([np.frombuffer(x, "u8") for x in data], scheme)

    def set_pair(n: int, data: bytes, m: int, other: bytes) -> bool:
        common = len(np.intersect1d(np.frombuffer(data, "u8"), np.frombuffer(other, "u8"), assume_unique=True))
        return bool(scheme.linked(common, n, m))

    linked = connected_components(_edges(wanted, sets, by_sets, set_pair, "linked"), "linked").select(F.col("node").alias("sid"), "root")
    named = real.groupBy("sid").agg(F.min("doc_id").alias("first_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("best"))
    rooted = named.join(linked, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    parts = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.min("best").alias("best"))
    by_sid = rooted.select("sid", "root").join(parts, "root").select("sid", "component_id", F.col("best.row").alias("best_row"))
    out = profiles.select("doc_id", "row", "sid", F.col("n").alias("n_shingles")).join(by_sid, "sid", "left")
    alone = F.col("sid").isNull()
    return out.select(
        "doc_id", "row", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), (alone | (F.col("row") == F.col("best_row"))).alias("keeper")
    )


def deduplicate(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of each component, as it was; rows without words all stay.

    Rows of equal id and text are one: that whose other columns have the smallest hash (maps do not count) stays.
    """
    keep = join(docs.select("doc_id", "text"), size, num, den).where("keeper").select(F.col("row").alias("_row")).distinct()
    own = Carried(docs)
    others = [F.col(f.name) for f in own.table.schema if "map<" not in f.dataType.simpleString()]
    marked = own.table.withColumn("_row", F.xxhash64(own["doc_id"], own["text"])).join(keep, "_row")
    # rows whose 64-bit hash alone is equal are told apart by a second one
    marked = marked.withColumns({"_again": F.xxhash64(F.lit(1), own["text"], own["doc_id"]), "_tie": F.xxhash64(*others)})
    one = marked.groupBy("_row", "_again").agg(F.min_by(F.struct(*own.table.columns), "_tie").alias("_one"))
    return one.select("_one.*").select(*own.columns())


def join_query(docs: DataFrame) -> DataFrame:
    return join(docs.select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")

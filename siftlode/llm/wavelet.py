"""Token-ID output: one wavelet matrix per shard of documents in ascending id order.

A shard file holds the documents' ids and lengths and the wavelet matrix of all their token ids: the alphabet in use is
renumbered 0..s-1, each bit of the numbers from the highest is a plane, and after every plane the sequence is stably
parted by that bit.  Planes are packed and cut into blocks, each compressed with zstd on its own; a directory says how
many ones stand before each block and where it is in the file.  Rank and select go by the directory to one block, so
access to a token, counting a token in a range and finding an occurrence read a few blocks of a plane, not the file.

Range partitioning deals the documents out by id; each task writes shards of about ``SHARD_TOKENS`` tokens with a name
of their own, of which only those that finished tasks list are read.  The start of a shard is the sum of all before it,
summed in two steps so that no task takes all shards.

Defined results: null text counts as empty and has only the end token; null ids come first; rows that share an id are
ordered by text, null first; an empty table gives no shards; other columns are ignored.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlode.llm.common import materialise, partitions_for, read_file, scratch, write_file
from siftlode.llm.encoding import default_path, encoder
from siftlode.llm.packing import release

SHARD_TOKENS = 4_000_000
#: Bits of a plane that are compressed together; a whole number of bytes.
BLOCK_BITS = 1 << 18
#: Blocks that a reader keeps.
KEPT_BLOCKS = 64
#: Range partitions whose shards are summed together.
GROUP_PARTS = 1024
END = 2
_MAGIC = b"SLWM0002"


class WaveletMatrix:
    """Wavelet matrix of a sequence of 16-bit token ids; ``block(level, b)`` gives the bytes of a plane's block."""

    def __init__(self, n: int, alphabet: np.ndarray, counts: np.ndarray, ones: np.ndarray, block: Callable[[int, int], np.ndarray]):
        self.n, self.alphabet, self.counts, self.ones, self.block = n, alphabet, counts, ones, block
        self.levels = len(ones)
        self.zeros = [n - int(x[-1]) for x in ones]

    @staticmethod
    def build(ids: np.ndarray) -> WaveletMatrix:
        seen = np.zeros(1 << 16, bool)
        seen[ids] = True
        alphabet = np.flatnonzero(seen).astype("<u2")
        number = np.zeros(1 << 16, "<u2")
        number[alphabet] = np.arange(len(alphabet))
        rest = number[ids]
        levels = max(1, int(len(alphabet) - 1).bit_length()) if len(alphabet) else 0
        planes, parted = [], np.empty_like(rest)
        step = BLOCK_BITS // 8
        ones = np.zeros((levels, -(-len(rest) // BLOCK_BITS) + 1), "<u4")
        for k, level in enumerate(range(levels - 1, -1, -1)):
            bit = (rest & (1 << level)) != 0
            planes.append(np.packbits(bit, bitorder="little"))
            ones[k, 1:] = np.cumsum(np.add.reduceat(np.bitwise_count(planes[-1]), np.arange(0, len(planes[-1]), step), dtype="i8"))
            zeros = len(rest) - int(ones[k, -1])
            np.compress(~bit, rest, out=parted[:zeros])
            np.compress(bit, rest, out=parted[zeros:])
            rest, parted = parted, rest
        return WaveletMatrix(len(ids), alphabet, np.bincount(ids, minlength=1 << 16)[alphabet], ones, lambda k, b: planes[k][b * step : (b + 1) * step])

    def _bits(self, level: int) -> np.ndarray:
        blocks = [self.block(level, b) for b in range(self.ones.shape[1] - 1)]
        return np.unpackbits(np.concatenate(blocks) if blocks else np.zeros(0, "u1"), count=self.n, bitorder="little")

    def _rank1(self, level: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ones before each of the positions, and the bits there (0 at the end)."""
        at = np.asarray(at, "i8")
        where, inside = at // BLOCK_BITS, at % BLOCK_BITS
        out, bit = self.ones[level][where].astype("i8"), np.zeros(len(at), "u1")
        for b in np.unique(where[at < self.n]):
            own = np.flatnonzero((where == b) & (at < self.n))
            block = self.block(level, int(b))
            byte, shift = inside[own] // 8, (inside[own] % 8).astype("u1")
            out[own] += np.cumsum(np.concatenate([[0], np.bitwise_count(block)]))[byte] + np.bitwise_count(block[byte] & ((1 << shift) - 1).astype("u1"))
            bit[own] = (block[byte] >> shift) & 1
        last = np.flatnonzero(at >= self.n)
        out[last] = self.ones[level][-1]
        return out, bit

    def _select(self, level: int, bit: bool, k: np.ndarray) -> np.ndarray:
        """Position of each k-th (from 0) bit of the kind."""
        ones = self.ones[level].astype("i8")
        ahead = ones if bit else np.minimum(np.arange(len(ones)) * BLOCK_BITS, self.n) - ones
        where = np.searchsorted(ahead, k, side="right") - 1
        out = np.empty(len(k), "i8")
        for b in np.unique(where):
            own = where == b
            bits = np.unpackbits(self.block(level, int(b)), count=min(BLOCK_BITS, self.n - int(b) * BLOCK_BITS), bitorder="little")
            out[own] = int(b) * BLOCK_BITS + np.flatnonzero(bits == bit)[k[own] - ahead[b]]
        return out

    def access(self, at) -> np.ndarray:
        """Token ids at the positions."""
        at = np.asarray(at, "i8")
        value = np.zeros(len(at), "i8")
        for level in range(self.levels):
            ones, bit = self._rank1(level, at)
            at = np.where(bit, self.zeros[level] + ones, at - ones)
            value = value * 2 + bit
        return self.alphabet[value]

    def _range(self, token: int, start: int, stop: int) -> tuple[int, int]:
        """Where the token's occurrences in [start, stop) stand after the last plane."""
        k = int(np.searchsorted(self.alphabet, token))
        if k == len(self.alphabet) or self.alphabet[k] != token:
            return 0, 0
        for level in range(self.levels):
            a, b = self._rank1(level, np.array([start, stop]))[0]
            if k >> (self.levels - 1 - level) & 1:
                start, stop = self.zeros[level] + int(a), self.zeros[level] + int(b)
            else:
                start, stop = start - int(a), stop - int(b)
        return start, stop

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """Occurrences of a token in [start, stop)."""
        a, b = self._range(token, start, self.n if stop is None else stop)
        return b - a

    def occurrences(self, token: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Positions of a token in [start, stop), ascending."""
        a, b = self._range(token, start, self.n if stop is None else stop)
        if a == b:
            return np.zeros(0, "i8")
        k, at = int(np.searchsorted(self.alphabet, token)), np.arange(a, b)
        for level in range(self.levels - 1, -1, -1):
            bit = bool(k >> (self.levels - 1 - level) & 1)
            at = self._select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def decode(self) -> np.ndarray:
        """All token ids: positions go through the partings; after the last plane tokens stand in bit-reversed order."""
        at, parted = np.arange(self.n, dtype="u4"), np.empty(self.n, "u4")
        for level in range(self.levels):
            bit = self._bits(level).view(bool)
            np.compress(~bit, at, out=parted[: self.zeros[level]])
            np.compress(bit, at, out=parted[self.zeros[level] :])
            at, parted = parted, at
        number = np.arange(len(self.alphabet))
        turned = sum(((number >> k & 1) << (self.levels - 1 - k) for k in range(self.levels)), np.zeros_like(number))
        order = np.argsort(turned)
        out = np.empty(self.n, "<u2")
        out[at] = np.repeat(self.alphabet[order], self.counts[order])
        return out

    def to_bytes(self, ids: list[int | None], lengths: np.ndarray) -> bytes:
        """The shard file: magic, header, compressed sections, then the planes' compressed blocks."""
        pack = zstandard.ZstdCompressor(level=1).compress
        null = np.array([i is None for i in ids], "u1")
        known = np.array([0 if i is None else i for i in ids], "<i8")
        blocks = [pack(self.block(level, b).tobytes()) for level in range(self.levels) for b in range(self.ones.shape[1] - 1)]
        raw = {
            "ids": known, "null": null, "lengths": np.asarray(lengths, "<u4"), "alphabet": self.alphabet.astype("<u2"), "counts": self.counts.astype("<u4"),
            "ones": self.ones.astype("<u4"), "sizes": np.array([len(x) for x in blocks], "<u4"),
        }
        sections = {k: pack(x.tobytes()) for k, x in raw.items()}
        head = json.dumps({"n": self.n, "levels": self.levels, "block_bits": BLOCK_BITS, "sections": {k: len(x) for k, x in sections.items()}}).encode()
        return _MAGIC + len(head).to_bytes(4, "little") + head + b"".join(sections.values()) + b"".join(blocks)


class Shard:
    """A shard file of which ``read(offset, length)`` gives parts; only what is asked for is read."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self.read, self.unpack = read, zstandard.ZstdDecompressor().decompress
        start = read(0, 12)
        if start[:8] != _MAGIC:
            raise ValueError("not a wavelet shard")
        size = int.from_bytes(start[8:12], "little")
        self.head = json.loads(read(12, size))
        if self.head["block_bits"] != BLOCK_BITS:
            raise ValueError("the shard has blocks of another size")
        self.places, at = {}, 12 + size
        for name, n in self.head["sections"].items():
            self.places[name] = at, n
            at += n
        sizes = self._section("sizes", "<u4").astype("i8").reshape(self.head["levels"], -1) if self.head["n"] else np.zeros((0, 0), "i8")
        self.sizes, self.starts = sizes, at + np.cumsum(sizes.ravel()).reshape(sizes.shape) - sizes
        self.kept: OrderedDict[tuple[int, int], np.ndarray] = OrderedDict()

    @staticmethod
    def open(uri: str) -> Shard:
        return Shard(lambda offset, length: read_file(uri, offset, length))

    @staticmethod
    def of(data: bytes) -> Shard:
        return Shard(lambda offset, length: data[offset : offset + length])

    def _section(self, name: str, kind: str) -> np.ndarray:
        return np.frombuffer(self.unpack(self.read(*self.places[name])), kind)

    def _block(self, level: int, b: int) -> np.ndarray:
        if (level, b) not in self.kept:
            self.kept[level, b] = np.frombuffer(self.unpack(self.read(int(self.starts[level, b]), int(self.sizes[level, b]))), "u1")
            if len(self.kept) > KEPT_BLOCKS:
                self.kept.popitem(last=False)
        return self.kept[level, b]

    def matrix(self) -> WaveletMatrix:
        ones = self._section("ones", "<u4").reshape(self.head["levels"], -(-self.head["n"] // BLOCK_BITS) + 1)
        return WaveletMatrix(self.head["n"], self._section("alphabet", "<u2"), self._section("counts", "<u4"), ones, self._block)

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """The documents' ids and lengths."""
        ids, null = self._section("ids", "<i8"), self._section("null", "u1")
        return [None if z else i for i, z in zip(ids.tolist(), null.tolist(), strict=True)], self._section("lengths", "<u4")


def write_shards(docs: DataFrame, vocabulary: str | None = None, end: int = END, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write ``docs`` (doc_id, text) to shard files; returns their list (part, seq, uri, docs, tokens)."""
    path = vocabulary or default_path()
    folder = scratch(docs.sparkSession, "wavelet")
    own = docs.select("doc_id", "text")
    # rows without an id would all be one range; the start of their texts parts them further
    more = F.when(F.col("doc_id").isNull(), F.substring("text", 1, 32))
    dealt = own.repartitionByRange(partitions_for(own), F.col("doc_id"), more).sortWithinPartitions("doc_id", "text")

    listing = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("uri", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())])
    names = listing.names

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        ids: list[int | None] = []
        parts: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def close() -> None:
            tokens = np.concatenate(parts)
            uri = f"{folder}/{uuid.uuid4().hex}.wavelet"
            write_file(uri, WaveletMatrix.build(tokens).to_bytes(ids, np.concatenate(sizes)))
            done.append((TaskContext.get().partitionId(), len(done), uri, len(ids), len(tokens)))
            ids.clear(), parts.clear(), sizes.clear()
            del tokens
            release()

        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                chunk = batch.slice(at, 2000)
                tokens, lengths = encoder(path).encode(chunk["text"], end)
                ids += chunk["doc_id"].to_pylist()
                parts.append(tokens), sizes.append(lengths)
                if sum(map(len, parts)) >= shard_tokens:
                    close()
        if ids:
            close()
        yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in done], listing)

    return materialise(dealt.mapInArrow(write, "part int, seq int, uri string, docs long, tokens long"), "wavelet-list")


def _placed(listed: DataFrame) -> DataFrame:
    """``listed`` with the ``start`` of every shard."""
    before = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grouped = listed.withColumn("group", F.floor(F.col("part") / GROUP_PARTS))
    groups = grouped.groupBy("group").agg(F.sum("tokens").alias("tokens"))  # a row for every GROUP_PARTS partitions
    groups = groups.select("group", before(Window.orderBy("group")).alias("ahead"))
    inner = before(Window.partitionBy("group").orderBy("part", "seq"))
    return grouped.join(groups, "group").withColumn("start", F.col("ahead") + inner).drop("group", "ahead")


def _spread(listed: DataFrame) -> DataFrame:
    session = listed.sparkSession
    return listed.repartition(max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions"))))


def read_shards(listed: DataFrame) -> DataFrame:
    """One row for each document of the listed shards: doc_id, start, n_tokens, ids_crc32."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for uri, start in zip(pdf["uri"], pdf["start"], strict=True):
                shard = Shard.of(read_file(uri))  # all of it is wanted
                ids, lengths = shard.documents()
                raw = memoryview(shard.matrix().decode().astype("<u4").tobytes())
                stop = np.cumsum(lengths, dtype="i8")
                crc = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(stop.tolist(), lengths.tolist(), strict=True)]
                yield pd.DataFrame(
                    {"doc_id": pd.array(ids, "Int64"), "start": start + stop - lengths, "n_tokens": lengths.astype("i8"), "ids_crc32": np.array(crc, "i8")}
                )

    return _spread(_placed(listed).select("uri", "start")).mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def count_tokens(listed: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, n): occurrences of each of the tokens in all listed shards, by rank."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for uri in pdf["uri"]:
                m = Shard.open(uri).matrix()
                yield pd.DataFrame({"token": np.array(tokens, "i8"), "n": np.array([m.count(t) for t in tokens], "i8")})

    return _spread(listed.select("uri")).mapInPandas(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def find_token(listed: DataFrame, token: int) -> DataFrame:
    """(doc_id, at): every occurrence of a token, by its position in the document; found by rank and select."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for uri in pdf["uri"]:
                shard = Shard.open(uri)
                at = shard.matrix().occurrences(token)
                if len(at):
                    ids, lengths = shard.documents()
                    stop = np.cumsum(lengths, dtype="i8")
                    own = np.searchsorted(stop, at, side="right")
                    yield pd.DataFrame({"doc_id": pd.array([ids[k] for k in own], "Int64"), "at": at - (stop - lengths)[own]})

    return _spread(listed.select("uri")).mapInPandas(find, "doc_id long, at long")


def shards_query(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    return read_shards(write_shards(docs, vocabulary))

"""URL filter: a sorted array of 64-bit digests, probed by vectorised binary search and confirmed by the stored strings.

A list entry is a host and a path prefix written together (``net/es/``).  It fits its host and all subdomains when the
URL's path starts with its path.  Of the fitting entries a rule (an entry that is marked ``first``) wins over others, then the
longest one, then that with the longest host.  The array of all entries' xxHash64 digests is sorted and written, with the
entries' strings and verdicts, to files in the shared folder, cut into shards by digest.  A URL asks for each of its
host's suffixes with each prefix of its path that is as long as some entry's path: probes are searched at once, and a
digest that is found counts only when the stored string is the probe's.

A list of one shard is mapped (or read, from a store that cannot be mapped) by every task.  Of a longer list each shard is
searched by one task: the digests of all different URLs' probes are dealt out by shard, 16 bytes each, and what they hit
comes back by URL and is confirmed against it.

Defined results: a null URL, or one without ``://``, has an empty host and path and fits nothing; null page ids and
repeated rows are judged like any other; empty tables and an empty list are fine; an entry listed more than once takes
the verdict ``block`` if any of its rows says so, those marked ``first`` before others; extra columns pass through
:func:`judge_urls`, except that columns named like its results are replaced.  URLs that fit no entry get the verdict ``allow``.
"""

from __future__ import annotations

import mmap
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlode.llm.common import Carried, is_local, local_path, lower_ascii, materialise, read_file, scratch, write_file
from siftlode.llm.packing import by_bucket

#: The rules of the query; fixed values.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: A tracking parameter in a URL.
TRACKING = r"^[^#?]*\?([^#]*&)?utm_"
#: Entries of one shard at most, roughly: bounds what a task maps at once.
SHARD_ENTRIES = 1_000_000
_BLOCK, _FIRST = 1, 2
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z in lower case) and path of a URL."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(_LOWER), re.match(r"[^?#]*", rest[len(host) :])[0]


def digest(entry: bytes) -> int:
    """Spark's xxhash64 of a string, as an unsigned number."""
    return xxhash.xxh64_intdigest(entry, 42)


def probes(host: str, path: str, lengths: list[int]) -> Iterator[bytes]:
    """What a URL asks for: each suffix of its host with each prefix of its path of one of the lengths (ascending)."""
    if host or path:
        labels = host.split(".")
        fitting = [path[:n] for n in lengths if n <= len(path)]
        for k in range(len(labels)):
            suffix = ".".join(labels[k:])
            for p in fitting:
                yield (suffix + p).encode("utf-8", "surrogatepass")


def strength(flags: int, entry: bytes) -> tuple[bool, int, int]:
    """Order of fitting entries: rules first, then by length in characters, then by the host's."""
    text = entry.decode("utf-8", "surrogatepass")
    return bool(flags & _FIRST), len(text), len(text.partition("/")[0])


class DigestArray:
    """One shard: sorted digests, string offsets, flags, then the strings; mapped where the file system allows it."""

    def __init__(self, uri: str):
        if is_local(uri):
            with open(local_path(uri), "rb") as f:
                data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        else:
            data = read_file(uri)
        n = int(np.frombuffer(data, "<u8", 1)[0])
        self.keys = np.frombuffer(data, "<u8", n, 8)
        self.offsets = np.frombuffer(data, "<u8", n + 1, 8 + 8 * n)
        self.flags = np.frombuffer(data, "u1", n, 16 + 16 * n)
        self.base, self.data = 16 + 17 * n, data

    @staticmethod
    def pack(entries: list[tuple[bytes, int]]) -> bytes:
        rows = sorted((digest(e), e, f) for e, f in entries)
        ends = np.cumsum([0, *[len(e) for _, e, _ in rows]]).astype("<u8")
        head = [np.array([len(rows)], "<u8"), np.array([k for k, _, _ in rows], "<u8"), ends, np.array([f for _, _, f in rows], "u1")]
        return b"".join(x.tobytes() for x in head) + b"".join(e for _, e, _ in rows)

    def entry(self, k: int) -> bytes:
        return bytes(self.data[self.base + int(self.offsets[k]) : self.base + int(self.offsets[k + 1])])

    def hits(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in ``digests``, place in the array) of equal digests; entries that share one all count."""
        low, high = np.searchsorted(self.keys, digests), np.searchsorted(self.keys, digests, side="right")
        n = high - low
        at = np.repeat(np.arange(len(digests)), n)
        return at, np.repeat(low - (np.cumsum(n) - n), n) + np.arange(len(at))

    def find(self, digests: np.ndarray, strings: list[bytes]) -> np.ndarray:
        """For each probe the flags of the entry that is this very string, -1 if there is none."""
        out = np.full(len(strings), -1, "i1")
        for i, k in zip(*self.hits(digests), strict=True):
            if self.entry(k) == strings[i]:
                out[i] = self.flags[k]
        return out


def build(entries: DataFrame, shard_entries: int | None = None) -> tuple[str, int, list[int]]:
    """Write the array of ``entries`` (entry, verdict, and perhaps first): folder, number of shards, path lengths.

    Path lengths are bounded by the longest URL, not by the number of entries.
    """
    spark = entries.sparkSession
    first = F.coalesce(F.col("first"), F.lit(False)) if "first" in entries.columns else F.lit(False)
    flag = F.when(F.col("verdict") == "block", _BLOCK).otherwise(0) + F.when(first, _FIRST).otherwise(0)
    clean = entries.where(F.col("entry").isNotNull()).groupBy("entry").agg(F.max(flag).alias("flags"))
    n, lengths = clean.agg(F.count(F.lit(1)), F.collect_set(F.length("entry") - F.coalesce(F.nullif(F.instr("entry", "/"), F.lit(0)) - 1, F.length("entry")))).first()
    shards = max(1, -(-n // (shard_entries or SHARD_ENTRIES)))
    folder = scratch(spark, "digests")

    def write(shard: int, pdf: pd.DataFrame) -> pd.DataFrame:
        packed = DigestArray.pack([(e.encode("utf-8", "surrogatepass"), f) for e, f in zip(pdf["entry"], pdf["flags"], strict=True)])
        write_file(f"{folder}/{shard}.digests", packed)
        return pd.DataFrame({"shard": [shard], "n": [len(pdf)]})

    place = F.shiftright(F.shiftrightunsigned(F.xxhash64("entry"), 32) * shards, 32)
    materialise(by_bucket(clean.select(place.alias("bucket"), "entry", "flags"), shards, write, "shard long, n long"), "digest-list")  # writes the files
    return folder, shards, sorted(int(x) for x in lengths)


def _opened(folder: str, shard: int) -> DigestArray | None:
    """A shard's array; none where no entry fell into it."""
    uri = f"{folder}/{shard}.digests"
    try:
        return DigestArray(uri) if not is_local(uri) or os.path.exists(local_path(uri)) else None
    except FileNotFoundError:
        return None


_RESULTS = ("host", "path", "rule", "verdict")


def _judge_here(own: Carried, folder: str, lengths: list[int]) -> DataFrame:
    """The table with its results, by one shard that every task opens."""
    schema = T.StructType([*own.table.schema, *[T.StructField(f"_{c}", T.StringType()) for c in _RESULTS]])
    url = f"u{[n.lower() for n in own.names].index('url')}"

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        array = _opened(folder, 0)
        for pdf in batches:
            split = [parts(u if isinstance(u, str) else None) for u in pdf[url]]
            asked = [(i, p) for i, (host, path) in enumerate(split) for p in probes(host, path, lengths)] if array else []
            strings = [p for _, p in asked]
            keys = np.fromiter((digest(p) for p in strings), "<u8", len(strings))
            found = array.find(keys, strings) if array else np.zeros(0, "i1")
            best: dict[int, tuple] = {}
            for j in np.flatnonzero(found >= 0):
                i, p = asked[j]
                best[i] = max(best.get(i, ((), b"", 0)), (strength(int(found[j]), p), p, int(found[j])))
            rule = [best[i][1].decode("utf-8", "surrogatepass") if i in best else None for i in range(len(pdf))]
            verdict = ["block" if i in best and best[i][2] & _BLOCK else "allow" for i in range(len(pdf))]
            yield pdf.assign(_host=[h for h, _ in split], _path=[p for _, p in split], _rule=rule, _verdict=verdict)

    return own.table.mapInPandas(judge, schema)


def _judge_dealt(own: Carried, folder: str, shards: int, lengths: list[int]) -> DataFrame:
    """The same, each shard searched by one task."""
    url = own["url"]

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            of, keys = [], []
            for u, h in zip(pdf["url"], pdf["of"], strict=True):
                mine = [digest(p) for p in probes(*parts(u), lengths)]
                keys += mine
                of += [h] * len(mine)
            k = np.array(keys, "u8")
            yield pd.DataFrame({"bucket": (((k >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype("i8"), "of": np.array(of, "i8"), "key": k.view("i8")})

    def search(shard: int, pdf: pd.DataFrame) -> pd.DataFrame:
        array = _opened(folder, shard)
        if array is None:
            return pd.DataFrame({"of": np.zeros(0, "i8"), "entry": [], "flags": np.zeros(0, "i4")})
        at, k = array.hits(pdf["key"].to_numpy().view("u8"))
        return pd.DataFrame(
            {"of": pdf["of"].to_numpy()[at], "entry": [array.entry(x).decode("utf-8", "surrogatepass") for x in k], "flags": array.flags[k].astype("i4")}
        )

    urls = own.table.where(F.contains(url, F.lit("://"))).select(url.alias("url")).distinct().select("url", F.xxhash64("url").alias("of"))
    asked = urls.mapInPandas(ask, "bucket long, of long, key long")
    hits = by_bucket(asked, shards, search, "of long, entry string, flags int").distinct()
    # at most as many entries as a URL has probes
    hits = materialise(hits.groupBy("of").agg(F.collect_list(F.struct("entry", "flags")).alias("_hits")), "url-hits")

    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.instr(url, F.lit("://")) + 3)).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    table = own.table.withColumns({"_of": F.xxhash64(url), "_host": lower_ascii(raw), "_path": F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"^[^?#]*", 0)})
    table = table.join(hits.withColumnRenamed("of", "_of"), "_of", "left")

    def rank(x: Column) -> Column:
        cut = F.instr(x["entry"], F.lit("/"))
        host = F.when(cut > 0, F.left(x["entry"], cut - 1)).otherwise(x["entry"])
        path = F.when(cut > 0, F.substr(x["entry"], cut)).otherwise(F.lit(""))
        fits = ((F.col("_host") == host) | F.endswith("_host", F.concat(F.lit("."), host))) & F.startswith("_path", path)
        return F.when(fits, F.struct((x["flags"] >= _FIRST).alias("first"), F.length(x["entry"]).alias("n"), F.length(host).alias("h"), x["entry"].alias("entry"), x["flags"].alias("flags")))

    best = F.array_max(F.transform("_hits", rank))
    judged = table.withColumn("_best", best)
    block = F.coalesce(F.col("_best.flags").bitwiseAND(F.lit(_BLOCK)) > 0, F.lit(False))
    return judged.withColumns({"_rule": F.col("_best.entry"), "_verdict": F.when(block, "block").otherwise("allow")})


def judge_urls(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (the fitting entry that wins, or null) and ``verdict`` of every row."""
    folder, shards, lengths = build(entries)
    own = Carried(pages)
    judged = _judge_here(own, folder, lengths) if shards == 1 else _judge_dealt(own, folder, shards, lengths)
    return judged.select(*own.columns(replaced=_RESULTS), *[F.col(f"_{c}").alias(c) for c in _RESULTS])


def tracked(pages: DataFrame) -> DataFrame:
    """(entry, verdict): blocks the addresses (host and path) of URLs with a tracking parameter, as links in campaigns have."""
    rest = F.substr("url", F.instr("url", F.lit("://")) + 3)
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    entry = F.concat(lower_ascii(raw), F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"^[^?#]*", 0))
    found = pages.where(F.contains("url", F.lit("://")) & F.rlike("url", F.lit(TRACKING)))
    return found.select(entry.alias("entry"), F.lit("block").alias("verdict")).where("entry <> ''").distinct()


def urls_query(pages: DataFrame) -> DataFrame:
    """Rules first; where none fits, the list of tracked addresses decides, which grows with the table."""
    rules = pages.sparkSession.createDataFrame(list(RULES), "entry string, verdict string")
    entries = rules.withColumn("first", F.lit(True)).unionByName(tracked(pages).withColumn("first", F.lit(False)))
    judged = judge_urls(pages.select("page_id", "url"), entries)
    ruled = F.col("rule").isin([r for r, _ in RULES])
    return judged.select(
        "page_id", "host", "path", F.when(ruled, F.col("rule")).alias("rule"), "verdict", F.when(~ruled, F.col("rule")).alias("blocklist_entry")
    )

"""Shared pieces of the training-data operators: scratch tables, portable file access and column helpers."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and U+0009 to U+000D.
WHITESPACE = " \t\n\x0b\f\r"
#: The same as a Java regular expression class.
WHITESPACE_CLASS = r"[\x20\x09-\x0D]"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder (URI, not yet created) in the shared folder that ``spark.checkpoint.dir`` names.

    Only where that setting is unset and the master is this machine (tests) a local temporary folder takes its place; it
    is removed at exit.  On a cluster executors could not see each other's local folders, so that raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _local_base()
    return f"{base.rstrip('/')}/siftlode/{name}-{uuid.uuid4().hex}"


_LOCAL: list[str] = []


def _local_base() -> str:
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="siftlode-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return f"file://{_LOCAL[0]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark, schema = df.sparkSession, df.schema
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that nothing refers to any more, which it does when the driver's garbage
    is collected.  Called once or twice by operators whose shuffles are several times their input."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def input_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of the size of ``df``; sets numbers of buckets, never results."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def partitions_for(df: DataFrame, bytes_each: int = 16 << 20) -> int:
    """Buckets so that each holds about ``bytes_each`` of the input; at least the session's shuffle partitions.

    Where the optimiser does not know the size (rows from Python, RDDs) the texts are measured.
    """
    size = input_bytes(df)
    if size >= 1 << 57:
        size = df.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // bytes_each))


class Carried:
    """A table whose columns are called u0, u1, ... while an operator adds its own, so that no two names clash.

    ``columns`` gives them back under their names and with their values, but for those that results replace.
    """

    def __init__(self, table: DataFrame):
        self.names = table.columns
        self.table = table.toDF(*[f"u{i}" for i in range(len(self.names))])

    def __getitem__(self, name: str) -> Column:
        exact = [i for i, n in enumerate(self.names) if n == name]
        i = (exact or [i for i, n in enumerate(self.names) if n.lower() == name.lower()])[0]
        return F.col(f"u{i}")

    def columns(self, replaced: tuple[str, ...] = ()) -> list[Column]:
        return [F.col(f"u{i}").alias(n) for i, n in enumerate(self.names) if n.lower() not in replaced]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it inside lambda functions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of ``text`` in order; none for null."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(WHITESPACE))
    return let(bare, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WHITESPACE_CLASS + "+")))


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z in lower case and every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def is_local(uri: str) -> bool:
    return urlparse(uri).scheme in ("", "file")


def local_path(uri: str) -> str:
    return urlparse(uri).path if uri.startswith("file:") else uri


def write_file(uri: str, data: bytes) -> None:
    """Write a file on any file system whole or not at all: to a name of its own, then renamed.

    A repeated or speculative task replaces the file by an equal one.
    """
    unique = f"{uri}.{uuid.uuid4().hex}.part"
    if is_local(uri):
        path, part = local_path(uri), local_path(unique)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    _, part = fs.FileSystem.from_uri(unique)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, path)


def read_file(uri: str, offset: int = 0, length: int | None = None) -> bytes:
    """Bytes of a file on any file system, or ``length`` of them from ``offset``."""
    if is_local(uri):
        with open(local_path(uri), "rb") as f:
            f.seek(offset)
            return f.read() if length is None else f.read(length)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        f.seek(offset)
        return f.read() if length is None else f.read(length)

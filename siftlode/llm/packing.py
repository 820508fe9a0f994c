"""Arrays packed into one binary value, so that many numbers travel as one row, and bucket ids dealt out one to one.

Defined results: empty arrays come back empty with their type; an empty table has no groups; other columns of a table travel along.
"""

from __future__ import annotations

import ctypes
import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return zstandard.ZstdCompressor(level=3).compress(out.getvalue())


def unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(data))) as f:
        return {k: f[k] for k in f.files}


def by_bucket(rows: DataFrame, buckets: int, own: Callable[[int, pd.DataFrame], pd.DataFrame], schema: str, place: Column | None = None) -> DataFrame:
    """``own(bucket, rows)`` of every value of the column ``bucket``, each in partition ``place % buckets`` (else the bucket's own number).

    A grouping would hash the few ids, so that some partitions get several and others none.  Each group is gathered
    by its task, so it must be bounded; columns that the result has not may be dropped before.
    """
    dealt = rows.repartitionById(buckets, F.pmod(F.col("bucket") if place is None else place, F.lit(buckets)).cast("int")).sortWithinPartitions("bucket")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, parts = None, []
        for pdf in batches:
            at = pdf["bucket"].to_numpy()
            cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if parts and at[a] != key:
                    yield own(key, parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True))
                    parts = []
                key = int(at[a])
                parts.append(pdf.iloc[a:b])
        if parts:
            yield own(key, parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True))

    return dealt.mapInPandas(run, schema)


def small(x: np.ndarray) -> np.ndarray:
    """The narrowest unsigned type that holds ``x``."""
    top = int(x.max()) if x.size else 0
    return x.astype("u1" if top < 1 << 8 else "u2" if top < 1 << 16 else "u4" if top < 1 << 32 else "u8")


def ascending(x: np.ndarray) -> np.ndarray:
    """Sorted 64-bit numbers as differences, bytes of equal weight together, which compress well."""
    return np.ascontiguousarray(np.diff(x, prepend=np.uint64(0)).view("u1").reshape(-1, 8).T)


def back(x: np.ndarray) -> np.ndarray:
    """The numbers that :func:`ascending` packed."""
    return np.cumsum(np.ascontiguousarray(x.T).view("u8").ravel(), dtype="u8")


def release() -> None:
    """Give freed memory back to the system: idle Python workers otherwise keep their peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass

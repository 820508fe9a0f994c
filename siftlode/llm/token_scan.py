"""Token counts: scanning flat, unindexed token files for end-of-document ids.

A flat file is nothing but 16-bit little-endian token ids; a document ends with the end id, which no text can produce.
Files are cut into blocks of ``BLOCK_TOKENS`` tokens that are read on their own; in each the ends are found by one
vectorised comparison.  A prefix scan over the blocks of a file then stitches documents that cross block boundaries:
it carries how many ends came before a block and where the last of them was.

Defined results: null text counts as empty and has 0 tokens; null ids and repeated rows keep their own rows; an empty
table gives no files and no rows; a file without a last end id yields its tail as one more document; other columns are
ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlode.llm.common import materialise, read_file, scratch, write_file
from siftlode.llm.encoding import default_path, encoder
from siftlode.llm.packing import release

BLOCK_TOKENS = 1 << 20
FILE_TOKENS = 1 << 23
#: <|endoftext|> of the default vocabulary; its string in a text is encoded as ordinary text.
END = 49407


def write_flat(docs: DataFrame, vocabulary: str | None = None, end: int = END, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write ``docs`` (doc_id, text) to flat token files as they are scanned, without a shuffle.

    Returns the list (uri, tokens, ids): ids are the documents' ids in the file's order; nothing tells where they end.
    """
    path = vocabulary or default_path()
    folder = scratch(docs.sparkSession, "flat")

    listing = pa.schema([("uri", pa.string()), ("tokens", pa.int64()), ("ids", pa.list_(pa.int64()))])
    names = listing.names

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        ids: list[int | None] = []
        parts: list[np.ndarray] = []

        def close() -> None:
            tokens = np.concatenate(parts)
            uri = f"{folder}/{uuid.uuid4().hex}.tokens"
            write_file(uri, tokens.tobytes())
            done.append((uri, len(tokens), list(ids)))
            ids.clear(), parts.clear()
            del tokens
            release()

        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                chunk = batch.slice(at, 2000)
                parts.append(encoder(path, special_as_text=True).encode(chunk["text"], end)[0])
                ids += chunk["doc_id"].to_pylist()
                if sum(map(len, parts)) >= file_tokens:
                    close()
        if ids:
            close()
        yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in done], listing)

    return materialise(docs.select("doc_id", "text").mapInArrow(write, "uri string, tokens long, ids array<long>"), "flat-list")


def scan(listed: DataFrame, end: int = END, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row for each document of flat files (uri, tokens): uri, ordinal, start, n_tokens without the end."""
    blocks = listed.select("uri", "tokens", F.explode(F.sequence(F.lit(0), F.floor((F.greatest(F.col("tokens"), F.lit(1)) - 1) / block_tokens))).alias("block"))
    blocks = blocks.repartition(max(blocks.sparkSession.sparkContext.defaultParallelism, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "uri", "block")

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ends = []
            for uri, block in zip(pdf["uri"], pdf["block"], strict=True):
                tokens = np.frombuffer(read_file(uri, 2 * block_tokens * block, 2 * block_tokens), "<u2")
                ends.append((np.flatnonzero(tokens == end) + block_tokens * block).astype("i8"))
            yield pdf.assign(ends=ends)

    found = blocks.mapInPandas(find, "uri string, tokens long, block long, ends array<long>")
    earlier = Window.partitionBy("uri").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = found.withColumns(
        {
            "before": F.coalesce(F.sum(F.size("ends")).over(earlier), F.lit(0)),
            "last_end": F.coalesce(F.max(F.try_element_at("ends", F.lit(-1))).over(earlier), F.lit(-1)),
        }
    )
    is_last = (F.col("block") + 1) * block_tokens >= F.col("tokens")
    open_tail = is_last & (F.coalesce(F.try_element_at("ends", F.lit(-1)), F.col("last_end")) < F.col("tokens") - 1)
    closed = stitched.withColumn("ends", F.when(open_tail, F.concat("ends", F.array("tokens"))).otherwise(F.col("ends")))
    each = closed.select("uri", "before", "last_end", F.posexplode("ends").alias("i", "stop"), F.col("ends"))
    start = F.when(F.col("i") > 0, F.get("ends", F.col("i") - 1)).otherwise(F.col("last_end")) + 1
    return each.select("uri", (F.col("before") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("stop") - start).alias("n_tokens"))


def scan_query(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Every document's id and token count, as found in the flat files."""
    listed = write_flat(docs, vocabulary)
    ids = listed.select("uri", F.posexplode("ids").alias("ordinal", "doc_id"))
    return scan(listed.select("uri", "tokens")).join(ids.hint("merge"), ["uri", "ordinal"]).select("doc_id", "n_tokens")

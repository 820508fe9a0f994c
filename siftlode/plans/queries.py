"""Queries of the retrieval operators over the driver's tables, each over whole tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlode.functions import paths, secrets, text, vectors
from siftlode.operators import chunking, embedding, evaluation, exact, hybrid, incremental, search, secret_scan
from siftlode.sources import files as file_source
from siftlode.sources import index_store, scratch, sessions

#: Extensions and names of the files that documents stand for.
EXTENSIONS = (".md", ".py", ".txt", ".jsonl", ".ts", ".json", ".ps1", ".go")
NAMES = (
    "README.md", ".env", "id_rsa", "yarn.lock", "server.pem", "node_modules/left.js", "docs/guide.md", ".codex/memories/m.md",
    ".codex/sessions/s.jsonl", "main.py", "Makefile", "Build/out.txt", "notes.v2.TXT", "app.config.json",
)
PATTERNS = ("token *=", "tion", "eau")
MIN_SCORE = 0.2
K = 8


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], by: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(by, F.lit(len(values))).cast("int"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files (path, text, source, doc_id)."""
    d = _table(spark, sf_dir, "documents")
    path = F.concat(F.lit("notes/"), "source", F.lit("/"), F.col("doc_id").cast("string"), _pick(EXTENSIONS, F.col("doc_id")))
    return d.select(path.alias("path"), "text", "doc_id")


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files with telling names (doc_id, path, size)."""
    path = F.concat(F.lit("/home/u/"), "source", F.lit("/"), _pick(NAMES, F.col("doc_id")))
    return _table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), (F.col("n_chars") * 1000).alias("size"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector scored for the stated query set: every vector whose id 50 divides, against all."""
    e = _table(spark, sf_dir, "embeddings")
    queries = e.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"), F.col("label").alias("query_label"))
    items = e.select(F.format_string("v/%09d", "vec_id").alias("path"), F.lit(0).alias("chunk"), "embedding", "label")
    return search.scores(items, queries)


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = search.top_k(_scored(spark, sf_dir), K, MIN_SCORE)
    return best.select("qid", "rank", "path", F.round("score", 4).alias("score"))


def vector_best_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.best_scores(_scored(spark, sf_dir)).select("qid", F.round("best_score", 6).alias("best_score"))


def confidence_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    others = _scored(spark, sf_dir).where(F.col("path") != F.format_string("v/%09d", "qid"))
    return search.confidence(others, 0.3)


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunking.chunk(_files(spark, sf_dir), redact=False)
    return c.select("doc_id", "chunk", "text", "start_line", "end_line", "byte_offset", "byte_end_offset")


def chunk_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunking.chunk(_files(spark, sf_dir), chunk_chars=600, overlap=80)
    return c.select("doc_id", "chunk", "text", "start_line", "byte_offset")


def chunk_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk(_files(spark, sf_dir), redact=False).select("path", "chunk", "language", "chunk_type", "symbol")


def chunk_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", text.preview(F.col("text"), 160).alias("preview"))


def file_skip_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _named(spark, sf_dir)
    return f.select("doc_id", "path", text.extension(F.col("path")).alias("extension"), paths.skipped(F.col("path"), F.col("size")).alias("skipped"))


def sensitive_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir).select("doc_id", "path", paths.sensitive_reason(F.col("path")).alias("reason"))


def file_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, key = paths.priority(F.col("path")), paths.priority_path(F.col("path"))
    return _named(spark, sf_dir).select("doc_id", "path", "size", p.alias("bucket"), key.alias("path_key"))


def secret_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", secrets.redact(F.col("text")).alias("text"))


def secret_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.findings(_files(spark, sf_dir).select("path", "text"))


def secret_scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _named(spark, sf_dir).select("doc_id", "path")
    texts = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return secret_scan.summary(named.join(texts, "doc_id").select("path", "text"))


def secret_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    found = d.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"({secrets.CANDIDATE})"), F.lit(1)))).alias("token"))
    return found.select("doc_id", "token", F.round(secrets.entropy(F.col("token")), 4).alias("entropy"), secrets.opaque(F.col("token")).alias("opaque"))


def exact_line_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.lines(_files(spark, sf_dir), PATTERNS[0])


def exact_hit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.by_path(exact.lines(_files(spark, sf_dir), PATTERNS[1]))


def exact_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.capped(exact.lines(_files(spark, sf_dir), PATTERNS[2]), 20, 400).select("path", "line", "column")


def hybrid_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries search the vectors, and the documents of the same ids for one of three patterns (80 lines each)."""
    ranked = search.top_k(_scored(spark, sf_dir), 2 * K, MIN_SCORE)
    semantic = ranked.select("qid", F.concat(F.lit("d/"), F.substr("path", F.lit(3)).cast("long").cast("string")).alias("path"), F.round("score", 4).alias("score"), "chunk")
    docs = _table(spark, sf_dir, "documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), "text")
    qids = ranked.select("qid").distinct().withColumn("pattern", F.pmod(F.floor(F.col("qid") / 50), F.lit(len(PATTERNS))))
    parts = [exact.capped(exact.lines(docs, p), exact.MAX_RESULTS, exact.MAX_RESULTS).select("path", "line").withColumn("pattern", F.lit(i).cast("long")) for i, p in enumerate(PATTERNS)]
    hits = parts[0].union(parts[1]).union(parts[2]).join(qids, "pattern").select("qid", "path", "line")
    return hybrid.merge(semantic, hits, K).drop("chunk")


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir)
    ranked = search.top_k(scored, K, -1.0).select("qid", "path", "rank")
    e = _table(spark, sf_dir, "embeddings")
    queries = e.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("qid"), "label")
    return evaluation.case_metrics(ranked, queries.join(e.select("label", F.format_string("v/%09d", "vec_id").alias("path")), "label").select("qid", "path"), K)


def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir)


def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.summary(_metrics(spark, sf_dir))


def latency_percentiles_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    return evaluation.percentile_index_by_rank(e, "event_type", "value", {"p50": 0.5, "p95": 0.95})


def latency_percentiles_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = lambda p: F.round(evaluation.percentile_nearest("value", p), 3)
    e = _table(spark, sf_dir, "events")
    out = e.groupBy("event_type").agg(near(0.5).alias("p50"), near(0.95).alias("p95"), F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select("event_type", "p50", "p95", F.round(evaluation.rate(F.col("n"), F.col("total")), 6).alias("per_second"))


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All documents as files now, and as they were: the French ones not there yet, the German ones shorter."""
    now = _table(spark, sf_dir, "documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text", "lang")
    was = now.where("lang <> 'fr'").withColumn("text", F.when(F.col("lang") == "de", F.substr("text", F.lit(2))).otherwise(F.col("text")))
    state = lambda d: d.select("path", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"), "text")
    return state(now), state(was)


def incremental_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, was = _snapshots(spark, sf_dir)
    return incremental.split(now.drop("text"), was).select("path", "sha256", "size", "reused")


def incremental_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, was = _snapshots(spark, sf_dir)
    return incremental.statistics(incremental.split(now.drop("text"), was), chunking.chunk(now.select("path", "text"), redact=False))


def chunk_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, _ = _snapshots(spark, sf_dir)
    counts = chunking.chunk(now.select("path", "text", "size"), redact=False).groupBy("path", "size").agg(F.count(F.lit(1)).alias("n"))
    return chunking.cap_total(counts, 500)


def _log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as log lines (conv_id, turn, line)."""
    c = _table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "input_text").otherwise("output_text")
    content = F.array(F.struct(kind.alias("type"), F.col("text").alias("text")))
    said = F.struct(F.lit("response_item").alias("type"), F.struct(F.lit("message").alias("type"), "role", content.alias("content")).alias("payload"))
    event = F.struct(F.lit("event_msg").alias("type"), F.struct(F.col("text").alias("message")).alias("payload"))
    return c.select("conv_id", "turn", F.when(F.col("role") == "system", F.to_json(event)).otherwise(F.to_json(said)).alias("line"))


def session_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages read back from log lines."""
    return _log_lines(spark, sf_dir).select("conv_id", "turn", sessions.message(F.col("line")).alias("message"))


def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 3).alias("v"))
    unit = e.select("vec_id", vectors.l2_normalize(F.col("v")).alias("u"))
    return unit.select("vec_id", F.round(vectors.dot(F.col("u"), F.col("u")), 6).alias("length"), F.round(F.get("u", F.lit(0)), 6).alias("first"))


def last_token_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings")
    hidden = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8))
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (i < F.col("label")).cast("int"))
    return e.select("vec_id", F.round(F.get(vectors.last_token_pool(hidden, mask), F.lit(0)).cast("double"), 6).alias("pooled"))


def query_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select("item_id", vectors.query_text(F.col("text")).alias("query"))


def _write_files(files: DataFrame, folder: str) -> None:
    """Writes (path, text) as files below a folder that all executors see."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, body in zip(pdf["path"], pdf["text"], strict=True):
                target = os.path.join(folder, path)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                part = f"{target}.{uuid.uuid4().hex}"
                with open(part, "wb") as f:
                    f.write((body or "").encode())
                os.replace(part, target)  # a task that runs again replaces the file by an equal one
            yield pd.DataFrame({"n": [len(pdf)]})

    scratch.written(files.select("path", "text").mapInPandas(write, "n long"), "written")


def _folder(spark: SparkSession, name: str) -> str:
    return urlparse(scratch.folder(spark, name)).path


def _below(folder: str) -> Column:
    return F.substr("path", F.lit(len(os.path.realpath(folder)) + 2))


def _tree(spark: SparkSession, sf_dir: str) -> str:
    """Documents as files with telling names, each in a folder of its own."""
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("/"), _pick(NAMES, F.col("doc_id")))
    folder = _folder(spark, "files")
    _write_files(_table(spark, sf_dir, "documents").select(path.alias("path"), "text"), folder)
    return folder


def file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file that a scan without pruning finds, and whether it is skipped."""
    folder = _tree(spark, sf_dir)
    f = file_source.scan(spark, [folder, f"{folder}/."], prune=False)
    return f.select(_below(folder).alias("path"), "size", paths.skipped(F.col("path"), F.col("size")).alias("skipped"))


def file_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of the files that a pruned scan keeps."""
    folder = _tree(spark, sf_dir)
    f = file_source.texts(file_source.scan(spark, [folder]))
    return f.select(_below(folder).alias("path"), "size", "sha256", F.length("text").alias("chars"))


def incremental_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of an earlier state indexed, then those of now over them: the second report."""
    now, was = _snapshots(spark, sf_dir)
    folder, index, provider = _folder(spark, "snapshot"), scratch.folder(spark, "index"), embedding.Lazy(embedding.HashingProvider)
    for state in (was, now):
        _write_files(state, folder)
        report = incremental.build(spark, [folder], index, lambda d: embedding.embed(d, provider), max_chunks_per_file=0)
    row = [report[k] for k in ("files_reused", "files_embedded", "chunks_reused", "chunks_to_embed", "chunks")] + report["vectors_shape"]
    return spark.createDataFrame([tuple(row)], "files_reused long, files_embedded long, chunks_reused long, chunks_to_embed long, chunks long, vectors long, dimension long")


def session_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as one log with blank, invalid and foreign lines, and its messages."""
    lines = _log_lines(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("rows"))
    log = F.array_join(F.transform("rows", lambda r: F.concat(r["line"], F.lit('\n\n{"cut\n[1, 2]'))), "\n")
    return lines.select("conv_id", sessions.messages(log).alias("text"))


def chunk_file_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.cap_per_file(chunking.chunk(_files(spark, sf_dir), 600, 80, redact=False), 3).select("doc_id", "chunk")


def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows: vectors stand for the documents of their ids."""
    path = F.format_string("v/%09d", "doc_id").alias("path")
    docs = _table(spark, sf_dir, "documents").select(path, "text", F.col("lang").alias("language"))
    best = search.top_k(_scored(spark, sf_dir), K, MIN_SCORE)
    return search.present(best.join(docs, "path"), 160)


def embed_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = embedding.embed(_table(spark, sf_dir, "benchmark"), embedding.Lazy(embedding.HashingProvider))
    return b.select("item_id", F.size("embedding").alias("dimension"), F.round(vectors.dot(F.col("embedding"), F.col("embedding")), 4).alias("length"))


def index_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all documents, embedded, written as an index and read back: chunks of each file."""
    state = F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"), F.lit(0.0).alias("mtime")
    chunks = embedding.embed(chunking.chunk(_files(spark, sf_dir).select("path", "text", *state)), embedding.HashingProvider())
    index = scratch.folder(spark, "index")
    index_store.write(chunks, index, [sf_dir], index_store.settings(chunking.CHUNK_CHARS, chunking.OVERLAP, 0, 0))
    stored, files = index_store.read(spark, index)
    found = stored.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min(F.size("embedding")).alias("dimension"))
    return files.join(found, "path").select("path", "chunks", "n", "dimension")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        vector_topk, vector_best_score, confidence_status, chunk_documents, chunk_redacted, chunk_metadata, chunk_preview, file_skip_filter,
        sensitive_reason, file_priority, secret_redact, secret_findings, secret_scan_summary, secret_entropy, exact_line_search,
        exact_hit_counts, exact_caps, hybrid_merge, retrieval_metrics, quality_summary, latency_percentiles_index,
        latency_percentiles_nearest, incremental_reuse, incremental_stats, chunk_cap, session_messages, l2_normalize, last_token_pool,
        query_prefix, file_scan, file_texts, embed_provider, index_roundtrip, incremental_build, session_logs, chunk_file_cap, search_results,
    )
}

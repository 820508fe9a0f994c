"""Command line: index, search, dual-search, secret-scan, status, bench, warm-bench, quality-bench, doctor, verify, smoke, serve.

Names of options and their defaults are fixed values."""

from __future__ import annotations

import argparse
import json
import os
import platform
import re
import shutil
import sys

import pyspark
from pyspark.sql import SparkSession

from siftlode.operators import chunking, incremental, search, secret_scan
from siftlode.operators.embedding import HashingProvider, Lazy, embed
from siftlode.service import Service
from siftlode.sources import files as file_source
from siftlode.sources import index_store


def setting(name: str, kind: type, default, least=None):
    """An environment variable SIFTLODE_<name>; the default where it is unset or cannot be read.

    A bool is one of 1/true/yes/on and 0/false/no/off; a path has its ~ expanded and must not be blank.
    """
    text = os.environ.get(f"SIFTLODE_{name}", "").strip()
    if not text:
        return default
    if kind is bool:
        return {**dict.fromkeys(("1", "true", "yes", "on"), True), **dict.fromkeys(("0", "false", "no", "off"), False)}.get(text.lower(), default)
    if kind is os.PathLike:
        return os.path.expanduser(text)
    try:
        value = kind(text)
    except ValueError:
        return default
    return value if least is None else max(least, value)


def version(text: str) -> tuple[int, ...]:
    return tuple(int(x) for x in re.findall(r"\d+", text)[:3])


def doctor(index: str) -> dict:
    """Environment and, as far as the file system shows it, the index."""
    checks = {"python": sys.version_info >= (3, 10), "java": shutil.which("java") is not None, "pyspark": version(pyspark.__version__) >= (4,)}
    known = "://" not in index  # another store is seen by Spark only
    there = os.path.isfile(os.path.join(index, "manifest.json"))
    missing = sorted([name for name, ok in checks.items() if not ok] + (["index"] if known and not there else []))
    report = {"ok": all(checks.values()), "checks": checks, "index": index, "index_found": there if known else None, "missing": missing}
    return report | {"python": platform.python_version(), "pyspark": pyspark.__version__}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siftlode")
    p.add_argument("--index", default=setting("INDEX", os.PathLike, "index"))
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("index")
    i.add_argument("--roots", nargs="*", default=[])
    i.add_argument("--extra-roots", nargs="*", default=[], help="must exist")
    i.add_argument("--sessions", help="a folder of session logs, if it exists")
    i.add_argument("--limit-mb", type=int, default=12)
    i.add_argument("--max-chunks", type=int, default=500)
    i.add_argument("--max-chunks-per-file", type=int, default=120)
    i.add_argument("--batch-size", type=int, default=setting("BATCH_SIZE", int, 8, 1))
    i.add_argument("--parallelism", type=int, default=setting("PARALLELISM", int, 1, 1))
    i.add_argument("--no-incremental", action="store_true", default=not setting("INCREMENTAL", bool, True))
    i.add_argument("--chunk-chars", type=int, default=chunking.CHUNK_CHARS)
    i.add_argument("--overlap", type=int, default=chunking.OVERLAP)
    i.add_argument("--fail-on-secret", action="store_true")
    for name in ("search", "dual-search"):
        s = sub.add_parser(name)
        s.add_argument("query")
        s.add_argument("--top-k", type=int, default=search.TOP_K)
        s.add_argument("--min-score", type=float, default=setting("MIN_SCORE", float, search.MIN_SCORE))
        s.add_argument("--preview-chars", type=int, default=search.PREVIEW_CHARS)
        if name == "dual-search":
            s.add_argument("--rg", help="pattern of the exact search")
            s.add_argument("--roots", nargs="*", default=[])
    x = sub.add_parser("secret-scan")
    x.add_argument("--roots", nargs="+", required=True)
    x.add_argument("--limit-mb", type=int, default=12)
    x.add_argument("--fail-on-secret", action="store_true")
    sub.add_parser("status")
    b = sub.add_parser("bench")
    b.add_argument("--iterations", type=int, default=20)
    b.add_argument("--warmup", type=int, default=2)
    b.add_argument("--sustain-seconds", type=float, default=0.0)
    b.add_argument("--batch-sizes", type=int, nargs="*")
    b.add_argument("--top-k", type=int, default=3)
    b.add_argument("--preview-chars", type=int, default=160)
    b.add_argument("--queries", nargs="*")
    w = sub.add_parser("warm-bench")
    w.add_argument("--iterations", type=int, default=20)
    w.add_argument("--top-k", type=int, default=3)
    w.add_argument("--min-score", type=float, default=0.3)
    w.add_argument("--queries", nargs="*")
    q = sub.add_parser("quality-bench")
    q.add_argument("cases")
    q.add_argument("--roots", nargs="*", default=[])
    q.add_argument("--top-k", type=int, default=search.TOP_K)
    q.add_argument("--min-score", type=float, default=setting("MIN_SCORE", float, search.MIN_SCORE))
    d = sub.add_parser("doctor")
    d.add_argument("--fail", action="store_true", help="exit with 1 where something is missing")
    sub.add_parser("verify")
    m = sub.add_parser("smoke")
    m.add_argument("--roots", nargs="*", default=[])
    sub.add_parser("serve")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    say = lambda x: print(json.dumps(x, ensure_ascii=False, indent=2, default=str))
    if a.command == "doctor":
        say(report := doctor(a.index))
        return int(bool(report["missing"]) and a.fail)
    spark = spark or SparkSession.builder.appName("siftlode").getOrCreate()
    provider = Lazy(HashingProvider)
    if a.command == "index":
        say(
            incremental.build(
                spark, file_source.plan_roots(a.roots, a.extra_roots, a.sessions), a.index,
                lambda d: embed(d, provider, batch_size=a.batch_size, parallelism=a.parallelism), limit_mb=a.limit_mb, chunk_chars=a.chunk_chars,
                overlap=a.overlap, max_chunks_per_file=a.max_chunks_per_file, max_chunks=a.max_chunks, fail_on_secret=a.fail_on_secret,
                reuse=not a.no_incremental,
            )
        )
        return 0
    if a.command == "secret-scan":
        files = file_source.texts(file_source.scan(spark, a.roots, a.limit_mb), a.limit_mb).select("path", "text")
        found = [r.asDict() for r in secret_scan.findings(files).collect()]
        say({"ok": not found, "status": "secret_findings" if found else "ok", "findings_count": len(found), "findings": found})
        return int(bool(found) and a.fail_on_secret)
    if a.command == "status":
        say(index_store.status(spark, a.index))
        return 0
    service = Service(spark, a.index, provider, setting("QUERY_CACHE", int, 128, 0))
    if a.command == "serve":
        service.serve(sys.stdin, sys.stdout)
        return 0
    params = {k: v for k, v in vars(a).items() if v is not None}
    if a.command == "quality-bench":
        with open(a.cases) as f:
            params["cases"] = json.load(f)
    method = {"search": "search", "dual-search": "dual_search", "bench": "benchmark", "quality-bench": "quality_benchmark", "warm-bench": "warm_benchmark"}.get(a.command, a.command)
    answer = service.handle(method, params)
    say(answer)
    return int(not answer["ok"])


if __name__ == "__main__":
    sys.exit(main())

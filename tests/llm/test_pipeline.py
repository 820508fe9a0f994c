"""The pipeline against a plain version, stage by stage."""

from __future__ import annotations

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftlode.llm import jaccard_join, mixing, oracles
from siftlode.llm.common import materialise
from tests.llm.conftest import SF
from tests.llm.test_corpus_operators import brute_components


def test_stages_equal_plain_versions(spark):
    duck = duckdb.connect()
    for t in ("labels", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    ids = lambda d: sorted(r.doc_id for r in d.select("doc_id").collect())
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        frame = docs.toPandas()
        duck.register("docs", frame)
        docs = materialise(stage(spark, docs, SF), name)
        if k < 4:
            assert docs.columns == columns and ids(docs)
        if name == "quality_rules":
            want = duck.execute(f"SELECT doc_id FROM ({oracles.quality_sql('docs')}) WHERE kept").fetchall()
        elif name == "ngram_jaccard_join":
            want = {(c,) for _, _, c in brute_components(list(zip(frame.doc_id, frame.text)), 5, 80)}
        elif name == "benchmark_decontamination":
            want = duck.execute(f"SELECT doc_id FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM ({oracles.leaks_sql('docs')}))").fetchall()
        elif name == "source_mixing":
            want = duck.execute(f"WITH {oracles.mixing_ctes('docs')} SELECT doc_id FROM mixed WHERE drawn").fetchall()
        else:
            want = [(i,) for i in frame.doc_id]
        assert ids(docs) == sorted(x[0] for x in want), name
    assert [tuple(r) for r in corpus_pipeline.run(spark, SF).orderBy("doc_id").collect()] == [tuple(r) for r in docs.orderBy("doc_id").collect()]


#: Names of internal and result columns of all operators, as columns of the user's own, with values to be kept.
CLASHING = (
    "kept p drawn topic tokens ratios _c llr n_words base_failed hashed row _row _key key sid cell root _p _drawn _source _lang _topic _tokens t w u0 u1 _again _tie _one "
    "item_id matched hash wins raw sha of `odd.name"
).replace("`odd.name", "odd.name").split()


@pytest.mark.parametrize("k", range(5))
def test_stages_bear_odd_rows(spark, odd_docs, no_docs, k):
    name, stage = corpus_pipeline.STAGES[k]
    plain = odd_docs.drop("kept", "p")
    # the values follow from the row, so what comes out can be told to be what went in
    own = lambda n: F.concat_ws("|", F.lit(n), F.col("doc_id"), F.substring("text", 1, 20)).alias(n)
    docs = plain.select("*", *[own(n) for n in CLASHING], F.create_map(F.lit("a"), "doc_id").alias("map"))
    for table in (docs, docs.where("false")):
        out = stage(spark, table, SF)
        if k == 4:
            assert out.count() == table.count()
            continue
        assert out.columns == table.columns
        rows, every = out.collect(), [tuple(map(str, r)) for r in table.collect()]
        assert all(tuple(map(str, r)) in every for r in rows)
        same = stage(spark, table.select(*plain.columns), SF)  # other columns decide nothing
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in same.collect())


def test_drawing_counts_all_documents(spark, monkeypatch):
    n = mixing.ANCHOR_DOCS + 500
    order = sorted(range(n), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    edge = set(order[-n // 25 :])  # 4 of 100 documents, none of them in a sample of ANCHOR_DOCS
    rows = [(i, ("edge " if i in edge else "") + "common words " * (1 + i % 7), "en" if i % 3 else "de", f"s{i % 2}") for i in range(n)]
    docs = spark.createDataFrame(rows + [(None, "edge", "en", "s1")], "doc_id long, text string, lang string, source string").repartition(5)
    duck = duckdb.connect()
    duck.register("docs", docs.toPandas().astype({"doc_id": "Int64"}))
    drawn = lambda: {r[0] for r in duck.execute(f"WITH {oracles.mixing_ctes('docs')} SELECT doc_id FROM mixed WHERE drawn").fetchall()}
    of_sample = drawn()
    with monkeypatch.context() as m:
        m.setattr(mixing, "ANCHOR_DOCS", 10 * n)  # the plain version over all documents
        of_all = drawn()
    assert of_all != of_sample
    assert {r.doc_id for r in corpus_pipeline.keep_drawn(spark, docs, "").collect()} == of_all


def test_equal_rows_leave_one_in_a_fixed_order(spark):
    rows = [(1, "one text of several words that stands here twice", x) for x in ("b", "a", "c")]
    left = [jaccard_join.deduplicate(spark.createDataFrame(r, "doc_id long, text string, x string").repartition(n)).collect() for r, n in ((rows, 1), (rows[::-1], 3))]
    assert left[0] == left[1] and len(left[0]) == 1

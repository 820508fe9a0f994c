"""Quality rules: hashed n-gram log-likelihood ratio with a fixed threshold, besides plain counting rules.

Every document becomes a bag of hashed word unigrams and bigrams.  Two multinomials over the hash buckets are
estimated with add-one smoothing: one from trusted documents, one from the whole corpus.  A document's score is the
sum of ``ln p_trusted - ln p_corpus`` over its n-grams divided by their number; it is kept when the score reaches a
fixed threshold and no counting rule fails.  DataFrame functions only.

Defined results: null or empty text has no words, all counts 0, a null score and is rejected by the base rules;
null ids are judged like any other row; repeated rows are judged alike; an empty table gives an empty result; other
columns of the input pass through :func:`judge` unless they bear the name of a result column, which is replaced;
:func:`keep` gives the rows it keeps as they were, whatever their columns are called.
Without any trusted document both multinomials would say nothing, so every score is 0 and only base rules reject.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlode.llm.common import WHITESPACE, Carried, let, materialise, words

#: Hash buckets of the two multinomials: bounds what is broadcast to this many doubles.  Junk words are all distinct, so with few
#: buckets they share those of clean words and score like them.
BUCKETS = 1 << 16
#: Score below which a document is rejected, in nats per n-gram; checked on labelled junk and clean rows at this number of buckets.
THRESHOLD = -0.2
#: At most this many trusted documents (those with the smallest md5 of their id) estimate the trusted multinomial.
MAX_TRUSTED = 20_000
#: Words of a repeated window.
WINDOW = 5


def hashes(w: Column) -> Column:
    """28-bit hashes of the words in lower case."""
    return F.transform(w, lambda x: F.conv(F.substring(F.md5(F.lower(x)), 1, 7), 16, 10).cast("int"))


def _bigram(a: Column, b: Column, buckets: int) -> Column:
    return ((a.cast("long") * 31 + b.cast("long") * 17 + 7) % buckets).cast("int")


def features(hashed: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of the unigrams and bigrams of an array of word hashes; the last bigram is null."""
    return F.flatten(
        F.transform(hashed, lambda a, i: F.array((a % buckets).cast("int"), _bigram(a, F.get(hashed, i + 1), buckets)))
    )


def ratio_sum(hashed: Column, ratios: Column, buckets: int = BUCKETS) -> Column:
    """The sum of the ratios of all unigrams and bigrams of an array of word hashes."""
    own = lambda a, i: F.get(ratios, (a % buckets).cast("int")) + F.coalesce(F.get(ratios, _bigram(a, F.get(hashed, i + 1), buckets)), F.lit(0.0))
    return F.aggregate(F.transform(hashed, own), F.lit(0.0), lambda total, x: total + x)


def repeated_words(w: Column, window: int = WINDOW) -> Column:
    """How many words lie in a window of ``window`` words that occurs twice or more, first occurrences included."""
    # get() is O(1) where slice() copies the whole array each time
    keys = F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]))

    def covered(k: Column) -> Column:
        order = F.sort_array(F.transform(k, lambda key, i: F.struct(key.alias("key"), i.alias("at"))))

        def starts(s: Column) -> Column:
            same = lambda i, j: F.coalesce(F.get(s, i)["key"] == F.get(s, j)["key"], F.lit(False))
            rows = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: same(i, i + 1) | same(i, i - 1))
            return F.sort_array(F.transform(rows, lambda i: F.get(s, i)["at"]))

        return let(
            let(order, starts),
            lambda p: F.aggregate(
                F.transform(p, lambda at, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - at, F.lit(window)))),
                F.lit(0).cast("long"),
                lambda total, x: total + x,
            ),
        )

    return F.when(F.size(w) <= window, F.lit(0).cast("long")).otherwise(
        let(keys, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0).cast("long")).otherwise(covered(k)))
    )


def _counted(text: Column) -> Column:
    """Struct of all counts and the word hashes of one text."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.trim(x, F.lit(WHITESPACE)) != "")
    return let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(whole, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
            hashes(w).alias("hashed"),
        ),
    )


def trusted_ids(labels: DataFrame, at_most: int = MAX_TRUSTED) -> DataFrame:
    """Ids of trusted documents: good quality and not toxic; at most ``at_most``, so that it may be broadcast."""
    good = labels.where((F.col("quality") == 1) & (F.col("toxic") == 0) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return good.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(at_most)


def log_ratios(hashed: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row with ``ratios``: for each bucket ln p_trusted - ln p_corpus, over all of ``hashed`` (doc_id, hashed)."""
    mark = F.broadcast(trusted.select(F.col("doc_id").alias("_trusted")))
    grams = hashed.select("doc_id", let(F.col("hashed"), lambda h: features(h, buckets)).alias("_grams"))
    grams = grams.join(mark, F.col("doc_id") == F.col("_trusted"), "left")
    counts = (
        grams.select(F.explode_outer("_grams").alias("bucket"), F.col("_trusted").isNotNull().cast("long").alias("t"))
        .where(F.col("bucket").isNotNull())  # explode() would compute the n-grams twice, in a filter of its own too
        .groupBy("bucket")
        .agg(F.sum("t").alias("t"), F.count(F.lit(1)).alias("n"))
    )
    every = hashed.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    filled = every.join(F.broadcast(counts), "bucket", "left").select("bucket", F.coalesce("t", F.lit(0)).alias("t"), F.coalesce("n", F.lit(0)).alias("n"))
    packed = filled.agg(F.sort_array(F.collect_list(F.struct("bucket", "t", "n"))).alias("c"), F.sum("t").alias("nt"), F.sum("n").alias("nn"))
    ratio = F.transform(
        "c", lambda x: F.log((x["t"] + 1) / (F.col("nt") + buckets)) - F.log((x["n"] + 1) / (F.col("nn") + buckets))
    )
    return packed.select(F.when(F.col("nt") == 0, F.transform("c", lambda x: F.lit(0.0))).otherwise(ratio).alias("ratios"))


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_RESULTS = (*_COUNTS, "base_failed", "llr", "kept")


def _verdicts(counted: DataFrame, ratios: DataFrame, columns: list[str], threshold: float, buckets: int) -> DataFrame:
    """``columns`` of ``counted`` (with _c) and the results."""
    scored = counted.crossJoin(F.broadcast(ratios))  # one row of fixed length
    total = let(
        F.struct(F.col("_c.hashed").alias("h"), F.col("ratios").alias("r")),
        lambda x: ratio_sum(x["h"], x["r"], buckets) / F.when(F.size(x["h"]) > 0, 2 * F.size(x["h"]) - 1),
    )
    counts = [F.col(f"_c.{c}").alias(c) for c in _COUNTS]
    kept = scored.select(*columns, *counts, F.round(total, 6).alias("llr"))
    kept = kept.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    # one comparison: a conjunct on the counts alone would be pushed below and count every text once more
    judged = F.when(F.col("base_failed"), F.lit(float("-inf"))).otherwise(F.col("llr"))
    return kept.withColumn("kept", F.coalesce(judged >= threshold, F.lit(False)))


def _judged(own: Carried, docs: DataFrame, trusted: DataFrame, threshold: float, buckets: int) -> DataFrame:
    hashed = docs.select("doc_id", let(words(F.lower("text")), hashes).alias("hashed"))
    return _verdicts(own.table.withColumn("_c", _counted(own["text"])), log_ratios(hashed, trusted, buckets), own.table.columns, threshold, buckets)


def judge(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``llr`` (nats per n-gram, 6 places) and ``kept`` of every row.

    Reads the texts twice, for the corpus and for the scores, and writes nothing.
    """
    own = Carried(docs)
    return _judged(own, docs, trusted, threshold, buckets).select(*own.columns(replaced=_RESULTS), *_RESULTS)


def keep(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``docs`` that neither the counting rules nor the ratio reject."""
    own = Carried(docs)
    return _judged(own, docs, trusted, threshold, buckets).where("kept").select(*own.columns())


def verdicts(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """:func:`judge` without the texts: reads them once and keeps the word hashes (4 bytes a word) in the shared folder."""
    counted = materialise(docs.select("doc_id", _counted(F.col("text")).alias("_c")), "word-hashes")
    ratios = log_ratios(counted.select("doc_id", F.col("_c.hashed").alias("hashed")), trusted, buckets)
    return _verdicts(counted, ratios, ["doc_id"], threshold, buckets)

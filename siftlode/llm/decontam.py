"""Benchmark decontamination by template canonicalisation.

A text becomes a list of tokens: words of letters, and numbers.  Each token has a template form: ``<num>`` for a number,
``<unit>`` for a unit of measure, ``<name>`` for a word with a capital inside a sentence, and the word in lower case
otherwise; punctuation and decoration are gone.  Windows of ``WINDOW`` template tokens of which at least ``MIN_LITERAL``
are words are hashed and the documents' windows joined with the benchmark's (an item shorter than a window is one
window).  A second form of each window is blind to case: names are words in lower case there, so copies in other letters
are found.  Where that has fewer words too, the exact tokens in lower case take its place: no window is left out.  Hits of one alignment (document, item, distance of positions) are checked for consistent slots: every value
of the item's placeholders must always be replaced by the same value.  A document is contaminated by an item when the
windows of its consistent alignments cover at least ``COVERAGE`` of the item's windows, or when ``RUN`` tokens in a row
match in one alignment, consistent or verbatim.  DataFrame functions only.

Defined results: null or empty texts have no windows; rows of equal id and text are one document; null ids are judged
by their text and reported as null; repeated benchmark items with one id are alternatives pooled under it, null item
ids are ignored; an item without tokens finds nothing; empty tables give empty results; extra columns pass
through :func:`decontaminate` unchanged, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlode.llm.common import Carried, let, materialise

WINDOW = 8
MIN_LITERAL = 4
COVERAGE = 0.4
#: Tokens of an unbroken run that contaminate whatever share of the item they are.
RUN = 13
#: Forms of a benchmark window: template, case-blind template, exact tokens.
TEMPLATE, BLIND, EXACT = 0, 1, 2
#: Benchmark windows of up to so many bytes are broadcast with their tokens.  Of more, hashes are joined first, broadcast
#: up to so many, and tokens are cut for what hits.
BROADCAST_BYTES, BROADCAST_HASHES = 32 << 20, 1_000_000
#: A token: a word with the end of a sentence shortly before it, a word, or a number.
TOKEN = r"[.!?\n][^\p{L}0-9]{0,8}\p{L}+|\p{L}+|[0-9]+(?:[.,][0-9]+)*"
#: The same for Java, whose stack a long number with many points would overflow if repetitions could give back.
LINEAR_TOKEN = r"[.!?\n][^\p{L}0-9]{0,8}\p{L}++|\p{L}++|[0-9]++(?:[.,][0-9]++)*+"
#: Units of measure; fixed values.
UNITS = (
    *("mm", "cm", "km", "mg", "kg", "lb", "lbs", "oz", "ml", "mph", "kmh", "inch", "inches", "foot", "feet", "yard", "yards"),
    *("mile", "miles", "meter", "meters", "metre", "metres", "gram", "grams", "kilogram", "kilograms", "ton", "tons", "pound", "pounds"),
    *("liter", "liters", "litre", "litres", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks"),
    *("month", "months", "year", "years", "cent", "cents", "dollar", "dollars", "euro", "euros", "percent", "degree", "degrees"),
)


def tokens(text: Column) -> Column:
    """The raw tokens of a text; a sentence's first word has what ends the sentence before it as a prefix."""
    return F.regexp_extract_all(F.concat(F.lit("\n"), F.coalesce(text, F.lit(""))), F.lit(LINEAR_TOKEN), F.lit(0))


def template(token: Column) -> Column:
    """The template form of one raw token."""
    first, second = F.substring(token, 1, 1), F.substring(token, 2, 1)
    word = lambda t: F.when(t.isin(*UNITS), F.lit("<unit>")).otherwise(t)
    return (
        F.when(first.between("0", "9"), F.lit("<num>"))
        .when(first.isin(".", "!", "?", "\n"), let(F.lower(F.regexp_extract(token, r"\p{L}+$", 0)), word))
        .when((first != F.lower(first)) & (second != "") & (second == F.lower(second)), F.lit("<name>"))
        .otherwise(let(F.lower(token), word))
    )


def _forms(raw: Column) -> Column:
    """Struct of arrays, a token each: ``exact`` (lower case), ``blind`` (numbers and units as placeholders) and ``named`` (template)."""
    first = lambda t: F.substring(t, 1, 1)
    bare = F.transform(raw, lambda t: F.when(first(t).isin(".", "!", "?", "\n"), F.lower(F.regexp_extract(t, r"\p{L}+$", 0))).otherwise(F.lower(t)))
    mark = lambda t: F.when(first(t).between("0", "9"), F.lit("<num>")).when(t.isin(*UNITS), F.lit("<unit>")).otherwise(t)

    def name(t: Column) -> Column:
        second = F.substring(t, 2, 1)
        return (first(t) != F.lower(first(t))) & (second != "") & (second == F.lower(second))

    return let(
        bare,
        lambda c: let(
            F.transform(c, mark),
            lambda b: F.struct(
                c.alias("exact"), b.alias("blind"), F.transform(raw, lambda t, i: F.when(name(t), F.lit("<name>")).otherwise(F.get(b, i))).alias("named")
            ),
        ),
    )


def _windows(f: Column, length: int, min_literal: int) -> Column:
    """(at, hash, length, plain) of the windows of ``length`` tokens: blind, or exact where literal words are few, and named where that differs.

    ``plain`` tells that a window is the document's template too.
    """
    exact, blind, named = f["exact"], f["blind"], f["named"]
    spare = length - min(min_literal, length)
    # get() is O(1) where slice() copies the whole array each time
    digest = lambda w, at: F.xxhash64(*[F.get(w, at + (k - 1)) for k in range(length)])
    row = lambda at, h: F.struct(at.alias("at"), h.alias("hash"), F.lit(length).alias("length"), F.lit(True).alias("plain"))
    marks = F.size(F.filter(blind, lambda t: t.startswith("<")))

    def few(at: Column) -> Column:
        return sum((F.get(blind, at + (k - 1)).startswith("<").cast("int") for k in range(length)), F.lit(0)) > spare

    every = F.sequence(F.lit(1), F.size(blind) - (length - 1))
    none = F.array().cast("array<struct<at:int,hash:bigint,length:int,plain:boolean>>")
    own = F.when(marks > spare, F.transform(every, lambda at: row(at, F.when(few(at), digest(exact, at)).otherwise(digest(blind, at))))).otherwise(
        F.transform(every, lambda at: row(at, digest(blind, at)))
    )
    told = lambda x, y: F.struct(x["at"].alias("at"), x["hash"].alias("hash"), x["length"].alias("length"), (x["hash"] == y["hash"]).alias("plain"))
    other = lambda o, m: F.concat(F.zip_with(o, m, told), F.filter(m, lambda x, i: x["hash"] != F.get(o, i)["hash"]))
    m = F.transform(every, lambda at: row(at, digest(named, at)))
    both = let(own, lambda o: F.when(F.array_contains(named, "<name>"), let(m, lambda m: other(o, m))).otherwise(o))
    return F.when(F.size(blind) >= length, both).otherwise(none)


def _hashed(forms: Column, window: int) -> Column:
    """The hash of one whole window; positions beyond a shorter one are null and do not count."""
    return F.xxhash64(*[F.get(forms, F.lit(k)) for k in range(window)]).alias("hash")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, min_literal: int = MIN_LITERAL) -> DataFrame:
    """(item_id, length, b_at, kind, hash, w, values, n, n_blind, n_all): the windows of each item in their forms.

    ``n``, ``n_blind`` and ``n_all`` are its numbers of template windows, of case-blind ones, and of all places.
    """
    own = benchmark.where(F.col("item_id").isNotNull()).select("item_id", tokens(F.col("text")).alias("raw"))
    own = own.where(F.size("raw") > 0).withColumn("f", _forms(F.col("raw")))
    own = own.withColumn("length", F.least(F.size("raw"), F.lit(window)))
    at = F.explode(F.sequence(F.lit(1), F.size("raw") - F.col("length") + 1))
    cut = own.select("item_id", "length", "f", at.alias("b_at")).select(
        "item_id", "length", "b_at", *[F.slice(F.col("f")[k], F.col("b_at"), F.col("length")).alias(k) for k in ("exact", "blind", "named")]
    )
    literal = lambda c: F.size(F.filter(c, lambda t: ~t.startswith("<"))) >= F.least(F.lit(min_literal), F.col("length"))
    form = lambda kind, c, on: F.struct(F.lit(kind).alias("kind"), F.col(c).alias("w"), on.alias("on"))
    forms = [
        form(TEMPLATE, "named", literal("named")),
        form(BLIND, "blind", literal("blind")),
        form(EXACT, "exact", ~literal("blind")),
    ]
    cut = cut.select("item_id", "length", "b_at", F.col("exact").alias("values"), F.explode(F.filter(F.array(*forms), lambda x: x["on"])).alias("form"))
    each = cut.select("item_id", "length", "b_at", F.col("form.kind").alias("kind"), _hashed(F.col("form.w"), window), F.col("form.w").alias("w"), "values")
    of = lambda kind: F.count_distinct(F.when(F.col("kind") == kind, F.col("b_at")))
    count = each.groupBy("item_id").agg(of(TEMPLATE).alias("n"), of(BLIND).alias("n_blind"), F.count_distinct("b_at").alias("n_all"))
    return each.join(count, "item_id")


def _bare(token: Column) -> Column:
    return F.lower(F.regexp_extract(token, r"[\p{L}0-9].*$", 0))


def _key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, text)


def _found(own: DataFrame, cut: DataFrame, index: DataFrame) -> DataFrame:
    """(_key, doc_id, raw, at, hash, length, plain) of the windows that the benchmark has.

    Only hashes and positions are joined with its hashes; texts are cut again for the documents that have a hit.
    """
    hashes = index.select("hash", "length").distinct()
    hashes = F.broadcast(hashes) if hashes.count() <= BROADCAST_HASHES else hashes
    bare = cut.select("_key", F.explode_outer("wins").alias("win")).select("_key", "win.*")
    hits = materialise(bare.join(hashes, ["hash", "length"]).distinct(), "window-hits")
    texts = own.join(hits.select("_key").distinct(), "_key", "left_semi").dropDuplicates(["_key"])
    return hits.join(texts, "_key")


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """One row for each contaminated document and item: _key, doc_id, item_id, matched, windows, coverage, changed.

    ``changed`` tells whether a placeholder of the item has another value in the document.  The figures are those of template
    windows where they reach ``coverage``, else of case-blind and template ones where they do, else of all places.
    """
    index = materialise(benchmark_windows(benchmark, window), "benchmark-windows")
    letters = F.octet_length(F.array_join("w", "")) + F.octet_length(F.array_join("values", ""))
    room = index.agg(F.sum(letters + 32 * F.size("w") + 100)).first()[0] or 0
    lengths = sorted(r[0] for r in index.select("length").distinct().collect()) or [window]  # at most ``window`` numbers
    own = docs.select(_key(F.col("doc_id"), F.col("text")).alias("_key"), "doc_id", tokens(F.col("text")).alias("raw"))
    cut = own.withColumn("wins", let(_forms(F.col("raw")), lambda f: F.concat(*[_windows(f, n, MIN_LITERAL) for n in lengths])))
    side = index.select("item_id", "b_at", "kind", "hash", "n", "n_blind", "n_all", "w", "values", F.col("length").alias("b_length"))
    slice_ = F.slice("raw", F.col("at"), F.col("length"))
    if room <= BROADCAST_BYTES:
        each = cut.select("_key", "doc_id", "raw", F.explode_outer("wins").alias("win")).select("_key", "doc_id", "raw", "win.*")
        met = each.join(F.broadcast(side), "hash").withColumn("d", slice_)
    else:
        met = _found(own, cut, index).withColumn("d", slice_).drop("raw").join(side, "hash")
    hit = met.where((F.col("length") == F.col("b_length")) & (F.col("plain") | (F.col("kind") != TEMPLATE)))
    pairs = F.filter(
        F.zip_with(F.arrays_zip("w", "values"), F.col("d"), lambda b, d: F.struct(b["w"].alias("w"), b["values"].alias("b"), _bare(d).alias("d"))),
        lambda p: p["w"].startswith("<"),
    )
    sizes = ["n", "n_blind", "n_all"]
    item = ["_key", "doc_id", "item_id", *sizes]
    hits = hit.select(*item, "kind", (F.col("at") - F.col("b_at")).alias("shift"), "b_at", pairs.alias("pairs"))
    same = ~F.exists("pairs", lambda p: p["b"] != p["d"])
    aligned = hits.groupBy(*item, "kind", "shift").agg(
        F.collect_set("b_at").alias("matched"),
        F.collect_set(F.when(same, F.col("b_at"))).alias("verbatim"),
        F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"),
    )
    values = F.array_distinct(F.transform("pairs", lambda p: F.struct(p["w"].alias("w"), p["b"].alias("b"))))
    aligned = aligned.withColumn("ok", F.size(values) == F.size("pairs"))
    aligned = aligned.withColumn("changed", F.exists("pairs", lambda p: p["b"] != p["d"]))
    # where slots contradict each other, only what is verbatim counts, and only for a run
    held = F.when(F.col("ok"), F.col("matched")).otherwise(F.col("verbatim"))
    kinds = aligned.groupBy(*item, "shift").agg(
        F.collect_list(F.struct("kind", "ok", "changed", "matched")).alias("kinds"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(held)))).alias("places")
    )
    ahead = max(run - window, 0)
    long = F.exists(F.transform("places", lambda p, i: F.get("places", i + ahead) == p + ahead), lambda x: F.coalesce(x, F.lit(False)))
    each_kind = kinds.select(*item, long.alias("run"), F.explode("kinds").alias("k")).select(
        *item, "run", "k.kind", "k.ok", "k.changed", F.explode("k.matched").alias("b_at")
    )
    within = lambda kind: F.col("ok") & (F.col("kind") <= kind)
    steps = ((TEMPLATE, "n"), (BLIND, "n_blind"), (EXACT, "n_all"))
    per_window = each_kind.groupBy(*item, "b_at").agg(
        F.max("run").alias("run"), *[F.min(F.when(within(kind), F.col("changed"))).alias(f"c{kind}") for kind, _ in steps]
    )
    found = per_window.groupBy(*item).agg(
        F.max("run").alias("run"),
        *[F.struct(F.count(f"c{kind}").alias("matched"), F.first(n).alias("windows"), F.max(f"c{kind}").alias("changed")).alias(f"s{kind}") for kind, n in steps],
    )
    enough = lambda s: (F.col(s)["windows"] > 0) & (F.col(s)["matched"] >= coverage * F.col(s)["windows"])
    chosen = F.when(enough("s0"), F.col("s0")).when(enough("s1"), F.col("s1")).when(enough("s2") | F.col("run"), F.col("s2"))
    found = found.select("_key", "doc_id", "item_id", chosen.alias("s")).where(F.col("s").isNotNull())
    out = found.select("_key", "doc_id", "item_id", "s.matched", "s.windows", F.coalesce("s.changed", F.lit(False)).alias("changed"))
    return out.withColumn("coverage", F.round(F.col("matched") / F.col("windows"), 6))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated ones."""
    bad = contaminated(docs.select("doc_id", "text"), benchmark).select("_key").distinct()
    own = Carried(docs)
    return own.table.withColumn("_key", _key(own["doc_id"], own["text"])).join(bad, "_key", "left_anti").select(*own.columns())


def leaks_query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contaminated(docs, benchmark).select("doc_id", "item_id", "matched", "windows", "coverage", "changed")

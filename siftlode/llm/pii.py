"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust their scores.

Kinds and rules, in this order: e-mail address, IPv4 address (parts at most 255), payment card (16 to 19 digits, Luhn),
telephone number (8 to 15 digits) - these four always count - then IBAN (mod 97) and secret (32 to 64
hexadecimal digits near a word such as token).  A proposed span that fails its validator is dropped without a second try.  Each span
has a score: the prior of its kind, raised when a context word stands within ``CONTEXT`` characters before it.  Kinds
after the first four are kept only when the score reaches ``KEEP``.  Positions are code points, end exclusive.

Spark has no function that returns match positions, so they follow from what lies between the matches: splitting at
the pattern and extracting its matches see the same leftmost non-overlapping matches.  Matches are validated first; only
where one stands are lengths summed up, over a tree of partial sums.  DataFrame functions only.

Defined results: null text counts as empty; empty text has no spans; null ids and repeated rows are judged like any
other row; an empty table gives an empty result; very long texts are scanned in linear time (each pattern starts only
where a run of its first class starts or the last match ended, and repetitions never give back; a position takes a fixed
number of additions, up to ``FAN ** (SUMS + 1)`` matches); extra columns pass through :func:`find_spans` unless they are
called ``spans``, which is replaced, whatever their names are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlode.llm.common import let

#: Code points before a span in which context words are looked for.
CONTEXT = 40
#: Least score of a span of the kinds that the method adds.
KEEP = 0.5
#: Numbers under a node of the tree of partial sums, and its levels; no result depends on them.
FAN, SUMS = 32, 4


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str  #: for Java; linear, and equal to the plain expression in ``plain``
    plain: str
    hint: str  #: a text without this expression has no such span
    prior: float
    context: tuple[str, ...]
    always: bool = False


#: The first four patterns are fixed values.
KINDS = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "@",
        0.9,
        ("mail", "contact", "write"),
        True,
    ),
    Kind(
        "ip",
        r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"[0-9]\.[0-9]",
        0.7,
        ("ip", "host", "server", "address"),
        True,
    ),
    Kind(
        "card",
        r"[0-9](?:[\x20-]?[0-9])++",
        r"[0-9]([\x20-]?[0-9])+",
        r"[0-9][\x20-]?[0-9]",
        0.8,
        ("card", "visa", "credit", "payment"),
        True,
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        r"\+[0-9]",
        0.6,
        ("phone", "tel", "call", "mobile"),
        True,
    ),
    Kind(
        "iban",
        r"[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Za-z0-9]{15,}",
        r"[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Za-z0-9]{15,}",
        r"[A-Z]{2}[0-9]{2}[A-Z0-9 ]",
        0.8,
        ("iban", "account", "bank", "transfer"),
    ),
    Kind(
        "secret",
        r"[A-Za-z0-9]{32,}",
        r"[A-Za-z0-9]{32,}",
        r"[0-9a-f]{32}",
        0.3,
        ("token", "secret", "key", "password"),
    ),
)
_SPAN = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    n = F.length(digits)
    value = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    twice = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    parts = F.transform(F.sequence(F.lit(1), n), lambda i: F.when((n - i) % 2 == 1, twice(value(i))).otherwise(value(i)))
    return (n > 0) & (F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10 == 0)


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces has the remainder 1 by 97."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))
    chars = F.filter(F.split(turned, ""), lambda c: c != "")

    def fold(rest: Column, c: Column) -> Column:
        v = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
        return F.when(v > 9, (rest * 100 + v) % 97).otherwise((rest * 10 + v) % 97)

    return F.aggregate(chars, F.lit(0), fold) == 1


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: let(F.regexp_replace(p, "^0+", ""), lambda q: (F.length(q) < 3) | ((F.length(q) == 3) & (q <= "255"))))
    if kind == "card":
        return let(digits, lambda d: F.length(d).between(16, 19) & luhn(F.when(F.length(d).between(16, 19), d)))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "iban":
        shape = "^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"
        return let(F.replace(match, F.lit(" "), F.lit("")), lambda x: F.rlike(x, F.lit(shape)) & mod97(F.when(F.rlike(x, F.lit(shape)), x)))
    if kind == "secret":
        return F.rlike(match, F.lit("^[0-9a-f]{32,64}$"))
    return F.lit(True)


def _total(x: Column, start: Column, count: Column) -> Column:
    """The sum of ``count`` numbers of an array from ``start`` (from 0)."""
    return F.aggregate(F.slice(x, (start + 1).cast("int"), count.cast("int")), F.lit(0).cast("long"), lambda a, n: a + n)


def _before(lengths: Column, use: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """``use(before)``, where ``before(i)`` is the sum of the first i lengths.

    A running sum would need a fold that keeps all its results, and Spark copies a fold's state in every step.
    """

    def level(sums: list[Column]) -> Column:
        if len(sums) <= SUMS:
            last = sums[-1]
            nodes = F.transform(F.sequence(F.lit(0), F.floor((F.size(last) - 1) / FAN)), lambda b: _total(last, b * FAN, F.lit(FAN)))
            return let(nodes, lambda x: level([*sums, x]))

        def before(i: Column) -> Column:
            out = _total(sums[SUMS], F.lit(0), F.floor(i / FAN**SUMS))
            for k in range(SUMS):
                out = out + _total(sums[k], F.floor(i / FAN ** (k + 1)) * FAN, F.floor(i / FAN**k) % FAN)
            return out

        return use(before)

    return level([lengths])


def _spans(text: Column, kind: Kind) -> Column:
    """The confirmed spans of one kind in ``text`` (not null), in order of position."""
    none = F.array().cast(_SPAN)
    words = F.lit("|".join(kind.context))

    def place(p: Column) -> Column:
        def near(i: Column) -> Column:
            # matches are not empty, so the characters before one stand in this many pieces
            pieces = F.transform(F.sequence(F.greatest(i - CONTEXT, F.lit(0)), i), lambda j: F.concat(F.coalesce(F.get(p["hit"], j - 1), F.lit("")), F.get(p["tail"], j)))
            return F.lower(F.right(F.array_join(pieces, ""), F.lit(CONTEXT)))

        def at(before: Callable[[Column], Column], s: Column) -> Column:
            start = before(s["i"]) + F.get(p["gap"], s["i"])
            return let(
                start, lambda x: F.struct(F.lit(kind.name).alias("kind"), x.alias("start"), (x + F.length(F.get(p["hit"], s["i"]))).alias("end"), s["score"].alias("score"))
            )

        score = lambda i: F.lit(kind.prior) + F.when(F.rlike(near(i), words), 0.3).otherwise(0.0)
        scored = F.transform(p["good"], lambda i: F.struct(i.alias("i"), score(i).alias("score")))
        kept = scored if kind.always else F.filter(scored, lambda s: s["score"] >= KEEP)
        both = F.transform(F.sequence(F.lit(0), F.size(p["hit"]) - 1), lambda i: F.get(p["gap"], i) + F.length(F.get(p["hit"], i)))
        summed = lambda k: let(both, lambda n: _before(n, lambda before: F.transform(k, lambda s: at(before, s))))
        return let(kept, lambda k: F.when(F.size(k) > 0, summed(k)).otherwise(none))

    def cut(j: Column) -> Column:
        gaps = F.split(text, kind.pattern, -1)
        lengths = lambda g: F.transform(g, lambda x: F.length(x).cast("long")).alias("gap")
        tails = lambda g: F.transform(g, lambda x: F.right(x, F.lit(CONTEXT))).alias("tail")
        return let(gaps, lambda g: let(F.struct(j["hit"].alias("hit"), j["good"].alias("good"), lengths(g), tails(g)), place))

    hits = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    good = lambda h: F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: _valid(kind.name, F.get(h, i)))
    judged = let(hits, lambda h: F.when(F.size(h) > 0, let(F.struct(h.alias("hit"), good(h).alias("good")), lambda j: F.when(F.size(j["good"]) > 0, cut(j)).otherwise(none))).otherwise(none))
    return F.when(F.rlike(text, F.lit(kind.hint)), judged).otherwise(none)


def _all_spans(text: Column, kinds: tuple[Kind, ...]) -> Column:
    whole = F.coalesce(text, F.lit(""))
    return F.concat(*[_spans(whole, k) for k in kinds])


def find_spans(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``docs`` with ``spans``: array of (kind, start, end, score), by kind in the order of ``kinds``, then position."""
    return docs.withColumn("spans", _all_spans(F.col("text"), kinds))


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of ``text`` replaced by ``[KIND]``; a span within or across an earlier one goes with it."""
    order = lambda s: F.array_sort(
        s, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(a["end"] > b["end"], -1).when(a["end"] < b["end"], 1).otherwise(0)
    )

    def masked(x: Column) -> Column:
        first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

        def step(acc: Column, s: Column) -> Column:
            clean = F.substr(x["text"], (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
            return F.when(
                s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(clean, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))).alias("out"))
            ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))

        return F.aggregate(x["spans"], first, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(x["text"], (acc["at"] + 1).cast("int"))))

    text = F.col("text")
    clean = let(F.struct(text.alias("text"), order(_all_spans(text, KINDS)).alias("spans")), masked)
    return docs.withColumn("text", F.when(text.isNotNull(), clean))


def spans_query(docs: DataFrame) -> DataFrame:
    """The digest columns of :func:`find_spans`: one row for every row of ``docs``.

    Besides them ``n_spans``, ``has_pii`` (any span of any kind) and ``best_score`` (the highest; null without spans).
    """
    base = F.filter("spans", lambda s: s["kind"].isin([k.name for k in KINDS if k.always]))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return find_spans(docs.select("doc_id", "text")).select(
        "doc_id",
        *[count(k.name) for k in KINDS],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
        (F.size("spans") > 0).alias("has_pii"),
        F.round(F.array_max(F.transform("spans", lambda s: s["score"])), 2).alias("best_score"),
    )

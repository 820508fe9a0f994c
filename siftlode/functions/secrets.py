"""Secrets: redaction rules and the entropy test.  The rules are this library's own; each hit becomes [REDACTED_KIND]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftlode.functions.text import let

#: (kind, pattern, replacement); applied in order, each to what the ones before left.  Patterns hold for Java and RE2.
RULES = (
    # with its body where the end stands in the same text; a body has few dashes, in the headers of encrypted keys
    ("PRIVATE_KEY", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*(?:-[^-]+){0,20}-----END [A-Z ]*PRIVATE KEY-----)?", "[REDACTED_PRIVATE_KEY]"),
    ("GITHUB_TOKEN", r"gh[pousr]_[A-Za-z0-9]{30,250}", "[REDACTED_GITHUB_TOKEN]"),
    ("AWS_ACCESS_KEY", r"A(?:KIA|SIA)[A-Z0-9]{16}", "[REDACTED_AWS_ACCESS_KEY]"),
    ("SLACK_TOKEN", r"xox[abprs]-[A-Za-z0-9-]{10,250}", "[REDACTED_SLACK_TOKEN]"),
    ("API_KEY", r"sk-[A-Za-z0-9_-]{20,250}", "[REDACTED_API_KEY]"),
    ("JWT", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "[REDACTED_JWT]"),
    ("ASSIGNED_SECRET", r"((?i:token|secret|password|passwd|api[_-]?key)[ \t]*[=:][ \t]*\"?)[A-Za-z0-9_./+=-]{16,}", "{1}[REDACTED_ASSIGNED_SECRET]"),
)
ENTROPY_KIND = "HIGH_ENTROPY_TOKEN"
#: What the entropy test looks at: a run of 32 or more of these characters with all four classes among them.
CANDIDATE = r"[A-Za-z0-9_./+=-]{32,}"
MIN_ENTROPY = 5.0
#: A text without this has no secret of any kind: spares most texts the rules.
HINT = rf"PRIVATE KEY|gh[pousr]_|A(?:KIA|SIA)|xox[abprs]-|sk-|eyJ|(?i:token|secret|passw|api[_-]?key)|{CANDIDATE}"
KINDS = (*[r[0] for r in RULES], ENTROPY_KIND)


def entropy(token: Column) -> Column:
    """Shannon entropy of a string's characters, in bits per character; 0 for the empty string."""
    chars = F.filter(F.split(token, ""), lambda c: c != "")
    share = lambda c: (F.length(token) - F.length(F.replace(token, c, F.lit("")))) / F.length(token)
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))


def opaque(token: Column) -> Column:
    """Whether a candidate has all four character classes and enough entropy."""
    classes = [F.rlike(token, F.lit(p)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[_./+=-]")]
    return classes[0] & classes[1] & classes[2] & classes[3] & (entropy(token) >= MIN_ENTROPY)


def _opaque_in(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(f"({CANDIDATE})"), F.lit(1)), opaque)


def known_redacted(text: Column) -> Column:
    for _, pattern, mask in RULES:
        text = F.regexp_replace(text, pattern, mask.replace("{1}", "$1"))
    return text


def redact(text: Column) -> Column:
    """``text`` with every secret replaced by its kind."""
    known = known_redacted(text)
    hide = lambda t: F.aggregate(_opaque_in(t), t, lambda a, x: F.replace(a, x, F.lit(f"[REDACTED_{ENTROPY_KIND}]")))
    masked = let(known, lambda k: F.when(F.rlike(k, F.lit(CANDIDATE)), hide(k)).otherwise(k))
    return F.when(F.rlike(text, F.lit(HINT)), masked).otherwise(text)


def kinds_found(text: Column) -> Column:
    """The kind of each secret in ``text``, by rule, repeated as often as found."""
    return F.when(F.rlike(text, F.lit(HINT)), _kinds_found(text)).otherwise(F.array().cast("array<string>"))


def _kinds_found(text: Column) -> Column:
    out, rest = [], text
    for kind, pattern, mask in RULES:
        out.append(F.array_repeat(F.lit(kind), F.regexp_count(rest, F.lit(pattern))))
        rest = F.regexp_replace(rest, pattern, mask.replace("{1}", "$1"))
    out.append(F.array_repeat(F.lit(ENTROPY_KIND), F.size(_opaque_in(rest))))
    return F.concat(*out)

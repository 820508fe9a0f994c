"""Column functions on text: white space, windows, positions, languages and symbols."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 29 characters that Python's str.strip() removes, as a Java class; Spark's own \s and trim() know fewer.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
#: File extension and language; fixed values.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".mjs": "javascript",
    ".cjs": "javascript", ".ps1": "powershell", ".psm1": "powershell", ".md": "markdown", ".txt": "text", ".json": "json", ".jsonl": "jsonl",
    ".toml": "toml", ".yaml": "yaml", ".yml": "yaml", ".html": "html", ".css": "css", ".scss": "scss", ".rs": "rust", ".go": "go",
    ".java": "java", ".kt": "kotlin", ".cs": "csharp", ".cpp": "cpp", ".c": "c", ".h": "c", ".hpp": "cpp", ".sql": "sql", ".sh": "shell",
    ".bat": "batch",
}
#: Extensions (and bare names) of each chunk type; fixed values.
CONFIG_EXTENSIONS = (".json", ".toml", ".yaml", ".yml")
CONFIG_NAMES = ("config", "settings")
COMMAND_EXTENSIONS = (".sh", ".ps1", ".psm1", ".bat")
CODE_EXTENSIONS = (".py", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".rs", ".go", ".java", ".kt", ".cs", ".cpp", ".c", ".h", ".hpp")
#: What a symbol looks like in each group of languages, tried in order; fixed values, as the index stores what they find.
SYMBOLS = (
    (("python",), r"\b(?:async\s+def|def|class)\s+([A-Za-z_][A-Za-z0-9_]*)"),
    (("javascript", "typescript"), r"\b(?:function|class)\s+([A-Za-z_$][A-Za-z0-9_$]*)"),
    (("javascript", "typescript"), r"\b(?:const|let|var)\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*="),
    (("go", "rust", "java", "kotlin", "csharp", "cpp", "c"), r"\b(?:fn|func|class|interface|struct|enum)\s+([A-Za-z_][A-Za-z0-9_]*)"),
    (("powershell",), r"(?i)\bfunction\s+([A-Za-z_][A-Za-z0-9_-]*)"),
    (("markdown",), r"(?:^|\s)#\s+(.{1,120})"),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE}+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def file_name(path: Column) -> Column:
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; null for none and for dot files without another dot."""
    return F.nullif(F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1)), F.lit(""))


def language(path: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(pairs, extension(path))


def chunk_type(path: Column) -> Column:
    ext, name = F.coalesce(extension(path), F.lit("")), F.lower(file_name(path))
    return (
        F.when(ext == ".md", "markdown_heading_section")
        .when(ext == ".jsonl", "jsonl_message_window")
        .when(ext.isin(*CONFIG_EXTENSIONS) | name.isin(*CONFIG_NAMES), "config_block")
        .when(ext.isin(*COMMAND_EXTENSIONS), "command_block")
        .when(ext.isin(*CODE_EXTENSIONS), "code_chunk")
        .otherwise("text_chunk")
    )


def symbol(language: Column, text: Column) -> Column:
    """The first definition or heading in a chunk of collapsed text, by the language's patterns; else null."""
    found = [F.when(language.isin(*langs), F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit(""))) for langs, p in SYMBOLS]
    return F.coalesce(*found)


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a code-point offset."""
    before = F.substr(text, F.lit(1), offset.cast("int"))
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("int")


def byte_of(text: Column, offset: Column) -> Column:
    """UTF-8 bytes before a code-point offset."""
    return F.octet_length(F.substr(text, F.lit(1), offset.cast("int"))).cast("long")


def preview(text: Column, chars: int) -> Column:
    """At most ``chars`` code points; a cut text loses white space at its end and gets three dots."""
    return F.when(F.length(text) > chars, F.concat(rstrip(F.substr(text, F.lit(1), F.lit(chars))), F.lit("..."))).otherwise(text)


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)

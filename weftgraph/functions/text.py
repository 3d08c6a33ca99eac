"""Globs, path classifiers, fuzzy match, token budgets, labels: built on the driver once, evaluated as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is analysed and what never is.
DEFAULT_INCLUDE = ["**/*.{ts,tsx,mts,cts,js,jsx,mjs,cjs}", "**/*.py", "**/*.go", "**/*.java", "**/*.rs", "**/*.rb", "**/*.cs"]
LANGUAGES = {"ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "typescript", "jsx": "typescript", "mjs": "typescript", "cjs": "typescript", "py": "python", "go": "go", "java": "java", "rs": "rust", "rb": "ruby", "cs": "csharp"}
TEST_FILE = [r"(^|/)(__tests__|tests|spec)/", r"\.(test|spec)\.[cm]?[jt]sx?$", r"(^|/)(test_[^/]+|[^/]+_test)\.py$"]
KIND_LABELS = {"function": "fn", "method": "method", "class": "class", "interface": "interface", "enum": "enum", "variable": "const", "namespace": "ns", "module": "module", "folder": "folder"}
CHARS_A_TOKEN = 3.7
MINIFIED_LENGTH, MINIFIED_LINE = 20000, 400


def expand_braces(glob: str) -> list[str]:
    m = re.search(r"\{([^{}]*)\}", glob)
    return [glob] if not m else [g for part in m[1].split(",") for g in expand_braces(glob[: m.start()] + part + glob[m.end() :])]


def glob_regex(glob: str) -> str:
    """``**/`` any folders, ``**`` anything, ``*`` within a segment, ``?`` one character; anchored, for any engine."""
    parts = re.split(r"(\*\*/|\*\*|\*|\?)", glob)
    known = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^(?:" + "".join(known[p] if p in known else re.sub(r"([^\w/ -])", r"\\\1", p) for p in parts if p) + ")"


def glob_pattern(globs: list[str]) -> str:
    return "(?s)" + "|".join(glob_regex(g) + r"\z" for glob in globs for g in expand_braces(glob))


def glob_column(path: Column, globs: list[str]) -> Column:
    return F.rlike(path, F.lit(glob_pattern(globs)))


def is_test_file(path: Column) -> Column:
    return F.rlike(path, F.lit("(?i)" + "|".join(TEST_FILE)))


def looks_minified(text: Column) -> Column:
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1
    return (F.length(text) >= MINIFIED_LENGTH) & (F.length(text) / lines > MINIFIED_LINE)


def language(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(table, ext)


def fuzzy_pattern(query: str) -> str:
    return "(?s)" + ".*".join(re.sub(r"([^\w ])", r"\\\1", c) for c in query.lower())


def fuzzy_match(text: Column, query: str) -> Column:
    return F.rlike(F.lower(text), F.lit(fuzzy_pattern(query))) if query else F.lit(True)


def top_segment(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def is_relative(spec: Column) -> Column:
    return F.startswith(spec, F.lit("./")) | F.startswith(spec, F.lit("../")) | (spec == ".")


def package_name(spec: Column) -> Column:
    return F.regexp_extract(spec, "^(@[^/]+/[^/]+|[^/]*)", 1)


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / F.lit(CHARS_A_TOKEN)).cast("long")


def cap_text(text: Column, tokens: int = 1500, notice: str = "\n… truncated") -> Column:
    cut = F.regexp_replace(F.substring(text, 1, int(tokens * CHARS_A_TOKEN)), r"\n[^\n]*\z", "")
    return F.when(estimate_tokens(text) > tokens, F.concat(cut, F.lit(notice))).otherwise(text)


def kind_label(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in KIND_LABELS.items() for x in kv]), kind), kind)


def display_label(kind: Column, name: Column) -> Column:
    return F.when(kind.isin("function", "method"), F.concat(name, F.lit("()"))).otherwise(name)


# Colours of nodes by kind and of edges by tone, this repository's own.
NODE_COLOURS = {"module": "#4c78a8", "folder": "#72879c", "namespace": "#7f7f7f", "class": "#f58518", "interface": "#54a24b", "enum": "#b279a2", "function": "#e45756", "method": "#ff9da6", "variable": "#9d755d"}
TONE_COLOURS = {"normal": "#555555", "muted": "#b0b0b0", "cycle": "#d62728", "heritage": "#2ca02c"}


def palette(kind: Column, colours: dict[str, str], other: str = "#555555") -> Column:
    """The colour of a kind or tone."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in colours.items() for x in kv]), kind), F.lit(other))


def emphasis(kind: Column, cnt: Column, type_only: Column, low: Column, in_cycle: Column) -> tuple[Column, Column]:
    """``(tone, width)`` of an edge."""
    no = F.lit(False)
    tone = F.when(kind.isin("extends", "implements"), "heritage").when(F.coalesce(in_cycle, no), "cycle").when(F.coalesce(low, no) | F.coalesce(type_only, no), "muted").otherwise("normal")
    return tone, F.round(F.least(1.2 + 0.75 * F.log2(F.coalesce(cnt, F.lit(1)).cast("double")), F.lit(3.5)), 2)

"""Symbol resolution, query answers, the budgeted map, diff parsing and impact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CHARS_A_TOKEN, display_label, estimate_tokens, fuzzy_match, is_test_file, kind_label, top_segment
from ..schema import CodeGraph
from .relational import degrees, inbound_weight, induced
from .traverse import KINDS, bfs, reach

SUGGESTIONS = 5
#: Lines of the narrowest bucket of spans, also the ratio of widths; how many widths there are (BUCKET ** LEVELS lines and more).
BUCKET, LEVELS = 64, 5


def symbol_matches(nodes: DataFrame, ref: str) -> DataFrame:
    """Nodes whose name, qualified name, id, ``file:qualified name`` or ``file:name`` is ``ref``."""
    forms = F.array("name", "qn", "id", F.concat_ws(":", "file", "qn"), F.concat_ws(":", "file", "name"))
    return nodes.where(~F.col("kind").isin("module", "folder") & F.array_contains(forms, ref))


def suggestions(nodes: DataFrame, ref: str, limit: int = SUGGESTIONS) -> DataFrame:
    return nodes.where(F.contains(F.lower("name"), F.lit(ref.lower())) | F.contains(F.lower("qn"), F.lit(ref.lower()))).orderBy("id").limit(limit)


def resolve_symbol(nodes: DataFrame, ref: str) -> DataFrame:
    """``(status, id)``: one resolved row, or the ambiguous ids, or suggestions."""
    found = symbol_matches(nodes, ref).select("id")
    n = found.limit(2).count()
    if n:
        return found.select(F.lit("resolved" if n == 1 else "ambiguous").alias("status"), "id")
    return suggestions(nodes, ref).select(F.lit("suggestion").alias("status"), "id")


def resolve_module_status(nodes: DataFrame, ref: str) -> DataFrame:
    """``(status, id)`` of a module, as ``resolve_symbol``."""
    found = resolve_module(nodes, ref)
    n = found.limit(2).count()
    if n:
        return found.select(F.lit("resolved" if n == 1 else "ambiguous").alias("status"), "id")
    return suggestions(nodes.where("kind = 'module'"), ref).select(F.lit("suggestion").alias("status"), "id")


def resolve_module(nodes: DataFrame, ref: str) -> DataFrame:
    return nodes.where((F.col("kind") == "module") & F.array_contains(F.array("qn", F.coalesce("file", F.lit("")), "id"), ref)).select("id")


def definitions(nodes: DataFrame, text: str) -> DataFrame:
    t = F.lit(text.lower())
    return nodes.where(~F.col("kind").isin("module", "folder") & (F.contains(F.lower("name"), t) | F.contains(F.lower("qn"), t)))


def symbol_text(kind: Column, name: Column, signature: Column, external: Column, line: Column) -> Column:
    return F.concat(kind_label(kind), F.lit(" "), name, F.coalesce(signature, F.lit("")), F.when(F.coalesce(external, F.lit(False)), " (external)").otherwise(""), F.coalesce(F.concat(F.lit(" ·"), line.cast("string")), F.lit("")))


def group_by_file(nodes: DataFrame) -> DataFrame:
    """``(file, symbols)``: members by line, then id."""
    row = F.struct(F.coalesce("start_line", F.lit(0)).alias("l"), "id", symbol_text(F.col("kind"), F.col("name"), F.col("signature"), F.col("external"), F.col("start_line")).alias("t"))
    return nodes.groupBy(F.coalesce("file", F.lit("(external)")).alias("file")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["t"]), "\n").alias("symbols"))


def listable(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("file").isNotNull() & ~F.col("kind").isin("module", "folder") & ~F.coalesce("external", F.lit(False)))


def symbol_line() -> Column:
    """A symbol's line of the map, over the columns of nodes and ``inbound``."""
    name = F.concat(kind_label(F.col("kind")), F.lit(" "), F.col("name"), F.coalesce("signature", F.lit("")))
    place = F.coalesce(F.concat(F.lit(" ·"), F.col("start_line").cast("string")), F.lit(""))
    return F.concat(F.lit("  "), name, place, F.when(F.col("inbound") > 0, F.concat(F.lit(" ←"), F.col("inbound").cast("string"))).otherwise(""))


def repo_map(g: CodeGraph, ranks: DataFrame, budget: int = 2000) -> DataFrame:
    """``(pos, file, line)`` of the largest ranked prefix whose rendered text fits the budget, one symbol at least.

    Lengths are summed in rank order; a file's heading counts where its first symbol stands. Every symbol takes at least
    two characters, so no more than the budget's characters of the ranking can be needed: a top-k, then one window.
    """
    syms = listable(g.nodes).join(ranks, "id").join(inbound_weight(g.edges), "id", "left")
    top = syms.select("id", "file", F.round("score", 12).alias("score"), "start_line", symbol_line().alias("line")).orderBy(F.desc("score"), "id").limit(int(budget * CHARS_A_TOKEN / 2) + 1)
    order = Window.orderBy(F.desc("score"), "id")
    first = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("score"), "id")) == 1
    sized = top.withColumn("first", first).withColumn("pos", F.row_number().over(order))
    run = F.sum(F.length("line") + 1 + F.when(F.col("first"), F.length("file") + 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return sized.withColumn("chars", run).where((F.ceil(F.col("chars") / CHARS_A_TOKEN) <= budget) | (F.col("pos") == 1)).select("pos", "file", "line", F.col("chars").cast("long").alias("chars"))


def map_by_file(shown: DataFrame) -> DataFrame:
    return shown.groupBy("file").agg(F.min("pos").alias("best"), F.count("*").alias("symbols"))


def parse_diff(diffs: DataFrame) -> DataFrame:
    """``(diff_id, file, line)`` of changed lines of unified diffs ``(diff_id, text)``; a diff's lines are windowed alone.

    Hunk lengths tell headers from content, so an added line of ``++ `` is content. Deletions count at the current line.
    """
    lines = diffs.select("diff_id", F.posexplode(F.split("text", "\r?\n")).alias("pos", "l"))
    w = Window.partitionBy("diff_id").orderBy("pos")
    hunk = F.regexp_extract("l", r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", 3)
    count = lambda k: F.when(F.regexp_extract("l", r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", k) == "", F.lit(1)).otherwise(F.regexp_extract("l", r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", k).cast("int"))
    is_hunk = hunk != ""
    rows = lines.withColumns({"start": F.when(is_hunk, hunk.cast("int")), "old": F.when(is_hunk, count(2)), "new": F.when(is_hunk, count(4)), "h": F.sum(F.when(is_hunk, 1).otherwise(0)).over(w)})
    inside = Window.partitionBy("diff_id", "h").orderBy("pos")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    kind = F.substring("l", 1, 1)
    rows = rows.withColumns({"start": F.first("start", True).over(inside), "old": F.first("old", True).over(inside), "new": F.first("new", True).over(inside)})
    adds, drops = F.when(is_hunk, 0).when(kind.isin("+", " ") | (F.col("l") == ""), 1).otherwise(0), F.when(is_hunk, 0).when(kind.isin("-", " ") | (F.col("l") == ""), 1).otherwise(0)
    rows = rows.withColumns({"a": F.coalesce(F.sum(adds).over(before), F.lit(0)), "d": F.coalesce(F.sum(drops).over(before), F.lit(0))})
    body = (F.col("h") > 0) & ~is_hunk & ((F.col("a") < F.col("new")) | (F.col("d") < F.col("old")))
    target = F.when(~body & F.startswith("l", F.lit("+++ ")), clean_path(F.substring(F.col("l"), F.lit(5), F.length("l"))))
    rows = rows.withColumns({"body": body, "file": F.last(target, True).over(w), "line": F.col("start") + F.col("a")})
    changed = rows.where(F.col("body") & kind.isin("+", "-") & F.col("file").isNotNull() & (F.col("file") != "/dev/null"))
    return changed.select("diff_id", "file", F.col("line").cast("int").alias("line")).distinct()


def clean_path(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"\t.*$", ""), '^"|"$', ""), "^[ab]/", "")


def span_within(start: Column, end: Column, outer_start: Column, outer_end: Column) -> Column:
    """Both ends inclusive."""
    return (start >= outer_start) & (end <= outer_end)


def span_contains_strict(start: Column, end: Column, inner_start: Column, inner_end: Column) -> Column:
    return span_within(inner_start, inner_end, start, end) & ~((start == inner_start) & (end == inner_end))


def enclosing(nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """The innermost node of each ``(file, line)``: latest start, then earliest end, then id.

    Spans stand in each bucket of lines they touch, at a width of at most 64 buckets a span, and a line asks one bucket of
    each width, so that a line meets the spans near it and not all of its file.
    """
    spans = nodes.where("kind <> 'folder' and start_line is not null").select("id", "file", "start_line", "end_line")
    # the least width 64, 64 * 64, .. of which the span touches few buckets
    level = F.greatest(F.lit(1), F.ceil(F.log(F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(2)).cast("double")) / F.log(F.lit(float(BUCKET)))).cast("int") - 1)
    width = F.pow(F.lit(BUCKET), F.col("level")).cast("long")
    at = lambda c: F.floor(F.col(c) / width)
    spans = spans.where("end_line >= start_line").withColumn("level", F.least(level, F.lit(LEVELS))).withColumn("bucket", F.explode(F.sequence(at("start_line"), at("end_line"))))
    asked = lines.select("file", "line").distinct().withColumn("level", F.explode(F.array(*[F.lit(k) for k in range(1, LEVELS + 1)]))).withColumn("bucket", at("line"))
    hit = asked.join(spans, ["file", "level", "bucket"]).where("line between start_line and end_line")
    best = F.min(F.struct((-F.col("start_line")).alias("s"), "end_line", "id"))
    return hit.groupBy("file", "line").agg(best.alias("b")).select("file", "line", F.col("b.id").alias("id"))


def impact(g: CodeGraph, lines: DataFrame, depth: int = 2) -> DataFrame:
    """``(id, role, is_test)``: what changed lines lie in, and what reaches it over calls and imports within depth."""
    changed = enclosing(g.nodes, lines).select("id").distinct()
    back = g.edges.where(F.col("kind").isin(*KINDS)).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    hit = bfs(back, changed, depth)
    role = F.when(F.col("depth") == 0, "changed").otherwise("reached")
    return hit.join(g.nodes.select("id", "file"), "id").select("id", role.alias("role"), F.coalesce(is_test_file(F.col("file")), F.lit(False)).alias("is_test"))


def importers(g: CodeGraph, module: str) -> DataFrame:
    """Modules that import one, over any number of steps, itself at depth 0."""
    return reach(g, [module], kinds=("imports",), reverse=True)


def path_text(nodes: DataFrame, path: DataFrame) -> DataFrame:
    """``(pos, id)`` of a shortest path as one row ``path``, its names joined by arrows; empty if there is none."""
    row = F.array_sort(F.collect_list(F.struct("pos", "name")))
    return path.join(nodes.select("id", "name"), "id").agg(F.array_join(F.transform(row, lambda r: r["name"]), " → ").alias("path"))


def hover_details(g: CodeGraph) -> DataFrame:
    """``id, kind, label, place, in_degree, out_degree`` of every node; a node without edges has zeros."""
    place = F.coalesce(F.concat_ws(":", "file", F.col("start_line").cast("string")), F.lit(""))
    n = g.nodes.join(degrees(g.edges), "id", "left")
    return n.select("id", "kind", display_label(F.col("kind"), F.col("name")).alias("label"), place.alias("place"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("in_degree", "out_degree")])


def search_filter(nodes: DataFrame, text: str, kinds_off=(), segments_off=()) -> DataFrame:
    """Nodes of enabled kinds and top folders whose label or path fuzzily matches."""
    path = F.coalesce("file", F.lit(""))
    hit = fuzzy_match(display_label(F.col("kind"), F.col("name")), text) | fuzzy_match(path, text)
    return nodes.where(~F.col("kind").isin(*kinds_off) & ~top_segment(path).isin(*segments_off) & hit)


def slice_graph(g: CodeGraph, ids: DataFrame) -> CodeGraph:
    return induced(g, ids)


__all__ = ["CHARS_A_TOKEN", "clean_path", "definitions", "display_label", "enclosing", "estimate_tokens", "group_by_file", "impact", "map_by_file", "parse_diff", "repo_map", "resolve_module", "resolve_symbol", "slice_graph", "suggestions", "symbol_matches", "symbol_text"]

"""Facts to graphs: import targets and callees are found by equality joins over exploded candidates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..operators.rank import cyclic
from ..schema import EDGES, NODES, CodeGraph, edge_id, padded
from ..storage import dealt, stored
from . import lexical

# Extensions in order of preference.
SCRIPT = ["ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs"]
_NONE = "cast(array() as array<string>)"


class Cancelled(RuntimeError):
    """``cancelled()`` was true before the phase that is named."""


def normalised(parts: Column) -> Column:
    """Path segments without ``.``, empty ones, and what ``..`` takes back."""
    step = lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(parts, F.expr(_NONE), step)


def folder(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def _first(tries: DataFrame, files: DataFrame, own: bool = False) -> DataFrame:
    """``path, spec, target``: the first candidate of an import that is a file, and not the importing one unless ``own``."""
    hit = tries.join(dealt(files.select(F.col("path").alias("target"))), "target").where(F.lit(own) | (F.col("target") != F.col("path")))
    return hit.groupBy("path", "spec").agg(F.min_by("target", "pos").alias("target"))


def _exploded(imports: DataFrame, candidates: Column) -> DataFrame:
    return imports.select("path", "spec", F.posexplode(candidates).alias("pos", "target"))


def script_targets(imports: DataFrame, files: DataFrame, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """Relative specifiers from the importing folder, others by ``paths`` aliases (at most one ``*`` each)."""
    spec = F.col("spec")
    bases = [F.when(spec.rlike(r"^\.{1,2}(/|$)"), F.array_join(normalised(F.concat(folder(F.col("path")), F.split(spec, "/"))), "/"))]
    for pattern, targets in (aliases or {}).items():
        head, star, tail = pattern.partition("*")
        fits = F.startswith(spec, F.lit(head)) & F.endswith(spec, F.lit(tail)) & (F.length(spec) >= len(head) + len(tail)) if star else spec == pattern
        middle = F.substring(spec, F.lit(len(head) + 1), F.length(spec) - len(head) - len(tail))
        for t in targets:
            a, s, b = t.partition("*")
            bases.append(F.when(fits, F.array_join(normalised(F.split(F.concat(F.lit(a), middle, F.lit(b)) if s else F.lit(t), "/")), "/")))
    tries = []
    for base in bases:
        stem = F.regexp_replace(base, r"\.([mc]?)js(x?)$", "")
        tries += [base, *[F.concat(base, F.lit("." + e)) for e in SCRIPT], *[F.when(base.rlike(r"\.[mc]?jsx?$"), F.concat(stem, F.lit("." + e))) for e in SCRIPT[:4]]]
        tries += [F.concat(base, F.when(base == "", "").otherwise("/"), F.lit("index." + e)) for e in SCRIPT]
    return _first(_exploded(imports, F.array(*tries)).where("target is not null"), files, own=True)


def ruby_targets(imports: DataFrame, files: DataFrame) -> DataFrame:
    own = F.split("spec", "/")
    named = lambda parts: F.regexp_replace(F.concat(F.array_join(normalised(parts), "/"), F.lit(".rb")), r"\.rb\.rb$", ".rb")
    return _first(_exploded(imports, F.array(named(F.concat(folder(F.col("path")), own)), named(own))), files)


def java_targets(imports: DataFrame, files: DataFrame) -> DataFrame:
    """The file of the qualified name, else the shortest path that ends with it; wildcards have none."""
    wanted = F.concat(F.replace("spec", F.lit("."), F.lit("/")), F.lit(".java"))
    parts = F.split("path", "/")
    ends = files.select(F.col("path").alias("target"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))).alias("wanted"))
    hit = imports.where("not endswith(spec, '.*')").withColumn("wanted", wanted).join(dealt(ends), "wanted").where("target <> path")
    return hit.groupBy("path", "spec").agg(F.min_by("target", F.struct(F.col("target") != F.col("wanted"), F.length("target"), F.col("target"))).alias("target"))


def rust_targets(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Module paths from the crate's root, the module's own folder or a folder above; trailing item names fall away."""
    root = files.where(F.rlike("path", F.lit(r"src/(lib|main)\.rs$"))).agg(F.min("path")).first()[0]
    top = F.lit(root.rsplit("/", 1)[0] if root else "")
    stem = F.regexp_extract("path", r"([^/]*)\.rs$", 1)
    here = F.when(stem.isin("mod", "lib", "main"), folder(F.col("path"))).otherwise(F.concat(folder(F.col("path")), F.array(stem)))
    parts = F.filter(F.split("spec", "::"), lambda x: x != "")
    supers = F.size(F.split(F.regexp_extract("spec", r"^((?:super::|super$)*)", 1), "super")) - 1
    head = F.try_element_at(parts, F.lit(1))
    base = F.when(head == "crate", F.filter(F.split(top, "/"), lambda x: x != "")).when(head == "super", F.slice(here, 1, F.greatest(F.size(here) - supers, F.lit(0)))).otherwise(here)
    skip = F.when(head.isin("crate", "self"), 1).when(head == "super", supers).otherwise(0)
    i = imports.select("path", "spec", base.alias("base"), F.slice(parts, skip + 1, F.size(parts)).alias("rest")).where("size(rest) > 0")
    stems = F.transform(F.sequence(F.size("rest"), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.concat(F.col("base"), F.slice("rest", F.lit(1), k)), "/"))
    return _first(_exploded(i, F.flatten(F.transform(stems, lambda s: F.array(F.concat(s, F.lit(".rs")), F.concat(s, F.lit("/mod.rs")))))), files)


TARGETS = {"typescript": script_targets, "ruby": ruby_targets, "java": java_targets, "rust": rust_targets}


def declared(f: DataFrame) -> DataFrame:
    """Declarations with ids; of the same name in a file, the second gets ``~2``."""
    base = F.when(F.col("kind") == "module", F.concat(F.lit("module:"), "path")).otherwise(F.concat("kind", F.lit(":"), "path", F.lit("#"), "qn"))
    d = f.where("fact = 'decl'").withColumn("base", base)
    n = F.row_number().over(Window.partitionBy("path", "base").orderBy("seq"))
    return d.withColumn("n", n).withColumn("id", F.when(F.col("n") > 1, F.concat("base", F.lit("~"), F.col("n").cast("string"))).otherwise(F.col("base")))


def _structure(files: DataFrame, lang: str) -> tuple[DataFrame, DataFrame]:
    f = stored(lexical.facts(files, lang), "facts")
    return f, stored(declared(f), "declared")


def _in_cycles(imports: DataFrame) -> DataFrame:
    """``imports`` with ``in_cycle``: value imports between files that are both on a cycle of value imports."""
    value = stored(imports.where("inside and type_only is null").select("src", "dst"), "value-imports")
    on = cyclic(value)
    if on.isEmpty():
        return imports
    hit = value.join(dealt(on.withColumnRenamed("id", "src")), "src", "left_semi").join(dealt(on.withColumnRenamed("id", "dst")), "dst", "left_semi")
    return imports.join(dealt(hit.withColumn("in_cycle", F.lit(True))), ["src", "dst"], "left")


def analyze(files: DataFrame, lang: str, aliases: dict[str, list[str]] | None = None, progress: Callable[[str, int, int], None] | None = None, cancelled: Callable[[], bool] | None = None) -> tuple[CodeGraph, DataFrame]:
    """The graph and diagnostics of the files of one language (``lexical.LANGUAGES``).

    Calls: by name within the file to the first callable, with low confidence; in TypeScript also through named
    imports, ``this`` and ``new`` with full confidence, an unknown name gives an ``unresolved`` node, and a function that is
    an argument of a call is called with low confidence. TypeScript also has extends and implements edges, import cycles,
    calls and imports of itself, and signatures and doc lines as they are written. The files are read by one pass whose
    facts are stored, and the joins deal out both sides.

    Phases: structure, imports and calls; in TypeScript structure, heritage, imports, cycles, calls. ``progress(phase, done,
    total)`` is told of each before and after, in files; before each ``cancelled()`` is asked, and ``Cancelled`` raised if
    it is true. With either of them a phase's rows are stored before the next begins, else what the caller doesn't use
    isn't made.
    """
    watched = progress is not None or cancelled is not None
    total = files.count() if progress else 0

    def phase(name: str, make):
        if cancelled and cancelled():
            raise Cancelled(name)
        if progress:
            progress(name, 0, total)
        out = make()
        if progress:
            progress(name, total, total)
        return out

    kept = lambda df, name: stored(df, name) if watched else df
    f, d = phase("structure", lambda: _structure(files, lang))
    module = F.concat(F.lit("module:"), "path")
    owner = dealt(d.select("path", F.col("seq").alias("parent"), F.col("id").alias("owner")))
    contains = d.where("kind <> 'module'").join(owner, ["path", "parent"], "left").select(F.lit("contains").alias("kind"), F.coalesce("owner", module).alias("src"), F.col("id").alias("dst"))

    raw = f.where("fact = 'import'").select("path", F.col("name").alias("spec"), (F.col("kind") == "type").alias("type"), F.col("qn").alias("names"))
    specs = raw.select("path", "spec").distinct()
    known = specs.withColumn("target", F.lit(None).cast("string")).where(F.lit(False))
    if lang in TARGETS:
        known = script_targets(specs, files, aliases) if lang == "typescript" else TARGETS[lang](specs, files)
    outside = F.col("spec")
    if lang == "typescript":
        outside = F.when(F.rlike("spec", F.lit(r"^\.")), F.col("spec")).otherwise(F.regexp_extract("spec", "^(@[^/]+/[^/]+|[^/]*)", 1))
    if lang == "java":
        outside = F.regexp_replace("spec", r"\.\*$", "")
    found = raw.join(dealt(known), ["path", "spec"], "left")
    to = F.coalesce(F.concat(F.lit("module:"), "target"), F.concat(F.lit("module:external:"), outside))
    found = found.select("path", "spec", "names", "target", module.alias("src"), to.alias("dst"), F.coalesce("type", F.lit(False)).alias("type"))
    if lang == "typescript":

        def inherited(found: DataFrame) -> tuple[DataFrame, DataFrame]:
            found = stored(found, "imports")
            return found, kept(_heritage(f, owner, d, found), "heritage")

        found, heritage = phase("heritage", lambda: inherited(found))
    else:
        found = found.where("src <> dst")
    imports = found.groupBy("src", "dst").agg(F.when(F.min("type"), True).alias("type_only"), F.max(F.col("target").isNotNull()).alias("inside")).withColumn("kind", F.lit("imports"))
    imports = phase("imports", lambda: kept(imports, "import-edges"))
    if lang == "typescript":
        imports = phase("cycles", lambda: kept(_in_cycles(imports), "cycles"))
    external = found.where("target is null").select(F.col("dst").alias("id"), F.expr("substring(dst, 17)").alias("name")).distinct().select("id", F.lit("module").alias("kind"), "name", F.col("name").alias("qn"), F.lit(True).alias("external"))

    how = F.when(F.col("fact") == "reference", "argument").otherwise(F.col("kind"))
    calls = f.where("fact in ('call', 'reference')").select("path", how.alias("how"), "name", "parent").join(owner, ["path", "parent"], "left").withColumn("src", F.coalesce("owner", module))
    kinds = ["function", "method"] if lang != "typescript" else ["function", "class"]
    first = lambda want: dealt(d.where(F.col("kind").isin(want)).groupBy("path", "name").agg(F.min_by("id", "seq").alias("dst")))
    if lang != "typescript":
        to_calls = calls.join(first(kinds), ["path", "name"]).select("src", "dst", F.lit(True).alias("low")).where("src <> dst")
    else:
        to_calls = _script_calls(calls, d, found, first)
        external = external.unionByName(to_calls.where("startswith(dst, 'function:unresolved#')").select(F.col("dst").alias("id"), F.lit("function").alias("kind"), F.substring_index("dst", "#", -1).alias("name"), F.substring_index("dst", "#", -1).alias("qn"), F.lit(True).alias("external")).distinct())
    n = F.count("*")
    to_calls = to_calls.groupBy("src", "dst").agg(F.when(n > 1, n).alias("cnt"), F.when(F.min("low"), True).alias("low")).withColumn("kind", F.lit("calls"))
    to_calls = phase("calls", lambda: kept(to_calls, "calls"))
    e = padded(contains, EDGES).unionByName(padded(to_calls, EDGES)).unionByName(padded(imports, EDGES))
    if lang == "typescript":
        e = e.unionByName(padded(heritage, EDGES))
    e = e.withColumn("id", edge_id(F.col("kind"), F.col("src"), F.col("dst")))
    nodes = padded(d.withColumn("file", F.col("path")), NODES).unionByName(padded(external, NODES))
    problems = f.where("fact = 'problem'").select(F.col("kind").alias("severity"), F.col("name").alias("message"), F.col("path").alias("file"))
    if lang == "typescript":
        missing = found.where("target is null and startswith(spec, '.')").select(F.lit("warning").alias("severity"), F.concat(F.lit('unresolved import "'), "spec", F.lit('"')).alias("message"), F.col("path").alias("file")).distinct()
        problems = problems.unionByName(missing)
    return CodeGraph(nodes, padded(e, EDGES)), problems


def _bound(found: DataFrame, first: DataFrame) -> DataFrame:
    """``path, name, away, bound``: names that a file takes from another by a named import, and what they stand for there."""
    part = F.explode(F.split(F.regexp_extract("names", r"\{([^}]*)\}", 1), ","))
    bound = found.where("target is not null and names like '%{%'").select("path", "target", part.alias("b")).withColumn("b", F.trim("b")).where("b <> ''")
    local = F.regexp_replace(F.substring_index("b", " as ", -1), "^type ", "")
    bound = bound.select("path", F.col("target"), F.regexp_replace(F.substring_index("b", " as ", 1), "^type ", "").alias("far"), local.alias("name"))
    away = first.select(F.col("path").alias("target"), F.col("name").alias("far"), F.col("dst").alias("away"))
    return bound.join(dealt(away), ["target", "far"], "left").groupBy("path", "name").agg(F.min("away").alias("away"), F.lit(True).alias("bound"))


def _heritage(f: DataFrame, owner: DataFrame, d: DataFrame, found: DataFrame) -> DataFrame:
    """``kind, src, dst, line`` of extends and implements clauses, resolved in the file by qualified name, else by name, then through named imports.

    A name that is neither declared nor imported (a library's type) gives no edge.
    """
    types = d.where("kind in ('class', 'interface')")
    by_name = types.groupBy("path", "name").agg(F.min_by("id", "seq").alias("dst"))
    by_qn = types.groupBy("path", F.col("qn").alias("name")).agg(F.min_by("id", "seq").alias("exact"))
    h = f.where("fact = 'heritage'").select("path", "kind", "name", "parent", F.col("start_line").alias("line")).join(owner, ["path", "parent"])
    h = h.join(dealt(by_qn), ["path", "name"], "left").join(dealt(by_name), ["path", "name"], "left").join(dealt(_bound(found, by_name)), ["path", "name"], "left")
    e = h.select("kind", F.col("owner").alias("src"), F.coalesce("exact", "away", "dst").alias("dst"), "line").where("src <> dst")
    return e.groupBy("kind", "src", "dst").agg(F.min("line").alias("line"))


def _script_calls(calls: DataFrame, d: DataFrame, found: DataFrame, first) -> DataFrame:
    """``src, dst, low``: this-methods within the owner's class; plain names in the file, then through imports; functions that are arguments."""
    methods = d.where("kind = 'method'").groupBy("path", F.col("parent").alias("cls"), "name").agg(F.min_by("id", "seq").alias("dst"))
    inside = d.select(F.col("id").alias("src"), F.col("parent").alias("cls"))
    own = calls.where("how = 'this'").join(dealt(inside), "src").join(dealt(methods), ["path", "cls", "name"]).select("src", "dst", F.lit(False).alias("low"))
    plain = calls.where("how is null or how in ('new', 'argument')")
    local = plain.join(first(["function", "class"]), ["path", "name"], "left")
    bound = _bound(found, first(["function", "class"]))
    r = local.join(dealt(bound), ["path", "name"], "left")
    argument = F.coalesce(F.col("how") == "argument", F.lit(False))
    # a function within another is in sight only there: the part of its name before the last dot begins the caller's
    caller = F.concat(F.regexp_replace(F.substring_index("src", "#", -1), r"~\d+$", ""), F.lit("."))
    within = F.regexp_extract(F.substring_index("dst", "#", -1), r"^(.*\.)?[^.]*$", 1)
    seen = ~argument | (within == "") | F.startswith(caller, within)
    known = r.select("src", F.coalesce(F.when(seen, F.col("dst")), "away").alias("dst"), argument.alias("low")).where("dst is not null and (not low or startswith(dst, 'function:'))")
    lost = r.where("dst is null and bound is null and (how is null or how = 'new')").where(~F.col("name").isin(sorted(lexical.GLOBALS)))
    return own.unionByName(known).unionByName(lost.select("src", F.concat(F.lit("function:unresolved#"), "name").alias("dst"), F.lit(True).alias("low")))

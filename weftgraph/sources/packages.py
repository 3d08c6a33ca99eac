"""Packages of a workspace, import aliases from packages and tsconfig files, and roots of several projects."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

# Where a package's entry is looked for, in order.
FOLDERS = ["src", "source", "lib", ""]
NAMES = ["index", "main", "mod"]
EXTENSIONS = ["ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs"]
DEEPEST = 5


def packages(files: DataFrame) -> DataFrame:
    """``name, root, source_root, entry`` from ``files(path, text)``: the first entry that exists; of a name, the first path."""
    parts = F.split("path", "/")
    own = files.where((F.substring_index("path", "/", -1) == "package.json") & (F.size(parts) <= DEEPEST + 1))
    p = own.select(F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("root"), F.get_json_object("text", "$.name").alias("name")).where("name <> ''")
    at = lambda *xs: "/".join(x for x in xs if x)
    tries = [(at(d), at(d, f"{n}.{e}")) for d in FOLDERS for n in NAMES for e in EXTENSIONS]
    tails = F.explode(F.array(*[F.struct(F.lit(k).alias("pos"), F.lit(d).alias("folder"), F.lit(t).alias("tail")) for k, (d, t) in enumerate(tries)])).alias("c")
    below = lambda tail: F.when(F.col("root") == "", tail).otherwise(F.rtrim(F.concat("root", F.lit("/"), tail), F.lit("/")))
    c = p.select("root", "name", tails).select("root", "name", "c.pos", below(F.col("c.folder")).alias("source_root"), below(F.col("c.tail")).alias("entry"))
    have = c.join(files.select(F.col("path").alias("entry")), "entry").groupBy("root", "name").agg(F.min_by(F.struct("source_root", "entry"), "pos").alias("x"))
    return have.groupBy("name").agg(F.min_by(F.struct("root", "x"), "root").alias("y")).select("name", "y.root", "y.x.source_root", "y.x.entry")


def package_aliases(found: DataFrame) -> DataFrame:
    """``pattern, target``: a name is its entry, what is below a name is below its source root."""
    deep = F.struct(F.concat("name", F.lit("/*")).alias("pattern"), F.concat(F.when(F.col("source_root") == "", "").otherwise(F.concat("source_root", F.lit("/"))), F.lit("*")).alias("target"))
    return found.select(F.explode(F.array(F.struct(F.col("name").alias("pattern"), F.col("entry").alias("target")), deep)).alias("a")).select("a.*")


def tsconfig_aliases(text: str, folder: str = "") -> tuple[dict[str, list[str]], str | None]:
    """``(paths from the workspace's root, why there are none)`` of one tsconfig; comments and trailing commas are allowed."""
    bare = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    bare = re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", bare)
    try:
        options = json.loads(bare).get("compilerOptions") or {}
    except (ValueError, AttributeError):
        return {}, "tsconfig can't be read"
    if not options.get("paths"):
        return {}, "tsconfig has no paths"
    out: dict[str, list[str]] = {}
    for pattern, targets in options["paths"].items():
        for t in targets:
            at: list[str] | None = []
            for x in f"{folder}/{options.get('baseUrl', '.')}/{t}".split("/"):
                if x == ".." and not at:
                    at = None
                    break
                at = at[:-1] if x == ".." else at if x in ("", ".") else [*at, x]
            if at is not None:
                out.setdefault(pattern, []).append("/".join(at))
    return out, None if out else "paths lie outside the workspace"


def alias_map(found: DataFrame, tsconfig: dict[str, list[str]]) -> dict[str, list[str]]:
    """Aliases for ``script_targets``; tsconfig wins. A workspace's packages are few: one row each."""
    return {r["pattern"]: [r["target"]] for r in package_aliases(found).toLocalIterator()} | tsconfig


def root_prefixes(roots: DataFrame) -> DataFrame:
    """``roots(pos, name)`` to ``pos, name, prefix``: none for a single root, ``~n`` behind names that repeat."""
    n = F.row_number().over(Window.partitionBy("name").orderBy("pos"))
    alone = roots.limit(2).count() < 2
    return roots.withColumn("prefix", F.lit("") if alone else F.when(n > 1, F.concat("name", F.lit("~"), n.cast("string"))).otherwise(F.col("name")))


def split_roots(paths: DataFrame, roots: DataFrame, path: str = "path") -> DataFrame:
    """``paths`` with ``root`` and ``rest``: the first root by position whose prefix the path stands below, both null if none."""
    prefixes = root_prefixes(roots).select(F.col("pos").alias("__pos"), F.col("name").alias("__root"), F.col("prefix").alias("__prefix"))
    # a prefix is a path's first segment, or empty for a single root, so the join is on equality
    head = F.when(F.lit(roots.limit(2).count() < 2), F.lit("")).otherwise(F.substring_index(path, "/", 1))
    first = prefixes.groupBy("__prefix").agg(F.min_by("__root", "__pos").alias("root"))
    rest = F.when(F.col("__prefix") == "", F.col(path)).when(F.instr(path, "/") > 0, F.expr(f"substring({path}, length(__prefix) + 2)"))
    out = paths.withColumn("__head", head).join(first, F.col("__head") == F.col("__prefix"), "left").withColumn("rest", rest)
    return out.withColumn("root", F.when(F.col("rest").isNotNull(), F.col("root"))).drop("__head", "__prefix")


def prefixed(path, prefix):
    return F.when(prefix == "", path).otherwise(F.concat(prefix, F.lit("/"), path))

"""Python sources to nodes and edges: one Arrow pass extracts facts a file, joins resolve them.

Facts are a pure function of one file, so a changed file only re-extracts itself; resolution is joins over all facts. A
file that doesn't parse gives a module node and a warning. Calls resolve by name within the file, first declaration wins,
with low confidence; self calls are dropped.
"""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..schema import EDGES, NODES, CodeGraph, edge_id, padded

FACTS = "path string, fact string, kind string, name string, qn string, parent string, start_line int, end_line int, seq int"


def facts_of(path: str, text: str | None) -> list[tuple]:
    """``(fact, kind, name, qn, parent, start, end)``: declarations, imports, calls and problems of one file."""
    text = text or ""
    out = [("decl", "module", path.rsplit("/", 1)[-1], path, None, 1, max(1, text.count("\n") + 1))]
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return [*out, ("problem", "warning", "file has syntax errors", None, None, 1, 1)]

    def walk(node, owner: str | None, in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                cls = isinstance(child, ast.ClassDef)
                qn = f"{owner}.{child.name}" if owner else child.name
                out.append(("decl", "class" if cls else "method" if in_class else "function", child.name, qn, owner, child.lineno, child.end_lineno))
                walk(child, qn, cls)
                continue
            if isinstance(child, ast.Import):
                out.extend(("import", None, a.name, None, owner, child.lineno, child.lineno) for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                out.append(("import", None, "." * child.level + (child.module or ""), None, owner, child.lineno, child.lineno))
            elif isinstance(child, ast.Call):
                f = child.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                if name:
                    out.append(("call", None, name, None, owner, child.lineno, child.lineno))
            walk(child, owner, in_class)

    walk(tree, None, False)
    return out


def facts(files: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            rows = [(p, *f, k) for p, t in zip(b.column("path").to_pylist(), b.column("text").to_pylist(), strict=True) for k, f in enumerate(facts_of(p, t))]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 9
            types = [pa.string()] * 6 + [pa.int32()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[c.split()[0] for c in FACTS.split(", ")])

    return files.select("path", "text").mapInArrow(run, FACTS)


def _declared(f: DataFrame) -> DataFrame:
    base = F.when(F.col("kind") == "module", F.concat(F.lit("module:"), "path")).otherwise(F.concat("kind", F.lit(":"), "path", F.lit("#"), "qn"))
    d = f.where("fact = 'decl'").withColumn("base", base)
    n = F.row_number().over(Window.partitionBy("path", "base").orderBy("seq"))
    return d.withColumn("n", n).withColumn("id", F.when(F.col("n") > 1, F.concat("base", F.lit("~"), F.col("n").cast("string"))).otherwise(F.col("base")))


def analyze(files: DataFrame) -> tuple[CodeGraph, DataFrame]:
    """The graph and its diagnostics; store ``facts`` first if files are many."""
    f = facts(files)
    d = _declared(f)
    first = d.where("n = 1")
    module = F.concat(F.lit("module:"), "path")
    owner = first.select("path", F.col("qn").alias("parent"), F.col("id").alias("owner")).where("not owner like 'module:%'")
    up = d.where("kind <> 'module'").join(owner, ["path", "parent"], "left")
    contains = up.select(F.lit("contains").alias("kind"), F.coalesce("owner", module).alias("src"), F.col("id").alias("dst"), F.lit(None).cast("long").alias("cnt"), F.lit(None).cast("boolean").alias("low"))
    callee = d.where("kind in ('function', 'method')").groupBy("path", "name").agg(F.min_by("id", "seq").alias("dst"))
    calls = f.where("fact = 'call'").join(owner, ["path", "parent"], "left").join(callee, ["path", "name"]).select(F.coalesce("owner", module).alias("src"), "dst").where("src <> dst")
    many = F.when(F.count("*") > 1, F.count("*"))
    calls = calls.groupBy("src", "dst").agg(many.alias("cnt")).select(F.lit("calls").alias("kind"), "src", "dst", "cnt", F.lit(True).alias("low"))
    i = f.where("fact = 'import'").select("path", F.col("name").alias("spec"))
    dots = F.length(F.regexp_extract("spec", r"^(\.*)", 1))
    tail = F.replace(F.regexp_replace("spec", r"^\.*", ""), F.lit("."), F.lit("/"))
    folder = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - F.greatest(dots, F.lit(1)), F.lit(0)))
    below = F.array_join(F.filter(F.concat(F.when(dots > 0, folder).otherwise(F.array().cast("array<string>")), F.array(tail)), lambda x: x != ""), "/")
    tries = i.withColumn("id", F.monotonically_increasing_id()).select("id", "path", "spec", F.posexplode(F.array(F.concat(below, F.lit(".py")), F.concat(below, F.lit("/__init__.py")))).alias("p", "target"))
    have = first.where("kind = 'module'").select(F.col("path").alias("target"), F.lit(True).alias("found"))
    hit = tries.join(have, "target", "left").groupBy("path", "spec").agg(F.min_by("target", F.when(F.col("found"), F.col("p")).otherwise(9)).alias("target"), F.max("found").alias("found"))
    imports = hit.select(module.alias("src"), F.when(F.col("found"), F.concat(F.lit("module:"), "target")).otherwise(F.concat(F.lit("module:external:"), "spec")).alias("dst"), (~F.coalesce("found", F.lit(False))).alias("ext"), "spec").where("src <> dst")
    external = imports.where("ext").select(F.col("dst").alias("id"), F.lit("module").alias("kind"), F.col("spec").alias("name"), F.col("spec").alias("qn"), F.lit(True).alias("external")).distinct()
    imports = imports.select(F.lit("imports").alias("kind"), "src", "dst", F.lit(None).cast("long").alias("cnt"), F.lit(None).cast("boolean").alias("low")).distinct()
    e = contains.unionByName(calls).unionByName(imports).withColumn("id", edge_id(F.col("kind"), F.col("src"), F.col("dst")))
    nodes = padded(d.withColumn("file", F.col("path")), NODES).unionByName(padded(external, NODES))
    problems = f.where("fact = 'problem'").select(F.col("kind").alias("severity"), F.col("name").alias("message"), F.col("path").alias("file"))
    return CodeGraph(nodes, padded(e, EDGES)), problems

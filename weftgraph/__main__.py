"""The command line: ``python -m weftgraph COMMAND``. It exits with 2 on wrong usage and 1 where there is no answer."""

from __future__ import annotations

import argparse
import subprocess
import sys

from pyspark.sql import SparkSession

from .export import diagrams, text
from .frontends import python as py
from .frontends import resolve
from .frontends.lexical import LANGUAGES
from .functions.text import language
from .operators.hierarchy import collapse_modules
from .operators.relational import union_graphs
from .schema import CodeGraph
from .service import Service, Unanswered, serve
from .sources.files import discover

QUESTIONS = {"defs": "find_symbol", "callers": "callers", "callees": "callees", "importers": "importers", "slice": "slice", "path": "path"}


def analyze(spark: SparkSession, root: str, tests: bool = False) -> CodeGraph:
    """All languages of the files below a root as one graph."""
    files = discover(spark, root if "://" in root else f"file://{root}", tests=tests).withColumn("lang", language("path")).persist()
    try:
        found = sorted(r["lang"] for r in files.select("lang").distinct().collect() if r["lang"])
        parts = [(py.analyze(mine) if lang == "python" else resolve.analyze(mine, lang))[0] for lang in found if lang == "python" or lang in LANGUAGES for mine in [files.where(files["lang"] == lang).select("path", "text")]]
        if not parts:
            raise Unanswered(f"no source files below {root}")
        return union_graphs(*parts) if len(parts) > 1 else parts[0]
    finally:
        files.unpersist()


def options() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="weftgraph")
    top.add_argument("--root", default=".")
    top.add_argument("--tests", action="store_true", help="test files too")
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("map").add_argument("--budget", type=int, default=2000)
    q = sub.add_parser("query")
    q.add_argument("question", choices=QUESTIONS)
    q.add_argument("of", nargs="+")
    q.add_argument("--depth", type=int)
    i = sub.add_parser("impact")
    i.add_argument("ref", nargs="?", help="what git compares with; - reads a diff from standard input")
    i.add_argument("--staged", action="store_true")
    i.add_argument("--depth", type=int, default=2)
    sub.add_parser("serve")
    sub.add_parser("analyze")
    e = sub.add_parser("export")
    e.add_argument("format", choices=text.BUILTIN.by_id)
    e.add_argument("--modules", action="store_true", help="modules only")
    return top


def diff_of(root: str, ref: str | None, staged: bool) -> str:
    if ref == "-":
        return sys.stdin.read()
    run = ["git", "-C", root, "diff", "--unified=0", "--no-color", "--no-ext-diff", *(["--staged"] if staged else []), *([ref] if ref else []), "--"]
    done = subprocess.run(run, capture_output=True, text=True, check=False)
    if done.returncode:
        raise Unanswered(done.stderr.strip() or "git diff failed")
    return done.stdout


def answer(spark: SparkSession, o: argparse.Namespace) -> str:
    g = analyze(spark, o.root, o.tests)
    if o.command == "analyze":
        return text.to_json(g)
    if o.command == "export":
        return text.BUILTIN.by_id[o.format](collapse_modules(g) if o.modules else g)
    service = Service(g)
    try:
        if o.command == "map":
            return service.call("repo_map", {"budget": o.budget})
        if o.command == "impact":
            return service.call("impact", {"diff": diff_of(o.root, o.ref, o.staged), "depth": o.depth})
        if o.command == "serve":
            for line in serve(service, sys.stdin):
                print(line, flush=True)
            return ""
        tool = service.tools[QUESTIONS[o.question]]
        given = dict(zip(tool.needs, o.of, strict=False))
        return service.call(QUESTIONS[o.question], given | ({"depth": o.depth} if "depth" in tool.takes and o.depth is not None else {}))
    finally:
        service.close()


def main(argv: list[str] | None = None) -> int:
    parser = options()
    o = parser.parse_args(argv)
    if o.command == "query" and len(o.of) != (2 if o.question == "path" else 1):
        parser.error(f"{o.question} takes {2 if o.question == 'path' else 1} name(s)")
    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        print(answer(spark, o))
    except Unanswered as why:
        print(why, file=sys.stderr)
        return 1
    return 0


__all__ = ["analyze", "diagrams", "main"]

if __name__ == "__main__":
    sys.exit(main())

"""Reads and writes of local variables in TypeScript and JavaScript functions, one Arrow pass over the files.

A variable is a parameter, a ``let``/``const``/``var``, a catch or loop binding, or a nested function's name; module-level
ones are ignored. A use belongs to the innermost named function around it, and is ``captured`` where that isn't the
function that declares the variable. Parameters of anonymous arrows count as variables of the named function around them.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .flow import Reader, functions_of
from .lexical import LANGUAGES, Brackets, blanked

SITES = "path string, fn int, name string, variable string, decl_line int, decl_col int, captured boolean, access string, line int, col int"
_TYPES = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.int32(), pa.int32()]
_NAME = re.compile(r"[A-Za-z_$][\w$]*")
_LEAD = re.compile(r"\s*(?:(?:public|private|protected|readonly|override)\s+)*(?:\.\.\.)?\s*")
_KEY = re.compile(r"[\w$]+\s*:\s*")


class Scopes:
    """Declared names by the span in which they are seen."""

    def __init__(self, code: str, reader: Reader, functions: list[tuple[str, int, int, int]]):
        self.code, self.r, self.functions = code, reader, functions
        self.seen: dict[str, list[tuple[int, int, int]]] = {}  # name: (scope start, scope end, offset of the declaration)
        self.writes: set[int] = set()
        self.opens = sorted((a, b) for a, b in reader.close.items() if code[a] == "{")
        for _, start, a, b in functions:
            self.parameters(start, a, b)
        for m in re.finditer(r"(?:\(([^()]*)\)|(?<![\w$.])([A-Za-z_$][\w$]*))\s*(?::[^={};()\n]+)?=>\s*", code):
            if all(f[2] != m.end() and f[2] != m.end() + 1 for f in functions):
                behind = reader.close[m.end()] if code[m.end() : m.end() + 1] == "{" else reader.until(m.end(), len(code), ",;)]}")
                k = 1 if m[1] is not None else 2
                self.declare(self.bound(m.start(k), m.end(k)), m.start(), behind, True)
        for m in re.finditer(r"\b(let|const|var)\s+", code):
            self.variables(m)
        for m in re.finditer(r"\bcatch\s*\(", code):
            inside, last, behind = reader.paren(m.end() - 1)
            self.declare(self.bound(inside, last), inside, reader.close.get(reader.space(behind), len(code)), True)
        for m in re.finditer(r"\bfunction\s*\*?\s*([A-Za-z_$][\w$]*)", code):
            self.declare([m.start(1)], *self.block(m.start()), True)

    def block(self, at: int) -> tuple[int, int]:
        """The innermost braces around an offset, else the whole file."""
        for a, b in reversed(self.opens[: bisect_left(self.opens, (at,))]):
            if b > at:
                return a, b
        return -1, len(self.code) + 1

    def bound(self, a: int, b: int, keys: bool = False) -> Iterator[int]:
        while a < b:
            stop = self.r.until(a, b, ",")
            at = _LEAD.match(self.code, a, b).end()
            if keys and (m := _KEY.match(self.code, at, b)):
                at = m.end()
            if at < stop and self.code[at] in "{[":
                yield from self.bound(at + 1, self.r.close[at], self.code[at] == "{")
            elif _NAME.match(self.code, at, stop):
                yield at
            a = stop + 1

    def declare(self, found, a: int, b: int, written: bool) -> None:
        for at in found:
            self.seen.setdefault(_NAME.match(self.code, at)[0], []).append((a, b, at))
            if written:
                self.writes.add(at)

    def parameters(self, start: int, a: int, b: int) -> None:
        arrow = self.code[start:a].rstrip().rstrip("{").rstrip().endswith("=>")
        at = self.code.find("=", start) + 1 if arrow else start
        opening = self.code.find("(", at, a)
        if opening >= 0:
            self.declare(self.bound(opening + 1, self.r.close[opening]), opening, b, True)
        elif arrow and (m := re.compile(r"\s*(?:async\s+)?([A-Za-z_$][\w$]*)").match(self.code, at)):
            self.declare([m.start(1)], m.start(1), b, True)

    def variables(self, m: re.Match) -> None:
        code, at = self.code, m.end()
        head = re.compile(r"\bfor\s*(?:await\s*)?\($").search(code[max(0, m.start() - 20) : m.start()].rstrip())
        a, b = self.block(m.start())
        if head:
            opening = code.rfind("(", 0, m.start())
            body = self.r.space(self.r.close[opening] + 1)
            a, b = opening, self.r.close[body] if code[body : body + 1] == "{" else self.r.expression_end(body, len(code))
        elif m[1] == "var":
            a, b = next(((x, y) for _, _, x, y in reversed(self.functions) if x <= m.start() < y), (a, b))
        end = self.r.expression_end(at, len(code))
        while at < end:
            pattern = code[at] in "{["
            names = list(self.bound(at + 1, self.r.close[at], code[at] == "{")) if pattern else [at] if _NAME.match(code, at) else []
            behind = self.r.close[at] + 1 if pattern else _NAME.match(code, at).end() if names else end
            stop = self.r.until(behind, end, ",")
            self.declare(names, a, b, bool(re.match(r"\s*(?:!?\s*:[^=;]*?)?(?:=(?!=)|\s(?:of|in)\b)", code[behind:stop])))
            at = self.r.space(stop + 1)

    def find(self, name: str, at: int) -> int | None:
        """The declaration a use means: of those whose span holds it, the innermost."""
        fits = [(a, d) for a, b, d in self.seen.get(name, ()) if a <= at < b or at == d]
        return max(fits)[1] if fits else None


def access(code: str, a: int, b: int) -> str:
    """Of a use between two offsets that isn't a declaration: ``read``, ``write`` or ``readwrite``."""
    after, before = code[b : b + 40].lstrip(), code[max(0, a - 10) : a].rstrip()
    if after.startswith(("++", "--")) or before.endswith(("++", "--")) or re.match(r"(?:[+\-*/%&|^]|\*\*|<<|>>>?|&&|\|\||\?\?)=(?!=)", after):
        return "readwrite"
    return "write" if re.match(r"=(?![=>])", after) else "read"


def sites_of(path: str, text: str | None) -> Iterator[tuple]:
    """The rows of ``SITES`` of one file, by function, variable and place; an unbalanced file has none."""
    text = text or ""
    code = blanked(text, LANGUAGES["typescript"].quiet)
    brackets = Brackets(code)
    if not brackets.balanced:
        return
    functions = list(functions_of(text, code, brackets))
    try:
        scopes = Scopes(code, Reader(text, code, brackets), functions)
    except (ValueError, KeyError, IndexError):
        return
    breaks = [m.start() for m in re.finditer("\n", code)]

    def place(at: int) -> tuple[int, int]:
        n = bisect_left(breaks, at)
        return n + 1, at - (breaks[n - 1] if n else -1)

    def owner(at: int) -> int:
        return max((k for k, f in enumerate(functions, 1) if f[1] <= at < f[3]), default=0)

    inner = {d for spans in scopes.seen.values() for _, _, d in spans}
    rows = []
    for m in _NAME.finditer(code):
        a, b = m.span()
        before = code[max(0, a - 4) : a].rstrip()
        if m[0] not in scopes.seen or (before.endswith(".") and not before.endswith("...")):
            continue
        if a in inner and a not in scopes.writes:
            continue
        if a not in inner and re.match(r"\s*:(?!:)", code[b : b + 20]) and before.endswith(("{", ",")):
            continue  # a property's key
        d = scopes.find(m[0], a)
        at, home = (owner(a), owner(d)) if d is not None else (0, 0)
        names_itself = a == d and at and _declares(functions[at - 1], code, a)
        if names_itself:
            at = home = _around(functions, at)
        if d is not None and _declares_any(functions, code, d):
            home = _around(functions, owner(d))
        if d is None or not at or not home:
            continue
        kind = "write" if a == d else access(code, a, b)
        rows += [(path, at, functions[at - 1][0], m[0], *place(d), at != home, k, *place(a)) for k in (("read", "write") if kind == "readwrite" else (kind,))]
    yield from sorted(rows, key=lambda r: (r[1], r[4], r[5], r[8], r[9], r[7]))


def _declares(f: tuple[str, int, int, int], code: str, at: int) -> bool:
    """Whether an offset is the name of a function, not something inside it."""
    m = re.compile(r"(?:\b(?:const|let|var)\s+|function\s*\*?\s*)(?=[A-Za-z_$])").match(code, f[1])
    return bool(m) and m.end() == at


def _declares_any(functions, code: str, at: int) -> bool:
    return any(f[1] <= at < f[2] and _declares(f, code, at) for f in functions)


def _around(functions, k: int) -> int:
    """The function around a function; 0 at module level."""
    f = functions[k - 1]
    return max((n for n, g in enumerate(functions, 1) if g[2] <= f[1] and f[3] <= g[3] and n != k), default=0)


def sites(files: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            for p, t in zip(b.column("path").to_pylist(), b.column("text").to_pylist(), strict=True):
                rows = list(sites_of(p, t))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=[c.split()[0] for c in SITES.split(", ")])

    return files.select("path", "text").mapInArrow(run, SITES)

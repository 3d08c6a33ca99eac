"""Control-flow graphs of TypeScript and JavaScript functions: blocks and typed edges, one Arrow pass over the files.

Statements are read off blanked text by a small recursive reader; a builder turns them into blocks. An edge's kind is
``normal``, ``true``, ``false``, ``back``, ``case``, ``exception`` or ``finally``. Named functions and methods have a graph
each, nested ones too; anonymous callbacks are part of the statement that holds them. A function that can't be read gives a
warning and no graph; the others stay. A row ``function`` has the ids of the entry and the exit as ``src`` and ``dst`` and the
function's lines; a block has a span for each statement, lines and columns from 1, the end behind its last character.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import dealt, spread, stored
from .lexical import _TS_ARGS, LANGUAGES, Brackets, arrow, blanked

FLOW = "path string, fn int, name string, fact string, id string, kind string, statements array<string>, awaits boolean, src string, dst string, label string, start_line int, end_line int, spans array<struct<start_line:int,start_col:int,end_line:int,end_col:int>>"
_SPAN = pa.struct([(c, pa.int32()) for c in ("start_line", "start_col", "end_line", "end_col")])
_TYPES = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(_SPAN)]
#: Fixed value: characters of a statement's label.
LABEL_CHARS = 60
_OPERATOR_END, _OPERATOR_START = re.compile(r"(?:[=+\-*/%&|^,.?:<>(!]|\b(?:in|of|instanceof|new|typeof|await))$"), re.compile(r"[.?:*/%&|^,=<>)\]]|\+(?!\+)|-(?!-)|instanceof\b|in\b")


def short(text: str) -> str:
    lines = text.strip().splitlines() or [""]
    line = re.sub(r"\s+", " ", lines[0]).strip()
    return line if len(line) <= LABEL_CHARS else line[: LABEL_CHARS - 1] + "…"


class Reader:
    """Statements as tuples whose first item is their form; the others are spans, names or lists of statements."""

    def __init__(self, text: str, code: str, brackets: Brackets):
        self.text, self.code, self.close = text, code, brackets.close

    def space(self, at: int) -> int:
        while at < len(self.code) and self.code[at].isspace():
            at += 1
        return at

    def word(self, at: int) -> str:
        m = re.compile(r"[A-Za-z_$][\w$]*").match(self.code, at)
        return m[0] if m else ""

    def until(self, at: int, end: int, stops: str) -> int:
        """The first of ``stops`` outside brackets."""
        while at < end and self.code[at] not in stops:
            at = self.close[at] + 1 if self.code[at] in "([{" else at + 1
        return at

    def expression_end(self, at: int, end: int) -> int:
        first = at
        while at < end:
            c = self.code[at]
            if c == ";":
                return at + 1
            if c in ")]}":
                return at
            if c == "\n" and not _OPERATOR_END.search(self.code[first:at].rstrip()):
                after = self.space(at)
                if after >= end or not _OPERATOR_START.match(self.code, after):
                    return at
            at = self.close[at] + 1 if c in "([{" else at + 1
        return end

    def paren(self, at: int) -> tuple[int, int, int]:
        """``(inside start, inside end, behind)`` of the brackets at or after an offset."""
        at = self.space(at)
        if self.code[at] != "(":
            raise ValueError("a bracket is missing")
        return at + 1, self.close[at], self.close[at] + 1

    def block(self, at: int, end: int) -> tuple[list, int]:
        """The statements of a block or of one statement."""
        at = self.space(at)
        if self.code[at : at + 1] == "{":
            return self.many(at + 1, self.close[at]), self.close[at] + 1
        one, at = self.one(at, end)
        return [one], at

    def many(self, at: int, end: int) -> list:
        out = []
        while (at := self.space(at)) < end:
            if self.code[at] == ";":
                at += 1
                continue
            one, after = self.one(at, end)
            if after <= at:
                raise ValueError("a statement is empty")
            out.append(one)
            at = after
        return out

    def one(self, at: int, end: int) -> tuple[tuple, int]:
        word = self.word(at)
        behind = at + len(word)
        if self.code[at] == "{":
            return ("block", self.many(at + 1, self.close[at])), self.close[at] + 1
        if word == "if":
            a, b, behind = self.paren(behind)
            then, behind = self.block(behind, end)
            nxt, other = self.space(behind), []
            if self.word(nxt) == "else":
                other, behind = self.block(nxt + 4, end)
            return ("if", (a, b), then, other), behind
        if word == "while":
            a, b, behind = self.paren(behind)
            body, behind = self.block(behind, end)
            return ("loop", None, (a, b), None, body), behind
        if word == "do":
            body, behind = self.block(behind, end)
            a, b, behind = self.paren(self.space(behind) + len("while"))
            return ("do", (a, b), body), behind + (self.code[behind : behind + 1] == ";")
        if word == "for":
            if self.word(self.space(behind)) == "await":
                behind = self.space(behind) + len("await")
            a, b, behind = self.paren(behind)
            body, behind = self.block(behind, end)
            first = self.until(a, b, ";")
            if first == b:
                return ("loop", None, (a, b), None, body), behind
            second = self.until(first + 1, b, ";")
            part = lambda x, y: (x, y) if self.code[x:y].strip() else None
            return ("loop", part(a, first), part(first + 1, second), part(second + 1, b), body, "for"), behind
        if word == "switch":
            a, b, behind = self.paren(behind)
            at = self.space(behind)
            return ("switch", (a, b), self.cases(at + 1, self.close[at])), self.close[at] + 1
        if word == "try":
            body, behind = self.block(behind, end)
            handler = last = None
            nxt = self.space(behind)
            if self.word(nxt) == "catch":
                start, head = nxt, self.space(nxt + len("catch"))
                head = self.close[head] + 1 if self.code[head] == "(" else nxt + len("catch")
                caught, behind = self.block(head, end)
                handler, nxt = ((start, head), caught), self.space(behind)
            if self.word(nxt) == "finally":
                last, behind = self.block(nxt + len("finally"), end)
            return ("try", body, handler, last), behind
        if word in ("return", "throw", "break", "continue"):
            after = self.expression_end(at, end) if word in ("return", "throw") else self.code.find("\n", at, end) % (end + 1)
            if word in ("break", "continue"):
                stop = self.until(at, after or end, ";\n}")
                after = stop + (self.code[stop : stop + 1] == ";")
            return (word, (at, after), self.word(self.space(behind)) if word in ("break", "continue") and "\n" not in self.code[behind : self.space(behind)] else ""), after
        if word and word not in ("case", "default") and (m := re.compile(r"\s*:(?!:)").match(self.code, behind)) and self.word(self.space(m.end())) + self.code[self.space(m.end())]:
            body, after = self.one(self.space(m.end()), end)
            return ("label", word, body), after
        if word in ("function", "class", "interface", "enum") or re.compile(r"(?:async\s+function|abstract\s+class|type\s+\w+\s*=)\b").match(self.code, at):
            opening = self.code.find("{", at, end)
            if opening >= 0 and word != "type":
                m = re.compile(r"(?:async\s+)?function\s*\*?\s*[\w$]*\s*(?:<[^<>()]*>)?").match(self.code, at)
                if m and self.code[m.end() : m.end() + 1] == "(":
                    opening = body_of(self.code, self.close, self.close[m.end()] + 1)
                return ("declaration", (at, self.close[opening] + 1)), self.close[opening] + 1
        after = self.expression_end(at, end)
        return ("simple", (at, after)), after

    def cases(self, at: int, end: int) -> list[tuple[str, list]]:
        starts = []
        while (at := self.space(at)) < end:
            word = self.word(at)
            if word in ("case", "default"):
                colon = self.until(at, end, ":")
                starts.append((at, colon, "default" if word == "default" else short(self.text[at + 4 : colon])))
                at = colon + 1
            else:
                at = max(self.one(at, end)[1], at + 1)
        return [(label, self.many(colon + 1, starts[k + 1][0] if k + 1 < len(starts) else end)) for k, (_, colon, label) in enumerate(starts)]


def body_of(code: str, close: dict[int, int], at: int) -> int:
    """The brace that opens a function's body, behind its parameters and any return type."""
    while True:
        at = code.find("{", at)
        if at < 0:
            raise ValueError("a function has no body")
        if code[:at].rstrip()[-1:] not in (":", "|", "&", "<", ","):
            return at
        at = close[at] + 1


class Builder:
    """Blocks and edges of one function; ``now`` is the block being filled, None where nothing can follow."""

    def __init__(self, reader: Reader):
        self.r, self.blocks, self.edges = reader, [], []
        self.loops: list[dict] = []  # targets of break and continue, and finally blocks, innermost last
        self.now = self.new()
        self.edge("entry", self.now, "normal")

    def new(self) -> int:
        self.blocks.append([])
        return len(self.blocks) - 1

    def edge(self, src, dst, kind: str, label: str | None = None) -> None:
        if (src, dst, kind, label) not in self.edges:
            self.edges.append((src, dst, kind, label))

    def go(self, to, kind: str = "normal") -> None:
        self.edge(self.now, to, kind)

    def add(self, span: tuple[int, int]) -> None:
        self.blocks[self.now].append(span)

    def fresh(self) -> None:
        """A block of its own for a decision, unless the one being filled is still empty."""
        if self.blocks[self.now]:
            b = self.new()
            self.go(b)
            self.now = b

    def jump(self, to_depth: int, target, kind: str) -> None:
        """Leaves scopes down to a depth; the innermost finally block on the way takes the jump and passes it on."""
        for k in range(len(self.loops) - 1, to_depth - 1, -1):
            if "finally" in self.loops[k]:
                self.edge(self.now, self.loops[k]["finally"], "finally")
                self.loops[k]["pending"].append((to_depth, target, kind))
                return
        self.edge(self.now, target, kind)

    def statements(self, many: list, label: str = "") -> None:
        for s in many:
            self.statement(s, label)

    def statement(self, s: tuple, label: str = "") -> None:
        getattr(self, "do_" + s[0])(s, label)

    def do_simple(self, s, label) -> None:
        self.add(s[1])

    do_declaration = do_simple

    def do_block(self, s, label) -> None:
        self.statements(s[1])

    def do_label(self, s, label) -> None:
        if s[2][0] in ("loop", "do", "switch"):
            return self.statement(s[2], s[1])
        after = self.new()
        self.loops.append({"label": s[1], "break": after, "named": True})
        self.statement(s[2])
        self.loops.pop()
        self.go(after)
        self.now = after

    def do_if(self, s, label) -> None:
        self.fresh()
        self.add(s[1])
        at, after, then = self.now, self.new(), self.new()
        self.edge(at, then, "true")
        other = self.new() if s[3] else after
        self.edge(at, other, "false")
        self.now = then
        self.statements(s[2])
        self.go(after)
        if s[3]:
            self.now = other
            self.statements(s[3])
            self.go(after)
        self.now = after

    def do_loop(self, s, label) -> None:
        if s[1]:
            self.add(s[1])
        head, body, after = self.new(), self.new(), self.new()
        again = self.new() if s[3] else head
        self.go(head)
        if s[2]:
            self.blocks[head].append(s[2])
            self.edge(head, body, "true")
            self.edge(head, after, "false")
        else:
            self.edge(head, body, "normal")
        self.inside(s[4], body, after, again, label, "normal" if s[3] else "back")
        if s[3]:
            self.blocks[again].append(s[3])
            self.edge(again, head, "back")
        self.now = after

    def do_do(self, s, label) -> None:
        body, test, after = self.new(), self.new(), self.new()
        self.go(body)
        self.inside(s[2], body, after, test, label, "normal")
        self.blocks[test].append(s[1])
        self.edge(test, body, "back")
        self.edge(test, after, "false")
        self.now = after

    def inside(self, many, body, after, again, label, kind) -> None:
        self.loops.append({"label": label, "break": after, "continue": again, "kind": kind})
        self.now = body
        self.statements(many)
        self.go(again, kind)
        self.loops.pop()

    def do_switch(self, s, label) -> None:
        self.fresh()
        at, after = self.now, self.new()
        self.add(("switch", *s[1]))
        self.loops.append({"label": label, "break": after})
        starts = [self.new() for _ in s[2]]
        for k, (name, many) in enumerate(s[2]):
            self.edge(at, starts[k], "case", name)
            self.now = starts[k]
            self.statements(many)
            self.go(starts[k + 1] if k + 1 < len(starts) else after)
        if all(name != "default" for name, _ in s[2]):
            self.edge(at, after, "case", "no match")
        self.loops.pop()
        self.now = after

    def do_try(self, s, label) -> None:
        self.fresh()
        _, body, handler, last = s
        start, after = self.now, self.new()
        leave = after
        if last is not None:
            leave = self.new()
            self.loops.append({"finally": leave, "pending": []})
        if handler:
            caught = self.new()
            self.edge(start, caught, "exception")
            self.loops.append({"catch": caught})
        self.statements(body)
        done = self.reached(self.now)
        self.go(leave)
        if handler:
            self.loops.pop()
            self.now = caught
            self.add(handler[0])
            self.statements(handler[1])
            done |= self.reached(self.now)
            self.go(leave)
        if last is not None:
            pending = self.loops.pop()["pending"]
            if not handler:
                self.edge(start, leave, "exception") if done and not pending else None
            self.now = leave
            self.statements(last)
            for depth, target, kind in dict.fromkeys(pending):
                self.jump(depth, target, kind)
            if done:
                self.go(after)
        self.now = after

    def reached(self, block: int) -> bool:
        return bool(self.blocks[block]) or any(e[1] == block for e in self.edges)

    def do_return(self, s, label) -> None:
        self.add(s[1])
        self.jump(0, "exit", "normal")
        self.now = self.new()

    def do_throw(self, s, label) -> None:
        self.add(s[1])
        depth = next((k for k in range(len(self.loops) - 1, -1, -1) if "catch" in self.loops[k]), None)
        self.jump(0 if depth is None else depth, "exit" if depth is None else self.loops[depth]["catch"], "exception")
        self.now = self.new()

    def _leave(self, s, key: str) -> None:
        self.add(s[1])
        for k in range(len(self.loops) - 1, -1, -1):
            x = self.loops[k]
            if key in x and (x["label"] == s[2] if s[2] else not x.get("named")):
                self.jump(k, x[key], x.get("kind", "normal") if key == "continue" else "normal")
                self.now = self.new()
                return
        raise ValueError(f"{key} has no target")

    def do_break(self, s, label) -> None:
        self._leave(s, "break")

    def do_continue(self, s, label) -> None:
        self._leave(s, "continue")

    def finished(self) -> tuple[dict, list]:
        """Blocks by id and edges, after empty blocks are taken out and the others numbered."""
        self.go("exit")
        alive = set(range(len(self.blocks)))
        changed = True
        while changed:
            changed = False
            for b in sorted(alive):
                if self.blocks[b]:
                    continue
                into, out = [e for e in self.edges if e[1] == b], [e for e in self.edges if e[0] == b]
                if into and not (len(out) == 1 and out[0][2] == "normal" and out[0][1] != b):
                    continue
                alive.discard(b)
                moved = [(e[0], out[0][1], e[2], e[3]) if e[1] == b else e for e in self.edges if e[0] != b] if into else [e for e in self.edges if e[0] != b]
                self.edges = list(dict.fromkeys(e for e in moved if e[0] != e[1] or e[2] == "back"))
                changed = True
        place = {b: k for k, b in enumerate(sorted(alive), 1)} | {"entry": 0, "exit": len(alive) + 1}
        name = lambda b: b if isinstance(b, str) else f"b{place[b]}"
        edges = sorted(self.edges, key=lambda e: (place[e[0]], place[e[1]], e[2]))
        return {name(b): self.blocks[b] for b in sorted(alive)}, [(name(a), name(b), kind, label) for a, b, kind, label in edges]


def functions_of(text: str, code: str, brackets: Brackets) -> Iterator[tuple[str, int, int, int]]:
    """``(name, start, body start, body end)`` in source order; an arrow's expression is its body."""
    classes = [(m["name"], m.end(), brackets.end(m.end())[0]) for m in re.finditer(LANGUAGES["typescript"].declares[0][1], code)]
    plain = [(m["name"], m.start(), m.end(), m[0].endswith("=>")) for _, p in LANGUAGES["typescript"].declares[5:6] for m in re.finditer(p, code)]
    plain += [(m["name"], m.start(), m.end(), False) for m in re.finditer(LANGUAGES["typescript"].declares[4][1], code)]
    member = re.compile(r"(?:^|[{};])\s*(?:(?:public|private|protected|static|async|override)\s+)*(?P<how>get\s+|set\s+)?\*?\s*(?P<name>#?[A-Za-z_$][\w$]*)\s*(?:<[^<>()]*>)?" + _TS_ARGS + r"\s*(?::\s*[^{};\n]+)?\s*(?=\{)", re.M)
    found = []
    for name, start, at, arrow in plain:
        at = at if arrow else brackets.close.get(code.find("(", at), at) + 1
        first = re.compile(r"\s*").match(code, at).end()
        if arrow and code[first : first + 1] != "{":
            found.append((name, start, first, brackets.end(first)[0] - (code[brackets.end(first)[0] - 1 :][:1] == ";")))
            continue
        opening = first if arrow else body_of(code, brackets.close, at) if brackets.end(at)[1] else None
        if opening is not None:
            found.append((name, start, opening + 1, brackets.close[opening]))
    for m in member.finditer(code):
        inner = [c for c in classes if c[1] <= m.start("name") < c[2]]
        opening = code.find("{", m.end())
        if inner and sum(1 for a, b in brackets.close.items() if inner[-1][1] <= a < m.start("name") < b and code[a] == "{") == 1:
            found.append((f"{inner[-1][0]}.{(m['how'] or '').strip()} {m['name']}".replace(". ", "."), m.start("name"), opening + 1, brackets.close[opening]))
    yield from sorted(found, key=lambda f: f[1])


def flow_of(path: str, text: str | None) -> Iterator[tuple]:
    """The rows of ``FLOW`` of one file."""
    text = text or ""
    code = blanked(text, LANGUAGES["typescript"].quiet)
    brackets = Brackets(code)
    if not brackets.balanced:
        yield (path, 0, None, "problem", None, "warning", None, None, None, None, "file has syntax errors", None, None, None)
        return
    breaks = [-1, *(m.start() for m in re.finditer("\n", code))]
    line = lambda at: bisect_left(breaks, at)

    def span(a: int, b: int) -> tuple[int, int, int, int]:
        """Of what is written from a to b, without the space around it."""
        inner = code[a:b].strip()
        a += len(code[a:b]) - len(code[a:b].lstrip()) if inner else 0
        b = a + len(inner)
        return line(a), a - breaks[line(a) - 1], line(b), b - breaks[line(b) - 1]

    for n, (name, start, a, b) in enumerate(functions_of(text, code, brackets), 1):
        reader = Reader(text, code, brackets)
        try:
            build = Builder(reader)
            if code[:a].rstrip().endswith("=>"):
                build.add((a, b))
            else:
                build.statements(reader.many(a, b))
            blocks, edges = build.finished()
        except (ValueError, KeyError, IndexError, RecursionError) as why:
            yield (path, n, name, "problem", None, "warning", None, None, None, None, f"{name} can't be read: {why}", line(start), line(b), None)
            continue
        for end in ("entry", "exit"):
            yield (path, n, name, "block", end, end, [], False, None, None, None, None, None, [])
        for key, spans in blocks.items():
            texts = [f"switch {short(text[s[1] : s[2]])}" if s[0] == "switch" else short(text[s[0] : s[1]]) for s in spans]
            where = [s[-2:] for s in spans]
            awaits = any(re.search(r"\bawait\b", code[x:y]) for x, y in where)
            yield (path, n, name, "block", key, "basic", texts, awaits, None, None, None, line(where[0][0]) if where else None, line(where[-1][1]) if where else None, [span(*s) for s in where])
        for src, dst, kind, label in edges:
            yield (path, n, name, "edge", None, kind, None, None, src, dst, label, None, None, None)
        start += len(code[start:a]) - len(code[start:a].lstrip())
        yield (path, n, name, "function", None, None, None, None, "entry", "exit", None, line(start), line(b), None)


def flow(files: DataFrame) -> DataFrame:
    """Blocks, edges and problems of all functions of ``files(path, text)``."""

    def run(batches):
        return arrow(batches, flow_of, FLOW, _TYPES)

    return spread(files.select("path", "text"), "path").mapInArrow(run, FLOW)


SPANS = "path string, fn int, name string, start_line int, start_col int, end_line int"


def spans_of(path: str, text: str | None) -> Iterator[tuple]:
    """The rows of ``SPANS`` of one file, numbered as in ``FLOW``; an unbalanced file has none."""
    text = text or ""
    code = blanked(text, LANGUAGES["typescript"].quiet)
    brackets = Brackets(code)
    if brackets.balanced:
        for n, (name, start, _, end) in enumerate(functions_of(text, code, brackets), 1):
            start += len(code[start:]) - len(code[start:].lstrip())
            yield (path, n, name, code.count("\n", 0, start) + 1, start - code.rfind("\n", 0, start), code.count("\n", 0, end) + 1)


def spans(files: DataFrame) -> DataFrame:
    """Where each function of ``files(path, text)`` stands; lines and columns from 1."""
    types = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32()]

    def run(batches):
        for b in batches:
            rows = [r for p, t in zip(b.column("path").to_pylist(), b.column("text").to_pylist(), strict=True) for r in spans_of(p, t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[c.split()[0] for c in SPANS.split(", ")])

    return files.select("path", "text").mapInArrow(run, SPANS)


def cfg_at_line(where: DataFrame, lines: DataFrame) -> DataFrame:
    """``path, line, fn, name`` of the function of fewest lines around each line of ``lines(path, line)``, the first on ties."""
    hit = lines.select("path", "line").distinct().join(where, "path").where("line between start_line and end_line")
    best = F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("n"), "fn", "name")).alias("b")
    return hit.groupBy("path", "line").agg(best).select("path", "line", "b.fn", "b.name")


def dataflow_for_span(where: DataFrame, sites: DataFrame, asked: DataFrame) -> DataFrame:
    """The ``sites`` of the functions that begin at ``asked(path, start_line, start_col)``."""
    key = ["path", "start_line", "start_col"]
    fns = where.join(asked.select(*key).distinct(), key, "left_semi").select("path", "fn")
    return sites.join(fns, ["path", "fn"], "left_semi")


def block_label(kind: Column, statements: Column, awaits: Column) -> Column:
    first = F.when(kind == "entry", "Start").when(kind == "exit", "End").otherwise(F.coalesce(F.try_element_at(statements, F.lit(1)), F.lit("")))
    return F.concat(F.when(awaits, "⏳ ").otherwise(""), first, F.when(F.size(statements) > 1, " ⋯").otherwise(""))


def parallel_edges(rows: DataFrame) -> DataFrame:
    """One edge for each pair of blocks: labels joined, and the strongest kind."""
    rank = F.when(F.col("kind") == "back", 0).when(F.col("kind") == "exception", 1).when(F.col("kind") == "finally", 2).otherwise(3)
    e = rows.where("fact = 'edge'")
    return e.groupBy("path", "fn", "src", "dst").agg(F.array_join(F.array_sort(F.collect_set("label")), " / ").alias("label"), F.min_by("kind", F.struct(rank, "kind")).alias("kind"))


def validate_flow(rows: DataFrame) -> DataFrame:
    """``path, fn, problem``, a row for each: ids that repeat or are unknown, not one entry or exit, statements without a span,
    entries and exits that aren't empty, spans that are inverted or outside their function, edges into the entry, out of the
    exit or twice, labels on edges that aren't cases.
    """
    rows = stored(rows.where("fact in ('function', 'block', 'edge')").select("path", "fn", "fact", "id", "kind", "statements", "src", "dst", "label", "start_line", "end_line", "spans"), "flow")
    b, e = rows.where("fact = 'block'"), rows.where("fact = 'edge'")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    say = lambda df, what: df.select("path", "fn", what.alias("problem"))
    again = lambda df, what: say(df.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("count") - 1))), what)
    id_, n = F.col("id"), lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0))
    f = rows.where("fact = 'function'").groupBy("path", "fn").agg(F.min(F.struct("src", "dst", "start_line", "end_line")).alias("f"))
    own = dealt(f.select("path", "fn", F.col("f.src").alias("entry"), F.col("f.dst").alias("exit"), F.col("f.start_line").alias("first"), F.col("f.end_line").alias("last")))

    has = lambda fact, kind=None: F.count_if((F.col("fact") == fact) & (F.lit(True) if kind is None else F.coalesce(F.col("kind") == kind, F.lit(False))))
    counts = rows.groupBy("path", "fn").agg(F.array(*[F.struct(F.lit(x).alias("what"), c.alias("n")) for x, c in (("function", has("function")), ("entry block", has("block", "entry")), ("exit block", has("block", "exit")))]).alias("c"))
    out = say(counts.select("path", "fn", F.explode("c").alias("c")).where("c.n <> 1"), text("expected exactly one ", F.col("c.what"), ", found ", F.col("c.n")))
    out = out.unionByName(again(b.groupBy("path", "fn", "id").count().where("count > 1"), text("duplicate block id ", id_)))

    out = out.unionByName(say(b.where(n("statements") != n("spans")), text("block ", id_, " has ", n("statements"), " statements but ", n("spans"), " spans")))
    out = out.unionByName(say(b.where(n("statements") > 0).where("kind <> 'basic'"), text(F.col("kind"), " block ", id_, " must be empty")))
    at = b.select("path", "fn", "id", F.explode("spans").alias("s"))
    out = out.unionByName(say(at.where("s.end_line < s.start_line or (s.end_line = s.start_line and s.end_col < s.start_col)"), text("block ", id_, " has an inverted span (", F.col("s.start_line"), ":", F.col("s.start_col"), ")")))
    out = out.unionByName(say(at.join(own, ["path", "fn"]).where("s.start_line < first or s.end_line > last"), text("block ", id_, " maps outside its function (", F.col("s.start_line"), ")")))

    end = lambda what, c: F.struct(F.lit(what).alias("what"), F.col(c).alias("id"))
    ends = e.select("path", "fn", F.inline(F.array(end("edge from unknown block ", "src"), end("edge to unknown block ", "dst"))))
    ends = ends.withColumn("tail", F.lit("")).unionByName(own.select("path", "fn", F.inline(F.array(end("entryId ", "entry"), end("exitId ", "exit"))), F.lit(" is not a block").alias("tail")))
    out = out.unionByName(say(ends.join(dealt(b.select("path", "fn", "id")), ["path", "fn", "id"], "left_anti"), text(F.col("what"), id_, F.col("tail"))))
    beyond = e.join(own, ["path", "fn"], "left")
    out = out.unionByName(say(beyond.where("dst = coalesce(entry, 'entry')"), text("entry block has an incoming edge")))
    out = out.unionByName(say(beyond.where("src = coalesce(exit, 'exit')"), text("exit block has an outgoing edge")))
    key = text(F.col("src"), "→", F.col("dst"), ":", F.col("kind"), ":", F.col("label"))
    out = out.unionByName(again(e.withColumn("label", F.coalesce("label", F.lit(""))).groupBy("path", "fn", "src", "dst", "kind", "label").count().where("count > 1"), text("duplicate edge ", key)))
    return out.unionByName(say(e.where("label is not null and kind <> 'case'"), text("edge ", key, " carries a label but is not a case edge")))


def dead_blocks(rows: DataFrame) -> DataFrame:
    """``path, fn, id`` of blocks that no path from the entry reaches; a function is walked whole, in one task, however deep it is."""

    def run(batches):
        for b in batches:
            paths, fns, ids = [], [], []
            for path, fn, blocks, edges in zip(*(b.column(c).to_pylist() for c in ("path", "fn", "blocks", "edges")), strict=True):
                after = defaultdict(list)
                for e in edges:
                    after[e["src"]].append(e["dst"])
                met = {x["id"] for x in blocks if x["kind"] == "entry"}
                front = list(met)
                while front:
                    for x in after[front.pop()]:
                        if x not in met:
                            met.add(x)
                            front.append(x)
                dead = [x["id"] for x in blocks if x["id"] not in met]
                paths += [path] * len(dead)
                fns += [fn] * len(dead)
                ids += dead
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(fns, pa.int32()), pa.array(ids, pa.string())], names=["path", "fn", "id"])

    # one group a function: its blocks and edges are as many as its text has statements
    part = lambda fact, *c: F.collect_list(F.when(F.col("fact") == fact, F.struct(*c)))
    whole = rows.where("fact in ('block', 'edge')").groupBy("path", "fn").agg(part("block", "id", "kind").alias("blocks"), part("edge", "src", "dst").alias("edges"))
    return whole.mapInArrow(run, "path string, fn int, id string")


def variable_blocks(rows: DataFrame, sites: DataFrame) -> DataFrame:
    """``path, fn, id, variable, access`` of the sites that lie in a block's lines."""
    b = rows.where("fact = 'block' and start_line is not null").select("path", "fn", "id", "start_line", "end_line")
    return b.join(sites.select("path", "variable", "access", "line"), "path").where("line between start_line and end_line").select("path", "fn", "id", "variable", "access").distinct()

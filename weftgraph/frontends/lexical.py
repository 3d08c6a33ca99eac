"""Declarations, imports and calls of brace and ``end`` languages, found on text whose comments and strings are blanked.

One file is one pure function call, run in an Arrow pass. Blanking keeps offsets and line breaks, so patterns see code
only and spans stay true. Nesting comes from spans: a declaration belongs to the innermost one that contains it, and a
function directly in a class is a method. No grammar is used: conditional compilation, macros and code inside template
literals aren't seen. An unbalanced file keeps what was found and gets a warning.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from ..storage import spread

#: ``parent`` is the ``seq`` of the owner within the file, null for the module.
FACTS = "path string, lang string, fact string, kind string, name string, qn string, parent int, start_line int, end_line int, exported boolean, signature string, doc string, seq int"
_TYPES = [pa.string()] * 6 + [pa.int32()] * 3 + [pa.bool_(), pa.string(), pa.string(), pa.int32()]

# Words that stand before a bracket without being calls or declarations.
KEYWORDS = set("if for while switch catch return new else do try throw import case".split())
OWN_KEYWORDS = {
    "go": set("func go defer select range type var const package".split()),
    "java": set("super this assert synchronized yield".split()),
    "csharp": set("base this foreach using lock await nameof typeof sizeof yield when is as in".split()),
    "rust": set("fn let match loop in as use mod impl where unsafe".split()),
    "ruby": set("elsif unless until and or not in then end def class module self super yield begin rescue ensure when require require_relative".split()),
    "typescript": set("super function await typeof delete void with yield in of as is".split()),
}
GLOBALS = set("Array BigInt Boolean Date Error Map Number Object Promise RegExp Set String Symbol WeakMap clearInterval clearTimeout decodeURIComponent encodeURIComponent fetch isFinite isNaN parseFloat parseInt queueMicrotask require setInterval setTimeout structuredClone import".split())

_C_QUIET = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_DOUBLE, _SINGLE = r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.|[^'\\\n])*'"
_ARGS = r"\((?:[^(){};]|\([^(){};]*\))*\)"
_TS_ARGS = r"\((?:[^();]|\((?:[^()]|\([^()]*\))*\))*\)"
_TYPED = r"(?P<before>[\w.]+(?:<[^;{}()]*>)?(?:\[\s*\])*\??)\s+(?P<name>\w+)\s*(?:<[^;{}()]*>)?\s*" + _ARGS
_AFTER = r"\s*(?:throws\s[\w\s,.]+|where\s[^{;]+|:\s*(?:base|this)\s*" + _ARGS + r")?\s*(?:\{|;|=>)"


@dataclass(frozen=True)
class Language:
    name: str
    quiet: str
    declares: list[tuple[str, str]]
    imports: list[str]
    call: str = r"(?<![\w$])(?P<name>[A-Za-z_]\w*)\s*(?:::\s*<[^<>]*>)?\s*\("
    blocks: bool = False  # bodies end with a keyword
    more: dict = field(default_factory=dict)


LANGUAGES = {
    "go": Language(
        "go",
        rf"{_C_QUIET}|`[^`]*`|{_DOUBLE}|'(?:\\.[^']*|[^'\\])'",
        [("class", r"^type[ \t]+(?P<name>\w+)\b"), ("callable", r"^func\s+(?:\([^)]*\)\s*)?(?P<name>\w+)")],
        [r"^import\s+(?:[\w.]+\s+)?(?P<q>[\"`])", r"(?<=\n)[ \t]+(?:[\w.]+[ \t]+)?(?P<q>[\"`])(?= *[\"`][ \t]*$)"],
    ),
    "java": Language(
        "java",
        rf'{_C_QUIET}|""".*?"""|{_DOUBLE}|{_SINGLE}',
        [("class", r"\b(?:class|interface|enum|record)\s+(?P<name>[A-Za-z_]\w*)"), ("callable", _TYPED + _AFTER), ("callable", r"(?:^|[{};])\s*(?P<name>[A-Z]\w*)\s*" + _ARGS + _AFTER)],
        [r"^\s*import\s+(?:static\s+)?(?P<name>[\w.]+(?:\.\*)?)\s*;"],
    ),
    "csharp": Language(
        "csharp",
        rf'{_C_QUIET}|@"(?:""|[^"])*"|{_DOUBLE}|{_SINGLE}',
        [("namespace", r"\bnamespace\s+(?P<name>[\w.]+)"), ("class", r"\b(?:class|interface|struct|enum|record(?:\s+(?:class|struct))?)\s+(?!class\b|struct\b)(?P<name>[A-Za-z_]\w*)"), ("callable", _TYPED + _AFTER), ("callable", r"(?:^|[{};])\s*(?P<name>[A-Z]\w*)\s*" + _ARGS + _AFTER)],
        [r"^\s*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?(?P<name>[\w.]+)\s*;"],
    ),
    "rust": Language(
        "rust",
        rf'{_C_QUIET}|\br(?P<h>#*)".*?"(?P=h)|"(?:\\.|[^"\\])*"|\'(?:\\[^\']*|[^\'\\])\'',
        [("class", r"\b(?:struct|enum|trait|union)\s+(?P<name>\w+)"), ("class", r"\bmod\s+(?P<name>\w+)"), ("class", r"^\s*(?:unsafe\s+)?impl\b\s*(?:<[^{};]*?>\s*)?(?:[^{};]*?\bfor\s+)?(?:[&\w]+::)*&?(?P<name>[A-Za-z_]\w*)[^{};]*(?=\{)"), ("callable", r"\bfn\s+(?P<name>\w+)")],
        [r"\buse\s+(?P<name>[\w:]+?)(?:::\{|::\*|\s+as\b|\s*;)", r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(?P<name>\w+)\s*;"],
    ),
    "ruby": Language(
        "ruby",
        rf"^=begin.*?^=end|#(?!\{{)[^\n]*|{_DOUBLE}|{_SINGLE}",
        [("class", r"^\s*(?:class|module)\s+(?:\w+::)*(?P<name>[A-Z]\w*)"), ("callable", r"^\s*(?:(?:private|public|protected)\s+)?def\s+(?:self\.|\w+\.)?(?P<name>\w+[?!=]?)")],
        [r"\brequire(?:_relative)?\s*\(?\s*(?P<q>[\"'])"],
        call=r"(?<![\w:@])(?P<name>[a-z_]\w*[?!]?)(?:\s*\(|(?=[ \t]+[\w\x22\x27:@\[]))|\.(?P<dotted>[a-z_]\w*[?!]?)|^[ \t]*(?P<bare>[a-z_]\w*[?!]?)[ \t]*$",
        blocks=True,
    ),
    "typescript": Language(
        "typescript",
        rf"{_C_QUIET}|`(?:\\.|[^`\\])*`|{_DOUBLE}|{_SINGLE}|(?<=[(,=:\[!&|?{{;])[ \t]*/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*",
        [
            ("class", r"\bclass\s+(?!extends\b|implements\b)(?P<name>[A-Za-z_$][\w$]*)"),
            ("interface", r"\binterface\s+(?P<name>[A-Za-z_$][\w$]*)(?=[^;()=]*\{)"),
            ("enum", r"\benum\s+(?P<name>[A-Za-z_$][\w$]*)(?=\s*\{)"),
            ("namespace", r"\b(?:namespace|module)\s+(?P<name>[A-Za-z_$][\w$.]*)(?=\s*\{)"),
            ("callable", r"\bfunction\s*\*?\s*(?P<name>[A-Za-z_$][\w$]*)"),
            ("callable", r"\b(?:const|let|var)\s+(?P<name>[A-Za-z_$][\w$]*)\s*(?::[^=;\n]+)?=\s*(?:async\s+)?(?:function\b|(?:<[^<>()]*>\s*)?" + _TS_ARGS + r"\s*(?::[^={;\n]+)?=>|[\w$]+\s*=>)"),
            ("member", r"(?:^|[{};])\s*(?:(?:public|private|protected|static|async|override|abstract|get|set)\s+)*\*?\s*(?P<name>#?[A-Za-z_$][\w$]*)\s*(?:<[^<>()]*>)?" + _TS_ARGS + r"\s*(?::\s*[^{};\n]+)?\s*[{;]"),
        ],
        [r"\bimport\s+(?P<type>type\s+)?(?P<names>[^'\"();]*?)\bfrom\s*(?P<q>['\"])", r"\bimport\s*(?P<q>['\"])", r"\bexport\s+(?P<type>type\s+)?(?:\*(?:\s*as\s+\w+)?|\{[^}]*\})\s*from\s*(?P<q>['\"])", r"\b(?:import|require)\s*\(\s*(?P<q>['\"])"],
        call=r"(?P<dot>\.\s*)?(?<![\w$#])(?P<name>[A-Za-z_$][\w$]*)\s*(?:<[^<>()]*>)?\(",
    ),
}


def blanked(text: str, quiet: str) -> str:
    """Comments and strings as spaces; a string keeps its quotes, so that imports can still find it."""

    def blank(m: re.Match) -> str:
        s = m[0]
        inner = re.sub(r"[^\n]", " ", s)
        return s[0] + inner[1:-1] + s[-1] if len(s) > 1 and s[0] in "\"'`" and s[-1] == s[0] else inner

    return re.sub(quiet, blank, text, flags=re.S | re.M)


class Brackets:
    """Where each opening brace closes, and where a declaration that starts at an offset ends."""

    def __init__(self, code: str):
        self.code, self.at, self.what, self.close, self.balanced = code, [], [], {}, True
        held: list[tuple[str, int]] = []
        for m in re.finditer(r"[{}()\[\];]", code):
            c, at = m[0], m.start()
            self.at.append(at)
            self.what.append(c)
            if c in "{([":
                held.append((c, at))
            elif c in "})]":
                if held and held[-1][0] + c in ("{}", "()", "[]"):
                    self.close[held.pop()[1]] = at
                else:
                    self.balanced = False
        self.balanced &= not held

    def end(self, start: int) -> tuple[int, bool]:
        """``(end offset, has a body)``: the brace that closes the first block, or the first semicolon outside brackets."""
        k = bisect_left(self.at, start)
        while k < len(self.at):
            c, at = self.what[k], self.at[k]
            if c == ";":
                return at + 1, False
            if c in "})]":
                return at, False
            to = self.close.get(at)
            if to is None:
                break
            if c == "{" and self.code[:at].rstrip()[-1:] not in (":", "|", "&", "<"):
                return to + 1, True
            k = bisect_left(self.at, to) + 1
        return len(self.code), False


_OPENERS = re.compile(r"(?P<end>\bend\b)|(?P<do>\bdo\b)|(?P<loop>^[ \t]*(?:while|until|for)\b)|(?P<open>(?:^|[=;(])[ \t]*(?:if|unless|case|begin|class|module)\b|\bdef\b(?![^\n]*\)\s*=[^=]|\s+(?:self\.)?\w+[?!]?\s+=\s))", re.M)


def block_ends(code: str) -> tuple[dict[int, int], bool]:
    """For a language with ``end``: the offset behind the end of the block opened on each line, by the line's start."""
    held, ends, whole, loop_line = [], {}, True, -1
    for m in _OPENERS.finditer(code):
        line = code.rfind("\n", 0, m.end()) + 1
        if m["end"]:
            if held:
                ends.setdefault(held.pop(), m.end())
            else:
                whole = False
        elif m["do"] and line == loop_line:
            loop_line = -1  # the loop's own
        else:
            loop_line = line if m["loop"] else loop_line
            held.append(line)
    return ends, whole and not held


_RESULT = re.compile(r"\s*:\s*((?:[^{};=\n]|\{[^{}]*\})+?)\s*(?=\{|=>|;|\n|$)")
_HERITAGE = re.compile(r"\b(extends|implements)\b((?:(?!\b(?:extends|implements)\b).)*)", re.S)


def signature_of(text: str, code: str, brackets: Brackets, name_end: int) -> str | None:
    """Parameters and result of a TypeScript callable as they are written; types that aren't written aren't inferred."""
    single = re.compile(r"\s*(?::[^=;\n]+)?=\s*(?:async\s+)?([\w$]+)\s*=>").match(code, name_end)
    if single:
        return f"({single[1]})"
    begin = code.find("(", name_end)
    end = brackets.close.get(begin)
    if end is None:
        return None
    result = _RESULT.match(code, end + 1)
    written = lambda a, b: re.sub(r"\s+", " ", re.sub(r"\s*(?:/\*.*?\*/|//[^\n]*)", "", text[a:b], flags=re.S)).strip()
    return written(begin, end + 1) + (f": {written(*result.span(1))}" if result else "")


def doc_of(text: str, start: int) -> str | None:
    """The first line of the ``/**`` comment directly before an offset; null where a tag comes first."""
    before = text[:start].rstrip()
    begin = before.rfind("/*")
    if not before.endswith("*/") or not before.startswith("/**", begin) or len(before) - begin < 5:
        return None
    lines = (re.sub(r"^\s*\*?\s*", "", x).strip() for x in before[begin + 3 : -2].split("\n"))
    first = next((x for x in lines if x), "")
    return first if first and not first.startswith("@") else None


def heritage_of(code: str, name_end: int) -> Iterator[tuple[str, str, int]]:
    """``(extends or implements, name, offset)`` of the clauses between a type's name and its body."""
    depth, end = 0, name_end
    for m in re.compile(r"=>|[<>{;]").finditer(code, name_end):
        depth += (m[0] == "<") - (m[0] == ">")
        if depth <= 0 and m[0] in "{;":
            end = m.start()
            break
    head = code[name_end:end].replace("=>", "  ")
    while (bare := re.sub(r"<[^<>]*>", lambda m: " " * len(m[0]), head)) != head:
        head = bare
    for clause in _HERITAGE.finditer(head):
        for m in re.finditer(r"(?:^|,)\s*([A-Za-z_$][\w$.]*)\s*(?=,|$)", clause[2].rstrip()):
            yield clause[1], m[1], name_end + clause.start(2) + m.start(1)


_CALLEE = re.compile(r"(?:([\w$]+)\s*(?:<[^<>()]*>)?|[)\]])\s*(?:\?\.\s*)?$")
_ARGUMENT_END, _BARE = re.compile(r"[,(\[{]"), re.compile(r"\s*([A-Za-z_$][\w$]*)\s*")
#: Fixed value: characters before a bracket that are read for what is called.
_CALLEE_CHARS = 200


def references_of(code: str, brackets: Brackets, wanted: set[str], declared: set[int]) -> Iterator[tuple[str, int]]:
    """``(name, offset)`` of the arguments of TypeScript calls that are a wanted name and nothing else; ``new``, ``import`` and ``require`` aren't calls here."""
    aside = (KEYWORDS | OWN_KEYWORDS["typescript"] | {"require"}) - {"super"}
    for opening, end in brackets.close.items():
        if code[opening] != "(":
            continue
        bare, first = [], opening + 1
        at = first
        while at <= end:
            stop = _ARGUMENT_END.search(code, at, end)
            if stop and stop[0] != ",":
                at = brackets.close.get(stop.start(), end) + 1
                continue
            behind = stop.start() if stop else end
            if (m := _BARE.fullmatch(code, first, behind)) and m[1] in wanted:
                bare.append((m[1], m.start(1)))
            first = at = behind + 1
        m = bare and _CALLEE.search(code, max(0, opening - _CALLEE_CHARS), opening)
        if not m or m[1] in aside or (m[1] and m.start(1) in declared) or re.compile(r"\s*(?:\{|=>)").match(code, end + 1):
            continue
        if not re.search(r"\b(?:new\s+(?:[\w$]+\s*\.\s*)*|function\s*\*?\s*)$", code[max(0, m.start() - _CALLEE_CHARS) : m.start()]):
            yield from bare


def facts_of(path: str, text: str | None, lang: Language) -> Iterator[tuple]:
    """``(fact, kind, name, qn, parent, start_line, end_line, exported, signature, doc)``; declarations come in source order."""
    text = text or ""
    code = blanked(text, lang.quiet)
    breaks = [m.start() for m in re.finditer("\n", code)]
    line = lambda at: bisect_left(breaks, at) + 1
    brackets = Brackets(code)
    ends, whole = block_ends(code) if lang.blocks else ({}, brackets.balanced)
    yield "decl", "module", path.rsplit("/", 1)[-1], path, None, 1, len(breaks) + 1, None, None, None

    found: dict[int, tuple] = {}
    keywords = KEYWORDS | OWN_KEYWORDS[lang.name]
    for kind, pattern in lang.declares:
        for m in re.finditer(pattern, code, re.M):
            name, at = m["name"], m.start("name")
            if (kind in ("callable", "member") and name in keywords) or m.groupdict().get("before") in keywords or at in found:
                continue
            start = m.start() + len(m[0]) - len(m[0].lstrip("{}; \t\r\n"))
            start = code.rfind("\n", 0, at) + 1 if not code[code.rfind("\n", 0, at) + 1 : start].strip(" \t" + "abcdefghijklmnopqrstuvwxyz") else start
            if lang.blocks:
                end, body = ends.get(code.rfind("\n", 0, at) + 1, code.find("\n", at) if "\n" in code[at:] else len(code)), True
            else:
                end, body = brackets.end(m.end() if m[0].endswith("=>") and lang.name == "typescript" else at)
            found[at] = (start, end, kind, name, body, m)
    rows = sorted(found.items(), key=lambda x: (x[1][0], -x[1][1]))
    bodied = {(v[2], v[3]) for _, v in rows if v[4]}
    names, kinds, shown, stack, heritage = set(), {}, [], [], []
    exports = {x.split(" as ")[0].strip() for m in re.finditer(r"\bexport\s*\{([^}]*)\}(?!\s*from)", code) for x in m[1].split(",")} if lang.name == "typescript" else set()
    if lang.name == "typescript":
        rows = sorted([*rows, *_variables(code, found)], key=lambda x: (x[1][0], -x[1][1]))
    for at, (start, end, kind, name, body, m) in rows:
        while stack and stack[-1][1] <= at:
            stack.pop()
        up = stack[-1] if stack else None
        if kind == "member" and not (up and up[2] == "class" and at > up[4]):
            continue
        if lang.name == "typescript" and kind == "callable" and not body and m[0].startswith("function") and ("callable", name) in bodied:
            continue  # an overload's signature
        real = "method" if kind == "member" or (kind == "callable" and up and up[2] == "class") else "function" if kind == "callable" else kind
        qn = f"{up[5]}.{name}" if up else name
        out = kind == "variable" or bool(re.match(r"\s*export\b", code[start:at])) or (up is None and name in exports) if lang.name == "typescript" else None
        seq = len(shown) + 1
        shown.append((start, end, seq))
        names.add(at)
        kinds[seq] = real
        signature = doc = None
        if lang.name == "typescript":
            signature = signature_of(text, code, brackets, m.end("name")) if real in ("function", "method") else None
            doc = doc_of(text, start if kind != "variable" else m.end() - len(m[0].lstrip("{}; \t\r\n")))
            heritage += [(how, base, seq, line(o)) for how, base, o in heritage_of(code, m.end("name"))] if real in ("class", "interface") else []
        yield "decl", real, name, qn, up[3] if up else None, line(start), line(max(start, end - 1)), out or None, signature, doc
        stack.append((start, end, "class" if real == "class" else real, seq, code.find("{", at) if not lang.blocks else at, qn))

    for how, base, seq, at in heritage:
        yield "heritage", how, base, None, seq, at, at, None, None, None

    starts = [s for s, _, _ in shown]

    def owner(at: int) -> int | None:
        for k in range(bisect_right(starts, at) - 1, -1, -1):
            if shown[k][1] > at:
                return shown[k][2]
        return None

    wanted = {v[3] for v in found.values() if v[2] == "callable"}
    for pattern in lang.imports:
        for m in re.finditer(pattern, code, re.M):
            g = m.groupdict()
            wanted.update(re.findall(r"[\w$]+", g.get("names") or ""))
            spec = text[m.end("q") : code.find(g["q"], m.end("q"))] if g.get("q") else g.get("name")
            if spec:
                bound = g.get("names")
                yield "import", "type" if g.get("type") else None, spec, re.sub(r"\s+", " ", bound).strip() if bound else None, owner(m.start()), line(m.start()), line(m.start()), None, None, None
    for m in re.finditer(lang.call, code, re.M):
        g = m.groupdict()
        name = g["name"] or g.get("dotted") or g.get("bare")
        at = m.start("name" if g["name"] else "dotted" if g.get("dotted") else "bare")
        if name in keywords or at in names or (g.get("bare") and owner(at) is not None):
            continue
        before = code[max(0, at - 40) : at].rstrip()
        how = "new" if re.search(r"\bnew$", before) else "this" if re.search(r"\bthis\s*\.$", before) else "member" if before.endswith((".", "::")) else None
        if re.search(r"\b(?:function|class)\s*\*?$", before) or kinds.get(owner(at)) == "interface":
            continue
        yield "call", how, name, None, owner(at), line(at), line(at), None, None, None
    if lang.name == "typescript":
        for name, at in references_of(code, brackets, wanted, names):
            yield "reference", None, name, None, owner(at), line(at), line(at), None, None, None
    if not whole:
        yield "problem", "warning", "file has syntax errors", None, None, 1, 1, None, None, None


def _variables(code: str, names: dict) -> Iterator[tuple[int, tuple]]:
    """Exported variables that aren't functions, every name of a list of declarations."""
    for m in re.finditer(r"(?:^|[{};])[ \t]*export\s+(?:declare\s+)?(?:const|let|var)\s+", code, re.M):
        at, depth, want = m.end(), 0, True
        while at < len(code):
            c = code[at]
            if want and (n := re.compile(r"\s*([A-Za-z_$][\w$]*)").match(code, at)):
                if n.start(1) not in names:
                    yield n.start(1), (n.start(1), n.end(1), "variable", n[1], False, m)
                at, want = n.end(1), False
                continue
            depth += (c in "{([") - (c in "})]")
            if depth < 0 or (depth == 0 and (c == ";" or (c == "\n" and not code[m.end() : at].rstrip().endswith((",", "="))))):
                break
            want = depth == 0 and c == ","
            at += 1


#: Rows of one Arrow batch that a pass over files hands back; a batch a file would cost more than reading the file.
OUT_ROWS = 4096


def arrow(batches, rows_of, schema: str, types: list) -> Iterator[pa.RecordBatch]:
    """The rows ``rows_of(path, text)`` of the files of some Arrow batches, in batches of about ``OUT_ROWS``."""
    names, held = [c.split()[0] for c in schema.split(", ")], []

    def out():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    for b in batches:
        for path, text in zip(b.column("path").to_pylist(), b.column("text").to_pylist(), strict=True):
            held += rows_of(path, text)
            if len(held) >= OUT_ROWS:
                yield out()
                held = []
    if held:
        yield out()


def facts(files: DataFrame, lang: str) -> DataFrame:
    """The facts of all files, which must be of one language."""

    def run(batches):
        spec = LANGUAGES[lang]
        return arrow(batches, lambda path, text: [(path, lang, *f, k) for k, f in enumerate(facts_of(path, text, spec))], FACTS, _TYPES)

    return spread(files.select("path", "text"), "path").mapInArrow(run, FACTS)

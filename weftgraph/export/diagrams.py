"""Drawn and class diagrams: SVG and draw.io from a layout, Mermaid and PlantUML classes, Mermaid flow charts."""

from __future__ import annotations

from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.layout import Layout, layout
from ..schema import CodeGraph
from .text import BUILTIN, _names, _rows

# Fills of the kinds, light and dark.
FILLS = {"module": ("#dbeafe", "#1e3a5f"), "folder": ("#fef3c7", "#5c4a1a"), "class": ("#dcfce7", "#1f4d33"), "fn": ("#f3e8ff", "#43285c"), "method": ("#fae8ff", "#55245c")}
OTHER = ("#f1f5f9", "#334155")
TYPES = ("class", "interface", "enum")


def _n(v: float) -> str:
    return f"{v:.2f}".rstrip("0").rstrip(".")


def svg(made: Layout) -> str:
    style = [".box{stroke:#64748b}.line{stroke:#64748b;fill:none}text{font:12px sans-serif;fill:#0f172a}"]
    style += [f".k-{k}{{fill:{light}}}" for k, (light, _) in FILLS.items()]
    dark = "".join(f".k-{k}{{fill:{shade}}}" for k, (_, shade) in FILLS.items())
    style.append(f".box:not([class*=' k-']){{fill:{OTHER[0]}}}@media(prefers-color-scheme:dark){{text{{fill:#e2e8f0}}{dark}}}")
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{_n(made.width)}" height="{_n(made.height)}" viewBox="0 0 {_n(made.width)} {_n(made.height)}">', f"<style>{''.join(style)}</style>"]
    for key, kind, _, _, points in made.lines:
        out.append(f'<polyline class="line" data-edge={quoteattr(key)} data-kind={quoteattr(kind)} points="{" ".join(f"{_n(x)},{_n(y)}" for x, y in points)}"/>')
    for b in made.boxes.values():
        mark = f"box k-{b.kind}" if b.kind in FILLS else "box"
        out.append(f'<rect class="{mark}" data-id={quoteattr(b.id)} x="{_n(b.x)}" y="{_n(b.y)}" width="{_n(b.width)}" height="{_n(b.height)}" rx="4"/>')
        out.append(f'<text x="{_n(b.x + b.width / 2)}" y="{_n(b.y + b.height / 2)}" text-anchor="middle" dominant-baseline="central">{escape(b.label)}</text>')
    return "\n".join([*out, "</svg>"]) + "\n"


def drawio(made: Layout) -> str:
    cells, at = [], {}
    for n, b in enumerate(made.boxes.values(), 2):
        at[b.id] = n
        fill = FILLS.get(b.kind, OTHER)[0]
        cells.append(f'<mxCell id="{n}" value={quoteattr(b.label)} style="rounded=1;html=0;fillColor={fill};" vertex="1" parent="1"><mxGeometry x="{_n(b.x)}" y="{_n(b.y)}" width="{_n(b.width)}" height="{_n(b.height)}" as="geometry"/></mxCell>')
    for n, (_, kind, src, dst, _) in enumerate(made.lines, len(at) + 2):
        dashed = "dashed=1;" if kind in ("imports", "implements") else ""
        cells.append(f'<mxCell id="{n}" value={quoteattr(kind)} style="{dashed}" edge="1" parent="1" source="{at[src]}" target="{at[dst]}"><mxGeometry relative="1" as="geometry"/></mxCell>')
    body = "\n".join(['<mxCell id="0"/>', '<mxCell id="1" parent="0"/>', *cells])
    return f'<mxfile><diagram name="graph"><mxGraphModel><root>\n{body}\n</root></mxGraphModel></diagram></mxfile>\n'


def to_svg(g: CodeGraph) -> str:
    return svg(layout(g))


def to_drawio(g: CodeGraph) -> str:
    return drawio(layout(g))


def _classes(g: CodeGraph) -> tuple[list[dict], dict[str, list[dict]], list[dict], dict[str, str]]:
    nodes, edges = _rows(g)
    types = [n for n in nodes if n["kind"] in TYPES]
    known, by_id = {n["id"] for n in types}, {n["id"]: n for n in nodes}
    members: dict[str, list[dict]] = {}
    for e in edges:
        if e["kind"] == "contains" and e["src"] in known and by_id[e["dst"]]["kind"] in ("method", "variable"):
            members.setdefault(e["src"], []).append(by_id[e["dst"]])
    heritage = [e for e in edges if e["kind"] in ("extends", "implements") and e["src"] in known and e["dst"] in known]
    return types, members, heritage, _names(types)


def _member(n: dict) -> str:
    return n["name"] + ((n["signature"] or "()") if n["kind"] == "method" else "")


def to_mermaid_class(g: CodeGraph) -> str:
    types, members, heritage, ids = _classes(g)
    lines = ["classDiagram"]
    for n in types:
        lines.append(f'  class {ids[n["id"]]}["{n["name"]}"] {{')
        lines += [f"    <<{n['kind']}>>"] if n["kind"] != "class" else []
        lines += [*(f"    +{_member(m)}" for m in members.get(n["id"], [])), "  }"]
    lines += [f"  {ids[e['dst']]} {'<|--' if e['kind'] == 'extends' else '<|..'} {ids[e['src']]}" for e in heritage]
    return "\n".join(lines) + "\n"


def to_plantuml_class(g: CodeGraph) -> str:
    types, members, heritage, ids = _classes(g)
    lines = ["@startuml"]
    for n in types:
        lines += [f'{n["kind"]} "{n["name"]}" as {ids[n["id"]]} {{', *(f"  {_member(m)}" for m in members.get(n["id"], [])), "}"]
    lines += [f"{ids[e['dst']]} {'<|--' if e['kind'] == 'extends' else '<|..'} {ids[e['src']]}" for e in heritage]
    return "\n".join([*lines, "@enduml"]) + "\n"


def flow_charts(rows: DataFrame) -> DataFrame:
    """``path, fn, text``: every function's blocks and edges as a chart from top to bottom, entry and exit first, then by number."""
    place = lambda c: F.when(F.col(c) == "entry", 0).when(F.col(c) == "exit", 1).otherwise(F.regexp_extract(c, r"(\d+)$", 1).try_cast("int") + 2)
    say = lambda c: F.replace(c, F.lit('"'), F.lit("#quot;"))
    told = F.array_join(F.when(F.size("statements") > 0, F.col("statements")).otherwise(F.array(F.lit(" "))), "<br/>")
    told = F.when(F.col("kind") == "entry", "Start").when(F.col("kind") == "exit", "End").otherwise(told)
    told = say(F.concat(F.when(F.coalesce("awaits", F.lit(False)), "⏳ ").otherwise(""), told))
    basic = F.col("kind") == "basic"
    block = F.concat(F.lit("  "), "id", F.when(basic, '["').otherwise('(["'), told, F.when(basic, '"]').otherwise('"])'))
    note = F.when(F.coalesce("label", F.lit("")) != "", F.col("label")).when(F.col("kind") == "normal", "").otherwise(F.col("kind"))
    arrow = F.when(F.col("kind").isin("exception", "finally"), " -.->").otherwise(" -->")
    edge = F.concat(F.lit("  "), "src", arrow, F.when(note != "", F.concat(F.lit("|"), say(note), F.lit("|"))).otherwise(""), F.lit(" "), "dst")
    is_edge = F.col("fact") == "edge"
    line = F.struct(is_edge.alias("e"), F.when(is_edge, place("src")).otherwise(place("id")).alias("a"), F.when(is_edge, place("dst")).alias("b"), F.when(is_edge, edge).otherwise(block).alias("t"))
    lines = F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"])
    text = F.concat(F.array_join(F.concat(F.array(F.lit("flowchart TD")), lines), "\n"), F.lit("\n"))
    return rows.where(F.col("fact").isin("block", "edge")).groupBy("path", "fn").agg(text.alias("text"))


def flow_mermaid(rows: DataFrame, path: str, fn: int) -> str:
    """One function's chart; other functions' rows aren't fetched."""
    one = flow_charts(rows.where((rows["path"] == path) & (rows["fn"] == fn))).first()
    return one["text"] if one else "flowchart TD\n"


for _name, _ext, _run in (("svg", ".svg", to_svg), ("drawio", ".drawio", to_drawio), ("mermaid-class", ".class.mmd", to_mermaid_class), ("plantuml-class", ".class.puml", to_plantuml_class)):
    BUILTIN.register(_name, _ext, _run)

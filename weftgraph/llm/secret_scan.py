"""Secret scan with an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its text. The ledger, a table in the shared folder, holds one
row per (blob, rule version) that has ever been scanned, with its spans. A run scans only blobs whose pair is missing,
each once however many paths share it, appends them, and joins the ledger back to all paths. DataFrame functions only.

Addressing reads each text once anyway, so the same pass tests one anchor expression (a superset of all rules); only
representatives of unseen blobs that pass it are scanned, in the tasks that read them while their keys are measured to
be few, else dealt out by id. Rows of the manifest are fixed-size; a blob that a third of the paths share is one row on
the build side of the join back, and AQE can split the other side. Two runs at once may both append a pair; the ledger's
reader takes one row of each blob, and equal pairs have equal spans.

Spans are code points, end exclusive. A rule's pattern runs leftmost and non-overlapping; matches whose kept part is too
short are dropped but still consume their text.

Edge cases: a null text counts as empty (no spans); repeated rows and null paths each get their row; an empty table
gives an empty result; a ledger of another rule version is not used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, scratch, sized

LEDGER = "blob string, rule_version string, spans array<struct<start:int,ord:int,kind:string,end:int>>"


@dataclass(frozen=True)
class Rule:
    """``head`` then ``body``; a match counts if the part that ``measured`` names has ``least`` code points."""

    kind: str
    head: str
    body: str
    least: int
    measured: str = "match"


# The contract's base kinds, in its order, then the kinds this method adds.
BASE = [
    Rule("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+", 12, "body"),
    Rule("access", "", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", "", r"[0-9a-f]+", 16),
]
ADDED = [
    Rule("github", "", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", "", r"xox[abeprs]-[A-Za-z0-9-]+", 15),
    Rule("google", "", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("jwt", "", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
    Rule("pem", "", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 20),
]
RULES = BASE + ADDED
RULE_VERSION = "2"
#: Matches of a text that are gathered at a time.
CHUNK = 256

#: Every text with a span matches this.
ANCHOR = r"[Pp][Aa][Ss][Ss][Ww]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]|AKIA[A-Z0-9]|[0-9a-f]{16}|gh[pousr]_|xox[abeprs]-|AIza|eyJ|-----BEGIN "


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _let(value: Column, use) -> Column:
    """``use`` of a value that is evaluated once, however often it stands there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def rule_spans(text: Column, rule: Rule, ordinal: int) -> Column:
    """The rule's spans of a text: marks are set around matches, and the pieces' lengths give the positions.

    The marks U+0001 to U+0003 are first replaced in the text by another control character that no rule takes.
    """
    clean = F.regexp_replace(text, "[\x01-\x03]", "\x04")
    marked = F.regexp_replace(clean, f"({rule.head})({rule.body})", "\x01$1\x03$2\x02")
    pieces = F.split(marked, "\x01", -1)

    kind = "struct<start:int,ord:int,kind:string,end:int>"
    width = lambda p: F.length(p) - 2  # noqa: E731  of a piece without its two marks

    def step(acc: Column, piece: Column) -> Column:
        match = F.substring_index(piece, "\x02", 1)
        length = F.length(match) - 1
        measured = F.length(F.substring_index(match, "\x03", -1)) if rule.measured == "body" else length
        found = F.struct(acc["pos"].alias("start"), F.lit(ordinal).alias("ord"), F.lit(rule.kind).alias("kind"), (acc["pos"] + length).alias("end"))
        return F.struct((acc["pos"] + width(piece)).alias("pos"), F.when(measured >= rule.least, F.concat(acc["out"], F.array(found))).otherwise(acc["out"]).alias("out"))

    none = F.array().cast(f"array<{kind}>")
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, p: a + width(p))
    gathered = lambda c, at: F.aggregate(c, F.struct(at.alias("pos"), none.alias("out")), step, lambda a: a["out"])

    # an array that grows is copied at each step, so pieces are gathered in chunks, whose offsets come first
    def chunked(pieces: Column) -> Column:
        count = F.size(pieces) - 1
        parts = F.transform(F.sequence(F.lit(0), F.floor((count - 1) / CHUNK).cast("int")), lambda k: F.slice(pieces, k * CHUNK + 2, F.least(F.lit(CHUNK), count - k * CHUNK)))
        begin = F.struct(F.length(F.element_at(pieces, 1)).alias("pos"), F.array().cast("array<int>").alias("out"))
        offsets = lambda chunks: F.aggregate(chunks, begin, lambda a, c: F.struct((a["pos"] + total(c)).alias("pos"), F.concat(a["out"], F.array(a["pos"])).alias("out")), lambda a: a["out"])
        return F.when(count > 0, _let(parts, lambda chunks: F.flatten(F.zip_with(chunks, offsets(chunks), gathered)))).otherwise(none)

    return _let(pieces, chunked)


def spans_of(text: Column, rules=None) -> Column:
    rules = RULES if rules is None else rules
    return F.array_sort(F.concat(*[rule_spans(text, r, i) for i, r in enumerate(rules)]))


def scan(docs: DataFrame, ledger: str | None = None, id_col: str = "doc_id", text_col: str = "text", rules=None, rule_version: str = RULE_VERSION, anchor: str | None = ANCHOR) -> DataFrame:
    """``__id, blob, spans`` per row of ``docs`` (path or version, text); appends what it scanned to the ledger.

    ``ledger``: the ledger's path, created where it is missing; None takes a new one. ``anchor``: None where own rules
    need not match it.
    """
    spark = docs.sparkSession
    ledger = ledger or scratch(spark, "ledger")
    rules = RULES if rules is None else rules
    text = F.coalesce(F.col(text_col), F.lit(""))
    may = F.rlike(text, F.lit(anchor)) if anchor else F.lit(True)
    manifest = materialise(docs.select(F.col(id_col).alias("__id"), blob_of(F.col(text_col)).alias("blob"), may.alias("__may")), "manifest")
    try:
        seen = spark.read.schema(LEDGER).parquet(ledger).where(F.col("rule_version") == rule_version)
        seen.isEmpty()
    except Exception as missing:  # the first run; any other failure is raised again
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        seen = spark.createDataFrame([], LEDGER)
    reps = manifest.groupBy("blob").agg(F.min_by("__id", F.col("__id")).alias("__rep"), F.max("__may").alias("__may")).join(seen.select("blob"), "blob", "left_anti")
    reps = materialise(reps, "unseen")
    due = materialise(reps.where("__may").select("blob", "__rep"), "due")
    # by id, which costs nothing; only rows with a representative's id are addressed again
    texts = docs.select(F.col(id_col).alias("__i"), F.col(text_col).alias("__t"))
    hits = texts.join(sized(due, 100), F.col("__i").eqNullSafe(due["__rep"]) & (blob_of(F.col("__t")) == due["blob"]))
    hits = hits.select("blob", spans_of(F.coalesce("__t", F.lit("")), rules).alias("spans")).dropDuplicates(["blob"])
    rows = reps.select("blob").join(hits, "blob", "left")
    empty = F.array().cast("array<struct<start:int,ord:int,kind:string,end:int>>")
    rows.select("blob", F.lit(rule_version).alias("rule_version"), F.coalesce("spans", empty).alias("spans")).write.mode("append").parquet(ledger)
    known = spark.read.schema(LEDGER).parquet(ledger).where(F.col("rule_version") == rule_version).select("blob", "spans")
    known = known.join(manifest.select("blob").distinct(), "blob", "left_semi").dropDuplicates(["blob"])
    # stored, so that the join back is one of two plain tables, whose hot blobs AQE can split
    known = materialise(known, "known")
    return manifest.select("__id", "blob").join(known, "blob").select("__id", "blob", "spans")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

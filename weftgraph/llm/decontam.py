"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of the benchmark: 13 consecutive words of an item, or the whole of a shorter one. Symbols are
words, not characters: a text is lowered and cut into words, words outside the benchmark's vocabulary become one symbol.
A shift table over blocks of two words skips positions at which no window can end; where the shift is zero, the hash of
the window's last block selects the few windows to test, and direct comparison of the words confirms.

The windows are a stated query set. Items are cut into pieces of at most ``PIECE_WORDS`` windows and the pieces dealt
into blocks of about ``BLOCK_BYTES`` of words, so that what a task is sent and builds is bounded whatever one item's length;
only one block is on the driver, or in a worker, at a time, and every block runs against all documents. With one block
rows stay where they are. With several, each block is a pass over the texts that writes the hits of the texts that have
any, and these few are joined back by a 128-bit digest of the text.

Edge cases: a null or empty text has no words, is never contaminated; an item without words has no windows; items that
repeat or share a window are all counted; a null item id counts as the empty string; empty tables give no hits; a column
of the documents whose name is one of the result's is replaced; very long texts are one pass with the text's words in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, materialise, trimmed

#: Fixed values of the contract.
WINDOW = 13
#: A document is contaminated when SHARE times its hit words reach its words.
SHARE = 20

#: Bytes of one block's words (a worker's tables take about 120 times as much), and windows of one piece of an item.
BLOCK_BYTES, PIECE_WORDS = 1 << 20, 1 << 13

# Bytes of UTF-8: letters and digits stay, A-Z is lowered, all of U+0080 and above stays, the rest parts words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


class WuManber:
    """Search for sequences of symbols that all have the same length."""

    def __init__(self, patterns: list[tuple[int, ...]]):
        self.length = m = len(patterns[0])
        self.block = b = min(2, m)
        self.default = m - b + 1
        self.shift: dict[tuple, int] = {}
        self.bucket: dict[tuple, list[int]] = {}
        self.patterns = patterns
        for k, p in enumerate(patterns):
            for end in range(b, m + 1):
                at = p[end - b : end]
                self.shift[at] = min(self.shift.get(at, self.default), m - end)
            self.bucket.setdefault(p[m - b :], []).append(k)

    def find(self, s: list[int]) -> Iterator[tuple[int, int]]:
        """``(start, pattern)`` of every occurrence, overlapping ones too."""
        m, b, default, shift, bucket, patterns = self.length, self.block, self.default, self.shift.get, self.bucket, self.patterns
        i, n = m, len(s)
        while i <= n:
            at = tuple(s[i - b : i])
            step = shift(at, default)
            if step:
                i += step
                continue
            start = i - m
            for k in bucket[at]:
                p = patterns[k]
                if p[0] == s[start] and p == tuple(s[start:i]):
                    yield start, k
            i += 1


class Matcher:
    """All windows of a block of pieces of items; a piece of fewer than ``WINDOW`` words is a whole item."""

    def __init__(self, pieces: list[tuple[str, list[bytes]]]):
        self.vocabulary: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple, set]] = {}
        number = self.vocabulary.setdefault
        for item, ws in pieces:
            s = [number(w, len(self.vocabulary) + 1) for w in ws]
            m = min(WINDOW, len(s))
            for i in range(len(s) - m + 1):
                by_length.setdefault(m, {}).setdefault(tuple(s[i : i + m]), set()).add(item)
        self.searches = [(WuManber(list(found)), list(found.values())) for _, found in sorted(by_length.items())]

    def scan(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Hit intervals, merged and sorted, and the items with windows that occur."""
        get = self.vocabulary.get
        s = [get(w, 0) for w in ws]
        spans, items = [], set()
        for search, owners in self.searches:
            for start, k in search.find(s):
                spans.append((start, start + search.length))
                items |= owners[k]
        return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def _pieces(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """``item, no, ws``: the items' words, space-joined, in pieces that overlap so that each window is in one piece."""
    rows = benchmark.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t"))

    def cut(batches):
        for b in batches:
            out = []
            for item, text in zip(b.column("i").to_pylist(), b.column("t"), strict=True):
                ws = words(text.as_buffer().to_pybytes())
                for at in range(0, max(1, len(ws) - WINDOW + 1), PIECE_WORDS) if ws else ():
                    out.append((item, at, b" ".join(ws[at : at + PIECE_WORDS + WINDOW - 1])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.binary()), strict=True)], names=["item", "no", "ws"])

    return rows.mapInArrow(lambda b: trimmed(cut(b)), "item string, no long, ws binary")


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> tuple[int, Iterator[list[tuple[str, list[bytes]]]]]:
    """The number of blocks, and the blocks; only one at a time is on the driver."""
    pieces = materialise(_pieces(benchmark, item_col, text_col), "decon-pieces")
    n = (pieces.agg(F.sum(F.length("ws"))).first()[0] or 0) // BLOCK_BYTES + 1
    mine = lambda k: pieces.where(F.pmod(F.xxhash64("item", "no", "ws"), F.lit(n)) == k) if n > 1 else pieces
    return n, ([(r["item"], bytes(r["ws"]).split()) for r in mine(k).select("item", "ws").collect()] for k in range(n))


_SPANS, _ITEMS = T.ArrayType(T.IntegerType()), T.ArrayType(T.StringType())


def _key(text: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(text, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _annotated(docs: DataFrame, text_col: str, pieces: list | None, prefix: str) -> DataFrame:
    """``docs`` with ``n_words`` and, given the one block, ``spans`` and ``items``; else with the text's digest."""
    extra = [T.StructField(prefix + "n_words", T.LongType()), *([T.StructField(prefix + "spans", _SPANS), T.StructField(prefix + "items", _ITEMS)] if pieces is not None else [T.StructField(prefix + c, T.LongType()) for c in ("k1", "k2")])]

    def run(batches):
        matcher = Matcher(pieces) if pieces is not None else None
        for b in batches:
            cols = [[], [], []]
            for text in b.column(text_col):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                ws = words(raw)
                got, found = matcher.scan(ws) if matcher else _key(raw)
                for c, v in zip(cols, (len(ws), [x for pair in got for x in pair] if matcher else got, sorted(found) if matcher else found), strict=True):
                    c.append(v)
            types = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string())] if matcher else [pa.int64()] * 3
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[*b.schema.names, *(f.name for f in extra)])

    return docs.mapInArrow(lambda b: trimmed(run(b)), T.StructType([*docs.schema.fields, *extra]))


def _hits(docs: DataFrame, text_col: str, pieces: list) -> DataFrame:
    """``k1, k2, spans, items`` of the texts that have hits of one block, each once a task."""

    def run(batches):
        matcher, seen = Matcher(pieces), set()
        for b in batches:
            out = []
            for text in b.column("t"):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                got, found = matcher.scan(words(raw))
                if got and (key := _key(raw)) not in seen:
                    seen.add(key)
                    out.append((*key, [x for pair in got for x in pair], sorted(found)))
            if out:
                types = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["k1", "k2", "spans", "items"])

    return docs.select(F.col(text_col).alias("t")).mapInArrow(lambda b: trimmed(run(b)), "k1 long, k2 long, spans array<int>, items array<string>")


def _merged_hits(parts: list[DataFrame]) -> DataFrame:
    """The blocks' hits of each text as one row."""
    schema = "k1 long, k2 long, spans array<int>, items array<string>"

    def run(batches):
        key, spans, items = None, [], set()

        def row():
            flat = [x for pair in merged(spans) for x in pair]
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([flat], pa.list_(pa.int32())), pa.array([sorted(items)], pa.list_(pa.string()))], names=["k1", "k2", "spans", "items"])

        for b in batches:
            for k1, k2, s, i in zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "spans", "items")), strict=True):
                if (k1, k2) != key:
                    if key is not None:
                        yield row()
                    key, spans, items = (k1, k2), [], set()
                spans = merged([*spans, *zip(s[::2], s[1::2], strict=True)])
                items.update(i)
        if key is not None:
            yield row()

    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.repartition("k1", "k2").sortWithinPartitions("k1", "k2").mapInArrow(lambda b: trimmed(run(b)), schema)


def annotate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", prefix: str = "__decon_") -> DataFrame:
    """``docs``, each row with ``n_words, n_hit, n_items, items_sha256, contaminated`` under ``prefix``."""
    bounded_batches(docs.sparkSession)
    own = [prefix + c for c in ("n_words", "spans", "items", "n_hit", "n_items", "items_sha256", "contaminated", "k1", "k2")]
    keep = [c for c in docs.columns if c not in own or c == text_col]
    spans_c, items_c, n_c = prefix + "spans", prefix + "items", prefix + "n_words"
    n, blocks = _blocks(benchmark, item_col, item_text)
    if n == 1:
        out = _annotated(docs.select(*[F.col(f"`{c}`") for c in keep]), text_col, next(blocks), prefix)
    else:
        hits = materialise(_merged_hits([materialise(_hits(docs, text_col, b), "decon-hits") for b in blocks]), "decon-hits")
        hits = hits.select(F.col("k1").alias("__h1"), F.col("k2").alias("__h2"), F.col("spans").alias(spans_c), F.col("items").alias(items_c))
        rows = _annotated(docs.select(*[F.col(f"`{c}`") for c in keep]), text_col, None, prefix)
        out = rows.join(hits, (F.col(prefix + "k1") == F.col("__h1")) & (F.col(prefix + "k2") == F.col("__h2")), "left").drop("__h1", "__h2", prefix + "k1", prefix + "k2")
        out = out.withColumn(items_c, F.coalesce(items_c, F.array().cast("array<string>")))
    signed = F.transform(F.coalesce(F.col(spans_c), F.array().cast("array<int>")), lambda x, i: F.when(i % 2 == 0, -x).otherwise(x))
    hit = F.aggregate(signed, F.lit(0).cast("long"), lambda total, x: total + x)
    out = out.withColumns({prefix + "n_hit": hit, prefix + "n_items": F.size(items_c).cast("long"), prefix + "items_sha256": F.sha2(F.array_join(items_c, ","), 256)})
    bad = (F.col(prefix + "n_hit") > 0) & (SHARE * F.col(prefix + "n_hit") >= F.col(n_c))
    return out.withColumn(prefix + "contaminated", bad).drop(spans_c, items_c)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """The documents that are not contaminated, columns as they were."""
    text_col = names.pop("text_col", "text")
    # the other columns in a struct, so that no name clashes
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(F.lit(0).alias("__pad"), *others).alias("__row"), F.col(text_col).alias("__text"))
    left = annotate(rows, benchmark, "__text", **names).where("not __decon_contaminated")
    return left.select(*[(F.col("__text") if c == text_col else F.col("__row").getField(c)).alias(c) for c in docs.columns])


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()

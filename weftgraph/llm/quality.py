"""Quality classifier: an interpolated modified Kneser-Ney character n-gram model of trusted text.

Units are characters, so no word is out of vocabulary and one model serves all languages and scripts. Training counts
the n-grams of all trusted documents of one half of the labels (by hash of the id), however many; the other half sets the
thresholds, as a text that was trained on looks better than it is. With ``left_out``, as in the pipeline, every trusted
document does both: one model is trained on all of them, and a text that is equal to trusted ones is scored by what the model
is without them, which follows exactly from the counts of the text's own n-grams. With ``crossed`` texts are halved by their
hash, each half trains a model, and a text is scored by the model of the half it isn't in. In both, equal texts are scored
alike and none by a model that saw it. Lower orders use continuation counts; discounts D1, D2 and D3+ come from the counts
of counts of each order.

Scoring joins counts, not documents: each input block (one scan task's documents) contributes its distinct n-grams, which
are joined, sharded by n-gram, with the count and context tables of every order. The probabilities return to the block,
where they meet its texts (packed with zstd for the one shuffle) and are summed by document. What is gathered follows
the input; nothing but discounts (a dozen numbers), and ids to train on that fit a broadcast, reaches the driver.

A document is rejected when its perplexity is above its threshold. A language's bound is the ``QUANTILE`` of the log
perplexities of all trusted labelled documents of the language that weren't trained on (of all, with ``left_out`` or
``crossed``), widened by ``WIDEN`` times its distance from the median. Both are values of exact ranks. A text's mean log probability counts with ``PRIOR_CHARS`` characters at the median beside it, so
short texts need stronger evidence: the threshold of a text of n characters is ``exp(median + (bound - median) * (n +
PRIOR_CHARS) / n)``. Languages with fewer than ``MIN_CALIBRATION`` such documents use the bound over all languages.

Edge cases: a null or empty text has no perplexity and no threshold and isn't rejected; a null language is a language of its own; without
trusted labels there is no threshold and nothing is rejected; with ``crossed`` or ``left_out``, a text whose model would have no text to
train on has no perplexity; rows that repeat are scored alike; very long texts are
scored whole.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, freed, materialise, sized, trimmed

ORDER = 4
QUANTILE = 0.99
WIDEN = 0.5
MIN_CALIBRATION = 30
#: Characters at the language's median that stand beside a text's own, so that a few words prove little.
PRIOR_CHARS = 60
#: Stands before a text, so that its first characters have a context.
PAD = "\x02"

#: Cells of a table that is addressed directly; beyond it, ranks are found by sorting.
_DIRECT = 1 << 23
_BLOB = 1 << 18
#: Characters that are turned into n-grams at once.
_PART = 1 << 19
#: Characters of texts whose own counts are taken off at once; a longer text is alone.
_LEFT = 1 << 17
#: Cells of a unit of log perplexity, among whose counts a rank is looked for first.
_CELLS = 256


def _rank(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``(rank of each id among the distinct ones, the distinct ids)``."""
    if size <= _DIRECT:
        seen = np.zeros(size, bool)
        seen[ids] = True
        distinct = np.flatnonzero(seen)
        where = np.zeros(size, np.int32)
        where[distinct] = np.arange(len(distinct), dtype=np.int32)
        return where[ids], distinct
    distinct, back = np.unique(ids, return_inverse=True)
    return back.astype(np.int32), distinct


def segments(texts: list[str], order: int, size: int = 0) -> list[list[tuple[str, str, int]]]:
    """``(context, part, text's number)`` of all texts in batches of about ``size`` characters; long texts in parts.

    A part's context is the padding at a text's start and the characters before it elsewhere, so parts add up.
    """
    pad, out, held, size = order - 1, [], 0, size or _PART
    now: list[tuple[str, str, int]] = []
    for k, t in enumerate(texts):
        for at in range(0, len(t), size):
            part = t[at : at + size]
            now.append(((PAD * pad + t[:at])[-pad:] if at < pad else t[at - pad : at], part, k))
            held += len(part)
            if held >= size:
                out.append(now)
                now, held = [], 0
    return [*out, now] if now else out


def _joined(parts: list[tuple[str, str, int]], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all parts, each behind its context, and the positions that aren't context."""
    pad = order - 1
    a = np.frombuffer("".join(c + t for c, t, _ in parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    keep = np.ones(len(a), bool)
    at = 0
    for _, t, _ in parts:
        keep[at : at + pad] = False
        at += pad + len(t)
    return a, np.flatnonzero(keep)


def grams_of(parts: list[tuple[str, str, int]], order: int) -> tuple[list[str], np.ndarray]:
    """The distinct n-grams of some parts of texts and how often each occurs."""
    a, at = _joined(parts, order)
    if not len(at):
        return [], np.zeros(0, np.int64)
    c, letters = _rank(a.astype(np.int64), 0x110000)
    width, ids, distinct = len(letters), c.astype(np.int64), letters
    for _ in range(order - 1):
        nxt = np.zeros(len(ids), np.int64)
        nxt[1:] = ids[:-1]
        ids, distinct = _rank(nxt * width + c, len(distinct) * width)
        ids = ids.astype(np.int64)
    own = ids[at]
    counts = np.bincount(own, minlength=len(distinct))
    example = np.zeros(len(distinct), np.int64)
    example[own] = at
    got = np.flatnonzero(counts)
    chars = a[example[got][:, None] + np.arange(1 - order, 1)]
    s = np.ascontiguousarray(chars).tobytes().decode("utf-32-le", "surrogatepass")
    return [s[k : k + order] for k in range(0, len(s), order)], counts[got]


class BlockScorer:
    """Sums the log probabilities of texts, given those of all their n-grams."""

    def __init__(self, grams: list[str], logp: np.ndarray, order: int):
        self.order = order
        chars = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, order).astype(np.int64)
        letters = np.unique(chars)
        self.letter = np.full(0x110000, -1, np.int32)
        self.letter[letters] = np.arange(len(letters))
        self.width = len(letters)
        c = self.letter[chars].astype(np.int64)
        ids, self.steps = c[:, 0], []
        for k in range(1, order):
            code = ids * self.width + c[:, k]
            distinct = np.unique(code)
            self.steps.append(self._table(distinct))
            ids = np.searchsorted(distinct, code)
        self.of = ids
        self.logp = np.zeros(len(ids))
        self.logp[ids] = logp

    def _table(self, distinct: np.ndarray):
        size = int(distinct[-1]) + 1
        if size > _DIRECT:
            return distinct
        where = np.full(size, -1, np.int32)
        where[distinct] = np.arange(len(distinct))
        return (where,)

    def score(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts))
        for parts in segments(texts, self.order):
            p = self.logp[self.ids(parts)]
            sizes = np.array([len(t) for _, t, _ in parts])
            np.add.at(out, [k for _, _, k in parts], np.add.reduceat(p, np.cumsum(sizes) - sizes))
        return out

    def ids(self, parts: list[tuple[str, str, int]]) -> np.ndarray:
        """The n-gram that ends at each character, by its rank among the block's."""
        a, at = _joined(parts, self.order)
        c = self.letter[a].astype(np.int64)
        ids = [c[at + k] for k in range(1 - self.order, 1)]
        now = ids[0]
        for k, step in enumerate(self.steps, 1):
            if now.min() < 0 or ids[k].min() < 0:
                raise ValueError("a block's n-grams and texts differ: its scan isn't repeatable")
            code = now * self.width + ids[k]
            if isinstance(step, tuple):
                code = np.minimum(code, len(step[0]) - 1)
                now = step[0][code].astype(np.int64)
            else:
                now = np.searchsorted(step, code)
        if now.min() < 0:
            raise ValueError("a block's n-grams and texts differ: its scan isn't repeatable")
        return now


class LeftOut:
    """Scores trusted texts by the model of all other texts, as if it were trained anew without them.

    Taking a text and its copies away changes the counts of its own n-grams, the totals and counts of counts of their contexts,
    and the continuation counts of what they end in, where an n-gram vanishes; so the rows of the text's n-grams (see
    ``KneserNey.rows``) hold all that is needed. The corpus' counts of counts, and so the discounts, follow in the same way.
    """

    def __init__(self, scorer: BlockScorer, grams: list[str], rows: np.ndarray, classes: dict[int, tuple], distinct: int, total: int):
        """``rows``: those of ``grams``, which are of the scorer's; ``classes``: by order, how many n-grams have counts 1 to 4."""
        n = self.order = scorer.order
        self.scorer, self.classes, self.distinct, self.total = scorer, classes, distinct, total
        chars = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)
        c = scorer.letter[chars].astype(np.int64)

        def ranked(a: int, b: int) -> np.ndarray:
            ids = c[:, a]
            for j in range(a + 1, b):
                ids = np.unique(ids * scorer.width + c[:, j], return_inverse=True)[1]
            return ids

        def table(ids: np.ndarray, values: np.ndarray) -> np.ndarray:
            out = np.zeros(int(ids.max()) + 1, np.int64)
            out[ids] = values
            return out

        unit = {k: ranked(n - k, n) if k < n else np.arange(len(grams)) for k in range(n, 0, -1)}
        self.counts = {k: table(unit[k], rows[:, n - k]) for k in unit}
        self.down, self.context, self.totals = {}, {}, {}
        for k in range(n, 1, -1):
            x, at = ranked(n - k, n - 1), n + 4 * (n - k)
            self.down[k], self.context[k] = table(unit[k], unit[k - 1]), table(unit[k], x)
            self.totals[k] = [table(x, rows[:, at + j]) for j in range(4)]

    def place(self, ids: np.ndarray) -> None:
        """``ids``: the scorer's of the grams."""
        self.at = np.full(len(self.scorer.logp), -1, np.int64)
        self.at[ids] = np.arange(len(ids))

    def _pairs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(text, n-gram, how often)`` of each text's distinct n-grams."""
        size, codes, counts = len(self.counts[self.order]), [], []
        for parts in segments(texts, self.order):
            at = self.at[self.scorer.ids(parts)]
            if at.min() < 0:
                raise ValueError("a trusted text has n-grams that weren't trained on: its scan isn't repeatable")
            code, n = np.unique(np.repeat([k for _, _, k in parts], [len(t) for _, t, _ in parts]) * size + at, return_counts=True)
            codes.append(code)
            counts.append(n)
        code, n = codes[0], counts[0]
        if len(codes) > 1:
            code, back = np.unique(np.concatenate(codes), return_inverse=True)
            n = np.bincount(back, np.concatenate(counts)).astype(np.int64)
        return code // size, code % size, n

    def score(self, texts: list[str], copies: list[int]) -> np.ndarray:
        """Sums of log probabilities of texts that aren't empty, each of which was trained on so often; nan where no other text is left."""
        m, steps = len(texts), []
        t, u, n = self._pairs(texts)
        first, c = t, self.counts[self.order][u]
        new = c - np.array(copies, np.int64)[t] * n
        if new.min() < 0:
            raise ValueError("a trusted text has more n-grams than were trained on: its scan isn't repeatable")
        for k in range(self.order, 0, -1):
            met = [had + np.bincount(t[new == i], minlength=m) - np.bincount(t[c == i], minlength=m) for i, had in enumerate(self.classes[k], 1)]
            d = np.array([discounts(*x) for x in zip(*(x.tolist() for x in met), strict=True)]).T
            own = np.where(new > 0, np.maximum(0.0, new - d[np.clip(new, 1, 3) - 1, t]), 0.0)
            if k == 1:
                break
            x, size = self.context[k][u], len(self.totals[k][0])
            code, back = np.unique(t * size + x, return_inverse=True)
            of, x = code // size, code % size
            total = self.totals[k][0][x] - np.bincount(back, c - new)
            less = 0.0
            for i in range(3):
                was, now = np.minimum(c, 3) == i + 1, np.minimum(new, 3) == i + 1
                less = less + d[i, of] * (self.totals[k][i + 1][x] + np.bincount(back, now.astype(np.float64) - was))
            size = len(self.counts[k - 1])
            code, down = np.unique(t * size + self.down[k][u], return_inverse=True)
            steps.append((own, less[back], total[back], down))
            lost = np.bincount(down, new == 0).astype(np.int64)
            t, u = code // size, code % size
            c = self.counts[k - 1][u]
            new = c - lost
        total = self.total - np.bincount(t, c - new, m)
        letters = self.distinct - np.bincount(t[new == 0], minlength=m)
        left = d[0] * met[0] + d[1] * met[1] + d[2] * (letters - met[0] - met[1])
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.where(total[t] > 0, (own + (left / (letters + 1))[t]) / total[t], np.nan)
        for own, less, total, down in reversed(steps):
            p = np.where(total > 0, (own + less * p[down]) / np.maximum(total, 1), p[down])
        return np.bincount(first, n * np.log(p), m)


def count_grams(docs: DataFrame, text_col: str, order: int, block: bool) -> DataFrame:
    """``gram, cnt``; with block, the distinct n-grams by ``block`` instead, each once a task."""

    def run(batches):
        seen: set[str] = set()
        for b in batches:
            for parts in segments([t for t in b.column("t").to_pylist() if t], order):
                grams, counts = grams_of(parts, order)
                if block:
                    grams = [g for g in grams if g not in seen]
                    seen.update(grams)
                    counts = np.ones(len(grams), np.int64)
                first = pa.array(np.full(len(grams), b.column("block")[0].as_py()), pa.int32())
                yield pa.RecordBatch.from_arrays([first, pa.array(grams, pa.string()), pa.array(counts, pa.int64())], names=["block", "gram", "cnt"])

    src = docs.select(F.spark_partition_id().alias("block"), F.col(text_col).alias("t"))
    out = src.mapInArrow(lambda b: trimmed(run(b)), "block int, gram string, cnt long")
    return out.select("block", "gram").distinct() if block else out.groupBy("gram").agg(F.sum("cnt").alias("cnt"))


class KneserNey:
    """The tables of every order: counts by n-gram, and totals and counts of counts by context."""

    def __init__(self, texts: DataFrame, text_col: str = "text", order: int = ORDER):
        self.order = order
        self.counts: dict[int, DataFrame] = {order: materialise(count_grams(texts, text_col, order, block=False), "kn-counts")}
        for k in range(order - 1, 0, -1):
            lower = self.counts[k + 1].groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("cnt"))
            self.counts[k] = materialise(lower, "kn-counts")
        self.contexts, self.discounts, self.classes = {}, {}, {}
        for k in range(order, 0, -1):
            t = self.counts[k]
            n = t.agg(*[F.count(F.when(F.col("cnt") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4)], F.sum("cnt").alias("total"), F.count("*").alias("distinct")).first()
            self.classes[k] = (n["n1"], n["n2"], n["n3"], n["n4"])
            self.discounts[k] = discounts(*self.classes[k])
            if k == 1:
                self.total, self.letters = n["total"] or 0, n["distinct"] + 1
                self.singles = (n["n1"], n["n2"], n["distinct"] - n["n1"] - n["n2"])
            else:
                by = t.groupBy(F.substring("gram", 1, k - 1).alias("ctx"))
                self.contexts[k] = materialise(by.agg(F.sum("cnt").alias("tot"), F.count(F.when(F.col("cnt") == 1, 1)).alias("c1"), F.count(F.when(F.col("cnt") == 2, 1)).alias("c2"), F.count(F.when(F.col("cnt") > 2, 1)).alias("c3")), "kn-contexts")

    def _less(self, k: int, c: Column) -> Column:
        d1, d2, d3 = self.discounts[k]
        return F.greatest(F.lit(0.0), c - F.when(c == 1, d1).when(c == 2, d2).otherwise(d3))

    def rows(self) -> Column:
        """What ``LeftOut`` needs of an n-gram that was trained on: counts by order, then each order's total and counts of counts."""
        n = self.order
        cols = [f"__c{k}" for k in range(n, 0, -1)] + [c for k in range(n, 1, -1) for c in (f"__t{k}", f"__c1_{k}", f"__c2_{k}", f"__c3_{k}")]
        return F.when(F.col(f"__c{n}").isNotNull(), F.array(*[F.col(c).cast("long") for c in cols]))

    def log_probabilities(self, grams: DataFrame, rows: bool = False) -> DataFrame:
        """``gram, logp`` of distinct n-grams, and their ``rows``: two joins an order, all on the n-gram's parts, none broadcast by hint."""
        n, q = self.order, grams
        for k in range(n, 0, -1):
            t = self.counts[k].select(F.col("gram").alias("__g"), F.col("cnt").alias(f"__c{k}"))
            q = q.join(t, F.expr(f"substring(gram, {n - k + 1}, {k})") == t["__g"], "left").drop("__g")
            if k > 1:
                x = self.contexts[k].select(F.col("ctx").alias("__x"), F.col("tot").alias(f"__t{k}"), *[F.col(c).alias(f"__{c}_{k}") for c in ("c1", "c2", "c3")])
                q = q.join(x, F.expr(f"substring(gram, {n - k + 1}, {k - 1})") == x["__x"], "left").drop("__x")
        d1, d2, d3 = self.discounts[1]
        left = d1 * self.singles[0] + d2 * self.singles[1] + d3 * self.singles[2]
        c1 = F.col("__c1")
        p = (F.when(c1.isNull(), 0.0).otherwise(self._less(1, c1)) + left / self.letters) / self.total if self.total else F.lit(1.0)
        for k in range(2, n + 1):
            d1, d2, d3 = self.discounts[k]
            c, tot = F.col(f"__c{k}"), F.col(f"__t{k}")
            own = F.when(c.isNull(), 0.0).otherwise(self._less(k, c))
            back = d1 * F.col(f"__c1_{k}") + d2 * F.col(f"__c2_{k}") + d3 * F.col(f"__c3_{k}")
            p = F.when(tot.isNull(), p).otherwise((own + back * p) / tot)
        return q.select("gram", F.log(p).alias("logp"), *([self.rows().alias("rows")] if rows else []))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts; where counts of counts are missing, the usual 0.5, 1 and 1.5."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return tuple(min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d, strict=True))


def _key(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def perplexities(docs: DataFrame, model: KneserNey, id_col: str, text_col: str, lang_col: str, trained: DataFrame | None = None) -> DataFrame:
    """``__id, lang, n_chars, perplexity`` per row. ``docs`` must be a scan that repeats (files, not a random order).

    A text in ``trained`` (``key``, and ``copies`` that the model was trained on) is scored as if they weren't in the model.
    """
    order, without = model.order, trained is not None
    numbers = (model.classes, model.letters - 1, model.total)
    more = ["rows"] if without else []
    blocks = materialise(count_grams(docs, text_col, order, block=True), "kn-blocks")
    known = materialise(model.log_probabilities(blocks.select("gram").distinct(), without), "kn-logp")
    slices = blocks.join(known, "gram").select("block", F.lit(0).alias("kind"), "gram", "logp", *more, *[F.lit(None).cast(t).alias(c) for c, t in (("ids", "array<bigint>"), ("langs", "array<string>"), ("blob", "binary"), ("sizes", "array<int>"))])

    def pack(batches):
        import zstandard

        z = zstandard.ZstdCompressor(level=3)
        held, size, block = [], 0, None

        def out():
            raw = [None if t is None else t.encode() for _, _, t in held]
            sizes = [-1 if r is None else len(r) for r in raw]
            row = [[block], [1], [None], [None], [[h[0] for h in held]], [[h[1] for h in held]], [z.compress(b"".join(r or b"" for r in raw))], [sizes]]
            types = [pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.binary(), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types, strict=True)], names=["block", "kind", "gram", "logp", "ids", "langs", "blob", "sizes"])

        for b in batches:
            block = b.column("block")[0].as_py() if b.num_rows else block
            for row in zip(b.column("i").to_pylist(), b.column("l").to_pylist(), b.column("t").to_pylist(), strict=True):
                held.append(row)
                size += len(row[2] or "")
                if size > _BLOB:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    schema = "block int, kind int, gram string, logp double, ids array<bigint>, langs array<string>, blob binary, sizes array<int>"
    none = [F.lit(None).cast(slices.schema[c].dataType).alias(c) for c in slices.columns]
    texts = docs.select(F.spark_partition_id().alias("block"), F.col(id_col).cast("long").alias("i"), F.col(lang_col).cast("string").alias("l"), F.col(text_col).alias("t")).mapInArrow(lambda b: trimmed(pack(b)), schema)

    def score(batches):
        import zstandard

        z = zstandard.ZstdDecompressor()
        block, grams, logp, scorer, copies, has, rows, left = None, [], [], None, {}, [], [], None

        def sums_of(ts: list[str], keys: list[str]) -> list[float]:
            own = [k for k, key in enumerate(keys) if ts[k] and key in copies]
            out = scorer.score(["" if k in set(own) else t for k, t in enumerate(ts)] if own else ts)
            while own:
                n = max(1, int(np.searchsorted(np.cumsum([len(ts[k]) for k in own]), _LEFT, "right")))
                out[own[:n]] = left.score([ts[k] for k in own[:n]], [copies[keys[k]] for k in own[:n]])
                own = own[n:]
            return out.tolist()

        for b in batches:
            ids, langs, sizes, sums = [], [], [], []
            cut = b.column("block").to_numpy()
            kind = b.column("kind").to_numpy()
            edges = np.flatnonzero(np.append(True, (cut[1:] != cut[:-1]) | (kind[1:] != kind[:-1])))
            for a, e in zip(edges, np.append(edges[1:], len(cut)), strict=True):
                part = b.slice(a, e - a)
                if cut[a] != block:
                    block, grams, logp, scorer, copies, has, rows, left = cut[a], [], [], None, {}, [], [], None
                if kind[a] < 0:
                    copies.update(zip(part.column("gram").to_pylist(), part.column("rows").flatten().to_pylist(), strict=True))
                    continue
                if kind[a] == 0:
                    grams += part.column("gram").to_pylist()
                    logp.append(part.column("logp").to_numpy())
                    if copies:
                        has.append(part.column("rows").is_valid().to_numpy(zero_copy_only=False))
                        rows.append(part.column("rows").flatten().to_numpy())
                    continue
                if scorer is None and grams:
                    scorer = BlockScorer(grams, np.concatenate(logp), order)
                    if copies:
                        own = np.flatnonzero(np.concatenate(has))
                        left = LeftOut(scorer, [grams[k] for k in own], np.concatenate(rows).reshape(len(own), -1), *numbers)
                        left.place(scorer.of[own])
                    grams, logp, has, rows = [], [], [], []
                for i, l, blob, n in zip(part.column("ids").to_pylist(), part.column("langs").to_pylist(), part.column("blob").to_pylist(), part.column("sizes").to_pylist(), strict=True):
                    raw, at, ts, keys = z.decompress(blob) if any(x > 0 for x in n) else b"", 0, [], []
                    for x in n:
                        ts.append(raw[at : at + max(x, 0)].decode())
                        if copies:
                            keys.append(hashlib.md5(raw[at : at + max(x, 0)], usedforsecurity=False).hexdigest())
                        at += max(x, 0)
                    ids += i
                    langs += l
                    sizes += [len(t) for t in ts]
                    sums += sums_of(ts, keys) if any(ts) else [0.0] * len(ts)
            ppl = [math.exp(min(700.0, -s / n)) if n and s == s else None for s, n in zip(sums, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(sizes, pa.int64()), pa.array(ppl, pa.float64())], names=["__id", "lang", "n_chars", "perplexity"])

    both = slices.unionByName(texts, allowMissingColumns=without)
    if without:
        # first of all a block's own texts that were trained on
        keys = docs.select(F.spark_partition_id().alias("block"), _key(F.col(text_col)).alias("key")).distinct().join(sized(trained, 48), "key")
        own = {"block": F.col("block"), "kind": F.lit(-1), "gram": F.col("key"), "rows": F.array(F.col("copies").cast("long"))}
        both = both.unionByName(keys.select(*[own[c].alias(c) if c in own else n for c, n in zip(slices.columns, none, strict=True)]))
    # two partitions a block, so that few of them meet in a task however many there are
    parts = 2 * ((blocks.agg(F.max("block")).first()[0] or 0) + 1)
    return both.repartition(parts, "block").sortWithinPartitions("block", "kind").mapInArrow(lambda b: trimmed(score(b)), "__id long, lang string, n_chars long, perplexity double")


def _half(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(2))


def _crossed(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, lang_col: str, order: int) -> DataFrame:
    """``perplexities`` of all rows, each by the model of the trusted texts in the half that its own text isn't in."""
    half, own, out = _half(docs[text_col]), docs[id_col].cast("long"), []
    for k in (0, 1):
        train = docs.where(half == k).join(sized(trusted), own == trusted["__l"], "left_semi")
        model = KneserNey(train.select(F.col(text_col).alias("text")), "text", order)
        part = perplexities(docs.where(half == 1 - k), model, id_col, text_col, lang_col)
        out.append(part if model.total else part.withColumn("perplexity", F.lit(None).cast("double")))
    return out[0].unionByName(out[1])


def _without(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, lang_col: str, order: int) -> DataFrame:
    """``perplexities`` of all rows by one model of all trusted texts, each without the trusted texts that are equal to it."""
    train = docs.join(sized(trusted), docs[id_col].cast("long") == trusted["__l"], "left_semi").select(F.col(text_col).alias("text"))
    model = KneserNey(train, "text", order)
    trained = materialise(train.where(F.length("text") > 0).groupBy(_key(F.col("text")).alias("key")).agg(F.count("*").alias("copies")), "kn-trained")
    out = perplexities(docs, model, id_col, text_col, lang_col, trained)
    return out if model.total else out.withColumn("perplexity", F.lit(None).cast("double"))


def exact_quantiles(rows: DataFrame, asked: list[float]) -> DataFrame:
    """``k, n, q`` of rows ``(k, v)``: per key the count and the values of rank ``ceil(asked n)``, 1 at least.

    Ranks are looked for among the counts of cells of values, then among the distinct values of the one cell that holds it, so
    no task sorts a key's rows. Keys aren't null, nor values.
    """
    values = materialise(rows.groupBy("k", "v").agg(F.count("*").alias("c")).withColumn("cell", F.floor(F.col("v") * _CELLS)), "kn-values")
    cells = materialise(values.groupBy("k", "cell").agg(F.sum("c").alias("c")), "kn-cells")
    upto, key = F.sum("c").over(Window.partitionBy("k").orderBy("cell")), Window.partitionBy("k")
    cells = cells.withColumns({"upto": upto, "n": F.sum("c").over(key)})
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), F.greatest(F.lit(1), F.ceil(F.col("n") * q)).alias("r")) for i, q in enumerate(asked)])
    cells = cells.withColumn("a", F.explode(ranks)).where("a.r <= upto and a.r > upto - c")
    cells = materialise(cells.select("k", "cell", "n", F.col("a.i").alias("i"), (F.col("a.r") - F.col("upto") + F.col("c")).alias("r")), "kn-cells")
    found = values.join(sized(cells, 64), ["k", "cell"]).withColumn("upto", F.sum("c").over(Window.partitionBy("k", "i").orderBy("v"))).where("r <= upto and r > upto - c")
    return found.groupBy("k", "n").agg(F.array(*[F.max(F.when(F.col("i") == i, F.col("v"))) for i in range(len(asked))]).alias("q"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, train_rows: int | None = None, quantile: float = QUANTILE, crossed: bool = False, left_out: bool = False) -> DataFrame:
    """One row per input row: ``__id, lang, n_chars, perplexity, threshold, rejected``.

    ``labels``: ``(doc_id, quality, toxic)``; text is trusted where quality is 1 and toxic isn't.
    With ``train_rows`` the model is trained on so many trusted documents at most; the thresholds use all others.
    With ``crossed`` all trusted documents train one of two models and set the thresholds, scored by the other one.
    With ``left_out`` all train the one model and set the thresholds, each scored without the trusted texts equal to it.
    """
    if crossed + left_out + (train_rows is not None) > 1:
        raise ValueError("crossed, left_out and train_rows exclude each other")
    spark = docs.sparkSession
    bounded_batches(spark)
    trusted = labels.where((F.col("quality") == 1) & ~F.coalesce(F.col("toxic") == 1, F.lit(False)) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("__l")).distinct()
    own = docs[id_col].cast("long")
    if crossed or left_out:
        trusted = materialise(trusted, "kn-trusted")
        scored = materialise((_without if left_out else _crossed)(docs, trusted, id_col, text_col, lang_col, order), "kn-scores")
        held = trusted
    else:
        sample = trusted.where(_half(F.col("__l")) == 0)
        if train_rows is not None:
            sample = sample.orderBy(F.xxhash64(F.col("__l"), F.lit(1)), "__l").limit(train_rows)
        sample = materialise(sample, "kn-sample")
        train = docs.where(_half(own) == 0).join(sized(sample), own == sample["__l"], "left_semi")
        model = KneserNey(train.select(F.col(text_col).alias("text")), "text", order)
        scored = materialise(perplexities(docs, model, id_col, text_col, lang_col), "kn-scores")
        held = trusted.join(sized(sample), "__l", "left_anti")
    held = scored.join(held, F.col("__id") == F.col("__l"), "left_semi").where("perplexity is not null")
    # a language's key begins with =, all languages' is empty
    own = F.concat(F.lit("="), F.coalesce("lang", F.lit("")))
    found = exact_quantiles(held.select(F.explode(F.array(own, F.lit(""))).alias("k"), F.log("perplexity").alias("v")), [0.5, quantile])
    q = F.col("q")
    found = materialise(found.select("k", "n", F.struct(q[0].alias("mid"), (q[1] + WIDEN * (q[1] - q[0])).alias("top")).alias("__own")), "kn-bounds")
    whole = (found.where("k = ''").first() or {"__own": {"mid": None, "top": None}})["__own"]
    overall = F.struct(F.lit(whole["mid"]).cast("double").alias("mid"), F.lit(whole["top"]).cast("double").alias("top"))
    by_lang = found.where((F.col("k") != "") & (F.col("n") >= MIN_CALIBRATION)).select("k", "__own")
    out = scored.join(sized(by_lang, 64), own == F.col("k"), "left").withColumn("__b", F.coalesce("__own", overall))
    mid, top, n = F.col("__b.mid"), F.col("__b.top"), F.col("n_chars")
    # a rounding's width above, so that a text at the quantile itself isn't beyond it
    bound = F.exp(mid + (top - mid) * (n + PRIOR_CHARS) / n) * (1 + 1e-9)
    return out.select("__id", "lang", "n_chars", "perplexity", F.when(n > 0, bound).alias("threshold"), F.coalesce((n > 0) & (F.col("perplexity") > bound), F.lit(False)).alias("rejected"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, columns as they were; an id is judged by its worst row.

    All trusted labels train and set the thresholds (``crossed`` or ``left_out``), unless ``train_rows`` bounds what is trained on.
    """
    kw.setdefault("crossed", kw.get("train_rows") is None and not kw.get("left_out"))
    with freed(docs.sparkSession):
        out = classify(docs, labels, id_col, **kw)
        lost = materialise(out.where("rejected").select("__id").distinct(), "kn-drop", keep=True)
    return docs.join(sized(lost), docs[id_col].cast("long") == lost["__id"], "left_anti")

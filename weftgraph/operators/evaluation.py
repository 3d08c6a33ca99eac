"""Scoring of answers against gold sets, transcripts of runs, their summaries, and benchmark gates."""

from __future__ import annotations

import json
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Per cent by which a figure may exceed its baseline.
TOLERANCE = 20


def _quoted(text: Column) -> Column:
    return F.regexp_replace(text, r"([^A-Za-z0-9_])", r"\\$1")


def mentioned(text: Column, kind: Column, expected: Column) -> Column:
    """A symbol between identifier boundaries; a file by its path or its last segment."""
    word = F.rlike(text, F.concat(F.lit(r"(?<![\w$])"), _quoted(expected), F.lit(r"(?![\w$])")))
    return F.when(kind == "symbol", word).otherwise(F.contains(text, F.substring_index(expected, "/", -1)))


def score_answers(answers: DataFrame, gold: DataFrame) -> DataFrame:
    """``answers(run, question, text)``, ``gold(question, kind, expected, minimum)`` to ``run, question, recall, correct``.

    An answer is correct when each kind reaches its minimum (null: all). Missing text finds nothing.
    """
    text = F.coalesce("text", F.lit(""))
    hit = answers.join(gold, "question").withColumn("hit", mentioned(text, F.col("kind"), F.col("expected")).cast("int"))
    kinds = hit.groupBy("run", "question", "kind").agg(F.sum("hit").alias("hits"), F.count("*").alias("of"), F.max("minimum").alias("minimum"))
    return kinds.groupBy("run", "question").agg((F.sum("hits") / F.sum("of")).alias("recall"), F.every(F.col("hits") >= F.coalesce("minimum", "of")).alias("correct"))


def summarize(runs: DataFrame, by: str = "condition") -> DataFrame:
    """``runs(condition, correct, recall, tokens)``; missing tokens aren't zero; the deviation is the population's."""
    return runs.groupBy(by).agg(F.count("*").alias("runs"), F.avg(F.col("correct").cast("int")).alias("accuracy"), F.avg("recall").alias("recall"), F.avg("tokens").alias("tokens"), F.when(F.count("tokens") < 2, 0.0).otherwise(F.stddev_pop("tokens")).alias("deviation"))


def compare_bench(measured: DataFrame, budgets: DataFrame, baseline: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """``metric, value`` tables to ``metric, value, status``: over budget first, then regressed, else ok."""
    m = measured.join(budgets.select("metric", F.col("value").alias("budget")), "metric", "left").join(baseline.select("metric", F.col("value").alias("base")), "metric", "left")
    status = F.when(F.col("value") > F.col("budget"), "over budget").when(F.col("value") > F.col("base") * (1 + tolerance / 100), "regressed").otherwise("ok")
    return m.select("metric", "value", status.alias("status"))


def verify_gold(gold: DataFrame, nodes: DataFrame) -> DataFrame:
    """Expected symbols and files that no node has."""
    have = nodes.select(F.lit("symbol").alias("kind"), F.explode(F.array("name", "qn")).alias("expected")).unionByName(nodes.where("file is not null").select(F.lit("file").alias("kind"), F.col("file").alias("expected")))
    return gold.join(have, ["kind", "expected"], "left_anti")


def bench_table(rows: DataFrame) -> str:
    """``metric, value, status`` as aligned text; a benchmark's metrics are few."""
    cells = [("metric", "value", "status"), *((r["metric"], f"{r['value']:g}", r["status"]) for r in rows.orderBy("metric").collect())]
    wide = [max(len(c[k]) for c in cells) for k in range(3)]
    return "\n".join(f"{m:<{wide[0]}}  {v:>{wide[1]}}  {s}".rstrip() for m, v, s in cells) + "\n"


def _last_record(data):
    """The entry that carries the outcome: a list's first result entry, else its last one."""
    if not isinstance(data, list):
        return data
    return next((x for x in data if isinstance(x, dict) and x.get("type") == "result"), data[-1] if data else None)


def _figure(usage: dict, *names: str) -> int | None:
    found = next((usage[n] for n in names if usage.get(n) is not None), None)
    return int(found) if isinstance(found, (int, float)) and not isinstance(found, bool) and math.isfinite(found) else None


def _tool_uses(data) -> int:
    """Objects of type ``tool_use`` at any depth, without recursion."""
    todo, n = [data], 0
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            n += x.get("type") == "tool_use"
            todo.extend(x.values())
        elif isinstance(x, list):
            todo.extend(x)
    return n


def _answer(record) -> str:
    if isinstance(record, str):
        return record
    if not isinstance(record, dict):
        return ""
    if isinstance(record.get("result"), str):
        return record["result"]
    message = record.get("message")
    content = message.get("content") if isinstance(message, dict) and message.get("content") is not None else record.get("content")
    if isinstance(content, list):
        return "\n".join(b["text"] for b in content if isinstance(b, dict) and b.get("type") == "text" and isinstance(b.get("text"), str))
    return content if isinstance(content, str) else ""


def _transcript(text: str | None) -> tuple:
    try:
        data = json.loads(text or "")
    except (ValueError, RecursionError):
        return None, None, None, 0, ""
    record = _last_record(data)
    usage, inner = {}, None
    if isinstance(record, dict):
        inner = record.get("result")
        usage = record.get("usage") or (inner.get("usage") if isinstance(inner, dict) else None) or {}
    usage = usage if isinstance(usage, dict) else {}
    read, wrote = _figure(usage, "input_tokens", "inputTokens"), _figure(usage, "output_tokens", "outputTokens")
    cached = sum(_figure(usage, k) or 0 for k in ("cache_read_input_tokens", "cache_creation_input_tokens"))
    total = None if read is None and wrote is None else (read or 0) + (wrote or 0) + cached
    return read, wrote, total, _tool_uses(data) if isinstance(record, dict) else 0, _answer(record)


TRANSCRIPT = "input_tokens long, output_tokens long, total_tokens long, tool_calls long, answer string"


def read_transcripts(transcripts: DataFrame) -> DataFrame:
    """``run, text`` (JSON of any nesting) to usage, tool calls and the answer.

    Figures that a transcript lacks are null, never zero; text that isn't JSON has none, no calls and an empty answer.
    """

    def read(batches):
        for b in batches:
            rows = [_transcript(t) for t in b.column("text").to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            types = [pa.int64()] * 4 + [pa.string()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("run"), *arrays], names=["run", *[c.split()[0] for c in TRANSCRIPT.split(", ")]])

    key = transcripts.schema["run"].dataType.simpleString()
    return transcripts.select("run", "text").mapInArrow(read, f"run {key}, {TRANSCRIPT}")

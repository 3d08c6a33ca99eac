"""Node and edge tables, their ids, and the graph that pairs them.

Spans are flat columns (``file, start_line, end_line``), so that range joins and pruning see them. Optional attributes
are null where absent: ``cnt`` (occurrences, two or more), ``type_only``, ``low`` (low confidence) and ``in_cycle``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODES = "id string, kind string, name string, qn string, file string, start_line int, end_line int, exported boolean, external boolean, signature string, doc string"
EDGES = "id string, kind string, src string, dst string, line int, cnt bigint, type_only boolean, low boolean, in_cycle boolean"
FILES = "path string, text string"
DIAGNOSTICS = "severity string, message string, file string"


@dataclass(frozen=True)
class CodeGraph:
    nodes: DataFrame
    edges: DataFrame

    def canonical(self) -> CodeGraph:
        """Both tables in id order; only for sinks."""
        return CodeGraph(self.nodes.orderBy("id"), self.edges.orderBy("id"))


def edge_id(kind: Column, src: Column, dst: Column) -> Column:
    return F.concat(kind, F.lit(":"), src, F.lit("->"), dst)


def node_id(kind: Column | str, path: Column, qn: Column | None = None) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(kind, F.lit(":"), path) if qn is None else F.concat(kind, F.lit(":"), path, F.lit("#"), qn)


def padded(df: DataFrame, schema: str) -> DataFrame:
    """``df`` with the columns of a schema, null where it has none."""
    cols = [c.strip().split(" ") for c in schema.split(",")]
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in cols])


def dedupe_ids(df: DataFrame, order: list[str], base: str = "id") -> DataFrame:
    """Ids that collide get ``~2``, ``~3`` in the given order; ids hold their path, so no task sees more than a file's."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(base).orderBy(*order))
    return df.withColumn("__n", n).withColumn(base, F.when(F.col("__n") > 1, F.concat(base, F.lit("~"), F.col("__n").cast("string"))).otherwise(F.col(base))).drop("__n")

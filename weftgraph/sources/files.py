"""Source files as ``files(path, text)``, and generated projects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import DEFAULT_INCLUDE, glob_column, is_test_file, looks_minified

# Folders and files that are never analysed.
DEFAULT_EXCLUDE = ["**/node_modules/**", "**/dist/**", "**/build/**", "**/out/**", "**/.git/**", "**/coverage/**", "**/.next/**", "**/.nuxt/**", "**/.svelte-kit/**", "**/.turbo/**", "**/.cache/**", "**/.vscode-test/**", "**/vendor/**", "**/fixtures/**", "**/testdata/**", "**/__pycache__/**", "**/*.min.js", "**/*.d.ts"]
MOST_BYTES = 512 << 10


def discover(spark: SparkSession, root: str, include=None, exclude=None, tests: bool = False, most_bytes: int | None = None) -> DataFrame:
    """All matching files below a root, on any file system Spark reads; paths are relative to the root."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split("://")[-1].lstrip("/")
    path = F.regexp_replace(F.substring_index("path", base + "/", -1), "\\\\", "/")
    f = raw.select(path.alias("path"), "content", "length").where(glob_column(F.col("path"), include or DEFAULT_INCLUDE) & ~glob_column(F.col("path"), exclude or DEFAULT_EXCLUDE))
    f = f if most_bytes is None else f.where(F.col("length") <= most_bytes)
    f = (f if tests else f.where(~is_test_file(F.col("path")))).select("path", F.expr("decode(content, 'UTF-8')").alias("text"))
    return f.where(~looks_minified(F.col("text")))


def synthetic(spark: SparkSession, n: int) -> DataFrame:
    """``n`` Python modules in a chain of calls that all import a log hub, a third of them an id hub too."""
    i = F.col("id").cast("string")
    body = F.concat(F.lit("from hubs import log\n"), F.when(F.col("id") % 3 == 0, "from hubs import ids\n").otherwise(""), F.when(F.col("id") > 0, F.concat(F.lit("from mods.m"), (F.col("id") - 1).cast("string"), F.lit(" import work\n"))).otherwise(""), F.lit("\ndef helper_"), i, F.lit("():\n    return 1\n\ndef work_"), i, F.lit("():\n    return helper_"), i, F.lit("()\n"))
    mods = spark.range(n).select(F.concat(F.lit("mods/m"), i, F.lit(".py")).alias("path"), body.alias("text"))
    return mods.unionByName(spark.createDataFrame([("hubs/__init__.py", ""), ("mods/__init__.py", "")], "path string, text string"))

"""Snapshot diff and merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame, key: str = "file_path", state: tuple[str, ...] = ("mtime_ms", "size_bytes")) -> DataFrame:
    """(key, change): added, changed or removed; unchanged rows aren't listed."""
    a, b = old.select(F.col(key), F.struct(*state).alias("a")), new.select(F.col(key), F.struct(*state).alias("b"))
    both = a.join(b, key, "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return both.select(key, change.alias("change")).where("change is not null")


def merge(prior: DataFrame, fresh: DataFrame, changes: DataFrame, key: str = "file_path") -> DataFrame:
    """Prior rows of untouched files and the fresh rows of added and changed ones."""
    kept = prior.join(changes.select(key), key, "left_anti")
    return kept.unionByName(fresh.join(changes.where("change <> 'removed'").select(key), key, "left_semi"))


def live_edges(edges: DataFrame, files: DataFrame) -> DataFrame:
    paths = files.select("file_path")
    return edges.join(paths, edges["src"] == paths["file_path"], "left_semi").join(paths, edges["dst"] == paths["file_path"], "left_semi")


def chunk_counts(files: DataFrame, chunks: DataFrame, key: str = "file_path") -> DataFrame:
    n = chunks.groupBy(key).agg(F.count("*").alias("chunk_count"))
    return files.join(n, key, "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)).cast("long"))

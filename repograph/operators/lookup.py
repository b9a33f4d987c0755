"""References, definitions, suggestions, candidates, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repograph.functions import text as T


def references(ref_lines: DataFrame, name: str | None = None) -> DataFrame:
    """(name, file_path, count, lines): uses by file, lines sorted."""
    rows = ref_lines if name is None else ref_lines.where(F.col("name") == name)
    return rows.groupBy("name", "file_path").agg(F.count("*").alias("count"), F.sort_array(F.collect_list("line")).alias("lines"))


def reference_totals(ref_lines: DataFrame) -> DataFrame:
    return ref_lines.groupBy("name").agg(F.count("*").alias("total"), F.count_distinct("file_path").alias("files"))


def ordered(refs: DataFrame) -> DataFrame:
    """Most uses first, then by path in the root locale's order."""
    return refs.orderBy(F.desc("count"), F.collate("file_path", "UNICODE"))


def definition(symbols: DataFrame, name: str) -> DataFrame:
    return symbols.where(F.col("name") == name).select("name", "kind", "file_path", "line", "end_line", "exported")


def suggest(symbols: DataFrame, query: str, limit: int = 5, chars: int | None = None) -> DataFrame:
    """The first symbols whose name contains the query (or its first ``chars`` characters)."""
    q = query.lower()[:chars]
    told = F.concat("name", F.lit(" ("), "kind", F.lit(" in "), "file_path", F.lit(")"))
    return symbols.where(F.lower("name").contains(q)).orderBy("sym_ord").limit(limit).select("name", told.alias("suggestion"))


def candidates(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(name, detail, kind): the first exported symbol of each name, and the files of (rel_path, language, chunk_count)."""
    first = F.min_by(F.struct("kind", "file_path", "line"), "sym_ord")
    own = symbols.where("exported").groupBy("name").agg(first.alias("s")).select("name", F.concat("s.kind", F.lit(" · "), "s.file_path", F.lit(":"), "s.line").alias("detail"), F.lit("symbol").alias("kind"))
    names = files.where(~F.col("rel_path").startswith("..")).select(F.col("rel_path").alias("name"), F.concat("language", F.lit(" · "), "chunk_count", F.lit(" chunks")).alias("detail"), F.lit("file").alias("kind"))
    return own.unionByName(names)


def rank(found: DataFrame, query: str, limit: int = 200) -> DataFrame:
    """Symbols before files for an empty query; else by score, then name."""
    query, by_name = query.strip(), F.collate("name", "UNICODE")
    if not query:
        return found.orderBy(F.desc(F.col("kind") == "symbol"), by_name, "detail").limit(limit)
    return found.withColumn("rank", T.fuzzy_score(F.col("name"), F.col("detail"), query)).where("rank > 0").orderBy(F.desc("rank"), by_name, F.desc(F.col("kind") == "symbol"), "name", "detail").limit(limit)


def stats(**tables: DataFrame) -> DataFrame:
    """One row with the number of rows of each table."""
    ones = [t.agg(F.count("*").alias(k)) for k, t in tables.items()]
    return reduce(lambda a, b: a.join(F.broadcast(b)), ones)

"""The import graph: resolution, edges, bounded dependents, impact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repograph.functions.lineage import cut


def resolve(specs: DataFrame, files: DataFrame) -> DataFrame:
    """Of (src, spec, candidates) and (path): (src, spec, dst, rank), the first candidate that exists."""
    tried = specs.select("src", "spec", F.posexplode("candidates").alias("rank", "dst"))
    found = tried.join(files.select(F.col("path").alias("dst")).distinct(), "dst")
    return found.groupBy("src", "spec").agg(F.min(F.struct("rank", "dst")).alias("b")).select("src", "spec", "b.dst", "b.rank")


def edges(links: DataFrame) -> DataFrame:
    return links.select("src", "dst").where("src <> dst").distinct()


def file_nodes(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, imports, imported_by), both sorted."""
    out = edges.groupBy(F.col("src").alias("path")).agg(F.sort_array(F.collect_set("dst")).alias("imports"))
    into = edges.groupBy(F.col("dst").alias("path")).agg(F.sort_array(F.collect_set("src")).alias("imported_by"))
    none = F.array().cast(dict(out.dtypes)["imports"])
    return files.select("path").join(out, "path", "left").join(into, "path", "left").select("path", F.coalesce("imports", none).alias("imports"), F.coalesce("imported_by", none).alias("imported_by"))


def dependents(edges: DataFrame, target, max_depth: int = 5, frontier_rows: int = 100_000) -> DataFrame:
    """(node, depth): what reaches the target, by the fewest steps; the target itself isn't listed, cycles end.

    A level of at most ``frontier_rows`` nodes is broadcast, so the edges stay where they are; a larger one is joined by shuffle.
    """
    frontier = edges.where(F.col("dst") == F.lit(target)).where("src <> dst").select(F.col("src").alias("node")).distinct()
    seen = cut(frontier.withColumn("depth", F.lit(1)))
    level = seen
    for depth in range(2, max_depth + 1):
        size = level.count()
        if not size:
            break
        asked = level.select(F.col("node").alias("dst"))
        nxt = edges.join(F.broadcast(asked) if size <= frontier_rows else asked, "dst").select(F.col("src").alias("node")).where(F.col("node") != F.lit(target)).distinct()
        level = cut(nxt.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(level)
    return seen


def impact_summary(found: DataFrame) -> DataFrame:
    """One row: n_direct, n_transitive, total, max_depth."""
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return found.agg(n(F.col("depth") == 1).alias("n_direct"), n(F.col("depth") > 1).alias("n_transitive"), F.count("*").alias("total"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"))


def breakages(symbols: DataFrame, edges: DataFrame, target) -> DataFrame:
    """The target's exported symbols by its importers: (symbol, kind, file_path, line, reason). Both are joined on the target, which bounds them to its own rows."""
    own = symbols.where((F.col("file_path") == F.lit(target)) & F.col("exported")).select(F.col("name").alias("symbol"), "kind", F.col("file_path").alias("dst"))
    users = edges.where((F.col("dst") == F.lit(target)) & (F.col("src") != F.col("dst"))).select(F.col("src").alias("file_path"), "dst").distinct()
    reason = F.concat(F.lit("imports "), "symbol", F.lit(" (exported "), "kind", F.lit(")"))
    return own.join(users, "dst").select("symbol", "kind", "file_path", F.lit(0).alias("line"), reason.alias("reason"))


def symbol_impact(symbols: DataFrame, ref_lines: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """(symbol, kind, file_path, relation, line, uses, reason): definitions; then the uses outside of the defining files, or else their importers."""
    own = symbols.where(F.col("name") == name)
    places = own.select("file_path").distinct()
    # One row: the first definition's kind, and whether there is a use outside.
    use = ref_lines.where(F.col("name") == name).join(places, "file_path", "left_anti").groupBy("file_path").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    facts = own.agg(F.min_by("kind", F.struct("file_path", "line")).alias("kind"))
    here = own.select(F.col("name").alias("symbol"), "kind", "file_path", F.lit("definition").alias("relation"), "line", F.lit(0).cast("long").alias("uses"),
        F.concat(F.lit("defined here ("), "kind", F.when(F.col("exported"), ", exported").otherwise(""), F.lit(")")).alias("reason"))
    head = F.array_join(F.slice("lines", 1, 4).cast("array<string>"), ", ")
    told = F.when(F.size("lines") == 1, F.concat(F.lit("line "), head)).otherwise(F.concat(F.lit("lines "), head, F.when(F.size("lines") > 4, ", …").otherwise("")))
    uses = use.join(F.broadcast(facts), F.lit(True)).select(F.lit(name).alias("symbol"), "kind", "file_path", F.lit("usage").alias("relation"), F.get("lines", 0).alias("line"), F.size("lines").cast("long").alias("uses"),
        F.concat(F.lit(f"uses {name} "), F.size("lines"), F.lit("× ("), told, F.lit(") (AST reference)")).alias("reason"))
    # The fallback is decided in the plan: it keeps no row as soon as there is any use.
    any_use = use.agg((F.count("*") > 0).alias("used"))
    importers = edges.join(places.select(F.col("file_path").alias("dst")), "dst").where("src <> dst").join(places.select(F.col("file_path").alias("src")), "src", "left_anti")
    fallback = importers.join(F.broadcast(any_use), ~F.col("used")).groupBy(F.col("src").alias("file_path")).agg(F.min("dst").alias("dst"))
    fall = fallback.join(F.broadcast(facts), F.lit(True)).select(F.lit(name).alias("symbol"), "kind", "file_path", F.lit("importer").alias("relation"), F.lit(0).alias("line"), F.lit(0).cast("long").alias("uses"),
        F.concat(F.lit("file imports from "), F.element_at(F.split(F.col("dst").cast("string"), "/"), -1), F.lit(f"; renaming {name} breaks this file")).alias("reason"))
    line = dict(here.dtypes)["line"]
    return here.unionByName(uses.withColumn("line", F.col("line").cast(line))).unionByName(fall.withColumn("line", F.col("line").cast(line)))


def victim_lines(victims: DataFrame, found: DataFrame) -> DataFrame:
    """(file_path, line): each file with the first breakage that has a line, or null."""
    first = found.where("line > 0").groupBy("file_path").agg(F.min("line").alias("line"))
    return victims.select("file_path").join(first, "file_path", "left")


def first_per(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, pre-aggregated, so that a frequent key costs no more than others."""
    others = [c for c in rows.columns if c not in keys]
    best = F.min_by(F.struct(*others), F.struct(*order)) if len(order) > 1 else F.min_by(F.struct(*others), order[0])
    return rows.groupBy(*keys).agg(best.alias("__r")).select(*keys, "__r.*").select(*rows.columns)

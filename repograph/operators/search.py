"""Blocks, postings, lexical, semantic and hybrid search."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from repograph.functions import text as T


def query_tokens(query: str) -> list[str]:
    """As :func:`repograph.functions.text.tokenize`, with duplicates, on the driver."""
    return [t for t in re.split(r"[^a-z0-9_$]+", query.lower()) if len(t) > 1 and t not in T.STOP_WORDS]


def blocks(files: DataFrame, key: str, content: str, lines: int = 60) -> DataFrame:
    """(key, start_line, end_line, content): windows of ``lines`` lines, blank ones dropped; a final newline makes one more line."""
    rows = F.split(content, "\n")
    cut = files.select(key, rows.alias("l")).select(key, "l", F.explode(F.sequence(F.lit(0), F.size("l") - 1, F.lit(lines))).alias("s"))
    out = cut.select(key, (F.col("s") + 1).alias("start_line"), F.least(F.col("s") + lines, F.size("l")).alias("end_line"), F.array_join(F.slice("l", F.col("s") + 1, lines), "\n").alias("content"))
    return out.where(F.col("content").rlike(r"\S"))


def tokens_of(content: str, symbol: str | None = None) -> Column:
    """A chunk's tokens; a symbol's words count too, unfiltered."""
    tokens = T.tokenize(F.coalesce(F.col(content), F.lit("")))
    return F.concat(tokens, F.coalesce(T.split_identifier(F.col(symbol)), F.array().cast("array<string>"))) if symbol else tokens


def postings(chunks: DataFrame, key: str, content: str, symbol: str | None = None) -> DataFrame:
    """(key, token, n, total): term counts of each chunk.

    A chunk lies in one row, so its tokens are counted there, as runs of equal ones in sorted order: no shuffle.
    """
    own = chunks.select(key, tokens_of(content, symbol).alias("t"))
    runs = F.regexp_extract_all(F.array_join(F.sort_array("t"), " "), F.lit(r"(?<!\S)(\S+)(?: \1(?!\S))*"), F.lit(0))
    each = own.select(key, F.greatest(F.size("t"), F.lit(1)).cast("long").alias("total"), F.explode(runs).alias("run"))
    token = F.substring_index("run", " ", 1)
    return each.select(key, token.alias("token"), F.floor((F.length("run") + 1) / (F.length(token) + 1)).cast("long").alias("n"), "total")


def search_postings(stored: DataFrame, query: str, key: str) -> DataFrame:
    """(key, score) of the chunks that hold a token of the query. Stored by token, only the asked tokens' rows are read."""
    asked = Counter(query_tokens(query))
    worth = F.coalesce(*(F.when(F.col("token") == t, F.lit(n)) for t, n in asked.items()), F.lit(0)) if asked else F.lit(0)
    hits = stored.where(F.col("token").isin(list(asked))).groupBy(key).agg(F.sum(worth * F.col("n")).alias("hits"), F.first("total").alias("total"))
    return hits.select(key, F.round(F.col("hits").cast("double") / F.col("total") / F.lit(math.sqrt(sum(asked.values())) or 1.0), 6).alias("score"))


def lexical_scores(chunks: DataFrame, query: str, content: str, symbol: str | None = None) -> DataFrame:
    """``chunks`` with score: the query tokens' summed term frequency over the root of their number. No shuffle: a chunk is scored by itself."""
    asked = Counter(query_tokens(query))
    own = chunks.withColumn("__t", tokens_of(content, symbol))
    hits = sum((T.occurrences(F.col("__t"), t) * n for t, n in asked.items()), F.lit(0))
    score = hits.cast("double") / F.greatest(F.size("__t"), F.lit(1)) / F.lit(math.sqrt(sum(asked.values())) or 1.0)
    return own.withColumn("score", F.round(score, 6)).drop("__t")


def symbol_match(symbol: Column, query: str, exact: bool = True) -> Column:
    asked = query_tokens(query)
    found = F.lit(False)
    for t in dict.fromkeys(asked):
        found = found | F.lower(symbol).contains(t)
    if exact and asked:
        found = found | (symbol == query)
    return F.coalesce(found, F.lit(False))


def ranked(scored: DataFrame, query: str, key: str, symbol: str | None = None, limit: int = 20) -> DataFrame:
    """The top rows by score, ties in the order of ``key``; a matching symbol adds 2."""
    match = symbol_match(F.col(symbol), query) if symbol else F.lit(False)
    own = scored.withColumn("matched_by", F.when(match, "symbol").otherwise("lexical")).withColumn("score", F.round(F.col("score") + F.when(match, 2.0).otherwise(0.0), 6))
    # Cut first: a filter below the sort would have every score computed twice.
    return own.orderBy(F.desc("score"), key).limit(limit).where("score > 0")


def lexical_search(chunks: DataFrame, query: str, key: str, content: str, symbol: str | None = None, limit: int = 20) -> DataFrame:
    """The top chunks by score, without an index."""
    return ranked(lexical_scores(chunks, query, content, symbol), query, key, symbol, limit)


def indexed_search(chunks: DataFrame, stored: DataFrame, query: str, key: str, symbol: str | None = None, limit: int = 20) -> DataFrame:
    """As :func:`lexical_search` by stored postings. Without a symbol column only chunks with a token of the query are looked at."""
    found = search_postings(stored, query, key)
    if symbol is None:
        best = ranked(found, query, key, None, limit)
        return chunks.join(F.broadcast(best), key).orderBy(F.desc("score"), key)
    names = chunks.where(symbol_match(F.col(symbol), query)).select(key, symbol)
    both = found.join(names, key, "full_outer").withColumn("score", F.coalesce("score", F.lit(0.0)))
    best = ranked(both, query, key, symbol, limit).drop(symbol)
    return chunks.join(F.broadcast(best), key).orderBy(F.desc("score"), key)


def cosine_top_k(vectors: DataFrame, query: list[float], key: str, vector: str, limit: int = 20) -> DataFrame:
    asked = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select(key, F.round(T.cosine(F.col(vector), asked), 6).alias("score")).orderBy(F.desc("score"), key).limit(limit)


def hybrid_search(chunks: DataFrame, query: str, vector: list[float], key: str, content: str, embedding: str, symbol: str | None = None, limit: int = 20, least: float = 0.05) -> DataFrame:
    """0.7 cosine and 0.3 lexical, 2 more for a matching symbol; scores of at most ``least`` drop out."""
    asked = F.array(*(F.lit(float(x)) for x in vector))
    own = lexical_scores(chunks, query, content, symbol).withColumnRenamed("score", "lex")
    return blended(own, query, asked, key, embedding, symbol, limit, least)


def blended(scored: DataFrame, query: str, asked: Column, key: str, embedding: str, symbol: str | None, limit: int, least: float) -> DataFrame:
    """Of rows with lex; a row without a vector has cosine 0."""
    own = scored.withColumn("cos", F.round(F.coalesce(T.cosine(F.col(embedding), asked), F.lit(0.0)), 6))
    match = symbol_match(F.col(symbol), query, exact=False) if symbol else F.lit(False)
    kind = F.when(match, "symbol").when(F.col("cos") >= F.col("lex"), "semantic").otherwise("lexical")
    score = F.round(0.7 * F.col("cos") + 0.3 * F.col("lex") + F.when(match, 2.0).otherwise(0.0), 6)
    return own.withColumn("matched_by", kind).withColumn("score", score).orderBy(F.desc("score"), key).limit(limit).where(F.col("score") > least)


def indexed_hybrid_search(chunks: DataFrame, stored: DataFrame, query: str, vector: list[float], key: str, embedding: str, symbol: str | None = None, limit: int = 20, least: float = 0.05) -> DataFrame:
    """As :func:`hybrid_search` by stored postings; every vector is compared."""
    asked = F.array(*(F.lit(float(x)) for x in vector))
    lex = search_postings(stored, query, key).withColumnRenamed("score", "lex")
    own = chunks.select(key, embedding, *([symbol] if symbol else [])).join(lex, key, "left").withColumn("lex", F.coalesce("lex", F.lit(0.0)))
    best = blended(own, query, asked, key, embedding, symbol, limit, least).select(key, "score", "matched_by")
    return chunks.join(F.broadcast(best), key).orderBy(F.desc("score"), key)


def embed(chunks: DataFrame, vectors_of, content: str, symbol: str, batch: int = 8) -> DataFrame:
    """``chunks`` with embedding: ``vectors_of`` gets lists of at most ``batch`` texts, a symbol's name and its chunk each, on the executors. A vector of zeros only counts as none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            texts = [f"{name or ''}\n{text}" for name, text in zip(rows[symbol], rows[content])]
            found = [v for k in range(0, len(texts), batch) for v in vectors_of(texts[k : k + batch])]
            yield rows.assign(embedding=[list(map(float, v)) if v is not None and any(v) else None for v in found])

    return chunks.mapInPandas(run, StructType([*chunks.schema.fields, StructField("embedding", ArrayType(FloatType()))]))

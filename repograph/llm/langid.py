"""Language identification, words first.

A word that the model knows adds its log frequency in each language. An unseen
word backs off to character n-grams, from ``ORDERS[0]`` characters down: the first length
of which the model knows any n-gram decides. A text's languages are compared by
the mean of its words.

The model is fitted on a bounded sample of the labelled rows (``max_rows``) and
keeps at most ``max_words`` words and ``max_grams`` n-grams of each length, the most frequent ones, so it can be sent
to all executors whatever the size of the corpus is: with four languages at most
180,000 rows of 24 bytes. A word beyond them backs off to n-grams, so it is still scored. All rows are then scored,
as whole texts.

Defined results: ``und`` with score 0 for a null text or one without a letter;
with no usable label at all, every row is ``und``; among equal scores the
alphabetically first language wins; rows with equal ids are scored each by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from repograph.llm import kernel as K
from repograph.llm.kernel import U

ORDERS = (5, 4, 3, 2, 1)
#: The mean of a text's words counts as that of so many independent words at most.
EVIDENCE = 12


@dataclass
class Model:
    langs: list[str]
    word: np.ndarray  # sorted hashes
    word_score: np.ndarray  # words x languages; the mean over languages is 0
    gram: dict[int, tuple[np.ndarray, np.ndarray]]


def gram_keys(point: np.ndarray, n: int) -> np.ndarray:
    """A key for the n characters from each place on."""
    h = np.zeros(max(0, len(point) - n + 1), U)
    for k in range(n):
        h = K.mix(h * U(0x9E3779B97F4A7C15) + point[k : k + len(h)].astype(U) + U(1))
    return h


def spread(w: K.Words, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The picked words' characters with a blank before and after each, and each word's bounds therein."""
    size = w.last[pick] - w.first[pick]
    at = np.concatenate([[0], np.cumsum(size + 2)])
    out = np.full(at[-1], 32, np.uint32)
    k = K.within(size)
    out[np.repeat(at[:-1] + 1, size) + k] = w.raw[np.repeat(w.first[pick], size) + k]
    return out, at


def _counts(labelled: DataFrame) -> DataFrame:
    """(lang, size, key, n): size 0 for words; partial sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in K.slices(batches, "text"):
            p = K.points(t)
            lang, code = np.unique(np.asarray(t.keys.column(0).to_pylist(), object).astype(str), return_inverse=True)
            row = K.rows_of(p.words.at)
            for k, name in enumerate(lang):
                own = np.flatnonzero(code[row] == k)
                if not len(own):
                    continue
                found = [(0, p.words.hash[own])]
                text, at = spread(p.words, own)
                for n in ORDERS:
                    start = np.arange(max(0, len(text) - n + 1))
                    inside = start + n <= at[1:][np.searchsorted(at, start, "right") - 1]
                    found.append((n, gram_keys(text, n)[inside]))
                for size, keys in found:
                    key, n = np.unique(keys, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([str(name)] * len(key)), pa.array(np.full(len(key), size, np.int32)), pa.array(K.signed(key)), pa.array(n)], names=["lang", "size", "key", "n"])

    return labelled.select("lang", "text").mapInArrow(run, "lang string, size int, key long, n long").groupBy("lang", "size", "key").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, max_rows: int = 3000, max_words: int = 30_000, max_grams: int = 30_000) -> Model:
    """Of rows (doc_id, text, lang); rows without text or lang take no part."""
    with K.scratch():
        rows = K.sampled(labelled.where("text is not null and lang is not null"), ["doc_id", "lang", "text"], max_rows)
        by_key = K.stored(_counts(rows).groupBy("size", "key").agg(F.collect_list(F.struct("lang", "n")).alias("by"), F.sum("n").alias("total")).where("total > 1 or size < 2"))
        got = []
        for size in (0, *ORDERS):
            kept = by_key.where((F.col("size") == size) & (F.col("total") > (1 if size > 1 else 0)))
            got.append((size, kept.orderBy(F.desc("total"), "key").limit(max_grams if size else max_words)))
        union = got[0][1]
        for _, x in got[1:]:
            union = union.unionAll(x)
        found = union.collect()
    langs = sorted({r["lang"] for x in found for r in x["by"]})
    tables = {}
    for size in (0, *ORDERS):
        own = sorted(((x["key"] & (2**64 - 1), x["by"]) for x in found if x["size"] == size), key=lambda y: y[0])
        n = np.zeros((len(own), len(langs)))
        for i, (_, by) in enumerate(own):
            for r in by:
                n[i, langs.index(r["lang"])] += r["n"]
        score = np.log((n + 0.5) / (n.sum(0) + 0.5 * len(own) + 1))
        tables[size] = np.array([k for k, _ in own], U), (score - (score.mean(1, keepdims=True) if langs else 0)).astype(np.float32)
    return Model(langs, *tables.pop(0), tables)


def _find(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(known):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return at, known[at] == keys


def word_scores(m: Model, w: K.Words) -> np.ndarray:
    at, seen = _find(m.word, w.hash)
    out = np.zeros((len(at), len(m.langs)), np.float32)
    out[seen] = m.word_score[at[seen]]
    unseen = np.flatnonzero(~seen)
    if len(unseen):
        _, pick, back = np.unique(w.hash[unseen], return_index=True, return_inverse=True)
        text, at = spread(w, unseen[pick])
        score, open_ = np.zeros((len(pick), len(m.langs)), np.float32), np.ones(len(pick), bool)
        word = np.searchsorted(at, np.arange(len(text)), "right") - 1
        for n in ORDERS:
            start = np.flatnonzero(open_[word[: max(0, len(text) - n + 1)]])
            start = start[start + n <= at[word[start] + 1]]
            hit, known = _find(m.gram[n][0], gram_keys(text, n)[start])
            start, hit = start[known], hit[known]
            if not len(start):
                continue
            own = word[start]
            new, begin, count = np.unique(own, return_index=True, return_counts=True)
            score[new] = np.add.reduceat(m.gram[n][1][hit], begin) / count[:, None]
            open_[new] = False
        out[unseen] = score[back]
    return out


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Of (doc_id, text): doc_id, lang_pred, score."""
    return _identified(docs.select("doc_id", "text"), model, False)


def recognised(docs: DataFrame, model: Model, least_score: float) -> DataFrame:
    """The rows of ``docs``, whatever their columns' names are, whose language has at least this score; a null lang is filled in."""
    others = [c for c in docs.columns if c != "text"]
    row = F.struct(F.lit(True).alias("_"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)))
    found = _identified(docs.select(row.alias("doc_id"), "text"), model, True).where((F.col("lang_pred") != "und") & (F.col("score") >= least_score))
    place = {c: F.col(f"doc_id.c{k}") for k, c in enumerate(others)} | {"text": F.col("text")}
    if "lang" in place:
        place["lang"] = F.coalesce(place["lang"], F.col("lang_pred"))
    return found.select(*(place[c].alias(c) for c in docs.columns))


def _identified(docs: DataFrame, model: Model, keep: bool) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = sent.value
        names = np.array([*m.langs, "und"], object)
        for t in K.slices(batches, "text"):
            w = K.points(t).words
            n = np.diff(w.at)
            total = np.zeros((len(t) + 0, len(m.langs)))
            if len(w.first) and m.langs:
                sums = np.concatenate([np.zeros((1, len(m.langs))), np.cumsum(word_scores(m, w), 0, dtype=np.float64)])
                total = (sums[w.at[1:]] - sums[w.at[:-1]]) / np.maximum(n, 1)[:, None] * np.minimum(n, EVIDENCE)[:, None]
            if m.langs:
                e = np.exp(total - total.max(1, keepdims=True))
                best, p = total.argmax(1), (e / e.sum(1, keepdims=True)).max(1)
            else:
                best, p = np.zeros(len(t), int), np.zeros(len(t))
            none = (n == 0) | (not m.langs)
            told = pa.array(names[np.where(none, len(m.langs), best)].tolist(), pa.string())
            yield pa.RecordBatch.from_arrays([t.keys.column(0), *([t.column] if keep else []), told, pa.array(np.where(none, 0.0, p))], names=["doc_id", *(["text"] if keep else []), "lang_pred", "score"])

    schema = StructType([docs.schema["doc_id"], *([docs.schema["text"]] if keep else []), StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.mapInArrow(run, schema)

"""Exact top-k inner-product search with a pivot-distance index.

Vectors are quantised to integers. With one more component,
sqrt(M - |v|^2) for M the largest squared norm, the order by inner product is the order by Euclidean
distance, which the triangle inequality bounds. :func:`build` keys each vector by its
nearest pivot and the distance to it and stores all vectors sorted so. A search reads the stored rows as
annuli: runs of one pivot's vectors between two distances. For the queries of one pivot, annuli are taken
in the order of the best score that |d(query, pivot) - d(annulus, pivot)| leaves room for, and
the first one that can't better any query's k-th score so far ends the expansion.

Pivots, and a first bound for each query, come from a bounded sample
(``max_sample`` vectors); every vector is indexed. Queries go to the executors
in groups of at most ``max_queries``, one after another: each group is one pass, whose results are stored before the next one
is fetched, so the driver holds one group at a time. The number of pairs looked at is returned with the results.

Defined results: vectors that are null, empty or hold null or non-finite
components take no part, neither do rows with a null id; a query with no other vector has no rows; ties go to the
smaller id; rows with equal ids are one another's own and never matched, as queries or vectors the pair of ids has the best score of its rows;
vectors and queries of unequal length count as filled up with zeros; inner products that could reach 2^53 raise ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from repograph.llm import kernel as K

PIVOTS, ANNULUS, BATCH = 32, 512, 1 << 15


def quantise(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """Of (vec_id, embedding): vec_id and q, the integer components as doubles; only usable vectors."""
    x = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("x")).where("vec_id is not null and size(x) > 0")
    fine = ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return x.where(F.coalesce(fine, F.lit(False))).select("vec_id", F.transform("x", lambda v: F.floor(v * scale).cast("double")).alias("q"))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    n = np.asarray(lists.value_lengths(), np.int64)
    out = np.zeros((len(n), width))
    out[np.repeat(np.arange(len(n)), n), K.within(n)] = np.asarray(lists.flatten())
    return out


def kmeans(x: np.ndarray, k: int) -> np.ndarray:
    at = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    for _ in range(6):
        own = distances(x, at).argmin(1)
        at = np.array([x[own == j].mean(0) if (own == j).any() else at[j] for j in range(len(at))])
    return at


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T))


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(0, most - (x * x).sum(1)))])


def best(row: np.ndarray, score: np.ndarray, vec: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's k first by (score down, id up), each id once."""
    order = np.lexsort((-score, vec, row))
    order = order[np.r_[True, (row[order][1:] != row[order][:-1]) | (vec[order][1:] != vec[order][:-1])]] if len(order) else order
    order = order[np.lexsort((vec[order], -score[order], row[order]))]
    own, begin = np.unique(row[order], return_index=True)
    rank = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
    return order[rank < k]


@dataclass
class Index:
    """(cell, distance, vec_id, q) of every vector, stored in the order of cell and distance."""

    rows: DataFrame
    pivot: np.ndarray
    most: float
    width: int
    sample_id: np.ndarray
    sample: np.ndarray


def build(vectors: DataFrame, max_sample: int = 2000, width: int = 0) -> Index | None:
    """The index of (vec_id, q); None if there are no vectors. ``width``: the longest query, if that is more."""
    squared = F.aggregate("q", F.lit(0.0), lambda a, v: a + v * v)
    most, own_width = vectors.agg(F.max(squared), F.max(F.size("q"))).first()
    if most is None:
        return None
    width = max(width, own_width)
    held = K.sampled(vectors, ["vec_id"], max_sample).dropDuplicates(["vec_id"]).toArrow()
    sample = matrix(held.column("q").combine_chunks(), width)
    pivot = kmeans(lifted(sample, most), PIVOTS) if len(sample) else np.zeros((1, width + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, BATCH):
                batch = whole.slice(k, BATCH)
                d = distances(lifted(matrix(batch.column(1), width), most), pivot)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell]), batch.column(0), batch.column(1)], names=["cell", "distance", "vec_id", "q"])

    # The id in the order splits even equal vectors over partitions.
    keyed = vectors.select("vec_id", "q").mapInArrow(run, "cell int, distance double, vec_id long, q array<double>")
    rows = K.stored(keyed.repartitionByRange("cell", "distance", "vec_id").sortWithinPartitions("cell", "distance"))
    return Index(rows, pivot, float(most), width, np.asarray(held.column("vec_id")), sample)


class Searcher:
    """One group of queries against stored rows that come in batches."""

    def __init__(self, query_id: np.ndarray, query: np.ndarray, sample_id: np.ndarray, sample: np.ndarray, pivot: np.ndarray, most: float, k: int):
        self.id, self.query, self.pivot, self.most, self.k = query_id, query, pivot, most, k
        self.norm = (query * query).sum(1)
        # A query's further component is 0, so |q' - v'|^2 = |q|^2 + most - 2 <q, v>.
        self.to_pivot = distances(np.column_stack([query, np.zeros(len(query))]), pivot)
        self.near = self.to_pivot.argmin(1)
        self.floor = np.full(len(query), -np.inf)
        if len(sample) > k:
            score = query @ sample.T
            score[query_id[:, None] == sample_id] = -np.inf
            self.floor = np.partition(score, -k, 1)[:, -k]
        self.found = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.read = 0

    def add(self, cell: np.ndarray, d: np.ndarray, vec: np.ndarray, x: np.ndarray) -> None:
        """Rows in the order of (cell, d)."""
        cut = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        size = np.diff(np.append(cut, len(cell)))
        parts = -(-size // ANNULUS)
        first = np.repeat(cut, parts) + K.within(parts) * ANNULUS
        last = np.minimum(first + ANNULUS, np.repeat(cut + size, parts))
        inner, outer, own = d[first], d[last - 1], cell[first]
        for c in np.unique(self.near):
            group = np.flatnonzero(self.near == c)
            away = self.to_pivot[np.ix_(group, own)]
            least = np.maximum(0, np.maximum(inner - away, away - outer))
            ceiling = (self.norm[group, None] + self.most - least**2) / 2 + 1e-6 * (1 + self.most)
            # Room above the queries' floors: no annulus after the first one without any can have some, as floors only rise.
            room = (ceiling - self.floor[group, None]).max(0)
            for j in np.argsort(-room, kind="stable"):
                if room[j] < 0:
                    break
                ask = group[ceiling[:, j] >= self.floor[group]]
                if not len(ask):
                    continue
                self.read += len(ask) * (last[j] - first[j])
                score = self.query[ask] @ x[first[j] : last[j]].T
                row, col = np.nonzero(score >= self.floor[ask, None])
                value, other, row = score[row, col], vec[first[j] + col], ask[row]
                keep = other != self.id[row]
                self.found = tuple(np.concatenate([a, b[keep]]) for a, b in zip(self.found, (row, value, other)))
                if len(self.found[0]) > 50 * self.k * len(self.query):
                    self.settle()
        self.settle()

    def settle(self) -> None:
        row, score, vec = self.found
        keep = best(row, score, vec, self.k)
        self.found = row, score, vec = row[keep], score[keep], vec[keep]
        own, begin, n = np.unique(row, return_index=True, return_counts=True)
        full = n == self.k
        self.floor[own[full]] = np.maximum(self.floor[own[full]], score[(begin + n - 1)[full]])


def search(index: Index, queries: DataFrame, k: int = 20, max_queries: int = 20_000) -> DataFrame:
    """Of (vec_id, q): query_id, vec_id, score of each query's best in some part of the index, and rows with a null query_id that count pairs looked at (read)."""
    spark = queries.sparkSession
    n = queries.count()
    groups, out = max(1, -(-n // max_queries)), []
    for g in range(groups):
        asked = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(groups)) == g).toArrow()
        sent = spark.sparkContext.broadcast((np.asarray(asked.column("vec_id")), matrix(asked.column("q").combine_chunks(), index.width), index.sample_id, index.sample, index.pivot, index.most, k))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, width=index.width) -> Iterator[pa.RecordBatch]:
            s, waiting = None, []

            def flush() -> None:
                nonlocal waiting
                s.add(*(np.concatenate(part) for part in zip(*waiting)))
                waiting = []

            for whole in batches:
                s = s or Searcher(*sent.value)
                for k in range(0, whole.num_rows, BATCH):
                    batch = whole.slice(k, BATCH)
                    waiting.append((*(np.asarray(batch.column(c)) for c in range(3)), matrix(batch.column(3), width)))
                    if sum(len(w[0]) for w in waiting) >= BATCH:
                        flush()
            if waiting:
                flush()
            if s is not None:
                row, score, vec = s.found
                told = np.append(np.zeros(len(row), np.int64), s.read)
                yield pa.RecordBatch.from_arrays([pa.array([*s.id[row].tolist(), None], pa.int64()), pa.array([*vec.tolist(), None], pa.int64()), pa.array([*score.tolist(), None], pa.float64()), pa.array(told)], names=["query_id", "vec_id", "score", "read"])

        out.append(K.stored(index.rows.select("cell", "distance", "vec_id", "q").mapInArrow(run, "query_id long, vec_id long, score double, read long")))
        sent.destroy()
    union = out[0]
    for x in out[1:]:
        union = union.unionAll(x)
    return union


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, max_queries: int = 20_000, max_sample: int = 2000) -> DataFrame:
    """Of (vec_id, q) each, as :func:`quantise` gives them: query_id, rank, vec_id, score, and share_read, which is the same in all rows: of all pairs those that were looked at."""
    spark = vectors.sparkSession
    squared = F.aggregate("q", F.lit(0.0), lambda a, v: a + v * v)
    most, width, asked = queries.agg(F.max(squared), F.max(F.size("q")), F.count("*")).first()
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long, share_read double")
    with K.scratch() as paths:
        index = build(vectors, max_sample, width or 0)
        if index is None or most is None:
            return none
        if (index.most * most) ** 0.5 >= 2**53:
            raise ValueError("inner products beyond 2^53 aren't exact")
        found = search(index, queries, k, max_queries)
        pairs = index.rows.count() * asked
        share = float((found.agg(F.sum("read")).first()[0] or 0) / pairs)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        each = found.where("query_id is not null").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        ranked = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return K.kept(paths, ranked.select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"), F.lit(share).alias("share_read")))

"""Benchmark decontamination by Wu-Manber search over words.

The symbols of the search are word hashes. Windows of one length are searched
together: a shift table over blocks of two words tells how far a cursor may
jump; at shift 0 the window's last block selects a bucket of candidate
windows, which are compared word by word and at last byte by byte. Rows are cut
into stretches that all move their cursors at once, which keeps numpy busy.

Defined results: a null or wordless text has n_words = n_hit = n_items = 0; null or wordless
items have no window; equal items are reported each; rows with equal ids
are judged each by itself; an item with a null id can hit words, but it is not
listed; an empty table gives no rows. Patterns go to the executors in blocks of about ``max_windows``
windows at most (of one item, if that alone has more); with more blocks, each is one pass over the texts, one after another, and
the passes are merged by row, so no pattern is ever dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repograph.llm import kernel as K
from repograph.llm.kernel import U

WINDOW = 10
TABLE_BITS = 20
STRETCH = 256


@dataclass
class Group:
    """All windows of one length."""

    length: int
    shift: np.ndarray
    bucket: np.ndarray  # last-block hashes, sorted
    hashes: np.ndarray  # windows x length, in the order of bucket
    text: list[bytes]
    item: np.ndarray


def _block(h: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    return K.mix(h[at - 1] * U(0xC2B2AE3D27D4EB4F) + h[at]) if size == 2 else h[at]


def item_windows(texts: list[str | None]) -> tuple[K.Words, list[tuple[int, int, int]]]:
    """The items' words, and (item, first word, words) of every window."""
    data = [(t or "").encode() for t in texts]
    raw = K.LOWER[np.frombuffer(b"".join(data), np.uint8)]
    w = K.words(raw, np.concatenate([[0], np.cumsum([len(x) for x in data], dtype=np.int64)]).astype(np.int64), K.ALNUM)
    out = []
    for i, (a, b) in enumerate(zip(w.at[:-1], w.at[1:])):
        if n := int(b - a):
            out += [(i, int(a) + k, min(n, WINDOW)) for k in range(max(1, n - WINDOW + 1))]
    return w, out


def compile_windows(w: K.Words, windows: list[tuple[int, int, int]]) -> list[Group]:
    groups = []
    for length in sorted({n for *_, n in windows}):
        own = [(i, a) for i, a, n in windows if n == length]
        item, first = np.array([i for i, _ in own]), np.array([a for _, a in own])
        size = min(2, length)
        shift = np.full(1 << TABLE_BITS, length - size + 1, np.uint8 if length < 255 else np.int64)
        for end in range(size - 1, length):
            np.minimum.at(shift, (_block(w.hash, first + end, size) >> U(64 - TABLE_BITS)).astype(np.int64), length - 1 - end)
        last = _block(w.hash, first + length - 1, size)
        order = np.argsort(last, kind="stable")
        text = [b" ".join(w.word(a + k) for k in range(length)) for a in first[order]]
        groups.append(Group(length, shift, last[order], w.hash[first[order][:, None] + np.arange(length)], text, item[order]))
    return groups


def _candidates(w: K.Words, g: Group) -> np.ndarray:
    """Ends of windows at which the shift table stops."""
    first, last = w.at[:-1] + g.length - 1, w.at[1:]
    parts = np.maximum(0, -(-(last - first) // STRETCH))
    row = np.repeat(np.arange(len(parts)), parts)
    cur = first[row] + K.within(parts) * STRETCH
    end = np.minimum(cur + STRETCH, last[row])
    found, size = [], min(2, g.length)
    while len(cur):
        step = g.shift[(_block(w.hash, cur, size) >> U(64 - TABLE_BITS)).astype(np.int64)].astype(np.int64)
        found.append(cur[step == 0])
        cur = cur + np.maximum(step, 1)
        keep = cur < end
        cur, end = cur[keep], end[keep]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def occurrences(w: K.Words, g: Group) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of each occurrence."""
    at = _candidates(w, g)
    block = _block(w.hash, at, min(2, g.length))
    lo, hi = np.searchsorted(g.bucket, block, "left"), np.searchsorted(g.bucket, block, "right")
    first, pattern = np.repeat(at, hi - lo) - g.length + 1, np.repeat(lo, hi - lo) + K.within(hi - lo)
    for k in range(g.length - 1, -1, -1):
        same = w.hash[first + k] == g.hashes[pattern, k]
        first, pattern = first[same], pattern[same]
    sure = np.fromiter((b" ".join(w.word(a + k) for k in range(g.length)) == g.text[p] for a, p in zip(first, pattern)), bool, len(first))
    return first[sure], pattern[sure]


def scan(t: K.Texts, groups: list[Group]) -> tuple[K.Words, list[tuple[int, int]], np.ndarray]:
    """The words, sorted (row, item) pairs, and whether each word is hit."""
    w = K.words(K.LOWER[t.raw], t.bounds, K.ALNUM)
    change, pairs = np.zeros(len(w.first) + 1, np.int64), set()
    for g in groups:
        first, pattern = occurrences(w, g)
        np.add.at(change, first, 1)
        np.add.at(change, first + g.length, -1)
        pairs |= set(zip((np.searchsorted(w.at, first, "right") - 1).tolist(), g.item[pattern].tolist()))
    return w, sorted(pairs), np.cumsum(change)[:-1] > 0


def find_contamination(docs: DataFrame, items: DataFrame, max_windows: int = 500_000, keep_text: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, items (array of item ids as strings).

    ``items`` has item_id and text. With ``keep_text`` the text stays as another column.
    """
    spark = docs.sparkSession
    told = items.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    # A window begins at each word, and a word and what parts it from the next have two bytes at least.
    most = told.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // 2
    passes = max(1, -(-2 * most // max_windows))
    rows = docs.select("doc_id", "text")

    def one_pass(rows: DataFrame, part: int, last: bool) -> DataFrame:
        # The driver holds one pass' items at a time; a pass has about half of max_windows windows, or one long item.
        held = told.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == part).collect()
        w, windows = item_windows([x["text"] for x in held])
        sent = spark.sparkContext.broadcast((compile_windows(w, windows), [x["item_id"] for x in held]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            groups, names = sent.value
            for t in K.slices(batches, "text"):
                w, pairs, hit = scan(t, groups)
                own: list[list[str]] = [[] for _ in range(len(t))]
                for row, item in pairs:
                    if names[item] is not None:
                        own[row].append(names[item])
                total = np.concatenate([[0], np.cumsum(hit)])
                spots = [] if last else [np.flatnonzero(hit[a:b]).tolist() for a, b in zip(w.at[:-1], w.at[1:])]
                columns = [t.keys.column(0), pa.array(np.diff(w.at)), pa.array(total[w.at[1:]] - total[w.at[:-1]]), pa.array([sorted(set(x)) for x in own], pa.list_(pa.string()))]
                names_out = ["doc_id", "n_words", "n_hit", "items"]
                if not last:
                    columns.append(pa.array(spots, pa.list_(pa.int64())))
                    names_out.append("spots")
                if keep_text and last:
                    columns.append(t.column)
                    names_out.append("text")
                yield pa.RecordBatch.from_arrays(columns, names=names_out)

        kind = dict(rows.dtypes)["doc_id"]
        extra = ("" if last else ", spots array<long>") + (", text string" if keep_text and last else "")
        return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_hit long, items array<string>{extra}")

    if passes == 1:
        return one_pass(rows, 0, True)
    # Numbered once they are stored, so that the passes can be merged row by row.
    whole = K.stored(rows.withColumn("row", F.monotonically_increasing_id()))
    numbered = whole.select(F.col("row").alias("doc_id"), "text")
    found = [K.stored(one_pass(numbered, p, False).where((F.col("n_hit") > 0) | F.lit(p == 0))) for p in range(passes)]
    union = found[0]
    for p in found[1:]:
        union = union.unionAll(p)
    merged = union.groupBy(F.col("doc_id").alias("row")).agg(
        F.max("n_words").alias("n_words"), F.size(F.array_distinct(F.flatten(F.collect_list("spots")))).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    out = whole.join(merged, "row").select("doc_id", "n_words", "n_hit", "items", "text")
    return out if keep_text else out.drop("text")


def clean_rows(docs: DataFrame, items: DataFrame, max_windows: int = 500_000) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and more) that no window of an item occurs in."""
    others = [c for c in docs.columns if c != "text"]
    row = F.struct(F.lit(True).alias("_"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)))
    found = find_contamination(docs.select(row.alias("doc_id"), "text"), items, max_windows, keep_text=True).where("n_hit = 0")
    place = {c: f"doc_id.c{k}" for k, c in enumerate(others)} | {"text": "text"}
    return found.select(*(F.col(place[c]).alias(c) for c in docs.columns))

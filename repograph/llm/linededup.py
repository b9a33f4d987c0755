"""Line dedup by winnowing over line hashes.

A run of consecutive non-blank lines of together ``min_words`` words or more
that also begins at an earlier place (by doc_id, then place in the
text) is deleted; the first occurrence stays. Lines are compared without blanks around them.

1. A window is the shortest run from a line on, forwards or backwards, that has ``min_words`` words.
   Windows are set by their content, so any repeated run consists of windows that repeat with it.
   Of each window the line with the least hash is selected: the fingerprints that a repeated run is sure to share.
2. Positions are joined: a fingerprint that occurs at one position only goes at once; of the others,
   each window is joined with the first position of its key (never with all of them).
3. These matches are extended both ways, line by line, by the lines themselves: the first position's
   lines come in cells of ``CELL`` lines, each taken once from its text. A match whose lines
   differ has met a collision of keys; then all starts anew with other hash bases.
4. What an extended match covers at the later position is deleted.

Texts are dealt out once, as a bucketed table, and later joins move only keys, cells and decisions.

Defined results: null and empty texts stay as they are; blank lines stay, but for those inside a window that goes;
rows without doc_id come before all others, in the order of their text's hash; rows equal in doc_id and text count as one;
a row may lose all its lines and then has an empty text (or its blank lines); an empty table gives no rows; other columns
stay, whatever their names are (an n_removed_lines column is replaced in :func:`dedup_lines`' extra column only if there is none).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from repograph.llm import kernel as K

MIN_WORDS = 50
CELL = 16
BLANKS = b" \t\x0b\x0c\r"
#: Seeds of the two hashes of each attempt, and their bits.
ATTEMPTS = ((201, 202, 64), (203, 204, 64), (205, 206, 64))


def trimmed_lines(t: K.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All non-blank lines without blanks around them: their bytes one after another, each with a line end; bounds therein; number in the row; words; row; the rows' bounds in lines."""
    w = K.words(t.raw, t.bounds, ~K.BLANK, hashed=False)
    lines = np.concatenate([[0], np.cumsum(t.raw == 10)])
    row = K.rows_of(w.at)
    number = lines[w.first] - lines[t.bounds[:-1]][row] if len(w.first) else np.zeros(0, np.int64)
    new = np.ones(len(w.first), bool)
    if len(new):
        new[1:] = (row[1:] != row[:-1]) | (number[1:] != number[:-1])
    begin = np.flatnonzero(new)
    first, last = w.first[begin], w.last[np.append(begin[1:], len(new)) - 1] if len(begin) else begin
    size = last - first
    at = np.concatenate([[0], np.cumsum(size + 1)])
    stream = np.full(at[-1], 10, np.uint8)
    k = K.within(size)
    stream[np.repeat(at[:-1], size) + k] = t.raw[np.repeat(first, size) + k]
    return stream, at, number[begin], np.diff(np.append(begin, len(new))), row[begin], np.searchsorted(first, t.bounds)


def windows(count: np.ndarray, row: np.ndarray, bounds: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last line of each window, each once."""
    if not len(count):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(count)])
    i = np.arange(len(count))
    last = np.searchsorted(total, total[:-1] + min_words) - 1  # total[last + 1] >= total[i] + min_words
    first = np.searchsorted(total, total[1:] - min_words, "right") - 1
    ok_f = (last < bounds[row + 1]) & (last < len(count))
    ok_b = (first >= bounds[row]) & (total[1:] >= min_words)
    both = np.unique(np.concatenate([np.column_stack([i, last])[ok_f], np.column_stack([first, i])[ok_b]]), axis=0)
    return both[:, 0], both[:, 1]


def _least(h: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The place of the least hash in each window (equal hashes: the leftmost), by doubling."""
    levels, out, size = [np.arange(len(h))], np.zeros(len(first), np.int64), last - first + 1
    while 2 << (len(levels) - 1) <= (size.max() if len(size) else 0):
        step = 1 << (len(levels) - 1)
        a = levels[-1][: len(levels[-1]) - step]
        b = levels[-1][step:]
        levels.append(np.where(h[b] < h[a], b, a))
    level = np.log2(np.maximum(size, 1)).astype(np.int64)
    for k, best in enumerate(levels):
        own = level == k
        a, b = best[first[own]], best[last[own] - (1 << k) + 1]
        out[own] = np.where(h[b] < h[a], b, a)
    return out


def fingerprints(rows: DataFrame, min_words: int = MIN_WORDS, attempt: tuple[int, int, int] = ATTEMPTS[0]) -> DataFrame:
    """Of (doc_id, mark, text): (key, doc_id, mark, place, runs), by row and fingerprint the windows (two hashes, first and last line) that it stands for."""
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two, drop = K.polynomial(attempt[0]), K.polynomial(attempt[1]), K.U(64 - attempt[2])
        for t in K.slices(batches, "text"):
            stream, at, number, count, row, bounds = trimmed_lines(t)
            first, last = windows(count, row, bounds, min_words)
            if not len(first):
                continue
            values, more = one.values(stream), two.values(stream)
            line = one.ranges(values, at[:-1], at[1:])
            place = _least(line, first, last)
            order = np.argsort(place, kind="stable")
            place, first, last = place[order], first[order], last[order]
            h, g = (x.ranges(v, at[first], at[last + 1]) >> drop for x, v in ((one, values), (two, more)))
            begin = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
            own = place[begin]
            runs = pa.StructArray.from_arrays([pa.array(K.signed(h)), pa.array(K.signed(g)), pa.array(number[first].astype(np.int32)), pa.array(number[last].astype(np.int32))], names=["h", "g", "i", "j"])
            cut = pa.array(np.append(begin, len(place)).astype(np.int32))
            take = pa.array(row[own])
            yield pa.RecordBatch.from_arrays([pa.array(K.signed(line[own])), t.keys.column(0).take(take), t.keys.column(1).take(take), pa.array(number[own].astype(np.int32)), pa.ListArray.from_arrays(cut, runs)], names=["key", "doc_id", "mark", "place", "runs"])

    return rows.select("doc_id", "mark", "text").mapInArrow(run, f"key long, doc_id {kind}, mark long, place int, runs array<struct<h:long,g:long,i:int,j:int>>")


def matches(rows: DataFrame, min_words: int, attempt: tuple[int, int, int]) -> DataFrame:
    """(doc_id, mark, i, j, o_doc, o_mark, o_i, o_j): each window that has an earlier position, with the first one."""
    marks = K.stored(fingerprints(rows, min_words, attempt))
    places = K.stored(marks.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    # Tables of their own: the joins then deal out both sides themselves, and a frequent key can be split over tasks.
    candidates = K.stored(marks.join(places, "key", "left_semi").select("doc_id", "mark", F.explode("runs").alias("r")).select("r.h", "r.g", "doc_id", "mark", "r.i", "r.j"))
    here = F.struct("doc_id", "mark", "i", "j")
    first = K.stored(candidates.groupBy("h", "g").agg(F.min(here).alias("o"), F.count("*").alias("n")).where("n > 1").select("h", "g", "o"))
    later = candidates.join(first, ["h", "g"]).where(~F.struct("doc_id", "mark", "i").eqNullSafe(F.struct("o.doc_id", "o.mark", "o.i")))
    return K.stored(later.select("doc_id", "mark", "i", "j", F.col("o.doc_id").alias("o_doc"), F.col("o.mark").alias("o_mark"), F.col("o.i").alias("o_i"), F.col("o.j").alias("o_j")))


def extended(text: bytes, others: dict, seeds: list[tuple], min_words: int) -> tuple[list[tuple[int, int]], bool]:
    """The runs of lines (first, last) that the seeds' matches cover, extended both ways; whether a seed's own lines differ.

    ``seeds``: (other row, i, j, o_i, o_j). ``others``: the other rows' lines by number, as far as they are known.
    """
    lines = [x.strip(BLANKS) for x in text.split(b"\n")]
    solid = [k for k, x in enumerate(lines) if x]
    rank = {k: r for r, k in enumerate(solid)}
    count = [len(lines[k].split()) for k in solid]
    out: list[tuple[int, int]] = []
    done: set[tuple] = set()
    for other, i, j, o_i, o_j in sorted(seeds, key=lambda s: (str(s[0]), s[3], s[1])):
        if (other, i, o_i) in done:
            continue
        theirs = others[other]

        def walk(step: int) -> int:
            """The last line of the match in this direction; -1 if not even the first lines agree."""
            r, o, last = rank[i], o_i, -1
            while 0 <= r < len(solid) and o in theirs and lines[solid[r]] == theirs[o]:
                last = r
                done.add((other, solid[r], o))
                r, o = r + step, o + step
                while theirs.get(o) == b"":
                    o += step
            return last

        a, b = walk(-1), walk(1)
        if a < 0 or b < rank[j]:
            return [], True
        before = np.concatenate([[0], np.cumsum(count[a : b + 1])])
        if before[-1] < min_words:
            return [], True
        for r in range(a, b + 1):
            k, n = r - a, count[r]
            # Blank lines between two lines go with a window that holds both.
            joins = r < b and (n < min_words <= before[-1] - before[k] or count[r + 1] < min_words <= before[k + 2])
            out.append((solid[r], solid[r + 1] - 1 if joins else solid[r]))
    return out, False


def _delete(t: DataFrame, found: DataFrame, min_words: int) -> DataFrame:
    """(spot, rows) for each row of the bucketed table ``t`` (spot, doc_id, mark, text) with a match in ``found``: its id and mark, the lines that go, and whether lines differ.

    Joins with the table are by spot alone, which is how it is dealt out; which row is meant is compared after.
    """
    spot = lambda doc, mark: F.xxhash64(doc, mark)
    kind = dict(t.dtypes)["doc_id"]
    cells = K.stored(found.select("doc_id", "mark", "o_doc", "o_mark", F.explode(F.sequence(F.floor(F.col("o_i") / CELL), F.floor(F.col("o_j") / CELL))).alias("cell")).distinct())
    # At most a cell for every CELL lines of a text.
    wanted = cells.select("o_doc", "o_mark", "cell").distinct().groupBy(spot("o_doc", "o_mark").alias("spot")).agg(F.collect_list(F.struct("o_doc", "o_mark", "cell")).alias("cells"))
    lent = t.join(wanted, "spot").select("text", "doc_id", "mark", "cells")

    def lend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(3)
        for batch in batches:
            for i in range(batch.num_rows):
                own = (batch.column(1)[i].as_py(), batch.column(2)[i].as_py())
                asked = sorted(c["cell"] for c in batch.column(3)[i].as_py() if (c["o_doc"], c["o_mark"]) == own)
                lines = batch.column(0)[i].as_py().encode().split(b"\n") if asked else []
                data = [z.compress(b"\n".join(x.strip(BLANKS) for x in lines[c * CELL : (c + 1) * CELL])) for c in asked]
                take = pa.array([i] * len(asked), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(1).take(take), batch.column(2).take(take), pa.array(asked, pa.int64()), pa.array(data, pa.binary())], names=["w_doc", "w_mark", "w_cell", "data"])

    # Rows equal in doc_id and text are one.
    lent = K.stored(lent.mapInArrow(lend, f"w_doc {kind}, w_mark long, w_cell long, data binary").dropDuplicates(["w_doc", "w_mark", "w_cell"]))
    both = cells.join(lent, cells["o_doc"].eqNullSafe(lent["w_doc"]) & (cells["o_mark"] == lent["w_mark"]) & (cells["cell"] == lent["w_cell"]))
    # By row: bounded by its own windows, each of which has one first position.
    lines = both.groupBy(spot("doc_id", "mark").alias("spot")).agg(F.collect_list(F.struct("doc_id", "mark", "o_doc", "o_mark", "cell", "data")).alias("cells"))
    seeds = found.groupBy(spot("doc_id", "mark").alias("spot")).agg(F.collect_list(F.struct("doc_id", "mark", "o_doc", "o_mark", "i", "j", "o_i", "o_j")).alias("seeds"))
    joined = t.join(lines, "spot").join(seeds, "spot").select("text", "spot", "doc_id", "mark", "cells", "seeds")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                own = (batch.column(2)[i].as_py(), batch.column(3)[i].as_py())
                seeds = [((s["o_doc"], s["o_mark"]), s["i"], s["j"], s["o_i"], s["o_j"]) for s in batch.column(5)[i].as_py() if (s["doc_id"], s["mark"]) == own]
                if not seeds:
                    continue
                theirs: dict[tuple, dict[int, bytes]] = {}
                for c in batch.column(4)[i].as_py():
                    if (c["doc_id"], c["mark"]) == own:
                        theirs.setdefault((c["o_doc"], c["o_mark"]), {}).update(enumerate(z.decompress(c["data"]).split(b"\n"), c["cell"] * CELL))
                gone, differs = extended(batch.column(0)[i].as_py().encode(), theirs, seeds, min_words)
                runs = pa.array([[{"i": a, "j": b} for a, b in gone]], pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32())])))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, 1) for k in (1, 2, 3)), runs, pa.array([differs])], names=["spot", "doc_id", "mark", "gone", "differs"])

    out = joined.mapInArrow(extend, f"spot long, doc_id {kind}, mark long, gone array<struct<i:int,j:int>>, differs boolean").dropDuplicates(["spot", "doc_id", "mark"])
    return out.groupBy("spot").agg(F.collect_list(F.struct("doc_id", "mark", "gone")).alias("rows"), F.max("differs").alias("differs"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with all its columns; text lacks its repeated lines, n_removed_lines (long) is added."""
    spark = docs.sparkSession
    others = [c for c in docs.columns if c not in ("text", "doc_id")]
    rest = F.struct(F.lit(True).alias("_"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)))
    mark = F.xxhash64("text")
    rows = docs.select(F.xxhash64("doc_id", mark).alias("spot"), "doc_id", mark.alias("mark"), "text", rest.alias("rest"))
    name = f"lines_{uuid.uuid4().hex}"
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(K.total_bytes(docs, "text") // (8 << 20), 100_000))
    rows.repartition(shards, "spot").write.bucketBy(shards, "spot").option("path", K.new_path(spark, name)).option("compression", "zstd").saveAsTable(name)
    t = spark.table(name)
    K.release(spark)
    for attempt in ATTEMPTS:
        with K.scratch() as paths:
            gone = _delete(t.select("spot", "doc_id", "mark", "text"), matches(t, min_words, attempt), min_words)
            gone = K.kept(paths, gone)
        if gone.where("differs").isEmpty():
            break
    else:
        raise RuntimeError("different lines had equal keys for each pair of hash bases")
    both = t.join(gone.select("spot", "rows"), "spot", "left").select("text", "rows", "doc_id", "rest", "mark")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                texts, removed, marks = [], [], batch.column(4).to_pylist()
                for text, rows, doc, mark in zip(batch.column(0), batch.column(1), batch.column(2), marks):
                    text, n = text.as_py(), 0
                    if text is not None and rows.is_valid:
                        own = next((r["gone"] for r in rows.as_py() if (r["doc_id"], r["mark"]) == (doc.as_py(), mark)), [])
                        lines = text.split("\n")
                        away = {k for r in own for k in range(r["i"], r["j"] + 1)}
                        n = sum(bool(lines[k].strip(BLANKS.decode())) for k in away)
                        text = "\n".join(x for k, x in enumerate(lines) if k not in away)
                    texts.append(text)
                    removed.append(n)
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(removed, pa.int64()), batch.column(2), batch.column(3)], names=["text", "n_removed", "doc_id", "rest"])

    schema = StructType([StructField("text", StringType()), StructField("n_removed", LongType()), docs.schema["doc_id"], t.schema["rest"]])
    out = both.mapInArrow(cut, schema)
    place = {c: f"rest.c{k}" for k, c in enumerate(others)} | {"text": "text", "doc_id": "doc_id"}
    extra = [] if "n_removed_lines" in docs.columns else [F.col("n_removed").alias("n_removed_lines")]
    return out.select(*(F.col(place[c]).alias(c) for c in docs.columns), *extra)

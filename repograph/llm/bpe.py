"""Byte-level BPE by overlapping chunks.

A text is cut into chunks that overlap, each a row of its own, so the chunks of one long text are pre-tokenised by many
tasks. Where two neighbours both begin a pre-token at the same place inside the
overlap, all later pre-tokens agree (a match depends on nothing before its
start), so the seam is stitched there. A seam without a common boundary, as
within a very long word, is mended by pre-tokenising on from the last sure boundary. The
stitched chunks are dealt out again and their pieces are merged by rank. A text of one chunk has no
seams and stays where it is. Pieces are found, told apart and merged as arrays, a slice of texts at a time; only
another pattern than BY_KIND goes through ``regex``. Decoding concatenates the tokens' bytes.

Defined results: null is encoded as the empty text, to no ids; a null list of ids
decodes to no bytes; ids out of range raise ValueError; each row is encoded by itself, whatever its id is; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repograph.llm import kernel as K

CHUNK, OVERLAP = 1 << 15, 1 << 9
#: Longer pieces are merged one by one.
LONG = 64
#: A table of pieces has at most so many places, so that it stays in the processor's cache.
BLOCK = 1 << 16
NONE = 1 << 60


def boundaries(matcher: regex.Pattern, text: str, first: int, last: int) -> list[int]:
    """Starts of pre-tokens that are sure although the text is cut at ``last``, and where they end.

    The last two matches may depend on what follows the cut, so they are left out, but at the end of the text.
    """
    starts = [first + x for x in starts_of(matcher, text[first:last])]
    return [*starts, last] if last == len(text) else starts[:-2]


def stitched(matcher: regex.Pattern, text: str, cut: list[list[int]], chunk: int, overlap: int) -> list[int]:
    """All boundaries of the text, from those of its chunks."""
    line = list(cut[0])
    for k in range(1, len(cut)):
        begin = k * chunk
        reach = line[-1] if line else 0
        shared = set(cut[k])
        while not (seam := next((x for x in reversed(line) if x in shared and x >= begin), None)) and reach < len(text):
            more, width = [], chunk + overlap
            while len(more) < 2:  # a word longer than all that has been read
                more = boundaries(matcher, text, reach, min(len(text), reach + width))
                width *= 2
            line += more[1:] if line else more
            reach = line[-1]
        if seam is not None:
            line[bisect_left(line, seam) :] = cut[k][bisect_left(cut[k], seam) :]
    return line


@lru_cache(2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(2)
def pair_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Open addressing: the slots' keys (two tokens that make a token) and that token of each; the token of each byte; what each two bytes make."""
    known = ranks(path)
    pairs = {}
    for token, r in known.items():
        for k in range(1, len(token)):
            a, b = known.get(token[:k]), known.get(token[k:])
            if a is not None and b is not None:
                pairs[a << 32 | b] = r
    slots = 1 << (2 * len(pairs) + 1).bit_length()
    keys, made = np.full(slots, -2), np.full(slots, NONE)
    key, value = np.fromiter(pairs.keys(), np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs))
    at = _slot(key, slots)
    while len(key):
        free = keys[at] == -2
        keys[at[free]] = key[free]  # the last one stays of those that ask for one slot
        own = keys[at] == key
        made[at[own]] = value[own]
        key, value, at = key[~own], value[~own], at[~own] + 1 & slots - 1
    byte = np.array([known[bytes([c])] for c in range(256)])
    return keys, made, byte, _rank(np.repeat(byte, 256), np.tile(byte, 256), keys, made)


def _slot(key: np.ndarray, slots: int) -> np.ndarray:
    return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - slots.bit_length())).view(np.int64)


def _rank(left: np.ndarray, right: np.ndarray, keys: np.ndarray, made: np.ndarray) -> np.ndarray:
    """The token that two tokens make, or NONE; -1 is no token."""
    key = left << 32 | right
    at = _slot(key, len(keys))
    held = keys[at]
    out = np.where(held == key, made[at], NONE)
    more = np.flatnonzero((held != key) & (held != -2))
    while len(more):
        at[more] = at[more] + 1 & len(keys) - 1
        held = keys[at[more]]
        same = held == key[more]
        out[more[same]] = made[at[more[same]]]
        more = more[~same & (held != -2)]
    return out


def merged(pieces: list[bytes], path: str) -> list[list[int]]:
    """The ids of pre-tokens: of all neighbours in one the pair of the least rank is joined, the leftmost first, until none has a rank."""
    at = np.concatenate([[0], np.cumsum([len(x) for x in pieces], dtype=np.int64)])
    ids, n = _merged(b"".join(pieces), at[:-1], at[1:], path)
    ids, ends = ids.tolist(), np.cumsum(n).tolist()
    return [ids[a:b] for a, b in zip([0, *ends], ends)]


def _merged(data: bytes, first: np.ndarray, last: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of pieces of the bytes, one after another, and how many each has. Pieces of about one length take a step at once."""
    known, size = ranks(path), last - first
    pieces = [data[a:b] for a, b in zip(first.tolist(), last.tolist())]
    whole = np.fromiter((known.get(x, -1) for x in pieces), np.int64, len(pieces))
    raw = np.frombuffer(data, np.uint8)
    own = np.flatnonzero(whole >= 0)
    found, least = [(own, whole[own], np.ones(len(own), np.int64))], 0
    for most in (8, 16, 32, LONG):
        some = np.flatnonzero((whole < 0) & (size > least) & (size <= most))
        for k in range(0, len(some), BLOCK // most):
            own = some[k : k + BLOCK // most]
            found.append((own, *_merged_columns(raw, first[own], size[own], most, path)))
        least = most
    longer: dict[bytes, list[int]] = {}
    for i in np.flatnonzero((whole < 0) & (size > LONG)).tolist():
        if pieces[i] not in longer:
            longer[pieces[i]] = _merged_long(pieces[i], known)
        ids = longer[pieces[i]]
        found.append((np.array([i]), np.array(ids), np.array([len(ids)])))
    n = np.zeros(len(pieces), np.int64)
    for own, _, count in found:
        n[own] = count
    begin, out = np.cumsum(n) - n, np.empty(n.sum(), np.int32)
    for own, ids, count in found:
        out[np.repeat(begin[own], count) + K.within(count)] = ids
    return out, n


def _merged_columns(raw: np.ndarray, first: np.ndarray, size: np.ndarray, rows: int, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The like of pieces of 1 to ``rows`` bytes, each in a column of a table."""
    keys, made, byte, two = pair_table(path)
    m = len(size)
    column, place = np.repeat(np.arange(m), size), K.within(size)
    raw = raw[first[column] + place].astype(np.int64)
    # Row 0 and what follows a piece's end hold no token. Flat places are row * m + column.
    flat = (place + 1) * m + column
    token = np.full((rows + 2) * m, -1)
    token[flat] = byte[raw]
    order = np.full((rows + 2) * m, NONE)  # of each token with the next one: rank and row
    inner = np.flatnonzero(place[1:] > 0)
    rank = two[raw[inner] << 8 | raw[inner + 1]]
    order[flat[inner]] = np.where(rank < NONE, rank << 7 | place[inner] + 1, NONE)
    after, before = np.arange(len(token)) + m, np.arange(len(token)) - m
    table = order.reshape(rows + 2, m)
    while True:
        least = table[1:-1].min(0)
        live = np.flatnonzero(least < NONE)
        if not len(live):
            break
        least = least[live]
        row, rank = least & 127, least >> 7
        at = row * m + live
        gone = after[at]
        then, ahead = after[gone], before[at]
        token[at], token[gone], order[gone] = rank, -1, NONE
        after[at], before[then] = then, at
        left = np.concatenate([token[ahead], rank])
        new = _rank(left, np.concatenate([rank, token[then]]), keys, made)
        order[np.concatenate([ahead, at])] = np.where(new < NONE, new << 7 | np.concatenate([ahead // m, row]), NONE)
    token = token.reshape(rows + 2, m).T
    left = token >= 0
    return token[left], left.sum(1)


def _merged_long(piece: bytes, known: dict[bytes, int]) -> list[int]:
    """With a heap of pairs, for a time that grows little faster than the piece."""
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that begins at a place
    before = list(range(-1, n - 1))
    rank: dict[int, int] = {}
    heap: list[tuple[int, int]] = []

    def look(i: int) -> None:
        """Of the part at i and the next one."""
        rank.pop(i, None)
        if i >= 0 and end[i] < n and (r := known.get(piece[i : end[end[i]]])) is not None:
            rank[i] = r
            heappush(heap, (r, i))

    for i in range(n):
        look(i)
    while heap:
        r, i = heappop(heap)
        if rank.get(i) != r:
            continue
        gone = end[i]
        rank.pop(gone, None)
        end[i] = end[gone]
        if end[i] < n:
            before[end[i]] = i
        look(i)
        if i:
            look(before[i])
    out, i = [], 0
    while i < n:
        out.append(known[piece[i : end[i]]])
        i = end[i]
    return out


#: The first bytes of eight, by how many.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _classes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One piece of each kind, and for each piece the place of its like among these. Pieces of more than LONG bytes are all told apart."""
    first, size = at[:-1], np.diff(at)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))
    words = [(np.arange(len(size)), eight[first] & _MASK[np.minimum(size, 8)])]
    digest = K.mix(words[0][1] + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for k in range(8, LONG, 8):
        some = words[-1][0]
        some = some[size[some] > k]
        if not len(some):
            break
        words.append((some, eight[first[some] + k] & _MASK[np.minimum(size[some] - k, 8)]))
        digest[some] = K.mix(digest[some] * np.uint64(0x9E3779B97F4A7C15) + words[-1][1])
    order = np.argsort(digest)
    new = np.ones(len(order), bool)
    new[1:] = digest[order[1:]] != digest[order[:-1]]
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    one = order[new]
    # Digests only propose: lengths and bytes are compared.
    like = one[kind]
    other = (size != size[like]) | (size > LONG)
    for some, word in words:
        full = np.zeros(len(size), np.uint64)
        full[some] = word
        other |= full != full[like]
    other[one] = False
    alone = np.flatnonzero(other)
    kind[alone] = len(one) + np.arange(len(alone))
    return np.concatenate([one, alone]), kind


def ids_of(raw: np.ndarray, at: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the pieces that the bytes fall into at ``at``, one after another, and where each piece's begin and the last one's end."""
    if len(at) < 2:
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    one, kind = _classes(raw, at)
    ids, n = _merged(raw.tobytes(), at[one], at[one + 1], path)
    begin, n = (np.cumsum(n) - n)[kind], n[kind]
    ends = np.concatenate([[0], np.cumsum(n)])
    return ids[np.repeat(begin - ends[:-1], n) + np.arange(ends[-1])], ends


#: The pattern whose matches are found by kinds of characters, all at once: letters, numbers, blanks, and the others.
BY_KIND = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters that Unicode has since 17.0 and ``regex`` may know already; tiktoken goes by 16.0, where they are neither letters nor numbers.
NEWER = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb "
    "11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 "
    "191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 "
    "1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f "
)


@lru_cache(1)
def kinds() -> np.ndarray:
    """Of each code point: 0 for blanks, 1 for letters, 2 for numbers, 3 for others, as tiktoken tells them."""
    every = np.arange(0x110000, dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass")
    out = np.full(len(every), 3, np.uint8)
    for k, name in enumerate((r"\s+", r"\p{L}+", r"\p{N}+")):
        for m in regex.finditer(name, every):
            out[m.start() : m.end()] = k
    for part in NEWER.split():
        first, _, last = part.partition("-")
        out[int(first, 16) : int(last or first, 16) + 1] = 3
    return out


def begins(point: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where matches of BY_KIND begin in rows of code points."""
    n = len(point)
    if not n:
        return np.zeros(0, np.int64)
    kind = kinds()[point]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    blank = kind == 0
    out = edge[:n].copy()
    out[1:] |= kind[1:] != kind[:-1]
    # A run takes the space before it along; other blanks before it stay together, but the last one.
    inside = ~blank[1:] & ~edge[1:n]
    out[1:] &= ~(inside & (point[:-1] == 32))
    out[:-1] |= blank[:-1] & inside
    # Where an apostrophe begins a match, the end of a contraction goes with it.
    at = np.flatnonzero(out & (point == 39))
    if len(at):
        padded = np.concatenate([point, np.zeros(2, point.dtype)])
        left = bounds[np.searchsorted(bounds, at, "right")] - at
        a, b = padded[at + 1], padded[at + 2]
        short = (left > 1) & np.isin(a, [ord(c) for c in "stmd"])
        long_ = (left > 2) & (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")))
        out[at[short | long_] + 1] = False
        ends = np.concatenate([at[short] + 2, at[long_] + 3])
        out[ends[ends < n]] = True
    return np.flatnonzero(out)


def pieces_of(matcher: regex.Pattern, t: K.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the texts' matches one after another, where these begin and the last one ends, and the rows' bounds among them."""
    if matcher.pattern == BY_KIND:
        lead = (t.raw & 0xC0) != 0x80
        count = np.concatenate([[0], np.cumsum(lead)])
        point = np.frombuffer(t.raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        at = np.append(np.flatnonzero(lead)[begins(point, count[t.bounds])], len(t.raw))
        return t.raw, at, np.searchsorted(at, t.bounds)
    found = [[x.encode() for x in matcher.findall(t.text(i).decode()) if x] for i in range(len(t))]
    size = [len(x) for own in found for x in own]
    raw = np.frombuffer(b"".join(chain.from_iterable(found)), np.uint8)
    return raw, np.concatenate([[0], np.cumsum(size, dtype=np.int64)]), np.concatenate([[0], np.cumsum([len(x) for x in found])])


def starts_of(matcher: regex.Pattern, text: str) -> list[int]:
    if matcher.pattern == BY_KIND:
        return begins(np.frombuffer(text.encode("utf-32-le"), np.uint32), np.array([0, len(text)])).tolist()
    return [m.start() for m in matcher.finditer(text)]


def _lists(rows: list[list[int]]) -> pa.Array:
    return _listed(np.fromiter(chain.from_iterable(rows), np.int32), np.concatenate([[0], np.cumsum([len(x) for x in rows], dtype=np.int64)]))


def _listed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))


def encode(docs: DataFrame, vocabulary: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Of (doc_id, text): doc_id and ids (array<int>). ``vocabulary`` is a rank file that all executors have; chunks are in characters."""
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = regex.compile(pattern)
        for t in K.slices(batches, "text"):
            raw, at, rows = pieces_of(matcher, t)
            ids, ends = ids_of(raw, at, vocabulary)
            yield pa.RecordBatch.from_arrays([t.keys.column(0), _listed(ids, ends[rows])], names=["doc_id", "ids"])

    short = rows.where(F.length("text") <= chunk + overlap).mapInArrow(whole, f"doc_id {kind}, ids array<int>")
    # A text's ids depend on nothing else, so chunks go by its digest: equal texts are encoded once.
    long_ = rows.where(F.length("text") > chunk + overlap).withColumn("key", F.sha2("text", 256))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                key, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                for k, a in enumerate(range(0, len(text), chunk)):
                    last = min(len(text), a + chunk + overlap)
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([k], pa.int32()), pa.array([last == len(text)]), pa.array([text[a:last]])], names=["key", "k", "last", "text"])

    def boundaries_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = regex.compile(pattern)
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(3)[i].as_py()
                starts = starts_of(matcher, text)
                # Without the last two matches, which may depend on what follows, but at the end of the text.
                own = [*starts, len(text)] if batch.column(2)[i].as_py() else starts[:-2]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in range(4)), _lists([own])], names=["key", "k", "last", "text", "starts"])

    def stitch(t: pa.Table) -> pa.Table:
        t = t.sort_by("k")
        texts, starts = t["text"].to_pylist(), t["starts"].to_pylist()
        text = "".join(x[:chunk] for x in texts[:-1]) + texts[-1]
        line = stitched(regex.compile(pattern), text, [[k * chunk + x for x in own] for k, own in enumerate(starts)], chunk, overlap)
        # Each chunk's pieces: those that begin in it.
        edge = [bisect_left(line, k * chunk) for k in range(len(texts))] + [len(line) - 1]
        rows = [(k, text[line[i] : line[j]], [x - line[i] for x in line[i : j + 1]]) for k, (i, j) in enumerate(zip(edge, edge[1:])) if i < j]
        return pa.table({"key": pa.array([t["key"][0].as_py()] * len(rows)), "k": pa.array([r[0] for r in rows], pa.int32()), "text": pa.array([r[1] for r in rows], pa.string()), "bounds": _lists([r[2] for r in rows])})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in K.slices(batches, "text"):
            lists = t.keys.column(2)
            n, lead = np.asarray(lists.value_lengths(), np.int64), (t.raw & 0xC0) != 0x80
            base = np.concatenate([[0], np.cumsum(lead)])[t.bounds[:-1]]
            at = np.append(np.flatnonzero(lead), len(t.raw))[np.asarray(lists.flatten(), np.int64) + np.repeat(base, n)]
            # Where a row ends, the next one begins.
            at = at[np.append(K.within(n)[1:] > 0, True)]
            ids, ends = ids_of(t.raw, at, vocabulary)
            rows = np.concatenate([[0], np.cumsum(n - 1)])
            yield pa.RecordBatch.from_arrays([t.keys.column(0), t.keys.column(1), _listed(ids, ends[rows])], names=["key", "k", "ids"])

    chunks = long_.dropDuplicates(["key"]).select("key", "text").mapInArrow(cut, "key string, k int, last boolean, text string").repartition("key", "k")
    told = chunks.mapInArrow(boundaries_of, "key string, k int, last boolean, text string, starts array<int>")
    sewn = told.groupBy("key").applyInArrow(stitch, "key string, k int, text string, bounds array<int>").repartition("key", "k")
    ids = sewn.mapInArrow(merge, "key string, k int, ids array<int>")
    # As long as the text's ids, which make one row in the end.
    ids = ids.groupBy("key").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))
    return short.unionAll(long_.select("doc_id", "key").join(ids, "key").select("doc_id", "ids"))


@lru_cache(2)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' bytes by id, and their bounds; an id without a token has none and a length of -1."""
    known = {v: k for k, v in ranks(path).items()}
    size = np.array([len(known[i]) if i in known else -1 for i in range(max(known) + 1)])
    return np.frombuffer(b"".join(known.get(i, b"") for i in range(len(size))), np.uint8), size


def bounded(whole: pa.RecordBatch, column: int, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose lists have at most ``most`` elements together, or one row."""
    total = np.concatenate([[0], np.cumsum(np.asarray(whole.column(column).value_lengths().fill_null(0), np.int64))])
    first = 0
    while first < whole.num_rows:
        last = max(first + 1, int(np.searchsorted(total, total[first] + most, "right")) - 1)
        yield whole.slice(first, last - first)
        first = last


def decode(encoded: DataFrame, vocabulary: str, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` as they are, ids, and data (binary): the tokens' bytes one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, size = token_bytes(vocabulary)
        at = np.concatenate([[0], np.cumsum(np.maximum(size, 0))])
        for whole in batches:
            for batch in bounded(whole, len(columns)):
                lists = batch.column(len(columns))
                ids = np.asarray(lists.flatten(), np.int64)
                if len(ids) and (ids.min() < 0 or ids.max() >= len(size) or size[ids].min() < 0):
                    raise ValueError("an id that the vocabulary doesn't have")
                n = size[ids]
                data = raw[np.repeat(at[ids], n) + K.within(n)]
                count = np.asarray(lists.value_lengths().fill_null(0), np.int64)
                total = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(count)])]
                out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(total.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*columns, "ids", "data"])

    kinds = dict(encoded.dtypes)
    return encoded.select(*columns, "ids").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", ids array<int>, data binary")

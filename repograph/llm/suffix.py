"""Removal of repeated byte strings with a difference cover, one bucket of suffixes at a time.

Every byte that is covered by a string of ``LENGTH`` bytes which also begins anywhere
else, in the same or another text, is removed. Matches never cross texts; strings are judged on the
input.

Only suffixes whose first ``LENGTH`` bytes tie count, so suffixes are cut to these bytes:

1. Texts are packed into blocks of a few MB, so a block's suffixes are
   enumerated from the block alone.
2. A difference cover of the period ``PERIOD`` picks 12 of 133 places. For any two
   places some shift below 133 takes both to sampled ones, so strings of 200 bytes that tie agree in the
   68 bytes at a pair of sampled places. The sampled places' names (these bytes) are sorted one bucket
   after another. A suffix with no sampled place of a shared name ties with none and isn't sorted: that
   leaves the repeated part of the corpus, whatever the length of its ties.
3. The other suffixes are sorted, again a bucket at a time, by keys of their 200 bytes.
   Copies of whole texts stand in for one another.
4. Ties of keys are confirmed by bytes. Of each run of tied suffixes a few anchors cover the same bytes
   as all of it. An anchor's 200 bytes are compared with those of another suffix of its key: in its own
   block or in the block before it in the ring of blocks that hold the key, so that no
   block is asked more than once for a string. One difference, and everything starts anew with other
   hash bases, so a collision costs time and never a byte.

A departure from the method as it is named: suffixes are ordered by keys, not by bytes, and ranks of the
sample don't resolve their ties. That would take twelve ranks and up to 132 bytes for each suffix of
the repeated part instead of eight bytes; README.md has the figures.

A bucket's task gets each key of a block once, in sorted order and as
differences. So a string in a third of all texts costs a bucket one key
for each block, a bucket's memory is set by ``BUCKET_BYTES``, and neither texts nor places are shuffled, but for the anchors' bytes.

Defined results: null and empty texts have no bytes and lose none; texts of under 200 bytes
lose none; rows with equal texts repeat one another, also with equal or null ids; each row is returned once; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repograph.llm import kernel as K
from repograph.llm.kernel import U

LENGTH = 200
PERIOD = 133
#: Blocks and buckets grow beyond 256 GB and 512 GB, so that a block has a few keys at least for each bucket.
BLOCK_BYTES, BUCKET_BYTES, MOST_BUCKETS = 2 << 20, 4 << 20, 1 << 17
NAMES, TEXTS, STRINGS = 0, 1, 2
#: Seeds of the two hashes, and bits of the keys, for each attempt.
ATTEMPTS = ((101, 102, 71), (103, 104, 71), (105, 106, 71))
#: A key's bits that are sorted; the other 24 are 14 more of the first hash and 10 of the second, whose other bits give the bucket.
SORTED = 47


def difference_cover(q: int) -> list[int]:
    """A perfect difference set of q + 1 places with the period q^2 + q + 1, for a prime q: the points of a line of the projective plane.

    The powers of an element that generates the field of q^3 elements are taken
    until their place in the plane repeats; those in a fixed plane form the set.
    """
    n = q * q + q + 1
    for a in range(q):
        for b in range(q):
            for c in range(1, q):
                # x^3 = a x^2 + b x + c
                x, line, k = (0, 1, 0), [], 1
                while k <= n:
                    if x[2] == 0:
                        line.append(k % n)
                    if x[1] == x[2] == 0:
                        break
                    x = (c * x[2] % q, (x[0] + b * x[2]) % q, (x[1] + a * x[2]) % q)
                    k += 1
                if k == n and len({(i - j) % n for i in line for j in line if i != j}) == n - 1:
                    return sorted(line)
    raise ValueError(f"no cover for {q}")


COVER = np.array(difference_cover(11))
NAME = LENGTH - PERIOD + 1


def coded(keys: np.ndarray, more: np.ndarray) -> bytes:
    """Sorted keys as differences, a plane for each byte that any of them needs; then three bytes more of each, if any."""
    step = np.diff(keys, prepend=U(0))
    width = max(1, (int(step[1:].max()).bit_length() + 7) // 8) if len(step) > 1 else 1
    planes = [((x >> U(8 * k)) & U(255)).astype(np.uint8).tobytes() for x, n in ((step[1:], width), (more, 3 * (len(more) > 0))) for k in range(n)]
    return bytes([width]) + len(keys).to_bytes(4, "little") + int(keys[0]).to_bytes(8, "little") + b"".join(planes)


def decoded(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    width, n, first = data[0], int.from_bytes(data[1:5], "little"), int.from_bytes(data[5:13], "little")
    step, more = np.zeros(n, U), np.zeros(n, U)
    step[0] = first
    for k, plane in enumerate(np.frombuffer(data, np.uint8, width * (n - 1), 13).reshape(width, -1)):
        step[1:] |= plane.astype(U) << U(8 * k)
    rest = np.frombuffer(data, np.uint8, offset=13 + width * (n - 1))
    for k, plane in enumerate(rest.reshape(-1, n)):
        more |= plane.astype(U) << U(8 * k)
    return np.cumsum(step, dtype=U), more


def ordered(key: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by (key, more), equal ones as they stand, and where a new one begins.

    Sorted are the key's highest bits with the place below them, which is much quicker than sorting places; that is
    the order, unless keys agree in these bits alone.
    """
    n = len(key)
    low = U(n.bit_length())
    up = U(64 - int(key.max()).bit_length())
    order = (np.sort(((key << up) >> low) << low | np.arange(n, dtype=U)) & ((U(1) << low) - U(1))).astype(np.int64)
    for _ in range(2):
        k, m = key[order], more[order]
        tie = k[1:] == k[:-1]
        if not ((k[1:] < k[:-1]) | tie & (m[1:] < m[:-1])).any():
            break
        order = np.lexsort((more, key))
    return order, np.r_[True, ~tie | (m[1:] != m[:-1])]


class Keys:
    """Elements dealt out to buckets by their keys, equal keys as one class; classes are numbered in the order of (bucket, key, more)."""

    def __init__(self, bucket: np.ndarray, key: np.ndarray, more: np.ndarray):
        self.parts: list[tuple[int, np.ndarray, np.ndarray]] = []
        n = len(key)
        self.which, self.twin = np.zeros(n, np.int64), np.full(n, -1)
        self.key, self.more = np.zeros(0, U), np.zeros(0, U)
        if not n:
            return
        whole = bucket << U(SORTED) | key
        m = more if len(more) else np.zeros(n, U)
        order, new = ordered(whole, m)
        self.which[order] = np.cumsum(new) - 1
        # Another element of the same class, where there is one.
        again = np.flatnonzero(~new)
        self.twin[order[again - 1]] = order[again]
        self.twin[order[again]] = order[again - 1]
        whole = whole[order[new]]
        b, self.key, self.more = whole >> U(SORTED), whole & U((1 << SORTED) - 1), m[order[new]]
        cut = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        self.parts = [(int(b[i]), self.key[i:j], self.more[i:j] if len(more) else more) for i, j in zip(cut, np.append(cut[1:], len(b)))]


class Block:
    """Packed texts with what their suffixes are told by."""

    def __init__(self, raw: np.ndarray, bounds: np.ndarray, buckets: int, attempt: tuple[int, int, int]):
        self.raw, self.bounds, self.buckets = raw, bounds, buckets
        self.size = np.diff(bounds)
        self.attempt = attempt
        self.first = K.polynomial(attempt[0])
        self.sums = self.first.values(raw)
        self.long = np.flatnonzero(self.size >= LENGTH)

    def keys_of(self, first: np.ndarray) -> np.ndarray:
        return first >> U(64 - min(SORTED, self.attempt[2]))

    def dealt(self, bits: np.ndarray, second: np.ndarray) -> Keys:
        more = ((bits >> U(3)) & U((1 << 14) - 1)) << U(10) | (second & U((1 << 10) - 1))
        return Keys((second >> U(10)) % U(self.buckets), self.keys_of(bits), more if self.attempt[2] > SORTED else np.zeros(len(more), U))

    def strings(self, at: np.ndarray) -> Keys:
        second = K.short_polynomial(self.attempt[1])
        return self.dealt(self.first.ranges(self.sums, at, at + LENGTH), second.ranges(second.values(self.raw), at, at + LENGTH))

    def names(self) -> tuple[np.ndarray, Keys]:
        """Sampled places. Their names are short keys, as a collision only lets a suffix be sorted in vain."""
        inside = [np.zeros(0, np.int64)]
        for a, b in zip(self.bounds[self.long], self.bounds[self.long + 1]):
            at = (np.arange(a, b, PERIOD)[:, None] + COVER).ravel()
            inside.append(at[at + NAME <= b])
        sample = np.concatenate(inside)
        name = self.first.ranges(self.sums, sample, sample + NAME)
        return sample, Keys((name & U((1 << 30) - 1)) % U(self.buckets), name >> U(32), np.zeros(0, U))

    def texts(self) -> Keys:
        seed = self.attempt[0].to_bytes(4, "little")
        data = [blake2b(self.raw[a:b], digest_size=16, key=seed).digest() for a, b in zip(self.bounds[self.long], self.bounds[self.long + 1])]
        return self.dealt(*np.frombuffer(b"".join(data), U).reshape(-1, 2).T)

    def copies(self, texts: Keys, shared: np.ndarray, owned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the long rows have a copy, and which rows another one stands in for."""
        copied = (texts.twin >= 0) | shared[texts.which]
        first = np.zeros(len(copied), bool)
        first[np.unique(texts.which, return_index=True)[1]] = True
        stood = np.zeros(len(self.size), bool)
        stood[self.long] = ~first | (shared[texts.which] & ~owned[texts.which])
        return copied, stood

    def places(self, sample: np.ndarray, names: Keys, shared: np.ndarray, stood: np.ndarray) -> np.ndarray:
        """The suffixes that may tie: some sampled place within ``PERIOD`` has a shared name."""
        hit = sample[(names.twin >= 0) | shared[names.which]]
        change = np.zeros(len(self.raw) + 2, np.int32)
        np.add.at(change, np.maximum(0, hit - PERIOD + 1), 1)
        np.add.at(change, hit + 1, -1)
        may = np.cumsum(change[:-2]) > 0
        fits = np.zeros(len(self.raw) + 1, np.int32)
        use = np.flatnonzero((self.size >= LENGTH) & ~stood)
        np.add.at(fits, self.bounds[:-1][use], 1)
        np.add.at(fits, self.bounds[1:][use] - LENGTH + 1, -1)
        return np.flatnonzero(may & (np.cumsum(fits[:-1]) > 0))

    def same(self, x: np.ndarray, y: np.ndarray) -> bool:
        """Whether the strings at the places x are those at y, byte by byte."""
        across = np.arange(LENGTH)
        return all((self.raw[x[k : k + 4096, None] + across] == self.raw[y[k : k + 4096, None] + across]).all() for k in range(0, len(x), 4096))


def runs_of(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive places."""
    if not len(at):
        return at, at
    new = np.flatnonzero(np.r_[True, np.diff(at) > 1])
    return at[new], at[np.append(new[1:], len(at)) - 1]


def anchors(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Places of each run whose strings cover what all strings of the run cover."""
    count = (last - first) // LENGTH + 1
    return np.unique(np.concatenate([np.repeat(first, count) + K.within(count) * LENGTH, last]))


def shared_keys(keys: DataFrame) -> DataFrame:
    """Sorts one bucket at a time. Of (kind, bucket, block, data): kind, bucket, block; for each key a bit if other blocks have it too and one if this block is the first; of the shared keys the block before this one in the ring."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("block")
        block = np.asarray(t.column("block"))
        parts = [decoded(x) for x in t.column("data").to_pylist()]
        n = np.array([len(k) for k, _ in parts])
        order, first = ordered(np.concatenate([k for k, _ in parts]), np.concatenate([m for _, m in parts]))
        held = np.repeat(block, n)[order]
        begin = np.flatnonzero(first)
        count = np.diff(np.append(begin, len(order)))
        before = np.empty(len(order), np.int64)
        before[1:] = held[:-1]
        before[begin] = held[begin + count - 1]
        shared, owned, near = np.empty(len(order), bool), np.empty(len(order), bool), np.empty(len(order), np.int64)
        shared[order], owned[order], near[order] = np.repeat(count > 1, count), first, before
        end, z = np.cumsum(n), zstandard.ZstdCompressor(3)
        bits = [[np.packbits(x[b - c : b]).tobytes() for b, c in zip(end, n)] for x in (shared, owned)]
        # Byte by byte of the numbers, as only the lowest bytes differ.
        around = [z.compress(near[b - c : b][shared[b - c : b]].view(np.uint8).reshape(-1, 8).T.tobytes()) for b, c in zip(end, n)]
        none = [b""] * len(parts)
        kind = t.column("kind")[0].as_py()
        return pa.table({"kind": t.column("kind"), "bucket": t.column("bucket"), "block": t.column("block"), "shared": pa.array(bits[0], pa.binary()), "owned": pa.array(bits[1] if kind == TEXTS else none, pa.binary()), "near": pa.array(none if kind == NAMES else around, pa.binary())})

    return keys.groupBy("kind", "bucket").applyInArrow(run, "kind int, bucket int, block long, shared binary, owned binary, near binary")


class Answers:
    """What the buckets say of a block's keys of one kind, class by class."""

    def __init__(self, rows: list[dict], kind: int, keys: Keys):
        got = {x["bucket"]: x for x in rows if x["kind"] == kind}
        z, empty = zstandard.ZstdDecompressor(), np.zeros(0, bool)

        def bits(field: str) -> np.ndarray:
            return np.concatenate([empty, *(np.unpackbits(np.frombuffer(got[b][field], np.uint8), count=len(k)).astype(bool) for b, k, _ in keys.parts)])

        self.shared = bits("shared")
        if kind == TEXTS:
            self.owned = bits("owned")
        if kind != NAMES:
            self.near = np.full(len(self.shared), -1)
            planes = [np.frombuffer(z.decompress(got[b]["near"], max_output_size=1 << 30), np.uint8).reshape(8, -1).T for b, _, _ in keys.parts if got[b]["near"]]
            if planes:
                self.near[self.shared] = np.ascontiguousarray(np.concatenate(planes)).view(np.int64).ravel()


def _blocks(docs: DataFrame, table: str, shards: int, block_bytes: int) -> DataFrame:
    """Texts packed into blocks, as a table that is bucketed by block, so that joins on it move only what is joined."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, part = zstandard.ZstdCompressor(3), TaskContext.get().partitionId() << 32
        for k, t in enumerate(K.slices(batches, "text", block_bytes)):
            ids = pa.ListArray.from_arrays(pa.array([0, len(t)], pa.int32()), t.keys.column(0))
            size = pa.ListArray.from_arrays(pa.array([0, len(t)], pa.int32()), pa.array(np.diff(t.bounds)))
            yield pa.RecordBatch.from_arrays([pa.array([part + k], pa.int64()), ids, size, pa.array([z.compress(t.raw.tobytes())], pa.binary())], names=["block", "ids", "size", "data"])

    packed = docs.select("doc_id", "text").mapInArrow(run, f"block long, ids array<{kind}>, size array<long>, data binary")
    path = K.new_path(docs.sparkSession, table)
    # One file for each shard, however many tasks pack the texts.
    packed.repartition(shards, "block").write.bucketBy(shards, "block").option("compression", "uncompressed").option("path", path).saveAsTable(table)
    return docs.sparkSession.table(table)


def _raw(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.asarray(batch.column(2)[i].values, np.int64)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(batch.column(3)[i].as_py(), max_output_size=int(size.sum())), np.uint8) if size.sum() else np.zeros(0, np.uint8)
    return raw, np.concatenate([[0], np.cumsum(size)])


def _told(block: int, kind: int, keys: Keys) -> Iterator[pa.RecordBatch]:
    if keys.parts:
        p = keys.parts
        yield pa.RecordBatch.from_arrays([pa.array([kind] * len(p), pa.int32()), pa.array([b for b, _, _ in p], pa.int32()), pa.array([block] * len(p), pa.int64()), pa.array([coded(k, m) for _, k, m in p], pa.binary())], names=["kind", "bucket", "block", "data"])


def _state(batch: pa.RecordBatch, i: int, buckets: int, attempt: tuple[int, int, int]):
    """A block, the buckets' answers, its texts' keys and theirs, which texts have copies, and the suffixes that may tie."""
    own, answers = Block(*_raw(batch, i), buckets, attempt), batch.column(4)[i].as_py() or []
    texts = own.texts()
    told = Answers(answers, TEXTS, texts)
    copied, stood = own.copies(texts, told.shared, told.owned)
    sample, names = own.names()
    return own, answers, texts, told, copied, own.places(sample, names, Answers(answers, NAMES, names).shared, stood)


ASK = "struct<kind:int,key:long,at:long>"


def _ties(batch: pa.RecordBatch, i: int, buckets: int, attempt: tuple[int, int, int]) -> dict:
    """What a block loses, by the keys, and what has to be compared for it; differs: whether a comparison within the block failed."""
    own, answers, texts, told, copied, at = _state(batch, i, buckets, attempt)
    keys = own.strings(at)
    strings = Answers(answers, STRINGS, keys)
    tied = (keys.twin >= 0) | strings.shared[keys.which]
    first, last = runs_of(at[tied])
    whole = np.flatnonzero(copied)
    change = np.zeros(len(own.raw) + 1, np.int32)
    np.add.at(change, np.r_[first, own.bounds[own.long[whole]]], 1)
    np.add.at(change, np.r_[last + LENGTH, own.bounds[own.long[whole] + 1]], -1)
    gone = np.cumsum(change[:-1]) > 0
    anchor = np.searchsorted(at, anchors(first, last))
    inner, outer = anchor[keys.twin[anchor] >= 0], anchor[keys.twin[anchor] < 0]
    differs = not own.same(at[inner], at[keys.twin[inner]])
    for x in whole[texts.twin[whole] >= 0]:
        (a, b), (c, d) = (own.bounds[own.long[y] : own.long[y] + 2] for y in (x, texts.twin[x]))
        differs |= not np.array_equal(own.raw[a:b], own.raw[c:d])
    far = whole[texts.twin[whole] < 0]
    c, t = keys.which[outer], texts.which[far]
    asked = pa.StructArray.from_arrays([
        pa.array(np.r_[np.full(len(c), STRINGS), np.full(len(t), TEXTS)].astype(np.int32)), pa.array(K.signed(np.r_[keys.key[c], texts.key[t]])),
        pa.array(np.r_[at[outer], own.long[far]].astype(np.int64)),
    ], names=["kind", "key", "at"])
    edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
    return {"gone": edge, "places": np.stack(runs_of(at), 1).ravel(), "to": np.r_[strings.near[c], told.near[t]], "asked": asked, "differs": differs}


def _attempt(blocks: DataFrame, buckets: int, attempt: tuple[int, int, int], paths: list[str]) -> DataFrame | None:
    """(block, gone) with the edges of what each block loses; None if strings with equal keys differ."""
    keys = "kind int, bucket int, block long, data binary"
    columns = ["block", "ids", "size", "data"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, int]]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield batch, i, batch.column(0)[i].as_py()

    def tell_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, block in rows(batches):
            own = Block(*_raw(batch, i), buckets, attempt)
            yield from _told(block, NAMES, own.names()[1])
            yield from _told(block, TEXTS, own.texts())

    def tell_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, block in rows(batches):
            own, *_, at = _state(batch, i, buckets, attempt)
            yield from _told(block, STRINGS, own.strings(at))

    def with_answers(answers: DataFrame) -> DataFrame:
        # A block has an answer for each bucket that it gave keys to: bounded by its size.
        own = answers.groupBy("block").agg(F.collect_list(F.struct("kind", "bucket", "shared", "owned", "near")).alias("answers"))
        return blocks.join(own, "block", "left").select(*columns, "answers")

    first = K.stored(shared_keys(blocks.select(columns).mapInArrow(tell_names, keys)))
    K.release(blocks.sparkSession)
    second = K.stored(shared_keys(with_answers(first).mapInArrow(tell_strings, keys)))
    K.release(blocks.sparkSession)

    def find_ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, block in rows(batches):
            x = _ties(batch, i, buckets, attempt)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (pa.array(x["gone"], pa.int64()), pa.array(x["places"], pa.int64()), pa.array(x["to"], pa.int64()), x["asked"])]
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *lists, pa.array([x["differs"]])], names=["block", "gone", "places", "to", "asked", "differs"])

    ties = K.stored(with_answers(first.unionAll(second)).mapInArrow(find_ties, f"block long, gone array<long>, places array<long>, to array<long>, asked array<{ASK}>, differs boolean"))
    asks = ties.select("block", F.explode(F.arrays_zip("to", "asked")).alias("a")).select(F.col("block").alias("from"), F.col("a.to").alias("block"), "a.asked.*")
    asks = asks.groupBy("block").agg(F.collect_list(F.struct("from", "kind", "key", "at")).alias("asks"))

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, _ in rows(batches):
            asked = batch.column(5)[i].as_py()
            own = Block(*_raw(batch, i), buckets, attempt)
            first, last = np.asarray(batch.column(4)[i].values, np.int64).reshape(-1, 2).T
            count = last - first + 1
            at = np.repeat(first, count) + K.within(count)
            key = own.keys_of(own.first.ranges(own.sums, at, at + LENGTH))
            hit = np.isin(key, np.unique(np.array([x["key"] for x in asked if x["kind"] == STRINGS], np.int64)).astype(U))
            place = dict(zip(key[hit].tolist(), at[hit].tolist()))
            texts = own.texts() if any(x["kind"] == TEXTS for x in asked) else None
            row = dict(zip(texts.key[texts.which].tolist(), own.long.tolist())) if texts else {}
            data, z = [], zstandard.ZstdCompressor(3)
            for x in asked:
                k = x["key"]
                if x["kind"] == STRINGS:
                    data.append(own.raw[place[k] : place[k] + LENGTH].tobytes())
                else:
                    data.append(z.compress(own.raw[own.bounds[row[k]] : own.bounds[row[k] + 1]].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x["from"] for x in asked], pa.int64()), pa.array([x["kind"] for x in asked], pa.int32()), pa.array([x["at"] for x in asked], pa.int64()), pa.array(data, pa.binary())], names=["block", "kind", "at", "bytes"])

    replies = blocks.join(ties.select("block", "places"), "block").join(asks, "block").select(*columns, "places", "asks").mapInArrow(reply, "block long, kind int, at long, bytes binary")
    replies = replies.groupBy("block").agg(F.collect_list(F.struct("kind", "at", "bytes")).alias("replies"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch, i, _ in rows(batches):
            raw, bounds = _raw(batch, i)
            differs = False
            for x in batch.column(4)[i].as_py():
                a, b = (x["at"], x["at"] + LENGTH) if x["kind"] == STRINGS else bounds[x["at"] : x["at"] + 2]
                theirs = x["bytes"] if x["kind"] == STRINGS else z.decompress(x["bytes"])
                differs |= raw[a:b].tobytes() != theirs
            if differs:
                yield pa.RecordBatch.from_arrays([pa.array([True])], names=["differs"])

    if not blocks.join(replies, "block").select(*columns, "replies").mapInArrow(compare, "differs boolean").unionAll(ties.where("differs").select("differs")).isEmpty():
        return None
    return K.kept(paths, ties.select("block", "gone"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Of (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept (binary)."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    size = K.total_bytes(docs, "text")
    buckets = min(max(8, size // BUCKET_BYTES), MOST_BUCKETS)
    block_bytes = min(max(BLOCK_BYTES, size // MOST_BUCKETS), 4 * BLOCK_BYTES)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(size // (4 * BLOCK_BYTES), 100_000))
    blocks = _blocks(docs, f"blocks_{uuid.uuid4().hex}", shards, block_bytes)
    for attempt in ATTEMPTS:
        with K.scratch() as paths:
            ties = _attempt(blocks, buckets, attempt, paths)
        if ties is not None:
            break
    else:
        raise RuntimeError("different strings had equal keys for each pair of hash bases")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw, bounds = _raw(batch, i)
                edge = np.asarray(batch.column(4)[i].values, np.int64)
                change = np.zeros(len(raw) + 1, np.int8)
                change[edge[::2]] += 1
                change[edge[1::2]] -= 1
                gone = np.cumsum(change[:-1], dtype=np.int8) > 0
                begins = gone & ~np.r_[False, gone[:-1]] if len(gone) else gone
                if len(gone):
                    rim = bounds[:-1][np.diff(bounds) > 0]
                    begins[rim] = gone[rim]
                totals = [np.concatenate([[0], np.cumsum(x)]) for x in (gone, begins)]
                kept = [raw[a:b][~gone[a:b]].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                counts = [pa.array(x[bounds[1:]] - x[bounds[:-1]]) for x in totals]
                yield pa.RecordBatch.from_arrays([batch.column(1)[i].values, pa.array(np.diff(bounds)), *counts, pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    known = blocks.join(ties, "block").select("block", "ids", "size", "data", "gone")
    return known.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")

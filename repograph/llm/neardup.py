"""Near-duplicates: MinHash with tensored banding, candidates verified on full sets.

A document's set is its distinct shingles of five words. Two small collections
of ``HALVES`` half keys, each of ``ROWS`` minhashes, are computed; every pair of a left and a
right half key is the key of one table. So 2 * HALVES * ROWS minhashes serve
HALVES^2 tables of 2 * ROWS minhashes: about the square root of what they'd take one by one. Two documents
at the threshold of 0.75 are missed if no left or no right half key agrees, with a probability below 1e-4; more similar ones far less.

1. Documents with equal sets become a class; only its smallest id goes on.
2. Left half keys that occur once are dropped; the other documents spread to full keys.
3. In each bucket every document's signature is compared with the smallest id's: no bucket makes more pairs than it has rows. The likeliest pair of each document is verified.
4. Of buckets that still hold several components the large ones are replaced by
   a prefix filter over shingles, rarest first. Buckets with the same
   smallest id form a group. Documents of a group that share enough minhashes come into one
   cluster: small groups pair by pair, others in blocks of ``BLOCK_ROWS``
   signatures, which give a spanning forest instead of pairs.
5. Pairs of a cluster that lie in different components are verified on the full sets: those of
   large clusters in blocks of ``BLOCK_BYTES`` of packed texts, by one
   incidence matrix for each two blocks. Components come from alternating large and small stars.

Defined results: null, empty and wordless texts have n_shingles 0, are linked
with nothing and kept; of one to four words the whole sequence is the set;
rows with equal ids are one document, which is linked if any of its texts is; a row without id has no component and is kept; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repograph.llm import kernel as K
from repograph.llm.kernel import U

WORDS, PERCENT = 5, 75
HALVES, ROWS = 12, 2
#: Buckets of up to so many documents are compared pair by pair.
SMALL = 24
#: Larger groups are compared in blocks: of so many signatures, of so many packed bytes (or 256 texts).
BLOCK_ROWS, BLOCK_BYTES = 1024, 1 << 18
#: Of 48 minhashes a pair at the threshold shares fewer with a probability of 1e-7.
SHARED = 20

_random = np.random.default_rng(5)
_factor = _random.integers(0, 1 << 63, 2 * HALVES * ROWS, dtype=np.uint64) * U(2) + U(1)
_offset = _random.integers(0, 1 << 63, 2 * HALVES * ROWS, dtype=np.uint64)


def shingle_sets(t: K.Texts) -> list[np.ndarray]:
    """Each row's set, as sorted 64-bit hashes."""
    w = K.words(K.LOWER[t.raw], t.bounds, K.BLANK == False)  # noqa: E712
    h = np.zeros(len(w.hash), U)
    if len(h) >= WORDS:
        g = np.zeros(len(h) - WORDS + 1, U)
        for k in range(WORDS):
            g = K.mix(g * U(0x9FB21C651E98DF25) + w.hash[k : k + len(g)])
        h[: len(g)] = g
    out = []
    for a, b in zip(w.at[:-1], w.at[1:]):
        if b - a >= WORDS:
            out.append(np.unique(h[a : b - WORDS + 1]))
        elif b > a:
            g = U(1)
            for k in range(a, b):
                g = K.mix(np.array([g]) * U(0xA0761D6478BD642F) + w.hash[k : k + 1])[0]
            out.append(np.array([g], U))
        else:
            out.append(np.zeros(0, U))
    return out


def minhashes(s: np.ndarray, part: int = 1 << 14) -> np.ndarray:
    """A part of a long set at a time."""
    return np.min([(s[k : k + part, None] * _factor + _offset).min(0) for k in range(0, len(s), part)], 0)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n, f1, f2, left, right, sig): the set's size and fingerprint, the half keys, 16 bits of each minhash."""
    rows = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in K.slices(batches, "text"):
            sets = shingle_sets(t)
            low = np.array([minhashes(s) if len(s) else np.zeros(2 * HALVES * ROWS, U) for s in sets])
            half = low.reshape(len(sets), 2, HALVES, ROWS)
            key = np.zeros(half.shape[:3], U) + np.arange(HALVES, dtype=U) + U(1)
            for k in range(ROWS):
                key = K.mix(key * U(0x9E3779B97F4A7C15) + half[..., k])
            at = pa.array(np.arange(0, (len(sets) + 1) * HALVES, HALVES, dtype=np.int32))
            sig = (low >> U(48)).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([
                t.keys.column(0), pa.array([len(s) for s in sets], pa.int64()),
                pa.array(np.array([K.signed(s.sum(dtype=U).reshape(1))[0] for s in sets])), pa.array(np.array([K.signed(K.mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U).reshape(1))[0] for s in sets])),
                *(pa.ListArray.from_arrays(at, pa.array(K.signed(np.ascontiguousarray(key[:, side]).reshape(-1)))) for side in (0, 1)), pa.array([x.tobytes() for x in sig], pa.binary()),
            ], names=["doc_id", "n", "f1", "f2", "left", "right", "sig"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n long, f1 long, f2 long, left array<long>, right array<long>, sig binary")


def packed(docs: DataFrame) -> DataFrame:
    """(id, packed): the texts, compressed before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(3)
        for t in K.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([t.keys.column(0), pa.array([z.compress(t.text(i)) for i in range(len(t))], pa.binary())], names=["id", "packed"])

    return docs.select("doc_id", "text").mapInArrow(run, f"id {dict(docs.dtypes)['doc_id']}, packed binary")


def verified(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough. ``texts``: (id, packed), some ids perhaps several times."""
    kind = dict(pairs.dtypes)["a"]
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("packed").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("packed").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                # Each text of the run is opened once, as one side is often the same.
                own = {x: i for i, x in enumerate(dict.fromkeys(batch.column(2).to_pylist() + batch.column(3).to_pylist()))}
                text = pa.array([z.decompress(x) for x in own], pa.binary())
                sets: list[np.ndarray] = []
                for t in K.slices(iter([pa.RecordBatch.from_arrays([text, pa.nulls(len(text))], names=["text", "none"])]), "text"):
                    sets += shingle_sets(t)
                keep = []
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    s, r = sets[own[x]], sets[own[y]]
                    if min(len(s), len(r)) * 100 < percent * max(len(s), len(r)):
                        keep.append(False)
                        continue
                    inter = len(s) + len(r) - len(np.union1d(s, r))
                    keep.append(100 * inter >= percent * (len(s) + len(r) - inter))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return both.select("a", "b", "x", "y").mapInArrow(run, f"a {kind}, b {kind}").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(id, comp) of every node of the stored (a, b): comp is the smallest id that it reaches. Large and small stars by turns."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    while True:
        sides = edges.select("a", "b", F.lit(1).alias("up")).unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(0).alias("up")))
        least = K.stored(sides.groupBy("a").agg(F.min("b").alias("m"), F.sum("up").alias("ups"), F.count("*").alias("c")).select("a", F.least("a", "m").alias("m"), "ups", "c"))
        # Stars already: each node has one smaller neighbour and no larger ones, or larger ones only.
        if least.where("ups > 1 or ups = 1 and c > 1").isEmpty():
            return edges.select(F.col("a").alias("id"), F.col("b").alias("comp"))
        # Large star: a node's larger neighbours go to its least one.
        large = K.stored(edges.select(F.col("b").alias("a"), F.col("a").alias("v")).join(least.select("a", "m"), "a").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        # Small star: a node and its smaller neighbours go to the least of these.
        least = K.stored(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = K.stored(small.where("a <> b").distinct())


def rooted(edges: DataFrame) -> DataFrame:
    """(id, comp) of every a of the stored (a, b), where each a has one b, a smaller one: the way's end. Each round doubles the steps."""
    edges = edges.select("a", "b")
    while True:
        up = edges.select(F.col("a").alias("b"), F.col("b").alias("c"))
        edges = K.stored(edges.join(up, "b", "left").select("a", F.coalesce("c", "b").alias("b"), F.col("c").isNotNull().alias("moved")))
        if edges.where("moved").isEmpty():
            return edges.select(F.col("a").alias("id"), F.col("b").alias("comp"))
        edges = edges.select("a", "b")


def _alike(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """(a, b, same): the pairs that share enough minhashes and could have the similarity by their sizes; how many they share."""
    own = sigs.select("doc_id", "n", "sig")
    both = pairs.join(own.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa")), "a").join(own.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb")), "b")
    both = both.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * PERCENT)
    kind = dict(pairs.dtypes)["a"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in (2, 3))
                same = (x == y).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same, pa.int32())], names=["a", "b", "same"]).filter(pa.array(same >= SHARED))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, f"a {kind}, b {kind}, same int")


def _pairs_within(members: DataFrame) -> DataFrame:
    """(a, b) of (key, id, comp) with equal keys and different components."""
    x, y = members.select("key", F.col("id").alias("a"), F.col("comp").alias("ca")), members.select("key", F.col("id").alias("b"), F.col("comp").alias("cb"))
    return x.join(y, "key").where("a > b and ca <> cb").select("a", "b").distinct()


def _forest(ids: pa.ChunkedArray, i: np.ndarray, j: np.ndarray) -> pa.Table:
    """Edges (a, b) that connect what the edges (i, j) between rows connect, fewer than rows."""
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = np.flatnonzero(label != np.arange(len(label)))
    return pa.table({"a": ids.take(pa.array(own)), "b": ids.take(pa.array(label[own]))})


def _sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The rows of either block; one block meets itself."""
    z, x, y = t["z"].to_numpy(), t["x"][0].as_py(), t["y"][0].as_py()
    return np.flatnonzero(z == x), np.flatnonzero(z == y)


def _apart(t: pa.Table, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs differ in their component."""
    comp = np.unique(np.array(t["comp"].to_pylist()), return_inverse=True)[1]
    return comp[left][:, None] != comp[right]


def _met(t: pa.Table) -> pa.Table:
    """Of two blocks of (id, comp, n, sig): which share enough minhashes, as a forest whose roots are smallest ids."""
    t = t.sort_by("id")
    left, right = _sides(t)
    sig, n = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint16).reshape(len(t), -1), t["n"].to_numpy()
    same = np.zeros((len(left), len(right)), np.uint8)
    for c in range(sig.shape[1]):
        same += sig[left, c][:, None] == sig[right, c]
    x, y = n[left][:, None], n[right]
    i, j = np.nonzero((same >= SHARED) & (np.minimum(x, y) * 100 >= np.maximum(x, y) * PERCENT) & _apart(t, left, right))
    return _forest(t["id"], left[i], right[j])


def _linked(t: pa.Table) -> pa.Table:
    """Of two blocks of (id, comp, packed): whose full sets are similar enough, as a forest whose roots are smallest ids."""
    t = t.sort_by("id")
    left, right = _sides(t)
    z = zstandard.ZstdDecompressor()
    sets: list[np.ndarray] = []
    text = pa.array([z.decompress(x) for x in t["packed"].to_pylist()], pa.binary())
    for part in K.slices(iter([pa.RecordBatch.from_arrays([text, pa.nulls(len(text))], names=["text", "none"])]), "text"):
        sets += shingle_sets(part)
    n = np.array([len(s) for s in sets])
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), n)
    # A shingle of one text is in no intersection.
    shared = often > 1
    row, column = row[shared[column]], (np.cumsum(shared) - 1)[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    inter = np.zeros((len(left), len(right)), np.int64)
    for first in range(0, int(shared.sum()), 2048):
        a, b = np.searchsorted(column, [first, first + 2048])
        has = np.zeros((len(sets), 2048), np.float32)
        has[row[a:b], column[a:b] - first] = 1
        inter += (has[left] @ has[right].T).astype(np.int64)
    i, j = np.nonzero((inter * 100 >= PERCENT * (n[left][:, None] + n[right] - inter)) & (inter > 0) & _apart(t, left, right))
    return _forest(t["id"], left[i], right[j])


def _in_blocks(rows: DataFrame, kernel, *columns: str) -> DataFrame:
    """The kernel's (a, b) for each two of the ``blocks`` blocks of each ``key``; a block's rows are dealt by a hash of their id."""
    kind = dict(rows.dtypes)["id"]
    dealt = rows.withColumn("z", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn("w", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    both = dealt.select("key", F.least("z", "w").alias("x"), F.greatest("z", "w").alias("y"), "z", "id", "comp", *columns)
    return both.groupBy("key", "x", "y").applyInArrow(kernel, f"a {kind}, b {kind}").distinct()


def within_groups(members: DataFrame, sized: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between components of (key, id, comp), for ids that share a key: at least a forest of them.

    ``sized``: (doc_id, n, sig). ``texts``: (id, packed).
    """
    lead = K.stored(members.groupBy("key").agg(F.min("id").alias("lead")))
    groups = K.stored(members.join(lead, "key").select(F.col("lead").alias("key"), "id", "comp").distinct())
    count = K.stored(groups.groupBy("key").agg(F.count("*").alias("c")))
    small = groups.join(count.where(f"c <= {SMALL}"), "key", "left_semi")
    edges = _alike(_pairs_within(small), sized).select("a", "b")
    blocks = count.where(f"c > {SMALL}").select("key", F.ceil(F.col("c") / BLOCK_ROWS).alias("blocks"))
    signed = groups.join(blocks, "key").join(sized.withColumnRenamed("doc_id", "id"), "id")
    edges = K.stored(edges.unionAll(_in_blocks(signed, _met, "n", "sig")).where("a <> b").distinct())
    # Each document lies in one cluster, so each pair is verified once.
    clusters = connected(edges).select("id", F.col("comp").alias("key"))
    clusters = K.stored(clusters.unionAll(clusters.select(F.col("key").alias("id"), "key")).distinct().join(groups.select("id", "comp").distinct(), "id"))
    size = K.stored(texts.select("id", F.length("packed").alias("bytes")).join(clusters, "id").groupBy("key").agg(F.count("*").alias("c"), F.sum("bytes").alias("bytes")))
    small = clusters.join(size.where(f"c <= {SMALL}"), "key", "left_semi")
    found = verified(_alike(_pairs_within(small), sized).select("a", "b"), texts)
    blocks = size.where(f"c > {SMALL}").select("key", F.greatest(F.ceil(F.col("bytes") / BLOCK_BYTES), F.ceil(F.col("c") / 256)).alias("blocks"))
    return K.stored(found.unionAll(_in_blocks(clusters.join(blocks, "key").join(texts, "id"), _linked, "packed")).where("a <> b"))


def prefixes(texts: DataFrame) -> DataFrame:
    """(key, id): of each text the rarest shingles that any text with the similarity must share one of."""
    kind = dict(texts.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                text = pa.array([z.decompress(x) for x in batch.column(1).to_pylist()], pa.binary())
                row = 0
                for t in K.slices(iter([pa.RecordBatch.from_arrays([text, pa.nulls(len(text))], names=["text", "none"])]), "text"):
                    sets = shingle_sets(t)
                    size = np.array([len(s) for s in sets])
                    yield pa.RecordBatch.from_arrays([pa.array(K.signed(np.concatenate(sets))), batch.column(0).take(pa.array(np.repeat(np.arange(row, row + len(sets)), size))), pa.array(np.repeat(size, size))], names=["key", "id", "n"])
                    row += len(sets)

    from pyspark.sql import Window

    all_ = K.stored(texts.mapInArrow(run, f"key long, id {kind}, n long"))
    often = K.stored(all_.groupBy("key").agg(F.count("*").alias("often")).where("often > 1"))
    # A shingle of one text only finds nothing, but it takes a place in the prefix.
    shared = all_.join(often, "key")
    order = Window.partitionBy("id", "n").orderBy(F.desc("often"), "key")
    # Counted from the most frequent shingle: those after the first ceil(0.75 n) - 1 are the prefix.
    return shared.withColumn("k", F.row_number().over(order)).where(F.col("k") > F.ceil(F.col("n") * PERCENT / 100) - 1).select("key", "id")


def components(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept."""
    with K.scratch() as paths:
        return K.kept(paths, _components(docs.select("doc_id", "text")))


def _components(docs: DataFrame) -> DataFrame:
    sigs = K.stored(signatures(docs))
    usable = sigs.where("n > 0 and doc_id is not null")
    classes = K.stored(usable.groupBy("n", "f1", "f2").agg(F.min(F.struct("doc_id", "left", "right", "sig")).alias("r")).select("n", "f1", "f2", "r.*"))
    lefts = classes.select("doc_id", F.posexplode("left").alias("i", "l"))
    busy = K.stored(lefts.groupBy("i", "l").agg(F.count("*").alias("c")).where("c > 1").select("i", "l"))
    # The right half keys come after, so that they aren't shuffled with each left one.
    spread = lefts.join(busy, ["i", "l"], "left_semi").join(classes.select("doc_id", "right"), "doc_id").select("doc_id", "i", "l", F.posexplode("right").alias("j", "r"))
    table = K.stored(spread.select(F.xxhash64("i", "l", "j", "r").alias("key"), F.col("doc_id").alias("id")))
    first = K.stored(table.groupBy("key").agg(F.min("id").alias("b"), F.count("*").alias("c")).where("c > 1"))
    shared = K.stored(table.join(first, "key").select("key", "id", "b", "c"))
    stars = shared.where("id <> b").select(F.col("id").alias("a"), "b").distinct()
    sized = classes.select("doc_id", "n", "sig")
    # The likeliest link of each document first; what it leaves apart is compared within the buckets below.
    pairs = K.stored(_alike(stars, sized).groupBy("a").agg(F.min(F.struct(-F.col("same"), "b")).alias("e")).select("a", "e.b"))
    wanted = K.stored(shared.select("id").distinct())
    # Dealt out, packed: copies may lie side by side in the input, and later steps open what a part holds.
    texts = K.stored(packed(K.held(docs.where("text is not null"), wanted)).repartition("id").join(wanted, "id", "left_semi"))
    links = K.stored(verified(pairs, texts))
    comps = rooted(links)
    # Buckets with several components are left.
    labelled = shared.select("key", "id", "c").join(comps, "id", "left").select("key", "id", "c", F.coalesce("comp", "id").alias("comp"))
    labelled = K.stored(labelled)
    mixed = K.stored(labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("c").alias("size")).where("lo <> hi").select("key", "size"))
    open_ = K.stored(labelled.drop("c").join(mixed, "key"))
    members = open_.where(f"size <= {SMALL}").select("key", "id", "comp")
    large = open_.where(f"size > {SMALL}").select("id", "comp").distinct()
    if not large.isEmpty():
        large = K.stored(large)
        rare = K.stored(prefixes(texts.join(large.select("id"), "id", "left_semi")))
        kept = K.stored(rare.join(large, "id"))
        several = K.stored(kept.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key"))
        members = members.unionAll(kept.join(several, "key", "left_semi").select("key", "id", "comp"))
    found = within_groups(members, sized, texts)
    if not found.isEmpty():
        # Links join whole components, so only these are connected anew.
        x, y = comps.select(F.col("id").alias("a"), F.col("comp").alias("ca")), comps.select(F.col("id").alias("b"), F.col("comp").alias("cb"))
        found = found.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        joined = connected(K.stored(found.distinct())).withColumnRenamed("comp", "into")
        whole = comps.unionAll(comps.select(F.col("comp").alias("id"), "comp")).unionAll(joined.select(F.explode(F.array("id", "into")).alias("id")).withColumn("comp", F.col("id"))).distinct()
        comps = whole.join(joined.withColumnRenamed("id", "comp"), "comp", "left").select("id", F.coalesce("into", "comp").alias("comp")).groupBy("id").agg(F.min("comp").alias("comp"))
    named = classes.select("n", "f1", "f2", F.col("doc_id").alias("rep"))
    named = K.stored(named.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("n", "f1", "f2", F.coalesce("comp", "rep").alias("comp")))
    out = sigs.select("doc_id", "n", "f1", "f2").join(named, ["n", "f1", "f2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id").isNull() | (component == F.col("doc_id"))).alias("kept"))

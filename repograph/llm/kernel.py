"""Numpy building blocks shared by the text operators.

Executors receive Arrow batches; :func:`slices` hands them on as runs of whole
rows of bounded bytes, so that the eight-byte-per-character work arrays stay
small whatever the batch size is. A single row is never cut.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

U = np.uint64
SLICE_BYTES = 1 << 19

@dataclass
class Texts:
    """Whole rows: ``keys`` (all columns but the text), the texts' bytes and their bounds."""

    keys: pa.RecordBatch
    raw: np.ndarray
    bounds: np.ndarray
    null: np.ndarray
    column: pa.Array

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def text(self, i: int) -> bytes:
        return self.raw[self.bounds[i] : self.bounds[i + 1]].tobytes()


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    _, at, data = column.buffers()
    bounds = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """Runs of rows with at most ``limit`` bytes of text (one row, if it alone has more)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.schema.get_field_index(text)
        column = batch.column(k)
        null = np.asarray(column.is_null())
        size = np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)
        other = pa.RecordBatch.from_arrays(
            [c for i, c in enumerate(batch.columns) if i != k], names=[n for i, n in enumerate(batch.schema.names) if i != k]
        ) if batch.num_columns > 1 else None
        whole = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
        total, first, n = np.concatenate([[0], np.cumsum(size)]), 0, batch.num_rows
        while first < n:
            last = max(first + 1, int(np.searchsorted(total, total[first] + limit, "right")) - 1)
            raw, bounds = _bytes_of(whole.slice(first, last - first))
            yield Texts(other.slice(first, last - first) if other is not None else None, raw, bounds, null[first:last], column.slice(first, last - first))
            first = last


#: Hashes are polynomials modulo this prime: two different strings of n symbols collide for at most n of 2^61 bases.
PRIME = (1 << 61) - 1
#: Work arrays of ``_PART`` numbers stay in the processor's cache and below the size at which memory is mapped anew.
_ROW, _PART, _LONG = 1 << 10, 1 << 13, 1 << 15


def _folded(x: np.ndarray) -> np.ndarray:
    high = x >> U(61)
    high += x & U(PRIME)
    return np.minimum(high, high - U(PRIME))  # the difference wraps around where it would be negative


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, by halves of 31 bits."""
    m31, m30 = U((1 << 31) - 1), U((1 << 30) - 1)
    ah, al, bh, bl = a >> U(31), a & m31, b >> U(31), b & m31
    middle = ah * bl
    middle += al * bh
    ah = ah * bh
    ah <<= U(1)
    ah += middle >> U(30)
    middle &= m30
    middle <<= U(31)
    ah += middle
    al = al * bl
    ah += al
    return _folded(ah)


class Polynomial:
    """Hashes of ranges of one string of symbols below 2^21, by their values at a base drawn at random."""

    def __init__(self, seed: int):
        self.base = int(np.random.default_rng(seed).integers(1 << 32, PRIME - 1))
        self.up = self._powers(self.base, _LONG)
        down = self._powers(pow(self.base, -1, PRIME), _ROW)
        self.down_high, self.down_low = down >> U(31), down & U((1 << 31) - 1)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.ones(1, U)
        while len(out) < n:
            out = np.concatenate([out, _times(out, U(pow(base, len(out), PRIME)))])
        return out[:n]

    def values(self, symbols: np.ndarray) -> np.ndarray:
        """The value of each prefix; one more than symbols."""
        out, start = np.zeros(len(symbols) + 1, U), 0
        for first in range(0, len(symbols), _PART):
            part = symbols[first : first + _PART]
            rows = -(-len(part) // _ROW)
            c = np.zeros(rows * _ROW, U)
            c[: len(part)] = part.astype(U) + U(1)
            c = c.reshape(rows, _ROW)
            low, high = np.cumsum(c * self.down_low, 1, dtype=U), np.cumsum(c * self.down_high, 1, dtype=U)
            # Within a row, symbol j times base^-j; what stands before the row comes as one more term.
            sums = _folded(low + (high >> U(30)) + ((high & U((1 << 30) - 1)) << U(31)))
            before, ends, last = np.zeros(rows, U), sums[:, -1].tolist(), pow(self.base, _ROW - 1, PRIME)
            for k in range(rows):
                before[k] = start * self.base % PRIME
                start = (int(before[k]) + ends[k]) * last % PRIME
            own = _times(_folded(sums + before[:, None]), self.up[:_ROW]).reshape(-1)[: len(part)]
            out[first + 1 : first + 1 + len(part)] = own
            start = int(own[-1])
        return out

    def ranges(self, values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each range, equal for equal ranges wherever they are."""
        out = np.empty(len(first), U)
        for k in range(0, len(first), _PART):
            a, n = first[k : k + _PART], last[k : k + _PART] - first[k : k + _PART]
            power = self.up[np.minimum(n, _LONG - 1)]
            for i in np.flatnonzero(n >= _LONG):
                power[i] = pow(self.base, int(n[i]), PRIME)
            out[k : k + _PART] = mix(_folded(values[last[k : k + _PART]] + U(PRIME) - _times(values[a], power)) + n.astype(U) * U(0x9E3779B97F4A7C15))
        return out


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer over 64 bits, in which each input bit reaches each output bit."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


@lru_cache(16)
def polynomial(seed: int) -> Polynomial:
    return Polynomial(seed)


class ShortPolynomial:
    """The like of bytes modulo 2^31 - 1: a quick second hash of 31 bits, for ranges below ``_LONG``."""

    P = U((1 << 31) - 1)

    def __init__(self, seed: int):
        self.base = base = int(np.random.default_rng(seed).integers(1 << 16, (1 << 31) - 2))
        self.up, self.down = ([1], [1])
        for powers, x, n in ((self.up, base, _LONG), (self.down, pow(base, -1, int(self.P)), _ROW)):
            while len(powers) < n:
                powers.append(powers[-1] * x % int(self.P))
        self.up, self.down = np.array(self.up, U), np.array(self.down, U)

    def _folded(self, x: np.ndarray) -> np.ndarray:
        x = (x & self.P) + (x >> U(31))
        x = (x & self.P) + (x >> U(31))
        return np.minimum(x, x - self.P)

    def values(self, raw: np.ndarray) -> np.ndarray:
        out, start = np.zeros(len(raw) + 1, U), 0
        last, p = pow(self.base, _ROW - 1, int(self.P)), int(self.P)
        for first in range(0, len(raw), _PART):
            part = raw[first : first + _PART]
            rows = -(-len(part) // _ROW)
            c = np.zeros(rows * _ROW, U)
            c[: len(part)] = part
            c += U(1)
            sums = self._folded(np.cumsum(c.reshape(rows, _ROW) * self.down, 1, dtype=U))
            before, ends = np.zeros(rows, U), sums[:, -1].tolist()
            for k in range(rows):
                before[k] = start * self.base % p
                start = (int(before[k]) + ends[k]) * last % p
            sums += before[:, None]
            own = self._folded(sums * self.up[:_ROW]).reshape(-1)[: len(part)]
            out[first + 1 : first + 1 + len(part)] = own
            start = int(own[-1])
        return out

    def ranges(self, values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        out = np.empty(len(first), U)
        for k in range(0, len(first), _PART):
            a, b = first[k : k + _PART], last[k : k + _PART]
            out[k : k + _PART] = mix(self._folded(values[b] + self.P - self._folded(values[a] * self.up[b - a])))
        return out


@lru_cache(16)
def short_polynomial(seed: int) -> ShortPolynomial:
    return ShortPolynomial(seed)


FIRST = polynomial(20240229)


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    return FIRST.values(raw)


def range_hash(sums: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return FIRST.ranges(sums, first, last)


def table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


#: Byte classes; all bytes of non-ASCII characters count as parts of words.
BLANK = table(b" \t\n\x0b\x0c\r")
ALNUM = table(b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)))
LETTER = table(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + bytes(range(128, 256)))
NEWLINE = table(b"\n")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Words:
    """Words in order: byte ranges, hashes, and for row i the words ``at[i]:at[i + 1]``."""

    raw: np.ndarray
    first: np.ndarray
    last: np.ndarray
    at: np.ndarray
    hash: np.ndarray

    def word(self, i: int) -> bytes:
        return self.raw[self.first[i] : self.last[i]].tobytes()


def words(raw: np.ndarray, bounds: np.ndarray, inside: np.ndarray, hashed: bool = True) -> Words:
    """Maximal runs of bytes of the class ``inside`` that no row bound cuts through."""
    member = inside[raw]
    begins, ends = member.copy(), member.copy()
    if len(raw):
        begins[1:] &= ~member[:-1]
        ends[:-1] &= ~member[1:]
        edge = bounds[(bounds > 0) & (bounds < len(raw))]
        begins[edge] |= member[edge]
        ends[edge - 1] |= member[edge - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(raw, first, last, np.searchsorted(first, bounds), range_hash(prefix_sums(raw), first, last) if hashed else np.zeros(0, U))


def rows_of(at: np.ndarray) -> np.ndarray:
    """The row of each element, from the rows' bounds."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def within(counts: np.ndarray) -> np.ndarray:
    """0, 1, … up to each count, one after another."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only in local mode, as in tests, may it be unset."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")


#: Paths and tables written by this process that are still there.
_written: dict[str, str | None] = {}
_open: list[list[str]] = []


def stored(df: DataFrame) -> DataFrame:
    """The rows by way of Parquet in the shared folder: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession, table: str | None = None) -> str:
    """A path to write to, removed at the end of the :func:`scratch` around it, or of the process."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    if not _written:
        atexit.register(clear)
    _written[path] = table
    if _open:
        _open[-1].append(path)
    return path


def clear(paths: list[str] | None = None) -> None:
    """Removes what :func:`stored` wrote: these paths, or all that are left."""
    spark = SparkSession.getActiveSession()
    for path in list(_written) if paths is None else paths:
        table = _written.pop(path, None)
        if spark is None or spark.sparkContext._jsc is None:
            continue
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished steps, which otherwise stay until the driver happens to collect garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def scratch() -> Iterator[list[str]]:
    """What is stored inside is removed at the end, but for the paths that the body takes out of the list."""
    paths: list[str] = []
    _open.append(paths)
    try:
        yield paths
    finally:
        _open.remove(paths)
        clear(paths)


def kept(paths: list[str], df: DataFrame) -> DataFrame:
    """``df`` stored beyond the end of the scratch ``paths``, until the process ends."""
    out = stored(df)
    paths.pop()
    return out


#: A bitmap of :func:`held` has at most so many bits (4 MB), in rows of ``_MAP`` bits.
MOST_BITS, _MAP = 1 << 25, 1 << 15


def held(df: DataFrame, ids: DataFrame, inside: bool = True) -> DataFrame:
    """The rows of ``df`` whose doc_id may be among the stored ``ids`` (one column), or those whose doc_id surely isn't.

    By a bitmap of hashes, with 32 bits or more for each id up to ``MOST_BITS``; it is broadcast, so no text is shuffled for rows that a join would
    drop or leave alone anyway. Beyond, and for about one row in 32, rows may be told to be inside that are not: the join itself decides.
    """
    from pyspark.sql import functions as F

    bits = min(MOST_BITS, max(_MAP, 1 << (32 * ids.count()).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    rows = ids.select(place(ids.columns[0]).alias("at")).distinct().select("at", F.floor(F.col("at") / _MAP).alias("part"))
    # Dealt out first: partial bitmaps of all tasks would be larger than the places.
    maps = rows.repartition("part").groupBy("part").agg(F.bitmap_construct_agg(F.col("at") % _MAP).alias("map"))
    at = place(df["doc_id"])
    byte = F.conv(F.hex(F.substring(maps["map"], (at % _MAP / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    both = (F.floor(at / _MAP) == maps["part"]) & (F.getbit(byte, (at % 8).cast("int")) == 1)
    return df.join(F.broadcast(maps), both, "left_semi" if inside else "left_anti")


def total_bytes(df: DataFrame, column: str) -> int:
    from pyspark.sql import functions as F

    return int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)


_tables: dict[str, np.ndarray] = {}


def char_table(name: str) -> np.ndarray:
    """For each code point: its lower case where that is one character, or whether it is a letter."""
    if not _tables:
        low, letter = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, bool)
        for c in range(0x20000):
            s = chr(c)
            if s.isalpha():
                letter[c] = True
                if len(x := s.lower()) == 1:
                    low[c] = ord(x)
        letter[0x20000:0x32000] = True
        _tables.update(lower=low, letter=letter)
    return _tables[name]


@dataclass
class Points:
    """A slice as code points: lower-cased, with the rows' bounds and the words (runs of letters)."""

    original: np.ndarray
    point: np.ndarray
    bounds: np.ndarray
    words: Words


def points(t: Texts, hashed: bool = True) -> Points:
    count = np.concatenate([[0], np.cumsum((t.raw & 0xC0) != 0x80)])
    bounds = count[t.bounds]
    original = np.frombuffer(t.raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    low = char_table("lower")[original]
    member = char_table("letter")[original]
    begins, ends = member.copy(), member.copy()
    if len(low):
        begins[1:] &= ~member[:-1]
        ends[:-1] &= ~member[1:]
        edge = bounds[(bounds > 0) & (bounds < len(low))]
        begins[edge] |= member[edge]
        ends[edge - 1] |= member[edge - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    h = range_hash(prefix_sums(low), first, last) if hashed else np.zeros(0, U)
    return Points(original, low, bounds, Words(low, first, last, np.searchsorted(first, bounds), h))


def sampled(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """All rows, or, of more than ``rows``, about so many, picked by a hash of ``keys``: the same ones in each run. Never more than twice as many, whatever repeats."""
    from pyspark.sql import functions as F

    total = df.count()
    if total <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) < int((1 << 30) * rows / total)).limit(2 * rows)

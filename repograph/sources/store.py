"""A versioned store of Parquet tables that are rewritten part by part.

Rows are dealt to ``PARTS`` parts by a hash of their file. A refresh writes the parts
that changed into new folders, then moves a pointer to a list of all parts;
readers see the former state until then. The former state's parts stay, older ones are removed.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCHEMA_VERSION = 2
POINTER = "CURRENT"
PARTS = 64


@dataclass
class Manifest:
    root: str
    tables: dict[str, dict]  # name: schema (JSON) and parts (number: folder below the index)
    facts: dict = field(default_factory=dict)
    before: list[str] = field(default_factory=list)

    def folders(self) -> set[str]:
        return {p for t in self.tables.values() for p in t["parts"].values()}


def _hadoop(spark: SparkSession, path: str):
    fs = spark._jvm.org.apache.hadoop.fs
    place = fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    place, fs = _hadoop(spark, path)
    out = fs.create(place, True)
    out.write(bytearray(text.encode()))
    out.close()


def _read_text(spark: SparkSession, path: str) -> str | None:
    place, fs = _hadoop(spark, path)
    if not fs.exists(place):
        return None
    into = fs.open(place)
    try:
        return bytes(into.readAllBytes()).decode("utf-8", "replace")
    finally:
        into.close()


def _delete(spark: SparkSession, path: str) -> None:
    place, fs = _hadoop(spark, path)
    fs.delete(place, True)


def _names(spark: SparkSession, path: str) -> list[str]:
    place, fs = _hadoop(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []


def part_of(path: Column) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(PARTS)).cast("int")


def write(spark: SparkSession, index_dir: str, own: Manifest, name: str, df: DataFrame, order: list[str], prior: Manifest | None = None, touched: list[int] | None = None) -> None:
    """Writes a table with a file_path into ``own``, which isn't seen before it is published.

    Given ``prior``, ``df`` holds the rows of the ``touched`` parts only, and the others are taken over. Within a
    part, rows are sorted by ``order``, so that filters on these columns skip row groups.
    """
    path = f"{uuid.uuid4().hex}/{name}"
    dealt = df.withColumn("part", part_of(F.col("file_path"))).repartition("part").sortWithinPartitions("part", *order)
    dealt.write.partitionBy("part").parquet(f"{index_dir}/{path}")
    parts = {k: v for k, v in prior.tables[name]["parts"].items() if int(k) not in (touched or [])} if prior else {}
    parts |= {n.removeprefix("part="): f"{path}/{n}" for n in _names(spark, f"{index_dir}/{path}") if n.startswith("part=")}
    own.tables[name] = {"schema": df.schema.json(), "parts": parts}


def publish(spark: SparkSession, index_dir: str, own: Manifest, prior: Manifest | None = None) -> None:
    """Moves the pointer; what neither this nor the former state names is removed."""
    own.before = sorted(prior.folders()) if prior else []
    told = {"schema": SCHEMA_VERSION, "root": own.root, "tables": own.tables, "facts": own.facts, "before": own.before}
    name = f"{index_dir}/{POINTER}.{uuid.uuid4().hex}"
    _write_text(spark, name, json.dumps(told))
    jvm = spark._jvm
    fresh, _ = _hadoop(spark, name)
    old, _ = _hadoop(spark, f"{index_dir}/{POINTER}")
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(old.toUri(), spark._jsc.hadoopConfiguration()).rename(fresh, old, how)
    if prior:
        _forget(spark, index_dir, set(prior.before) - prior.folders() - own.folders())


def _forget(spark: SparkSession, index_dir: str, folders: set[str]) -> None:
    """Removes parts, and what they leave empty."""
    for folder in folders:
        _delete(spark, f"{index_dir}/{folder}")
    for above in {f.rsplit("/", 1)[0] for f in folders}:
        if not any(n.startswith("part=") for n in _names(spark, f"{index_dir}/{above}")):
            _delete(spark, f"{index_dir}/{above}")
    for version in {f.split("/")[0] for f in folders}:
        if not _names(spark, f"{index_dir}/{version}"):
            _delete(spark, f"{index_dir}/{version}")


def manifest(spark: SparkSession, index_dir: str, root: str) -> tuple[Manifest | None, str]:
    """The manifest and "loaded", or None and why not: missing, corrupt, stale-schema, wrong-root."""
    told = _read_text(spark, f"{index_dir}/{POINTER}")
    if told is None:
        return None, "missing"
    try:
        meta = json.loads(told)
        if meta["schema"] != SCHEMA_VERSION:
            return None, "stale-schema"
        own = Manifest(meta["root"], meta["tables"], meta["facts"], meta["before"])
        folders = own.folders()
    except (ValueError, KeyError, TypeError, AttributeError):
        return None, "corrupt"
    if own.root != root:
        return None, "wrong-root"
    there = {f"{above}/{n}" for above in {f.rsplit("/", 1)[0] for f in folders} for n in _names(spark, f"{index_dir}/{above}")}
    return (own, "loaded") if folders <= there else (None, "corrupt")


def table(spark: SparkSession, index_dir: str, own: Manifest, name: str, parts: list[int] | None = None) -> DataFrame:
    """A table's rows, or those of some parts."""
    schema = StructType.fromJson(json.loads(own.tables[name]["schema"]))
    paths = [f"{index_dir}/{p}" for k, p in sorted(own.tables[name]["parts"].items()) if parts is None or int(k) in parts]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def load(spark: SparkSession, index_dir: str, root: str) -> tuple[dict[str, DataFrame] | None, str]:
    own, why = manifest(spark, index_dir, root)
    return ({n: table(spark, index_dir, own, n) for n in own.tables} if own else None), why


def clear(spark: SparkSession, index_dir: str) -> None:
    """Removes what the pointer names, and the pointer; other files in the folder stay."""
    told = _read_text(spark, f"{index_dir}/{POINTER}")
    if told is None:
        return
    try:
        meta = json.loads(told)
        own = Manifest(meta["root"], meta["tables"], {}, meta["before"])
        _forget(spark, index_dir, own.folders() | set(own.before))
    except (ValueError, KeyError, TypeError, AttributeError):
        pass
    _delete(spark, f"{index_dir}/{POINTER}")

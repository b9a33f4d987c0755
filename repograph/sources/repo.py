"""A source tree as a table: ``spark.read.format("repo").load(root)``.

The driver lists the paths, at most ``maxFiles``; the executors read the
contents, a slice of the list for each partition.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from repograph.sources.ignore import IGNORED_DIRS, SKIPPED_NAME, compile_rules, ignored

MAX_FILES, MAX_FILE_BYTES = 50_000, 1_000_000
SNIFFED = 512
SCHEMA = "file_path string, mtime_ms long, size_bytes long, file_ord long, content string"


def ignore_lines(root: str) -> list[str]:
    try:
        with open(os.path.join(root, ".gitignore"), encoding="utf-8", errors="replace") as f:
            return f.read().splitlines()
    except OSError:
        return []


def is_binary(path: str, size: int) -> bool:
    """A NUL among the first bytes of a file that is longer than these; an unreadable file counts as one."""
    if size <= SNIFFED:
        return False
    try:
        with open(path, "rb") as f:
            return b"\0" in f.read(SNIFFED)
    except OSError:
        return True


def walk(root: str, max_files: int = MAX_FILES, max_bytes: int = MAX_FILE_BYTES, respect_ignore: bool = True) -> tuple[list[tuple[str, int, int]], bool]:
    """[(relative path, mtime_ms, size)] in order of names, and whether more than ``max_files`` were found.

    Links, empty and too large files, binaries, ignored names and ignored
    folders, which aren't entered, are left out.
    """
    rules = compile_rules(ignore_lines(root)) if respect_ignore else []
    found: list[tuple[str, int, int]] = []
    pending = [""]
    while pending:
        here = pending.pop()
        path = os.path.join(root, here) if here else root
        info = os.lstat(path)
        if os.path.isdir(path) and not os.path.islink(path):
            try:
                names = sorted(os.listdir(path), key=lambda n: (n.lower(), n), reverse=True)
            except OSError:
                continue
            for name in names:
                below = f"{here}/{name}" if here else name
                folder = os.path.isdir(os.path.join(root, below))
                hidden = folder and (name in IGNORED_DIRS or (name.startswith(".") and name != ".github"))
                if not hidden and not os.path.islink(os.path.join(root, below)) and not ignored(rules, below) and (folder or not re.search(SKIPPED_NAME, name)):
                    pending.append(below)
        elif os.path.isfile(path) and 0 < info.st_size <= max_bytes and not is_binary(path, info.st_size):
            if len(found) == max_files:
                return found, True
            found.append((here, int(info.st_mtime * 1000), info.st_size))
    return found, False


@dataclass
class Slice(InputPartition):
    rows: list[tuple[int, str, int, int]]


class RepoReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = os.path.abspath(options["path"])
        self.max_files, self.max_bytes = int(options.get("maxfiles", MAX_FILES)), int(options.get("maxfilebytes", MAX_FILE_BYTES))
        self.respect = options.get("respectgitignore", "true").lower() == "true"
        self.each = int(options.get("filesperpartition", 500))

    def partitions(self) -> list[InputPartition]:
        rows = [(k, *row) for k, row in enumerate(walk(self.root, self.max_files, self.max_bytes, self.respect)[0])]
        return [Slice(rows[k : k + self.each]) for k in range(0, len(rows), self.each)] or [Slice([])]

    def read(self, part: Slice) -> Iterator[tuple]:
        for k, path, mtime, size in part.rows:
            try:
                with open(os.path.join(self.root, path), encoding="utf-8", errors="replace") as f:
                    content = f.read()
            except OSError:
                content = None
            yield path, mtime, size, k, content


class RepoSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repo"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return RepoReader({k.lower(): v for k, v in self.options.items()})


def read_repo(spark: SparkSession, root: str, **options) -> DataFrame:
    spark.dataSource.register(RepoSource)
    return spark.read.format("repo").options(**options).load(root)


def listing(spark: SparkSession, root: str, **options) -> tuple[DataFrame, bool]:
    """(file_path, mtime_ms, size_bytes) without contents, and whether there are more files than ``max_files``."""
    rows, truncated = walk(root, **options)
    return spark.createDataFrame(rows, "file_path string, mtime_ms long, size_bytes long"), truncated


def contents(files: DataFrame, root: str, each: int = 500) -> DataFrame:
    """``files`` with content, read on the executors; null where a file is gone meanwhile."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = []
            for path in rows["file_path"]:
                try:
                    with open(os.path.join(root, path), encoding="utf-8", errors="replace") as f:
                        found.append(f.read())
                except OSError:
                    found.append(None)
            yield rows.assign(content=found)

    dealt = files.repartition(max(1, -(-files.count() // each)), "file_path")
    return dealt.mapInPandas(run, StructType([*files.schema.fields, StructField("content", StringType())]))

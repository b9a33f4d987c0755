"""The operators over one source tree and its stored index."""

from __future__ import annotations

import os
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repograph.functions import text as T
from repograph.operators import extract, graph, incremental, lookup, search
from repograph.sources import repo, store

LEXICAL = "lexical"
#: How a part's rows lie, so that filters by name, target or token skip row groups.
ORDER = {"symbols": ["name"], "ref_lines": ["name"], "edges": ["dst"], "postings": ["token"], "files": ["file_path"], "chunks": ["file_path", "start_line"]}
BY_FILE = ("files", "symbols", "chunks", "ref_lines", "specs", "postings")


class Embedder(Protocol):
    """Vectors of texts; sent to the executors. ``kind`` names the model."""

    kind: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


@dataclass(frozen=True)
class Outcome:
    mode: str
    added: int = 0
    changed: int = 0
    removed: int = 0
    truncated: bool = False

    @property
    def any(self) -> bool:
        return bool(self.added or self.changed or self.removed)


class Engine:
    def __init__(self, spark: SparkSession, root: str, index_dir: str, embedder: Embedder | None = None, extraction: str = "auto", **options) -> None:
        """``extraction``: "auto" or "patterns", see :func:`extract.scan`. Options: max_files, max_bytes, respect_ignore."""
        self.spark, self.root, self.index_dir, self.options = spark, os.path.abspath(root), index_dir, options
        self.embedder, self.extraction = embedder, extraction
        self._manifest: store.Manifest | None = None
        if not os.path.isdir(self.root):
            raise ValueError(f"{root} is no folder")

    @property
    def kind(self) -> str:
        return self.embedder.kind if self.embedder else LEXICAL

    def _of_files(self, files: DataFrame, held: list[DataFrame]) -> dict[str, DataFrame]:
        """The tables of (file_path, mtime_ms, size_bytes), whose contents are read here."""
        # Kept for the tables that are written from it.
        found = extract.extract(repo.contents(files, self.root), self.extraction).persist()
        held.append(found)
        chunks = extract.chunks(found)
        if self.embedder:
            chunks = search.embed(chunks, self.embedder.embed, "content", "symbol_name")
        language = T.language_of(F.element_at(F.split("file_path", "/"), -1))
        tables = {"symbols": extract.symbols(found), "chunks": chunks, "ref_lines": extract.ref_lines(found), "specs": extract.specs(found).withColumnRenamed("src", "file_path")}
        tables["postings"] = search.postings(chunks.withColumn("__key", F.struct("file_path", "chunk_id")), "__key", "content", "symbol_name").select("__key.*", "token", "n", "total")
        tables["files"] = incremental.chunk_counts(files.withColumn("language", language), extract.chunks(found)).select("file_path", "language", "mtime_ms", "size_bytes", "chunk_count")
        return tables

    def _edges(self, specs: DataFrame, files: DataFrame) -> DataFrame:
        """Resolved anew from all imports, so a file that appears later mends them. The file of an edge is its target."""
        resolved = graph.resolve(specs.withColumnRenamed("file_path", "src"), files.select(F.col("file_path").alias("path")))
        return graph.edges(resolved).withColumn("file_path", F.col("dst"))

    def index(self) -> Outcome:
        """Builds the index, or renews the parts that hold changed files; nothing is extracted or written where nothing changed."""
        listing, truncated = repo.listing(self.spark, self.root, **self.options)
        prior, _ = store.manifest(self.spark, self.index_dir, self.root)
        facts = {"truncated": truncated, "embedder": self.kind, "extraction": self.extraction, "indexed_at": time.time()}
        if prior is not None and any(prior.facts.get(k) != facts[k] for k in ("embedder", "extraction")):
            prior = None  # made in another way; its parts go with the next but one state
        old = lambda name, parts=None: store.table(self.spark, self.index_dir, prior, name, parts)
        new, held = store.Manifest(self.root, {}, facts), []
        try:
            if prior is None:
                outcome, every = Outcome("fresh", added=listing.count(), truncated=truncated), None
                tables = self._of_files(listing, held)
            else:
                changes = incremental.diff(old("files"), listing).persist()
                held.append(changes)
                count = {r["change"]: r["n"] for r in changes.groupBy("change").agg(F.count("*").alias("n")).collect()}
                outcome = Outcome("incremental", *(count.get(k, 0) for k in ("added", "changed", "removed")), truncated)
                if not outcome.any:
                    self._manifest = prior
                    return outcome
                # At most PARTS numbers.
                every = [r["part"] for r in changes.select(store.part_of(F.col("file_path")).alias("part")).distinct().collect()]
                fresh = self._of_files(listing.join(changes.where("change <> 'removed'").select("file_path"), "file_path", "left_semi"), held)
                tables = {n: incremental.merge(old(n, every), fresh[n], changes) for n in BY_FILE}
            # Side by side, as each is a few small jobs after a change.
            with ThreadPoolExecutor(len(BY_FILE)) as pool:
                list(pool.map(lambda name: store.write(self.spark, self.index_dir, new, name, tables[name], ORDER.get(name, []), prior, every), BY_FILE))
            edges = self._edges(*(store.table(self.spark, self.index_dir, new, n) for n in ("specs", "files")))
            store.write(self.spark, self.index_dir, new, "edges", edges, ORDER["edges"])
            store.publish(self.spark, self.index_dir, new, prior)
        finally:
            for df in held:
                df.unpersist()
        self._manifest = new
        return outcome

    def ensure_index(self) -> Outcome:
        """The stored index as it is ("restored"), or a fresh one where there is none that can be used."""
        own, _ = store.manifest(self.spark, self.index_dir, self.root)
        if own is None or own.facts.get("embedder") != self.kind:
            return self.index()
        self._manifest = own
        return Outcome("restored", truncated=bool(own.facts.get("truncated")))

    def table(self, name: str) -> DataFrame:
        if self._manifest is None:
            self._manifest, why = store.manifest(self.spark, self.index_dir, self.root)
            if self._manifest is None:
                raise LookupError(f"No index for {self.root} ({why}). Call index first.")
        return store.table(self.spark, self.index_dir, self._manifest, name)

    def reload(self) -> None:
        """Looks for a newer state at the next question."""
        self._manifest = None

    def clear(self) -> None:
        store.clear(self.spark, self.index_dir)
        self._manifest = None

    def search(self, query: str, limit: int = 20) -> DataFrame:
        """Hybrid with an embedder, else lexical, by the stored postings."""
        chunks, postings = self.table("chunks"), self.table("postings")
        if self.embedder and "embedding" in chunks.columns:
            found = search.indexed_hybrid_search(chunks, postings, query, self.embedder.embed([query])[0], "chunk_id", "embedding", "symbol_name", limit)
        else:
            found = search.indexed_search(chunks, postings, query, "chunk_id", "symbol_name", limit)
        return found.select("chunk_id", "file_path", "start_line", "end_line", "symbol_name", "symbol_kind", "score", "matched_by", T.first_lines(F.col("content")).alias("snippet"))

    def definition(self, name: str) -> DataFrame:
        return lookup.definition(self.table("symbols"), name).orderBy("file_path", "line")

    def references(self, name: str) -> DataFrame:
        """All uses by file, those in defining files too."""
        return lookup.ordered(lookup.references(self.table("ref_lines"), name))

    def file_impact(self, path: str, max_depth: int = 5) -> DataFrame:
        """(node, depth); without rows if nothing imports the file or it is unknown."""
        return graph.dependents(self.table("edges"), path, max_depth)

    def breakages(self, path: str) -> DataFrame:
        return graph.breakages(self.table("symbols"), self.table("edges"), path)

    def symbol_impact(self, name: str) -> DataFrame:
        symbols = self.table("symbols")
        if symbols.where(F.col("name") == name).isEmpty():
            near = self._near(name, 4)
            raise LookupError(f"Symbol '{name}' not found in the index." + (f" Did you mean: {near}?" if near else " Re-index if the codebase changed."))
        return graph.symbol_impact(symbols, self.table("ref_lines"), self.table("edges"), name)

    def _near(self, name: str, chars: int | None = None) -> str:
        own = self.table("symbols").withColumn("sym_ord", F.struct("file_path", "line"))
        return ", ".join(r["suggestion"] for r in lookup.suggest(own, name, chars=chars).collect())

    def target(self, target: str) -> str | None:
        """The indexed file that the target names, by its path in the tree or an absolute one."""
        path = os.path.normpath(os.path.relpath(target, self.root) if os.path.isabs(target) else target)
        return None if self.table("files").where(F.col("file_path") == path).isEmpty() else path

    def impact(self, target: str, max_depth: int = 5, most: int = 10_000) -> dict:
        """What a change of a file or symbol affects: target, kind, direct, transitive, total, breakages. Lists hold at most ``most`` entries; the total counts all."""
        path = self.target(target)
        if path is not None:
            found = self.file_impact(path, max_depth).persist()
            count = graph.impact_summary(found).first()
            listed = lambda rows: [r["node"] for r in rows.orderBy("node").limit(most).collect()]
            risk = self.breakages(path).orderBy("symbol", "file_path").limit(most).collect()
            return {"target": path, "kind": "file", "direct": listed(found.where("depth = 1")), "transitive": listed(found.where("depth > 1")), "total": count["total"], "max_depth": max_depth, "breakages": [r.asDict() for r in risk]}
        if self.table("symbols").where(F.col("name") == target).isEmpty():
            near = self._near(target)
            raise LookupError(f"Target '{target}' not found as a file or symbol in {self.root}." + (f" Did you mean one of: {near}?" if near else " Call index first if the codebase changed."))
        found = self.symbol_impact(target).persist()
        outside = found.where("relation <> 'definition'").select("file_path").distinct()
        order = F.expr("array_position(array('definition', 'usage', 'importer'), relation)")
        risk = found.orderBy(order, "file_path", "line").limit(most).collect()
        return {"target": target, "kind": "symbol", "direct": [r["file_path"] for r in outside.orderBy("file_path").limit(most).collect()], "transitive": [], "total": outside.count(), "max_depth": max_depth, "breakages": [r.asDict() for r in risk]}

    def candidates(self, query: str = "", limit: int = 200) -> DataFrame:
        symbols = self.table("symbols").withColumn("sym_ord", F.struct("file_path", "line"))
        return lookup.rank(lookup.candidates(symbols, self.table("files").withColumnRenamed("file_path", "rel_path")), query, limit)

    def status(self) -> dict:
        """Counts and how the index was made; {"indexed": False, …} where there is none."""
        try:
            count = lookup.stats(files=self.table("files"), chunks=self.table("chunks"), symbols=self.table("symbols"), references=self.table("ref_lines").select("name", "file_path").distinct()).first().asDict()
        except LookupError:
            return {"indexed": False, "root": self.root, "hint": "Call index to build a local index."}
        facts = self._manifest.facts
        when = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(facts["indexed_at"]))
        told = {"auto": "syntax where a language has it, line patterns elsewhere", "patterns": "line patterns"}
        return {"indexed": True, "root": self.root, **count, "extraction": told[facts["extraction"]], "embedder": facts["embedder"], "indexed_at": when, "truncated": facts["truncated"], "index_dir": self.index_dir}

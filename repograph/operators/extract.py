"""Symbols, chunks, uses and imports of files, in one pass over each content.

Which pattern claims a line depends on the names found above it, which no
column expression can say; so a file is scanned in Python, by Arrow batches.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repograph.functions import text as T
from repograph.operators import syntax

BLOCK_LINES, SYMBOL_LINES, TITLE_CHARS = 60, 240, 80

# Fixed values: (kind, pattern) by language, tried in this order.
_SCRIPT = [
    ("interface", r"^\s*(?:export\s+)?interface\s+([A-Za-z_$][\w$]*)"),
    ("type", r"^\s*(?:export\s+)?type\s+([A-Za-z_$][\w$]*)\s*[=<]"),
    ("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)"),
    ("enum", r"^\s*(?:export\s+)?enum\s+([A-Za-z_$][\w$]*)"),
    ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s+([A-Za-z_$][\w$]*)"),
    ("constant", r"^\s*(?:export\s+)?const\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)?\s*=>"),
    ("constant", r"^\s*(?:export\s+)?const\s+([A-Z_$][A-Z0-9_$]*)\s*="),
    ("method", r"^\s{2,}(?:public\s+|private\s+|protected\s+|static\s+|readonly\s+)*(?:async\s+|get\s+|set\s+)?([a-zA-Z_$][\w$]*)\s*\([^)]*\)\s*[:{]"),
]
PATTERNS = {language: [(kind, re.compile(p, re.A)) for kind, p in own] for language, own in {
    "typescript": _SCRIPT, "javascript": _SCRIPT,
    "python": [("class", r"^\s*class\s+([A-Za-z_]\w*)"), ("function", r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)"), ("constant", r"^([A-Z_][A-Z0-9_]*)\s*=")],
    "go": [("function", r"^func\s+(?:\([^)]*\)\s+)?([A-Za-z_]\w*)\s*\("), ("type", r"^type\s+([A-Za-z_]\w*)\s+(?:struct|interface)"), ("constant", r"^const\s+([A-Za-z_]\w*)")],
    "rust": [("function", r"^\s*(?:pub\s+)?(?:async\s+)?fn\s+([a-z_]\w*)"), ("struct", r"^\s*(?:pub\s+)?struct\s+([A-Za-z_]\w*)"), ("trait", r"^\s*(?:pub\s+)?trait\s+([A-Za-z_]\w*)"), ("enum", r"^\s*(?:pub\s+)?enum\s+([A-Za-z_]\w*)")],
    "java": [("class", r"^\s*(?:public\s+|private\s+|protected\s+)?(?:abstract\s+|final\s+|static\s+)*class\s+([A-Za-z_]\w*)"), ("interface", r"^\s*(?:public\s+)?interface\s+([A-Za-z_]\w*)"), ("enum", r"^\s*(?:public\s+)?enum\s+([A-Za-z_]\w*)")],
    "ruby": [("class", r"^\s*class\s+([A-Za-z_]\w*)"), ("method", r"^\s*def\s+([a-z_]\w*[?!]?)"), ("constant", r"^\s*([A-Z][A-Z0-9_]*)\s*=")],
}.items()}
_EXPORTS = re.compile(r"^\s*export\s")
_HEADING = re.compile(r"^#{1,3}\s")
_SCRIPT_IMPORT = re.compile(r"""import\s+(?:[^'"]*?\s+from\s+)?['"]([^'"]+)['"]""")
_PYTHON_IMPORT = re.compile(r"from\s+([\w.]+)\s+import|import\s+([\w.]+)", re.A)

_WORD = re.compile(r"[A-Za-z_$][\w$]*", re.A)

SYMBOL = "struct<name: string, kind: string, line: int, end_line: int, exported: boolean>"
CHUNK = "struct<kind: string, symbol_name: string, symbol_kind: string, start_line: int, end_line: int, content: string>"
SCHEMA = f"file_path string, language string, symbols array<{SYMBOL}>, chunks array<{CHUNK}>, ref_lines array<struct<name: string, line: int>>, specs array<struct<spec: string, candidates: array<string>>>"


def exported_names(lines: list[str]) -> set[str]:
    """Every identifier of the lines that begin with export."""
    return {w for line in lines if _EXPORTS.match(line) for w in _WORD.findall(line)}


def scan_symbols(lines: list[str], language: str) -> list[dict]:
    """In each line the first pattern with a name of two characters that the file hasn't had; a symbol ends before the next, the last at the end. One without any text is none."""
    out, seen, public = [], set(), exported_names(lines)
    for k, line in enumerate(lines):
        for kind, pattern in PATTERNS.get(language, ()):
            m = pattern.match(line)
            if m and len(m[1]) > 1 and m[1] not in seen:
                seen.add(m[1])
                out.append({"name": m[1], "kind": kind, "line": k + 1, "end_line": len(lines), "exported": m[1] in public})
                break
    for a, b in zip(out, out[1:]):
        a["end_line"] = min(b["line"] - 1, a["line"] + SYMBOL_LINES - 1)
    return out


def _chunk(kind, name, sort, first, last, content) -> list[dict]:
    return [{"kind": kind, "symbol_name": name, "symbol_kind": sort, "start_line": first, "end_line": last, "content": content}] if content.strip() else []


def scan_chunks(lines: list[str], language: str, symbols: list[dict]) -> list[dict]:
    """A chunk for each symbol; else, in Markdown, for each section; else blocks of lines. Blank ones are dropped."""
    out: list[dict] = []
    if symbols:
        for s in symbols:
            out += _chunk("symbol", s["name"], s["kind"], s["line"], min(s["end_line"], len(lines)), "\n".join(lines[s["line"] - 1 : s["end_line"]]))
        return out
    heads = [k for k, line in enumerate(lines) if _HEADING.match(line)] if language == "markdown" else []
    for a, b in zip(heads, [*heads[1:], len(lines)]):
        title = re.sub(r"^#+\s*", "", lines[a])[:TITLE_CHARS]
        out += _chunk("prose", title or None, None, a + 1, b, "\n".join(lines[a:b]).strip())
    if not heads:
        for a in range(0, len(lines), BLOCK_LINES):
            out += _chunk("block", None, None, a + 1, min(a + BLOCK_LINES, len(lines)), "\n".join(lines[a : a + BLOCK_LINES]))
    return out


def scan(content: str, language: str, mode: str = "auto") -> tuple[list[dict], list[dict], list[dict]]:
    """(symbols, chunks, uses). ``mode``: "auto" reads tokens where the language allows it and line patterns elsewhere; "patterns" has line patterns only, and no uses."""
    found, uses = syntax.scan(content, language) if mode == "auto" else (None, None)
    lines = content.split("\n")
    if found is None:
        found = scan_symbols(lines, language)
    return found, scan_chunks(lines, language, found), uses or []


def candidates(path: str, spec: str, language: str) -> list[str]:
    """The paths that an import may mean, best first; none if it doesn't point into the tree."""
    if language == "python":
        parts = spec.split(".")
        heads = ["/".join(parts[:n]) for n in range(len(parts), 0, -1)] if parts[0] else []
        return [p for h in heads for p in (h + ".py", h + "/__init__.py")]
    if not spec.startswith((".", "/")):
        return []
    base = posixpath.normpath(posixpath.join(posixpath.dirname(path), spec))
    stem, ext = posixpath.splitext(base)
    bases = {".js": [stem + ".ts", stem + ".tsx", base], ".jsx": [stem + ".tsx", base]}.get(ext, [base])
    scripts = (".ts", ".tsx", ".js", ".jsx")
    ends = ["", *scripts, ".mjs", *("/index" + e for e in scripts), ".py", "/__init__.py"]
    return [b + e for b in bases for e in ends]


def scan_imports(path: str, content: str, language: str) -> list[dict]:
    if language in ("typescript", "javascript"):
        specs = _SCRIPT_IMPORT.findall(content)
    elif language == "python":
        specs = [a or b for a, b in _PYTHON_IMPORT.findall(content)]
    else:
        specs = []
    return [{"spec": s, "candidates": c} for s in dict.fromkeys(specs) if (c := candidates(path, s, language))]


def extract(files: DataFrame, mode: str = "auto") -> DataFrame:
    """Per row of (file_path, content): language, symbols, chunks, ref_lines, specs. Null and empty contents give no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content, language in zip(batch["file_path"], batch["content"], batch["language"]):
                found, own, uses = scan(content, language, mode)
                rows.append((path, language, found, own, uses, scan_imports(path, content, language)))
            yield pd.DataFrame(rows, columns=["file_path", "language", "symbols", "chunks", "ref_lines", "specs"])

    base = F.element_at(F.split("file_path", "/"), -1)
    return files.where("content <> ''").select("file_path", "content", T.language_of(base).alias("language")).mapInPandas(run, SCHEMA)


def symbols(found: DataFrame) -> DataFrame:
    return found.select("file_path", F.explode("symbols").alias("s")).select("s.name", "s.kind", "file_path", "s.line", "s.end_line", "s.exported", F.struct("file_path", "s.line").alias("sym_ord"))


def chunks(found: DataFrame) -> DataFrame:
    own = found.select("file_path", "language", F.explode("chunks").alias("c")).select("file_path", "language", "c.*")
    named = F.when(F.col("kind") == "symbol", F.col("symbol_name")).when(F.col("kind") == "prose", "md").otherwise("block")
    return own.withColumn("chunk_id", F.concat("file_path", F.lit("#"), named, F.lit("@"), "start_line"))


def ref_lines(found: DataFrame) -> DataFrame:
    return found.select("file_path", F.explode("ref_lines").alias("r")).select("r.name", "file_path", "r.line")


def specs(found: DataFrame) -> DataFrame:
    return found.select(F.col("file_path").alias("src"), F.explode("specs").alias("s")).select("src", "s.spec", "s.candidates")

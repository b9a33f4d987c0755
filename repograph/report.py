"""Results as Markdown, JSON and plain text. All take rows that a caller has bounded."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

CHARACTER_LIMIT = 25_000


def truncated(text: str, limit: int = CHARACTER_LIMIT) -> str:
    return text if len(text) <= limit else text[:limit] + "\n…(truncated; use a narrower query or lower limit)"


def _json(value) -> str:
    return truncated(json.dumps(value, indent=2, ensure_ascii=False))


def _listed(title: str, items: Iterable[str]) -> list[str]:
    own = [f"- {x}" for x in items]
    return [title, *own, ""] if own else []


def hits(rows: list[Mapping], form: str = "markdown") -> str:
    """Rows with file_path, start_line, end_line, symbol_name, symbol_kind, score, matched_by, snippet."""
    if form == "json":
        return _json({"total": len(rows), "hits": [
            {"file": r["file_path"], "lines": f"{r['start_line']}-{r['end_line']}", "symbol": r["symbol_name"], "symbolKind": r["symbol_kind"], "score": round(r["score"], 4), "matchedBy": r["matched_by"]} for r in rows
        ]})
    out = [f"# Search results ({len(rows)})", ""]
    for r in rows:
        symbol = f" — {r['symbol_name']} ({r['symbol_kind']})" if r["symbol_name"] else ""
        out += [f"## {r['file_path']}:{r['start_line']}{symbol}", f"score {r['score']:.3f} · matched by {r['matched_by']}", "", "```", r["snippet"], "```", ""]
    return truncated("\n".join(out))


def _summary(report: Mapping) -> str:
    return f"Files affected: {report['total']} (direct: {len(report['direct'])}, transitive: {len(report['transitive'])})"


def _place(b: Mapping) -> str:
    return b["file_path"] + (f":{b['line']}" if b["line"] else "")


def impact(report: Mapping, form: str = "markdown") -> str:
    """A report with target, kind (file or symbol), direct, transitive, total, breakages (symbol, kind, file_path, line, reason)."""
    if form == "json":
        return _json({
            "target": report["target"], "targetKind": report["kind"], "directDependents": report["direct"], "transitiveDependents": report["transitive"], "totalFilesAffected": report["total"],
            "symbolBreakages": [{"symbol": b["symbol"], "kind": b["kind"], "file": b["file_path"], **({"line": b["line"]} if b["line"] else {}), "reason": b["reason"]} for b in report["breakages"]],
        })
    out = [f"# Impact of changing {report['target']}", "", _summary(report), ""]
    out += _listed("## Direct dependents (break first)", report["direct"]) or ["No direct dependents. This target is a leaf.", ""]
    out += _listed("## Transitive dependents (may break indirectly)", report["transitive"])
    out += _listed("## Symbols at risk", (f"**{b['symbol']}** ({b['kind'] or '?'}) — {_place(b)} — {b['reason']}" for b in report["breakages"]))
    if not report["total"]:
        out.append("Nothing references this target inside the index. Safe to change locally.")
    return truncated("\n".join(out))


def plain_impact(report: Mapping) -> list[str]:
    indented = lambda title, items: [title, *(f"  {x}" for x in items)]
    out = [f"Impact of changing {report['target']}", _summary(report), ""]
    out += indented("Breaks first:", report["direct"]) if report["direct"] else ["Nothing references this target. Safe to change."]
    if report["transitive"]:
        out += ["", *indented("May break indirectly:", report["transitive"])]
    if report["breakages"]:
        out += ["", *indented("Symbols at risk:", (f"{b['symbol']} ({b['kind'] or '?'}) — {_place(b)} — {b['reason']}" for b in report["breakages"]))]
    return out


def references(symbol: str, rows: list[Mapping], form: str = "markdown") -> str:
    """Rows with file_path, lines, count."""
    if not rows:
        return f"No references to '{symbol}' in the index. Check the name, or re-index if the codebase changed."
    total = sum(r["count"] for r in rows)
    if form == "json":
        return _json({"symbol": symbol, "total": total, "files": [{"file": r["file_path"], "lines": list(r["lines"]), "count": r["count"]} for r in rows]})
    plural = lambda n: "" if n == 1 else "s"
    head = f"# {symbol} — {total} reference{plural(total)} in {len(rows)} file{plural(len(rows))}"
    return truncated("\n".join([head, "", *(f"- {r['file_path']}:{', '.join(map(str, r['lines']))} ({r['count']}×)" for r in rows)]))


def definitions(symbol: str, rows: list[Mapping], form: str = "markdown") -> str:
    if not rows:
        return f"'{symbol}' is not defined in the index. Check the name, or re-index if the codebase changed."
    if form == "json":
        return _json({"symbol": symbol, "definitions": [{"file": r["file_path"], "line": r["line"], "endLine": r["end_line"], "kind": r["kind"], "exported": r["exported"]} for r in rows]})
    return truncated("\n".join([f"# {symbol}", "", *(f"- {r['file_path']}:{r['line']}-{r['end_line']} — {r['kind']}{' (exported)' if r['exported'] else ''}" for r in rows)]))


def status(facts: Mapping, form: str = "markdown") -> str:
    return _json(dict(facts)) if form == "json" else "\n".join(["# status", "", *(f"- **{k}**: {str(v).lower() if isinstance(v, bool) else v}" for k, v in facts.items())])


def index_summary(s: Mapping, form: str = "markdown") -> str:
    """root, mode, files, chunks, symbols, changed, added, removed, truncated, embedder, duration_ms."""
    if form == "json":
        return _json(dict(s))
    parts = f" (+{s['added']} added, ~{s['changed']} changed, -{s['removed']} removed)" if s["mode"] == "incremental" else ""
    out = [f"# Indexed {s['root'].rstrip('/').rsplit('/', 1)[-1] or s['root']}", "", f"- Files: {s['files']}", f"- Chunks: {s['chunks']}", f"- Symbols: {s['symbols']}", f"- Update: {s['mode']}{parts}", f"- Embedder: {s['embedder']}", f"- Took: {s['duration_ms']}ms"]
    return "\n".join(out + (["- More files than max_files: the rest isn't indexed"] if s["truncated"] else []))


def plain_index_summary(s: Mapping) -> list[str]:
    return [f"Indexed {s['files']} files", f"{s['symbols']} symbols · {s['references']} references", f"Extraction: {s['extraction']}", f"Took {s['duration_ms']}ms"]

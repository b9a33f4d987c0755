"""``python -m repograph COMMAND [TARGET] --path ROOT --index DIR [--format markdown|json|plain]``"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from repograph import inputs, report
from repograph.engine import Engine

#: Commands, and whether they need a target.
COMMANDS = {"index": False, "search": True, "references": True, "definition": True, "impact": True, "report": True, "candidates": False, "status": False, "clear": False}


def run(engine: Engine, command: str, target: str, form: str, limit: int, depth: int) -> str:
    rows = lambda df: [r.asDict() for r in df.collect()]  # noqa: E731  (bounded by a limit, or by one name's files)
    kind = {"response_format": form} if form != "plain" else {}
    if command == "index":
        inputs.IndexRequest(path=engine.root, **kind)
        began = time.time()
        outcome = engine.index()
        facts = engine.status() | vars(outcome) | {"duration_ms": int(1000 * (time.time() - began))}
        return "\n".join(report.plain_index_summary(facts)) if form == "plain" else report.index_summary(facts, form)
    if command == "clear":
        engine.clear()
        return "cleared"
    engine.ensure_index()
    if command == "search":
        inputs.SearchRequest(query=target, limit=limit, **kind)
        return report.hits(rows(engine.search(target, limit)), form)
    if command == "references":
        inputs.ReferencesRequest(symbol=target, **kind)
        return report.references(target, rows(engine.references(target)), form)
    if command == "definition":
        inputs.DefinitionRequest(symbol=target, **kind)
        return report.definitions(target, rows(engine.definition(target)), form)
    if command in ("impact", "report"):
        inputs.ImpactRequest(target=target, max_depth=depth, **kind)
        found = engine.impact(target, depth)
        return "\n".join(report.plain_impact(found)) if command == "report" or form == "plain" else report.impact(found, form)
    if command == "candidates":
        return "\n".join(f"{r['name']}\t{r['detail']}\t{r['kind']}" for r in rows(engine.candidates(target, limit)))
    inputs.StatusRequest(path=engine.root, **kind)
    return report.status(engine.status(), form)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="repograph")
    p.add_argument("command", choices=list(COMMANDS))
    p.add_argument("target", nargs="?", default="")
    p.add_argument("--path", default=".")
    p.add_argument("--index", default=".repograph")
    p.add_argument("--format", default="markdown", choices=[*inputs.FORMATS, "plain"])
    p.add_argument("--limit", type=int, default=20)
    p.add_argument("--max-depth", type=int, default=5)
    p.add_argument("--max-files", type=int, default=50_000)
    own = p.parse_args(argv)
    if COMMANDS[own.command] and not own.target:
        p.error(f"{own.command} needs a target")
    try:
        inputs.IndexRequest(path=own.path, max_files=own.max_files)
        engine = Engine(SparkSession.builder.appName("repograph").getOrCreate(), own.path, own.index, max_files=own.max_files)
        print(run(engine, own.command, own.target, own.format, own.limit, own.max_depth))
    except (LookupError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())

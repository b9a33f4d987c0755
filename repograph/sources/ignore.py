"""Ignore rules: names that are always skipped, and a root's ignore file."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
IGNORED_DIRS = "node_modules .git dist build out .next .nuxt .turbo .vercel target vendor __pycache__ .venv venv .mypy_cache .pytest_cache coverage .idea .vscode .cache tmp".split()
SKIPPED_SUFFIXES = [".lock", ".log", ".min.js", ".min.map", "package-lock.json", "pnpm-lock.yaml", "yarn.lock"]
SKIPPED_NAME = r"(?i)(\.lock|\.log|\.min\.js|\.min\.map|package-lock\.json|pnpm-lock\.yaml|yarn\.lock|\.env|\.env\.[^/]*)$"


@dataclass(frozen=True)
class Rule:
    pattern: str
    negated: bool
    anchored: bool


def compile_rules(lines: list[str]) -> list[Rule]:
    """Rules in order; without an end anchor, so a rule matches any path that begins with it, and a trailing slash changes nothing."""
    rules = []
    for line in lines:
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        body = line[negated:].rstrip("/")
        anchored = body.startswith("/")
        parts = re.split(r"(\*\*|\*|\?)", body.lstrip("/"))
        told = "".join({"**": ".*", "*": "[^/]*", "?": "."}.get(p, re.sub(r"([.+^${}()|\[\]\\])", r"\\\1", p)) for p in parts)
        try:
            re.compile(told)
        except re.error:
            continue
        rules.append(Rule(("^" if anchored else "(^|/)") + told, negated, anchored))
    return rules


def matches(rules: list[Rule], path: Column) -> Column:
    """The last rule that matches the path, or the base name of unanchored ones, decides."""
    base = F.regexp_replace(path, "^.*/", "")
    verdict = [F.when(path.rlike(r.pattern) | (F.lit(not r.anchored) & base.rlike(r.pattern)), F.lit(not r.negated)) for r in reversed(rules)]
    return F.coalesce(*verdict, F.lit(False))


def ignored(rules: list[Rule], path: str) -> bool:
    base = path.rsplit("/", 1)[-1]
    for r in reversed(rules):
        if re.search(r.pattern, path) or (not r.anchored and re.search(r.pattern, base)):
            return not r.negated
    return False


def skipped_name(name: Column) -> Column:
    return name.rlike(SKIPPED_NAME)

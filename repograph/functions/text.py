"""Column functions over text, identifiers, vectors and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
STOP_WORDS = "the a an and or if then else for of to in on at by is it as with this that be from are we you i".split()
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "go": "go", "rs": "rust", "java": "java", "rb": "ruby", "php": "php", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "cs": "csharp",
    "sh": "shell", "bash": "shell", "zsh": "shell", "md": "markdown", "mdx": "markdown", "json": "json", "yaml": "yaml", "yml": "yaml", "html": "html", "htm": "html", "css": "css", "scss": "css", "less": "css",
}
SOURCE_LANGUAGES = ["typescript", "javascript", "python", "go", "rust", "java", "ruby", "php", "c", "cpp", "csharp"]

#: A token: a longest run of its characters, two or more, that isn't a stop word.
TOKEN = r"(?<![a-z0-9_$])(?!(?:" + "|".join(w for w in STOP_WORDS if len(w) > 1) + r")(?![a-z0-9_$]))[a-z0-9_$]{2,}"


def tokenize(c: Column) -> Column:
    """Lower-case tokens of [a-z0-9_$], longer than one character, without stop words; identifiers stay whole."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def occurrences(tokens: Column, token: str) -> Column:
    return F.size(tokens) - F.size(F.array_remove(tokens, token))


def split_identifier(c: Column) -> Column:
    """Words of an identifier: at case changes, underscores, dollars and hyphens."""
    spaced = F.regexp_replace(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(F.regexp_replace(spaced, "[_$-]", " ")), r"\s+"), lambda w: w != "")


def language_of(name: Column) -> Column:
    """By the part after the last dot, lower-cased; a name without a dot counts as that part."""
    ext = F.lower(F.element_at(F.split(name, r"\."), -1))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), ext), F.lit("other"))


def is_source(language: Column) -> Column:
    return language.isin(SOURCE_LANGUAGES)


def first_lines(c: Column, lines: int = 6, chars: int = 800) -> Column:
    return F.substring(F.array_join(F.slice(F.split(c, "\n"), 1, lines), "\n"), 1, chars)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """Over the common length; 0 where a norm is 0."""
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, 1, n), F.slice(b, 1, n)
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(0.0)).otherwise(F.try_divide(dot(a, b), scale))


def normalize(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: F.try_divide(x.cast("double"), n)))


def usable_vector(a: Column) -> Column:
    """The vector, or null where all of its components are zero."""
    return F.when(F.exists(a, lambda x: x != 0), a)


def truncated(c: Column, limit: int = 25_000) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("\n… output truncated"))).otherwise(c)


def subsequence_pattern(query: str) -> str:
    import re

    return "(?s)" + ".*".join(re.escape(x) for x in query.lower())


def fuzzy_score(name: Column, detail: Column, query: str) -> Column:
    """100 equal, 60 prefix, 30 inside, 10 inside the detail, 5 subsequence; else 0."""
    q, n = query.lower(), F.lower(name)
    return (
        F.when(n == q, 100).when(n.startswith(q), 60).when(n.contains(q), 30).when(F.lower(detail).contains(q), 10).when(n.rlike(subsequence_pattern(query)), 5).otherwise(0)
    )


def match_positions(column: str, query: str) -> Column:
    """Greedy positions of the query's characters in the named column; empty if they aren't a subsequence."""
    if not query:
        return F.array().cast("array<int>")
    chars = ", ".join("'" + c.replace("\\", "\\\\").replace("'", "\\'") + "'" for c in query.lower())
    none = "named_struct('at', 0, 'found', cast(array() as array<int>))"
    at = f"locate(c, lower(`{column}`), s.at)"
    return F.expr(
        f"aggregate(array({chars}), named_struct('at', 1, 'found', cast(array() as array<int>)), "
        f"(s, c) -> if(s.at = 0 or {at} = 0, {none}, named_struct('at', {at} + 1, 'found', concat(s.found, array({at} - 1))))).found"
    )

"""The bound queries against their SQL, and the operators on small inputs."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from repograph.functions import text as T
from repograph.operators import graph, incremental, lookup, search
from repograph.plans import bindings
from repograph.sources import ignore

SF = "/root/testdata/sf0.001"


def rows(frame):
    return sorted(map(str, frame[sorted(frame)].astype(str).values.tolist()))


@pytest.fixture(scope="module")
def duck():
    d = duckdb.connect()
    for x in os.listdir(SF):
        d.sql(f"CREATE VIEW {x[:-8]} AS SELECT * FROM '{SF}/{x}'")
    return d


@pytest.mark.parametrize("name", sorted(bindings.QUERIES))
def test_sql_agrees(spark, duck, name):
    got, want = bindings.QUERIES[name](spark, SF).toPandas(), duck.sql(bindings.SQL[name]).df()
    assert sorted(got) == sorted(want)
    assert rows(got) == rows(want)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, T.tokenize(F.lit("the parser for the config"))) == ["parser", "config"]
    assert one(spark, T.split_identifier(F.lit("parseConfig"))) == ["parse", "config"]
    assert one(spark, T.split_identifier(F.lit("HTTPServer"))) == ["http", "server"]


def test_vectors(spark):
    v = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, T.cosine(v(1.0, 0.0, 1.0), v(1.0, 0.0, 1.0))) == pytest.approx(1)
    assert one(spark, T.cosine(v(1.0, 0.0), v(0.0, 1.0))) == 0
    assert one(spark, T.cosine(v(0.0, 0.0), v(0.0, 1.0))) == 0


def test_match_positions(spark):
    df = spark.createDataFrame([("parseConfig",), ("zebra",)], "name string")
    assert [r[0] for r in df.select(T.match_positions("name", "pc")).collect()] == [[0, 5], []]


def test_ignore_rules():
    rules = ignore.compile_rules(["node_modules/", "*.log", "build", "", "# no"])
    assert all(ignore.ignored(rules, p) for p in ("node_modules", "foo/node_modules", "debug.log", "build", "builder.ts"))
    assert not ignore.ignored(rules, "src/index.ts")
    rules = ignore.compile_rules(["*.log", "!important.log"])
    assert ignore.ignored(rules, "debug.log") and not ignore.ignored(rules, "important.log")


def test_dependents_in_a_cycle(spark):
    e = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("d", "c"), ("a", "a"), ("c", "a")], "src string, dst string")
    assert {(r.node, r.depth) for r in graph.dependents(e, "a", 5).collect()} == {("b", 1), ("c", 1), ("d", 2)}
    assert {r.node for r in graph.dependents(e, "a", 1).collect()} == {"b", "c"}
    assert graph.dependents(e, "nothing", 5).count() == 0


def test_block_edges(spark):
    df = spark.createDataFrame([(n, "\n".join(["x"] * n)) for n in (60, 61, 120)], "k long, t string")
    got = {(r.k, r.start_line, r.end_line) for r in search.blocks(df, "k", "t").collect()}
    assert got == {(60, 1, 60), (61, 1, 60), (61, 61, 61), (120, 1, 60), (120, 61, 120)}


def test_duplicate_query_tokens_count_twice(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "k long, t string")
    once, twice = (search.lexical_search(df, q, "k", "t").collect()[0]["score"] for q in ("alpha", "alpha alpha"))
    assert twice == pytest.approx(once * 2 / 2**0.5, abs=1e-5)
    assert search.lexical_search(df, "the of", "k", "t").count() == 0


def test_diff_and_merge(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 1)], "file_path string, mtime_ms long, size_bytes long")
    new = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("d", 1, 1)], "file_path string, mtime_ms long, size_bytes long")
    change = incremental.diff(old, new)
    assert {tuple(r) for r in change.collect()} == {("b", "changed"), ("c", "removed"), ("d", "added")}
    assert {tuple(r) for r in incremental.merge(old, new, change).collect()} == {("a", 1, 1), ("b", 2, 1), ("d", 1, 1)}


def test_candidates_rank(spark):
    c = spark.createDataFrame([(n, "x", "symbol") for n in ("configParser", "parseConfig", "parseConfigDeep", "zebra")], "name string, detail string, kind string")
    assert [r["name"] for r in lookup.rank(c, "parseconfig").collect()] == ["parseConfig", "parseConfigDeep"]

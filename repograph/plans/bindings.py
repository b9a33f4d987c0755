"""The operators bound to the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repograph.functions import text as T
from repograph.operators import extract, graph, incremental, lookup, search
from repograph.sources import ignore

QUERY = "the and theation"
SYMBOL_QUERY = "file read"
CANDIDATE = "d#13"
TARGET = 3
STOP_SQL = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
TOKENS_SQL = f"list_filter(regexp_split_to_array(lower(%s), '[^a-z0-9_$]+'), lambda t: length(t) > 1 AND t NOT IN ({STOP_SQL}))"
IGNORES = ["*.log", "node_modules/", "/p1*", "!*7.html", "build"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.blocks(read(spark, sf_dir, "documents"), "doc_id", "text")


BLOCKS_SQL = r"""blocks AS (SELECT doc_id, s + 1 start_line, least(s + 60, len(l)) end_line, array_to_string(list_slice(l, s + 1, s + 60), chr(10)) AS content
  FROM (SELECT doc_id, l, unnest(generate_series(0, len(l) - 1, 60)) s FROM (SELECT doc_id, string_split(text, chr(10)) l FROM documents)))"""


def chunk_blocks(spark, sf_dir):
    return doc_blocks(spark, sf_dir).select("doc_id", "start_line", "end_line", F.length("content").cast("long").alias("chars"))


def tokenize(spark, sf_dir):
    t = T.tokenize(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.array_join(F.slice(t, 1, 5), " ").alias("first_tokens"))


def postings(spark, sf_dir):
    return search.postings(doc_blocks(spark, sf_dir).select(F.concat_ws("#", "doc_id", "start_line").alias("chunk"), "content"), "chunk", "content")


def lexical_search(spark, sf_dir):
    found = search.lexical_search(doc_blocks(spark, sf_dir).withColumn("chunk", F.format_string("%010d#%06d", "doc_id", "start_line")), QUERY, "chunk", "content")
    return found.select("chunk", "score", "matched_by")


def pages_with_symbols(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", "html", F.nullif(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1), F.lit("")).alias("symbol"))


def symbol_boost_search(spark, sf_dir):
    return search.lexical_search(pages_with_symbols(spark, sf_dir), "thea ation", "page_id", "html", "symbol").select("page_id", "score", "matched_by")


def _vector(spark, sf_dir):
    return list(read(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"])


def cosine_topk(spark, sf_dir):
    return search.cosine_top_k(read(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), "vec_id", "embedding")


def with_vectors(spark, sf_dir):
    """Documents, of which some have a vector, and a name for some."""
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    own = read(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("readTheFile"), F.col("doc_id").cast("string"))).alias("symbol"))
    return own.join(vectors, "doc_id", "left")


def hybrid_search(spark, sf_dir):
    return search.hybrid_search(with_vectors(spark, sf_dir), QUERY, _vector(spark, sf_dir), "doc_id", "text", "embedding").select("doc_id", "score", "matched_by")


def hybrid_symbol_search(spark, sf_dir):
    return search.hybrid_search(with_vectors(spark, sf_dir), SYMBOL_QUERY, _vector(spark, sf_dir), "doc_id", "text", "embedding", "symbol").select("doc_id", "score", "matched_by")


def postings_search(spark, sf_dir):
    """The lexical search through postings, as the engine's stored ones."""
    own = doc_blocks(spark, sf_dir).withColumn("chunk", F.format_string("%010d#%06d", "doc_id", "start_line"))
    return search.indexed_search(own.select("chunk", "doc_id"), search.postings(own, "chunk", "content"), QUERY, "chunk").select("chunk", "score", "matched_by")


def postings_hybrid_search(spark, sf_dir):
    own = with_vectors(spark, sf_dir)
    found = search.indexed_hybrid_search(own, search.postings(own, "doc_id", "text", "symbol"), SYMBOL_QUERY, _vector(spark, sf_dir), "doc_id", "embedding", "symbol")
    return found.select("doc_id", "score", "matched_by")


def split_identifier(spark, sf_dir):
    c = F.concat("c_name", F.lit("_"), "c_mktsegment", F.lit("HTTPServer"))
    return read(spark, sf_dir, "customer").select("c_custkey", F.array_join(T.split_identifier(c), " ").alias("words"))


EXTENSIONS = [*T.LANGUAGES, "xyz", "PY", "d.ts", "lock"]


def language_detect(spark, sf_dir):
    ext = F.get(F.array(*map(F.lit, EXTENSIONS)), (F.col("p_partkey") % len(EXTENSIONS)).cast("int"))
    lang = T.language_of(F.concat_ws(".", F.lit("f"), ext))
    return read(spark, sf_dir, "part").select("p_partkey", lang.alias("language"), T.is_source(lang).alias("source"))


def first_lines(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.first_lines(F.col("text"), 3, 100).alias("head"))


def gitignore_filter(spark, sf_dir):
    path = F.regexp_extract("url", "https?://[^/]+/(.*)", 1)
    return read(spark, sf_dir, "pages").select("page_id", path.alias("path"), ignore.matches(ignore.compile_rules(IGNORES), path).alias("ignored"))


GITIGNORE_SQL = r"""SELECT page_id, path, CASE WHEN regexp_matches(path, '(^|/)build') OR regexp_matches(base, '(^|/)build') THEN true WHEN regexp_matches(path, '(^|/)[^/]*7\.html') OR regexp_matches(base, '(^|/)[^/]*7\.html') THEN false
 WHEN regexp_matches(path, '^p1[^/]*') THEN true WHEN regexp_matches(path, '(^|/)node_modules') OR regexp_matches(base, '(^|/)node_modules') THEN true WHEN regexp_matches(path, '(^|/)[^/]*\.log') OR regexp_matches(base, '(^|/)[^/]*\.log') THEN true ELSE false END ignored
 FROM (SELECT page_id, path, regexp_replace(path, '^.*/', '') base FROM (SELECT page_id, regexp_extract(url, 'https?://[^/]+/(.*)', 1) path FROM pages))"""


def ignore_filter(spark, sf_dir):
    name = F.concat("c_mktsegment", F.get(F.array(*map(F.lit, [".lock", ".log", ".min.js", ".env", ".env.local", ".py", "-yarn.lock"])), (F.col("c_custkey") % 7).cast("int")))
    return read(spark, sf_dir, "customer").select("c_custkey", ignore.skipped_name(name).alias("skipped"))


def part_links(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    a = l.where("l_linenumber = 1").select("l_orderkey", F.col("l_partkey").alias("dst"))
    b = l.where("l_linenumber = 2").select("l_orderkey", F.col("l_partkey").alias("src"))
    return graph.edges(a.join(b, "l_orderkey"))


EDGES_SQL = "edges AS (SELECT DISTINCT b.l_partkey src, a.l_partkey dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_linenumber = 1 AND b.l_linenumber = 2 AND a.l_partkey <> b.l_partkey)"


def file_nodes(spark, sf_dir):
    files = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"))
    n = graph.file_nodes(files, part_links(spark, sf_dir))
    told = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return n.select("path", told("imports"), told("imported_by"))


def _impact(depth):
    return lambda spark, sf_dir: graph.dependents(part_links(spark, sf_dir), TARGET, depth)


def impact_sql(depth):
    return f"WITH RECURSIVE {EDGES_SQL}, r AS (SELECT src node, 1 AS depth FROM edges WHERE dst = {TARGET} UNION SELECT e.src, r.depth + 1 FROM r JOIN edges e ON e.dst = r.node WHERE r.depth < {depth})"


def impact_summary(spark, sf_dir):
    return graph.impact_summary(graph.dependents(part_links(spark, sf_dir), TARGET, 5))


def part_symbols(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.lower("p_type").alias("kind"), F.col("p_brand").alias("file_path"), F.col("p_partkey").alias("line"),
        (F.col("p_partkey") + F.col("p_size")).alias("end_line"), (F.col("p_size") % 2 == 0).alias("exported"), F.col("p_partkey").alias("sym_ord"))


SYMBOLS_SQL = "symbols AS (SELECT p_name AS name, lower(p_type) kind, p_brand file_path, p_partkey line, p_partkey + p_size end_line, p_size % 2 = 0 exported, p_partkey sym_ord FROM part)"


def breakages(spark, sf_dir):
    symbols = part_symbols(spark, sf_dir).withColumn("file_path", F.col("line"))
    return graph.breakages(symbols.where("line % 2 = 1").withColumn("exported", F.lit(True)), part_links(spark, sf_dir), TARGET)


def resolve_imports(spark, sf_dir):
    path = F.regexp_extract("url", "https?://[^/]+/(.*)", 1)
    files = read(spark, sf_dir, "pages").select(path.alias("path")).distinct()
    spec = F.regexp_replace("path", r"\.html$", "")
    specs = files.select(F.col("path").alias("src"), spec.alias("spec"), F.array(spec, F.concat(spec, F.lit(".html")), F.concat(spec, F.lit("/index.html"))).alias("candidates"))
    return graph.resolve(specs, files)


def extract_links(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1))).alias("link"))


def uses(spark, sf_dir):
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.col("user_id").alias("file_path"), F.col("event_id").alias("line"))


def references_rollup(spark, sf_dir):
    return lookup.references(uses(spark, sf_dir)).select("name", "file_path", "count", F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"))


def total_references(spark, sf_dir):
    return lookup.reference_totals(uses(spark, sf_dir))


def _first_name(spark, sf_dir):
    return part_symbols(spark, sf_dir).orderBy("sym_ord").first()["name"]


def definition(spark, sf_dir):
    return lookup.definition(part_symbols(spark, sf_dir), _first_name(spark, sf_dir))


def first_exported_per_name(spark, sf_dir):
    return graph.first_per(part_symbols(spark, sf_dir).where("exported"), ["name"], ["sym_ord"]).select("name", "file_path", "line")


def suggest(spark, sf_dir):
    return lookup.suggest(part_symbols(spark, sf_dir), "a")


def candidate_rank(spark, sf_dir):
    own = part_symbols(spark, sf_dir)
    files = own.groupBy(F.concat(F.lit("src/"), "file_path").alias("rel_path")).agg(F.lit("go").alias("language"), F.count("*").alias("chunk_count"))
    return lookup.rank(lookup.candidates(own, files), CANDIDATE).select("name", "detail", "kind", "rank")


# A source tree out of parts: seven kinds of files, whose extracts follow from their numbers.
FILE_KINDS = {
    "ts": "export function load%(k)s(raw: string) {\n  const held = read%(k)s(raw); // read%(k)s again\n  return held;\n}\n\nexport class Box%(k)s {\n  constructor() {}\n  open(path) {\n    return 'load%(k)s';\n  }\n}\n",
    "py": "import pkg.f%(k)s\n\nclass Job%(k)s:\n    def run%(k)s(self):\n        return self.boot%(k)s()\n",
    "go": "func Boot%(k)s() error {\n\treturn nil\n}\n\ntype Server%(k)s struct {\n\tport int\n}\n",
    "rs": "pub struct Item%(k)s {\n}\n\nfn go%(k)s() {\n}\n",
    "java": "public class Main%(k)s {\n  // class Other%(k)s {\n}\n",
    "rb": "class Dog%(k)s\n  def bark%(k)s\n  end\nend\n",
    "md": "intro\n# Top %(k)s\ntext\n#### deep\n## Sub\nmore\n",
}
MODES = {
    "auto": {
        "ts": [("load%", "function", 1, 4, True), ("held", "variable", 2, 2, False), ("Box%", "class", 6, 11, True), ("open", "method", 8, 10, False)],
        "py": [("Job%", "class", 3, 5, False), ("run%", "function", 4, 5, False)], "go": [("Boot%", "function", 1, 3, False), ("Server%", "type", 5, 7, False)],
        "rs": [("Item%", "struct", 1, 2, True), ("go%", "function", 4, 5, False)], "java": [("Main%", "class", 1, 3, False)], "rb": [("Dog%", "class", 1, 1, False), ("bark%", "method", 2, 5, False)], "md": [],
    },
    "patterns": {
        "ts": [("load%", "function", 1, 5, True), ("Box%", "class", 6, 6, True), ("constructor", "method", 7, 7, False), ("open", "method", 8, 12, False)],
        "py": [("Job%", "class", 3, 3, False), ("run%", "function", 4, 6, False)], "go": [("Boot%", "function", 1, 4, False), ("Server%", "type", 5, 8, False)],
        "rs": [("Item%", "struct", 1, 3, False), ("go%", "function", 4, 6, False)], "java": [("Main%", "class", 1, 4, False)], "rb": [("Dog%", "class", 1, 1, False), ("bark%", "method", 2, 5, False)], "md": [],
    },
}
USES = {
    "ts": [("raw", 1), ("read%", 2), ("raw", 2), ("held", 3), ("path", 8)], "py": [("pkg", 1), ("f%", 1), ("self", 4), ("self", 5), ("boot%", 5)], "go": [("error", 1), ("port", 6), ("int", 6)], "rs": [], "java": [], "rb": [("Dog%", 1), ("bark%", 2)], "md": [],
}


def part_files(spark, sf_dir):
    exts = list(FILE_KINDS)
    k = F.col("p_partkey").cast("string")
    of = lambda texts: F.get(F.array(*texts), (F.col("p_partkey") % len(exts)).cast("int"))
    text = of([F.replace(F.lit(FILE_KINDS[e]), F.lit("%(k)s"), k) for e in exts])
    return read(spark, sf_dir, "part").select(F.concat(F.lit("pkg/f"), k, F.lit("."), of(map(F.lit, exts))).alias("file_path"), text.alias("content"))


def _files_sql(rows: dict[str, list[tuple]], columns: str) -> str:
    """For each kind of file its rows, with the part's number in the place of each %."""
    told = lambda v: ("'" + v.replace("'", "''") + "'") if isinstance(v, str) else str(v).lower()
    values = ", ".join(f"({i}, '{e}', {', '.join(map(told, r))})" for i, e in enumerate(FILE_KINDS) for r in rows[e])
    return f"(SELECT p_partkey, 'pkg/f' || p_partkey || '.' || e file_path, v.* EXCLUDE (i, e) FROM part JOIN (VALUES {values}) v(i, e, {columns}) ON p_partkey % {len(FILE_KINDS)} = i)"


def _symbols_query(mode):
    return lambda spark, sf_dir: extract.symbols(extract.extract(part_files(spark, sf_dir), mode)).drop("sym_ord")


def _symbols_sql(mode):
    return f"SELECT replace(name, '%', p_partkey::VARCHAR) AS name, kind, file_path, line::INT line, end_line::INT end_line, exported FROM {_files_sql(MODES[mode], 'name, kind, line, end_line, exported')}"


def extract_uses(spark, sf_dir):
    return extract.ref_lines(extract.extract(part_files(spark, sf_dir)))


CHUNKS = {e: [("symbol", n, k, a, b) for n, k, a, b, _ in own] for e, own in MODES["auto"].items()} | {"md": [("prose", "Top %", "", 2, 4), ("prose", "Sub", "", 5, 7)]}


def extract_chunks(spark, sf_dir):
    own = extract.chunks(extract.extract(part_files(spark, sf_dir)))
    return own.select("chunk_id", "kind", "symbol_name", F.coalesce("symbol_kind", F.lit("")).alias("symbol_kind"), "start_line", "end_line")


def extract_imports(spark, sf_dir):
    return extract.specs(extract.extract(part_files(spark, sf_dir))).select("src", "spec", F.array_join("candidates", " ").alias("candidates"))


def tree_edges(spark, sf_dir):
    """Imports of files of one number less, resolved against the files."""
    back = F.replace("content", F.regexp_extract("file_path", r"f(\d+)\.py", 1), (F.regexp_extract("file_path", r"f(\d+)\.py", 1).try_cast("int") - 7).cast("string"))
    files = part_files(spark, sf_dir).withColumn("content", F.when(F.col("file_path").endswith(".py"), back).otherwise(F.col("content")))
    return graph.edges(graph.resolve(extract.specs(extract.extract(files)), files.select(F.col("file_path").alias("path"))))


def symbol_impact(spark, sf_dir):
    own = part_symbols(spark, sf_dir)
    name = _first_name(spark, sf_dir)
    refs = read(spark, sf_dir, "part").where("p_size > 10").select("p_name", F.col("p_type").alias("file_path"), F.col("p_partkey").alias("line")).withColumnRenamed("p_name", "name")
    links = own.select(F.col("kind").alias("src"), F.col("file_path").alias("dst"))
    return graph.symbol_impact(own, refs, links, name).select("file_path", "relation", "line", "uses")


def symbol_fallback(spark, sf_dir):
    own = part_symbols(spark, sf_dir)
    links = own.select(F.col("kind").alias("src"), F.col("file_path").alias("dst"))
    return graph.symbol_impact(own, own.select("name", "file_path", "line"), links, _first_name(spark, sf_dir)).select("file_path", "relation", "line", "uses")


NAME_SQL = "(SELECT name FROM symbols ORDER BY sym_ord LIMIT 1)"


def snapshots(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_path"), F.lit(0).cast("long").alias("mtime_ms"), F.col("n_chars").alias("size_bytes"))
    return docs.where("file_path % 17 <> 0").withColumn("size_bytes", F.when(F.col("file_path") % 13 == 0, F.col("size_bytes") + 1).otherwise(F.col("size_bytes"))), docs.where("file_path % 19 <> 0")


SNAPSHOT_SQL = """old AS (SELECT doc_id file_path, CASE WHEN doc_id % 13 = 0 THEN n_chars + 1 ELSE n_chars END size_bytes FROM documents WHERE doc_id % 17 <> 0),
new AS (SELECT doc_id file_path, n_chars size_bytes FROM documents WHERE doc_id % 19 <> 0),
d AS (SELECT coalesce(old.file_path, new.file_path) file_path, CASE WHEN old.file_path IS NULL THEN 'added' WHEN new.file_path IS NULL THEN 'removed' WHEN old.size_bytes <> new.size_bytes THEN 'changed' END change FROM old FULL JOIN new ON old.file_path = new.file_path)"""


def snapshot_diff(spark, sf_dir):
    return incremental.diff(*snapshots(spark, sf_dir))


def incremental_merge(spark, sf_dir):
    old, new = snapshots(spark, sf_dir)
    return incremental.merge(old, new, incremental.diff(old, new)).select("file_path", "size_bytes")


def chunk_counts(spark, sf_dir):
    chunks = doc_blocks(spark, sf_dir).select(F.col("doc_id").alias("file_path"))
    return incremental.chunk_counts(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_path")), chunks)


def status_stats(spark, sf_dir):
    return lookup.stats(files=read(spark, sf_dir, "documents"), chunks=doc_blocks(spark, sf_dir), symbols=part_symbols(spark, sf_dir), references=lookup.references(uses(spark, sf_dir)))


def normalize(spark, sf_dir):
    v = T.normalize(F.col("embedding"))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(T.norm(F.col("embedding")), 6).alias("norm"), F.round(F.get(v, 0), 6).alias("first"))


QUERIES = {f.__name__: f for f in (
    chunk_blocks, tokenize, postings, lexical_search, symbol_boost_search, cosine_topk, hybrid_search, split_identifier, language_detect, first_lines, gitignore_filter, ignore_filter, file_nodes, impact_summary, breakages,
    resolve_imports, extract_links, references_rollup, total_references, definition, first_exported_per_name, suggest, candidate_rank, symbol_impact, symbol_fallback, snapshot_diff, incremental_merge, chunk_counts, status_stats, normalize,
    hybrid_symbol_search, postings_search, postings_hybrid_search, extract_uses, extract_chunks, extract_imports, tree_edges,
)}
QUERIES |= {"extract_symbols": _symbols_query("auto"), "extract_symbols_by_pattern": _symbols_query("patterns")}
QUERIES |= {"import_edges": part_links, "file_impact_depth1": _impact(1), "file_impact_depth3": _impact(3), "file_impact_depth5": _impact(5)}

_asked = search.query_tokens(QUERY)
_hits = " + ".join(f"len(list_filter(t, lambda x: x = '{w}'))" for w in _asked)
_root = len(_asked) ** 0.5
_boost = search.query_tokens("thea ation")
_boost_hits = " + ".join(f"len(list_filter(t, lambda x: x = '{w}'))" for w in _boost)
_split = r"list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(regexp_replace(%s, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[_$-]', ' ', 'g')), '\s+'), lambda w: w <> '')"
_cos = "round(CASE WHEN sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)) = 0 THEN 0 ELSE list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))) END, 6)"
_pairs = "v AS (SELECT vec_id, embedding::DOUBLE[] a, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0) b FROM embeddings)"
_symbol_impact = f"""WITH {SYMBOLS_SQL}, own AS (SELECT * FROM symbols WHERE name = {NAME_SQL}), refs AS (%s),
u AS (SELECT file_path, 'usage' relation, min(line) line, count(*)::BIGINT uses FROM refs WHERE name = {NAME_SQL} AND file_path NOT IN (SELECT file_path FROM own) GROUP BY file_path),
i AS (SELECT DISTINCT kind file_path, 'importer' relation, 0::BIGINT line, 0::BIGINT uses FROM symbols WHERE file_path IN (SELECT file_path FROM own) AND kind <> file_path AND kind NOT IN (SELECT file_path FROM own) AND NOT EXISTS (SELECT 1 FROM u))
SELECT file_path, 'definition' relation, line, 0::BIGINT uses FROM own UNION ALL SELECT * FROM u UNION ALL SELECT * FROM i"""
_lexical_sql = f"WITH {BLOCKS_SQL}, t AS (SELECT format('{{:010d}}#{{:06d}}', doc_id, start_line) chunk, {TOKENS_SQL % 'content'} t FROM blocks WHERE regexp_matches(content, '\\S')) SELECT chunk, score, 'lexical' matched_by FROM (SELECT chunk, round(({_hits})::DOUBLE / greatest(len(t), 1) / {_root!r}, 6) score FROM t) WHERE score > 0 ORDER BY score DESC, chunk LIMIT 20"

def _hybrid_sql(query: str, symbol: bool) -> str:
    asked = search.query_tokens(query)
    hits = " + ".join(f"len(list_filter(t, lambda x: x = '{w}'))" for w in asked)
    words = TOKENS_SQL % "text" + (f" || coalesce({_split % 's'}, [])" if symbol else "")
    named = " OR ".join(f"contains(lower(s), '{w}')" for w in asked)
    match = f"coalesce({named}, false)" if symbol else "false"
    score = "round(0.7::DOUBLE * cos + 0.3::DOUBLE * lex + CASE WHEN m THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END, 6)"
    return (
        f"WITH {_pairs}, d AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'readTheFile' || doc_id END s FROM documents), t AS (SELECT doc_id, s, {words} t, coalesce({_cos}, 0) cos FROM d LEFT JOIN v ON vec_id = doc_id), "
        f"x AS (SELECT doc_id, cos, {match} m, round(({hits})::DOUBLE / greatest(len(t), 1) / {len(asked) ** 0.5!r}, 6) lex FROM t) "
        f"SELECT doc_id, {score} score, CASE WHEN m THEN 'symbol' WHEN cos >= lex THEN 'semantic' ELSE 'lexical' END matched_by FROM x WHERE {score} > 0.05 ORDER BY score DESC, doc_id LIMIT 20"
    )


SQL = {
    "chunk_blocks": f"WITH {BLOCKS_SQL} SELECT doc_id, start_line::INT start_line, end_line::INT end_line, length(content)::BIGINT chars FROM blocks WHERE regexp_matches(content, '\\S')",
    "tokenize": f"SELECT doc_id, len(t)::BIGINT n_tokens, array_to_string(list_slice(t, 1, 5), ' ') first_tokens FROM (SELECT doc_id, {TOKENS_SQL % 'text'} t FROM documents)",
    "postings": f"WITH {BLOCKS_SQL}, t AS (SELECT doc_id || '#' || start_line chunk, {TOKENS_SQL % 'content'} t FROM blocks WHERE regexp_matches(content, '\\S')) SELECT chunk, token, count(*)::BIGINT n, total::BIGINT total FROM (SELECT chunk, len(t) total, unnest(t) AS token FROM t) GROUP BY chunk, token, total",
    "lexical_search": _lexical_sql,
    "postings_search": _lexical_sql,
    "symbol_boost_search": f"WITH p AS (SELECT page_id, html, nullif(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '') s FROM pages), t AS (SELECT page_id, s, {TOKENS_SQL % 'html'} || coalesce({_split % 's'}, []) t FROM p), m AS (SELECT page_id, coalesce({' OR '.join(f'''contains(lower(s), '{w}')''' for w in _boost)} OR s = 'thea ation', false) m, ({_boost_hits})::DOUBLE / greatest(len(t), 1) / {len(_boost) ** 0.5!r} x FROM t) SELECT page_id, round(round(x, 6) + CASE WHEN m THEN 2.0 ELSE 0.0 END, 6) score, CASE WHEN m THEN 'symbol' ELSE 'lexical' END matched_by FROM m WHERE round(x, 6) + CASE WHEN m THEN 2.0 ELSE 0.0 END > 0 ORDER BY score DESC, page_id LIMIT 20",
    "cosine_topk": f"WITH {_pairs} SELECT vec_id, {_cos} score FROM v ORDER BY score DESC, vec_id LIMIT 20",
    "hybrid_search": _hybrid_sql(QUERY, False),
    "hybrid_symbol_search": _hybrid_sql(SYMBOL_QUERY, True),
    "postings_hybrid_search": _hybrid_sql(SYMBOL_QUERY, True),
    "extract_symbols": _symbols_sql("auto"),
    "extract_symbols_by_pattern": _symbols_sql("patterns"),
    "extract_uses": f"SELECT replace(name, '%', p_partkey::VARCHAR) AS name, file_path, line::INT line FROM {_files_sql(USES, 'name, line')}",
    "extract_chunks": f"SELECT file_path || '#' || CASE WHEN kind = 'prose' THEN 'md' ELSE n END || '@' || a chunk_id, kind, n symbol_name, symbol_kind, a::INT start_line, b::INT end_line FROM (SELECT *, replace(name, '%', p_partkey::VARCHAR) n FROM {_files_sql(CHUNKS, 'kind, name, symbol_kind, a, b')})",
    "extract_imports": "SELECT 'pkg/f' || p_partkey || '.py' src, 'pkg.f' || p_partkey spec, 'pkg/f' || p_partkey || '.py pkg/f' || p_partkey || '/__init__.py pkg.py pkg/__init__.py' candidates FROM part WHERE p_partkey % 7 = 1",
    "tree_edges": "SELECT 'pkg/f' || p_partkey || '.py' src, 'pkg/f' || (p_partkey - 7) || '.py' dst FROM part WHERE p_partkey % 7 = 1 AND p_partkey > 7",
    "split_identifier": "SELECT c_custkey, array_to_string(" + _split % "c_name || '_' || c_mktsegment || 'HTTPServer'" + ", ' ') words FROM customer",
    "language_detect": f"SELECT p_partkey, l AS \"language\", l IN ({', '.join(repr(x) for x in T.SOURCE_LANGUAGES)}) \"source\" FROM (SELECT p_partkey, [{', '.join(repr(x) for x in [*T.LANGUAGES.values(), 'other', 'python', 'typescript', 'other'])}][p_partkey % {len(EXTENSIONS)} + 1] l FROM part)",
    "first_lines": "SELECT doc_id, substring(array_to_string(list_slice(string_split(text, chr(10)), 1, 3), chr(10)), 1, 100) head FROM documents",
    "gitignore_filter": GITIGNORE_SQL,
    "ignore_filter": "SELECT c_custkey, c_custkey % 7 <> 5 skipped FROM customer",
    "import_edges": f"WITH {EDGES_SQL} SELECT * FROM edges",
    "file_nodes": f"WITH {EDGES_SQL}, o AS (SELECT src, string_agg(dst::VARCHAR, ',' ORDER BY dst) s FROM edges GROUP BY src), i AS (SELECT dst, string_agg(src::VARCHAR, ',' ORDER BY src) s FROM edges GROUP BY dst) SELECT p_partkey path, coalesce(o.s, '') imports, coalesce(i.s, '') imported_by FROM part LEFT JOIN o ON src = p_partkey LEFT JOIN i ON dst = p_partkey",
    **{f"file_impact_depth{n}": impact_sql(n) + f" SELECT node, min(depth)::INT AS depth FROM r WHERE node <> {TARGET} GROUP BY node" for n in (1, 3, 5)},
    "impact_summary": impact_sql(5) + f", m AS (SELECT node, min(depth) AS d FROM r WHERE node <> {TARGET} GROUP BY node) SELECT count(*) FILTER (d = 1)::BIGINT n_direct, count(*) FILTER (d > 1)::BIGINT n_transitive, count(*)::BIGINT total, coalesce(max(d), 0)::INT max_depth FROM m",
    "breakages": f"WITH {EDGES_SQL} SELECT p_name symbol, lower(p_type) kind, src file_path, 0::INT line, 'imports ' || p_name || ' (exported ' || lower(p_type) || ')' reason FROM part JOIN edges ON dst = p_partkey WHERE p_partkey = {TARGET}",
    "resolve_imports": r"WITH f AS (SELECT DISTINCT regexp_extract(url, 'https?://[^/]+/(.*)', 1) path FROM pages), s AS (SELECT path src, regexp_replace(path, '\.html$', '') spec FROM f), c AS (SELECT src, spec, spec dst, 0 AS rank FROM s UNION ALL SELECT src, spec, spec || '.html', 1 FROM s UNION ALL SELECT src, spec, spec || '/index.html', 2 FROM s) SELECT src, spec, arg_min(dst, rank) dst, min(rank)::INT AS rank FROM c JOIN f ON path = dst GROUP BY src, spec",
    "extract_links": "SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) link FROM pages",
    "references_rollup": "SELECT event_type AS name, user_id file_path, count(*)::BIGINT AS count, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS lines FROM events GROUP BY ALL",
    "total_references": "SELECT event_type AS name, count(*)::BIGINT total, count(DISTINCT user_id)::BIGINT files FROM events GROUP BY ALL",
    "definition": f"WITH {SYMBOLS_SQL} SELECT name, kind, file_path, line, end_line, exported FROM symbols WHERE name = {NAME_SQL}",
    "first_exported_per_name": f"WITH {SYMBOLS_SQL} SELECT name, file_path, line FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY sym_ord) n FROM symbols WHERE exported) WHERE n = 1",
    "suggest": f"WITH {SYMBOLS_SQL} SELECT name, name || ' (' || kind || ' in ' || file_path || ')' suggestion FROM symbols WHERE contains(lower(name), 'a') ORDER BY sym_ord LIMIT 5",
    "candidate_rank": f"WITH {SYMBOLS_SQL}, c AS (SELECT name, kind || ' · ' || file_path || ':' || line AS detail, 'symbol' kind FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY sym_ord) n FROM symbols WHERE exported) WHERE n = 1 UNION ALL SELECT 'src/' || file_path, 'go · ' || count(*) || ' chunks', 'file' FROM symbols GROUP BY file_path), r AS (SELECT *, CASE WHEN lower(name) = '{CANDIDATE}' THEN 100 WHEN starts_with(lower(name), '{CANDIDATE}') THEN 60 WHEN contains(lower(name), '{CANDIDATE}') THEN 30 WHEN contains(lower(detail), '{CANDIDATE}') THEN 10 WHEN regexp_matches(lower(name), '(?s){'.*'.join(CANDIDATE)}') THEN 5 ELSE 0 END::INT AS rank FROM c) SELECT name, detail, kind, rank FROM r WHERE rank > 0 ORDER BY rank DESC, name, detail LIMIT 200",
    "symbol_impact": _symbol_impact.replace("%s", "SELECT p_name AS name, p_type file_path, p_partkey line FROM part WHERE p_size > 10"),
    "symbol_fallback": _symbol_impact.replace("%s", "SELECT name, file_path, line FROM symbols"),
    "snapshot_diff": f"WITH {SNAPSHOT_SQL} SELECT * FROM d WHERE change IS NOT NULL",
    "incremental_merge": f"WITH {SNAPSHOT_SQL} SELECT file_path, size_bytes FROM old WHERE file_path NOT IN (SELECT file_path FROM d WHERE change IS NOT NULL) UNION ALL SELECT n.file_path, n.size_bytes FROM new n JOIN d ON d.file_path = n.file_path WHERE change IN ('added', 'changed')",
    "chunk_counts": f"WITH {BLOCKS_SQL} SELECT d.doc_id file_path, count(b.doc_id)::BIGINT chunk_count FROM documents d LEFT JOIN (SELECT * FROM blocks WHERE regexp_matches(content, '\\S')) b ON b.doc_id = d.doc_id GROUP BY d.doc_id",
    "status_stats": f"WITH {BLOCKS_SQL} SELECT (SELECT count(*) FROM documents)::BIGINT files, (SELECT count(*) FROM blocks WHERE regexp_matches(content, '\\S'))::BIGINT chunks, (SELECT count(*) FROM part)::BIGINT symbols, (SELECT count(*) FROM (SELECT DISTINCT event_type, user_id FROM events))::BIGINT \"references\"",
    "normalize": "SELECT vec_id, round(sqrt(list_dot_product(a, a)), 6) norm, round(a[1] / sqrt(list_dot_product(a, a)), 6) AS first FROM (SELECT vec_id, embedding::DOUBLE[] a FROM embeddings)",
}

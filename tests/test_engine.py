import json
import os
import time

import pytest

from repograph import inputs, report
from repograph.__main__ import main
from repograph.engine import Engine
from repograph.operators import extract, syntax
from repograph.sources import store
from repograph.sources.repo import walk
from repograph.streaming import refresh

TREE = {
    "src/app.ts": 'import { Store } from "./lib/store.js";\nimport { readAll } from "./lib/read.js";\nlet s = new Store(readAll);\n',
    "src/lib/store.ts": 'import { readAll } from "./read.js";\nexport class Store {\n  open(path) {\n    return readAll(path);\n  }\n}\n',
    "src/lib/read.ts": "export interface Options {\n  path: string;\n}\n\nexport function readAll(o: Options) {\n  return o;\n}\nexport const MAX_DEPTH = 3;\n",
    "pkg/__init__.py": "",
    "pkg/a.py": "LIMIT = 3\n\nclass Thing:\n    def go(self):\n        return LIMIT\n",
    "main.py": "from pkg.a import Thing\nThing().go()\n",
    "notes.md": "intro\n# Top\nsome text\n\n## Sub\nmore text\n",
    "skip/x.log": "log",
    "gen/out.ts": "export const MAX_DEPTH = 4;\n",
    ".gitignore": "gen\n",
    ".hidden/a.py": "x = 1\n",
    ".github/ci.yml": "on: push\n",
}


@pytest.fixture
def root(tmp_path):
    for path, text in TREE.items():
        p = tmp_path / "tree" / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return tmp_path / "tree"


def test_walk(root):
    os.symlink(root / "main.py", root / "link.py")
    (root / "bin.py").write_bytes(b"a" * 512 + b"\0")
    (root / "bad.py").write_bytes(b"\0" + b"a" * 512)
    (root / "tiny.py").write_bytes(b"\0" + b"a" * 511)
    (root / "big.py").write_bytes(b"a" * 1_000_001)
    (root / "most.py").write_bytes(b"a" * 1_000_000)
    got, more = walk(str(root))
    assert [p for p, *_ in got] == [".github/ci.yml", ".gitignore", "bin.py", "main.py", "most.py", "notes.md", "pkg/a.py", "src/app.ts", "src/lib/read.ts", "src/lib/store.ts", "tiny.py"]
    assert not more
    assert len(walk(str(root), max_files=3)[0]) == 3 and walk(str(root), max_files=3)[1]
    assert "gen/out.ts" in [p for p, *_ in walk(str(root), respect_ignore=False)[0]]


def spans(found):
    return [(x["name"], x["kind"], x["line"], x["end_line"], x["exported"]) for x in found]


def test_line_patterns():
    lines = TREE["src/lib/read.ts"].split("\n")
    assert spans(extract.scan_symbols(lines, "typescript")) == [("Options", "interface", 1, 4, True), ("readAll", "function", 5, 7, True), ("MAX_DEPTH", "constant", 8, 9, True)]
    assert [(c["kind"], c["symbol_name"], c["start_line"], c["end_line"]) for c in extract.scan_chunks(TREE["notes.md"].split("\n"), "markdown", [])] == [("prose", "Top", 2, 4), ("prose", "Sub", 5, 7)]
    for n, want in ((60, [(1, 60)]), (61, [(1, 60), (61, 61)]), (120, [(1, 60), (61, 120)])):
        assert [(c["start_line"], c["end_line"]) for c in extract.scan_chunks(["x"] * n, "other", [])] == want
    assert extract.candidates("main.py", "pkg.a", "python") == ["pkg/a.py", "pkg/a/__init__.py", "pkg.py", "pkg/__init__.py"]
    assert extract.candidates("main.py", ".a", "python") == [] and extract.candidates("a.ts", "react", "typescript") == []
    kinds = lambda text, language: [(x["name"], x["kind"]) for x in extract.scan_symbols(text.split("\n"), language)]
    assert kinds("const enum No { A }\nconst NAME: string = 1\nconst AB = 1\nconst run = => 1", "typescript") == [("AB", "constant"), ("run", "constant")]
    assert kinds("type Server struct {\ntype Alias int\nfunc Boot() {\nfunc Odd", "go") == [("Server", "type"), ("Boot", "function")]
    assert kinds("pub(crate) fn hidden() {}\npub fn shown() {}", "rust") == [("shown", "function")]
    assert kinds("def self.build\ndef plain?", "ruby") == [("self", "method"), ("plain?", "method")]
    assert extract.exported_names(["  export { ab, cd as ef };", "export const gh = 1", "const no = export_"]) >= {"ab", "cd", "ef", "gh"}
    assert [x["spec"] for x in extract.scan_imports("a.py", "x = 1; import pkg.b\n  from pkg.c import d\n", "python")] == ["pkg.b", "pkg.c"]
    assert [x["spec"] for x in extract.scan_imports("a.ts", "import './a'\nimport {\n x\n} from \"./b\"\nexport { y } from './c'", "typescript")] == ["./a", "./b"]


SCRIPT = """import { a as b } from "./x.js";
// class Nope {}
export interface AppConfig {
  path: string;
}
const s1 = `text ${fn(`in ${deep}`)} class Zed {}`;
export async function parseConfig(raw: string): Promise<AppConfig> {
  const parsed = JSON.parse(raw);
  if (parsed) { return helper(parsed) as AppConfig; }
  return /class Foo {/.test(raw);
}
class Server extends Base {
  constructor(private cfg: AppConfig) { super(); }
  async start(): Promise<void> {
    this.cfg.load();
    this.other;
  }
}
export { Server };
"""


def test_tokens_give_spans_and_uses():
    found, uses = syntax.scan(SCRIPT, "typescript")
    assert spans(found) == [
        ("AppConfig", "interface", 3, 5, True), ("s1", "variable", 6, 6, False), ("parseConfig", "function", 7, 11, True), ("parsed", "variable", 8, 8, False), ("Server", "class", 12, 18, True), ("start", "method", 14, 17, False),
    ]
    names = {(u["name"], u["line"]) for u in uses}
    assert {("fn", 6), ("deep", 6), ("helper", 9), ("load", 15), ("AppConfig", 13)} <= names
    assert not {n for n, _ in names} & {"Nope", "Zed", "Foo", "other", "return", "text"}
    found, uses = syntax.scan("class Worker:\n    def run(self):\n        return self.boot()  # word\n\nasync def main():\n    'text'\n", "python")
    assert spans(found) == [("Worker", "class", 1, 3, False), ("run", "function", 2, 3, False), ("main", "function", 5, 6, False)]
    assert {u["name"] for u in uses} == {"self", "boot"}
    assert spans(syntax.scan("func Boot() error {\n\treturn nil\n}\n\ntype Server struct {\n\tport int\n}\n", "go")[0]) == [("Boot", "function", 1, 3, False), ("Server", "type", 5, 7, False)]
    assert syntax.scan("# Title", "markdown") == (None, None) and syntax.scan("def (", "python") == (None, None) and syntax.scan("  ", "go") == (None, None)
    assert extract.scan("def (\nclass Odd:", "python")[0][0]["name"] == "Odd"


def test_engine(spark, root, tmp_path):
    e = Engine(spark, str(root), f"file://{tmp_path}/index")
    assert store.load(spark, e.index_dir, e.root)[1] == "missing"
    with pytest.raises(LookupError):
        e.search("readAll")
    assert e.status()["indexed"] is False
    outcome = e.ensure_index()
    assert (outcome.mode, outcome.truncated) == ("fresh", False) and outcome.added == e.table("files").count() == 8
    edges = {(r.src, r.dst) for r in e.table("edges").collect()}
    assert edges == {("src/app.ts", "src/lib/store.ts"), ("src/app.ts", "src/lib/read.ts"), ("src/lib/store.ts", "src/lib/read.ts"), ("main.py", "pkg/a.py")}
    first = e.search("readAll").first()
    assert (first.matched_by, first.symbol_name) == ("symbol", "readAll") and first.snippet.startswith("export function readAll")
    assert [r.file_path for r in e.search("top text").collect()][0] == "notes.md"
    # Defining files are among the references; comments and the definition itself aren't.
    refs = {r.file_path: r["lines"] for r in e.references("readAll").collect()}
    assert refs == {"src/app.ts": [2, 3], "src/lib/store.ts": [1, 4]}
    assert {r.file_path for r in e.references("Options").collect()} == {"src/lib/read.ts"}
    assert [(r.kind, r.file_path, r.line, r.exported) for r in e.definition("readAll").collect()] == [("function", "src/lib/read.ts", 5, True)]
    told = e.impact("src/lib/read.ts")
    assert (told["kind"], told["direct"], told["transitive"], told["total"]) == ("file", ["src/app.ts", "src/lib/store.ts"], [], 2)
    assert len(told["breakages"]) == 6 and told["breakages"][0]["reason"] == "imports MAX_DEPTH (exported variable)"
    assert e.impact(f"{root}/src/app.ts")["total"] == 0
    told = e.impact("Thing")
    assert (told["kind"], told["direct"], told["total"]) == ("symbol", ["main.py"], 1)
    assert [b["reason"] for b in told["breakages"]] == ["defined here (class)", "uses Thing 2× (lines 1, 2) (AST reference)"]
    with pytest.raises(LookupError, match="not found as a file or symbol.*MAX_DEPTH"):
        e.impact("max_de")
    names = {(r["name"], r.kind) for r in e.candidates().collect()}
    assert {("readAll", "symbol"), ("src/app.ts", "file")} <= names and ("s", "symbol") not in names
    assert e.status()["indexed"] and e.status()["files"] == e.table("files").count()

    before = {str(p) for p in (tmp_path / "index").rglob("*.parquet")}
    assert not e.index().any and {str(p) for p in (tmp_path / "index").rglob("*.parquet")} == before
    assert Engine(spark, str(root), e.index_dir).ensure_index().mode == "restored"
    (root / "src/lib/read.ts").write_text("export function loadAll() {\n}\n")
    (root / "notes.md").unlink()
    (root / "pkg/b.py").write_text("from pkg.a import LIMIT\n")
    outcome = e.index()
    assert (outcome.mode, outcome.added, outcome.changed, outcome.removed) == ("incremental", 1, 1, 1)
    assert e.definition("readAll").count() == 0 and e.definition("loadAll").count() == 1
    assert e.table("chunks").where("file_path = 'notes.md'").count() == 0 and e.table("postings").where("file_path = 'notes.md'").count() == 0
    assert e.definition("Thing").count() == 1 and e.impact("pkg/a.py")["direct"] == ["main.py", "pkg/b.py"]
    # Two states are kept, not every one.
    sizes = []
    for k in range(3):
        (root / "pkg/b.py").write_text(f"from pkg.a import LIMIT\nx{k} = {k}\n" * (k + 1))
        assert e.index().changed == 1
        sizes.append(len(list((tmp_path / "index").rglob("*.parquet"))))
    assert sizes[2] <= sizes[1]

    assert store.load(spark, e.index_dir, "/elsewhere")[1] == "wrong-root"
    pointer = tmp_path / "index" / "CURRENT"

    def overwrite(text):
        pointer.write_text(text)
        for crc in (tmp_path / "index").glob(".CURRENT*.crc"):
            crc.unlink()

    good = pointer.read_text()
    for text, why in (("{", "corrupt"), (good.replace('"schema": 2', '"schema": 1', 1), "stale-schema"), (good.replace("part=", "part=9", 1), "corrupt")):
        overwrite(text)
        assert store.load(spark, e.index_dir, e.root)[1] == why
    overwrite(good)
    (tmp_path / "index" / "mine.txt").write_text("stays")
    e.clear()
    assert store.load(spark, e.index_dir, e.root)[1] == "missing"
    left = [p for p in (tmp_path / "index").iterdir() if not p.name.startswith(".")]
    assert [p.name for p in left if p.is_file() and not p.name.startswith("CURRENT.")] == ["mine.txt"]


def letters():
    class Letters:  # sent by value, as the executors don't have this module
        """Vectors of letter counts."""

        kind = "letters"

        def embed(self, texts):
            return [[float(t.lower().count(c)) for c in "abcdefgh"] for t in texts]

    return Letters()


def test_hybrid_search_and_truncation(spark, root, tmp_path):
    e = Engine(spark, str(root), f"file://{tmp_path}/index", embedder=letters(), max_files=3)
    outcome = e.index()
    assert outcome.truncated and outcome.added == 3 and e.status()["truncated"] and e.status()["embedder"] == "letters"
    assert {r.matched_by for r in e.search("go").collect()} <= {"semantic", "lexical", "symbol"} and e.search("on push").count() > 0
    plain = Engine(spark, str(root), e.index_dir)
    assert plain.ensure_index().mode == "fresh" and "embedding" not in plain.table("chunks").columns


def test_extraction_by_patterns_has_no_references(spark, root, tmp_path):
    e = Engine(spark, str(root), f"file://{tmp_path}/index", extraction="patterns")
    e.index()
    assert e.table("ref_lines").count() == 0
    assert e.impact("readAll")["breakages"][1]["reason"] == "file imports from read.ts; renaming readAll breaks this file"


def test_reports():
    found = {"target": "a.ts", "kind": "file", "direct": ["b.ts"], "transitive": ["c.ts"], "total": 2, "breakages": [{"symbol": "run", "kind": "function", "file_path": "b.ts", "line": 3, "reason": "why"}]}
    assert report.impact(found).split("\n") == ["# Impact of changing a.ts", "", "Files affected: 2 (direct: 1, transitive: 1)", "", "## Direct dependents (break first)", "- b.ts", "", "## Transitive dependents (may break indirectly)", "- c.ts", "", "## Symbols at risk", "- **run** (function) — b.ts:3 — why", ""]
    assert json.loads(report.impact(found, "json"))["symbolBreakages"] == [{"symbol": "run", "kind": "function", "file": "b.ts", "line": 3, "reason": "why"}]
    assert report.plain_impact(found)[3:5] == ["Breaks first:", "  b.ts"] and "\x1b" not in "".join(report.plain_impact(found))
    none = found | {"direct": [], "transitive": [], "total": 0, "breakages": []}
    assert "This target is a leaf." in report.impact(none) and report.plain_impact(none)[-1] == "Nothing references this target. Safe to change."
    hit = {"file_path": "a.ts", "start_line": 1, "end_line": 2, "symbol_name": None, "symbol_kind": None, "score": 0.12345, "matched_by": "lexical", "snippet": "x"}
    assert report.hits([hit]).split("\n")[2:4] == ["## a.ts:1", "score 0.123 · matched by lexical"]
    assert json.loads(report.hits([hit], "json"))["hits"][0]["score"] == 0.1235
    assert report.truncated("x" * 30_000).startswith("x" * 25_000 + "\n…(truncated")
    assert report.references("ab", [{"file_path": "a.ts", "lines": [1, 2], "count": 2}]).split("\n") == ["# ab — 2 references in 1 file", "", "- a.ts:1, 2 (2×)"]
    assert report.references("ab", []).startswith("No references to 'ab'") and "is not defined" in report.definitions("ab", [])


def test_requests():
    assert inputs.SearchRequest(query="ab").limit == 20 and inputs.ImpactRequest(target="x").max_depth == 5
    for bad in (
        lambda: inputs.SearchRequest(query="a"), lambda: inputs.SearchRequest(query="a" * 501), lambda: inputs.SearchRequest(query="ab", limit=0), lambda: inputs.SearchRequest(query="ab", limit=101), lambda: inputs.ImpactRequest(target=""),
        lambda: inputs.ImpactRequest(target="x", max_depth=11), lambda: inputs.IndexRequest(max_files=200_001), lambda: inputs.StatusRequest(response_format="xml"), lambda: inputs.ReferencesRequest(symbol="x"), lambda: inputs.DefinitionRequest(symbol="ab", path=""),
        lambda: inputs.IndexRequest(max_files=True),
    ):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(TypeError):
        inputs.StatusRequest(more=1)


def test_watch(spark, root, tmp_path):
    e = Engine(spark, str(root), f"file://{tmp_path}/index")
    e.index()
    q = refresh.watch(e)
    try:
        time.sleep(3)
        quiet = len(list((tmp_path / "index").rglob("*.parquet")))
        assert quiet == len(list((tmp_path / "index").rglob("*.parquet")))
        (root / "pkg/new.py").write_text("def appears():\n    pass\n")
        for _ in range(60):
            time.sleep(1)
            e.reload()
            if e.definition("appears").count():
                break
        assert e.definition("appears").count() == 1
    finally:
        q.stop()


def test_command_line(spark, root, tmp_path, capsys):
    own = ["--path", str(root), "--index", f"file://{tmp_path}/index"]
    for command, want in (
        (["index", "--format", "plain"], "Indexed"), (["search", "readAll"], "# Search results"), (["references", "readAll"], "# readAll — 4 references in 2 files"), (["definition", "readAll"], "src/lib/read.ts:5-7 — function (exported)"),
        (["impact", "src/lib/read.ts"], "Files affected: 2"), (["report", "Thing"], "Breaks first:"), (["candidates", "readall"], "readAll\tfunction"), (["status", "--format", "json"], '"indexed": true'), (["clear"], "cleared"),
    ):
        assert main([*command, *own]) == 0
        assert want in capsys.readouterr().out, command
    assert main(["impact", "nothing at all", *own]) == 2 and main(["search", "x", *own]) == 2

"""Maps, diffs, projects, descriptions, full-text search, the index build, hooks and the command line."""

import json
import re
import shutil
import sqlite3
import subprocess
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarry import __main__ as cli
from quarry import hooks
from quarry.functions import describe
from quarry.lang.summary import summary
from quarry.operators import extract, fulltext
from quarry.plans import build
from quarry.sources import events, git, mapfile, projects, tree
from quarry.streaming import ledger as stream


def test_map_round_trip(spark, tmp_path):
    rows = [("a.rs", "fn main()", 120, None), ("src/b.md", "Title (~x)", 7, 0.9), ("src/c.py", "code", 5, 0.1), ("src/x/d.go", "", 0, 0.3)]
    df = spark.createDataFrame(rows, "path string, description string, token_estimate bigint, density double")
    assert mapfile.write(df, str(tmp_path), datetime(2026, 1, 2, tzinfo=UTC)) == 4
    text = (tmp_path / "map.md").read_text()
    assert "## .\n\n- `a.rs` — fn main() (~120 tok)\n" in text and "- `b.md` — Title (~x) (~7 tok, dense)\n" in text
    got = {(r.path, r.description, r.token_estimate, r.density) for r in mapfile.read(spark, str(tmp_path / "map.md")).collect()}
    assert got == {("a.rs", "fn main()", 120, None), ("src/b.md", "Title (~x)", 7, 0.55), ("src/c.py", "code", 5, 0.1), ("src/x/d.go", "", 0, None)}
    head = mapfile.headers(spark, str(tmp_path / "map.md")).first()
    assert head.file_count == 4 and head.generated_at == datetime(2026, 1, 2)
    twice = mapfile.with_architecture(mapfile.with_architecture(text, "Rust 50%", "src/ (2)"), "Go 9%")
    assert twice.count("### Architecture") == 1 and "Go 9%" in twice and "Hotspots" not in twice and twice.index("###") < twice.index("\n## .")


def test_map_malformed(spark):
    bad = ["", "<!-- Generated: yesterday | Files: 3 -->", "<!-- Generated: 2026-01-02T00:00:00Z | Files: x -->", None]
    df = spark.createDataFrame([(b,) for b in bad], "text string").select(mapfile.header(F.col("text")).alias("h"))
    assert all(r.h is None for r in df.collect())
    tails = [" — x (~12 tok)", " - y (~3 tok, dense)", " — no count", " — bad (~z tok)", ""]
    got = [tuple(r.e) for r in spark.createDataFrame([(t,) for t in tails], "t string").select(mapfile.entry_tail(F.col("t")).alias("e")).collect()]
    assert got == [("x", 12, None), ("y", 3, 0.55), ("no count", 0, None), ("bad (~z tok)", 0, None), ("", 0, None)]


def test_hunks(spark):
    diffs = [
        "diff --git a/f.rs b/f.rs\n--- a/f.rs\n+++ b/f.rs\n@@ -1,2 +1,3 @@ x\n-- a/q\n@@ -9 +11 @@\n",
        "--- a/gone.rs\n+++ /dev/null\n@@ -5,3 +4,0 @@\n",
        "--- a/old.rs\n+++ b/new.rs\n@@ -10,2 +12,3 @@\n--- /dev/null\n+++ b/made.rs\n@@ -0,0 +1,4 @@\n",
        "",
        None,
    ]
    got = {tuple(r) for r in git.hunks(spark.createDataFrame([(d,) for d in diffs], "diff string")).collect()}
    assert got == {("f.rs", 1, 3), ("f.rs", 11, 11), ("gone.rs", 5, 7), ("new.rs", 12, 14), ("old.rs", 10, 11), ("made.rs", 1, 4)}


DESCRIBED = [
    ("run.sh", "function a {\n}\nb() {\n", "shell: a, b"), ("x.md", "text\n# Head \r\n", "Head"), ("x.html", "<title> T </title>", "T"), ("x.css", ".a {\n#b{\n", "styles: .a, #b"),
    ("x.sql", "create table if not exists `t` (", "tables: t"), ("compose.dev.yml", "services:\n  web:\n  db:\n", "compose services: web, db"), ("ci.yml", "name: CI\non: x\njobs:\n", "GHA: CI"),
    ("a.schema.json", "{}", "JSON schema"), ("x.gql", "type A {\n", "types: A"), ("x.tf", 'resource "aws" "b" {', "resources: aws.b"), ("x.xml", "<?xml v?>\n<root a='1'>", "XML: <root>"),
    ("x.vue", "name: 'Box'", "Vue: Box"), ("x.svelte", "<script>", "Svelte component"), ("x.rb", "class A\nmodule B\n", "A, B"), ("x.java", "public class Ünï {\n", "Ünï"),
    ("x.c", "int main(void) {\nelse if (x)\n", "main"), ("x.swift", "struct S {\n", "S"), ("x.proto", "message M {\nservice S {\n", "services: S; messages: M"), ("x.toml", "", "toml source file"),
    ("Cargo.toml", "", "Rust package manifest"), ("y.yml", "a: 1", "YAML configuration"), ("y.proto", "", "Protocol Buffers"),
]


def test_describe(spark):
    df = spark.createDataFrame([(n, n.rsplit(".", 1)[-1], t) for n, t, _ in DESCRIBED], "name string, ext string, text string")
    got = {r.name: r.d for r in df.select("name", describe.describe(F.col("name"), F.col("ext"), F.col("text")).alias("d")).collect()}
    assert got == {n: d for n, _, d in DESCRIBED}


def test_summary():
    assert summary("const a = 1;\nfunction b() {}\nclass C extends HTMLElement {}\nmodule.exports = { b, C };\nconst q = require('x');\n", "js") == "export function b(), export class C (web component), const a"
    assert summary("fn p() {}\npub(crate) enum E {}\nimpl<T> Show for E {}\n", "rs") == "pub enum E, fn p(), impl Show"
    assert summary("def _a(): pass\n@x\nclass B: pass\n", "py") == "class B, def _a()" and summary("x", "md") == ""


SYMBOLS = [("process_data", "fn", "pub fn process_data(x: u8)", "src/core.rs"), ("Process", "struct", "struct Process", "src/process.rs"), ("écrire", "fn", "fn ecrire map write map", "src/map.rs"), ("map", "mod", "mod map", "src/lib.rs"), ("other", "const", "const other", "tests/map.rs")]


@pytest.mark.parametrize("query", ["process", "process data", '"write map"', "write_map", "name:map", "fn OR mod", "proc*", "fn NOT src", "(struct OR const) AND map", "ecrire", "name:(map OR other)", "absent", "Foo::new", "a-b", "foo(", '"', "src/map.rs", "", "AND", "kin:x", "^process", "^ process", "name:^map", "NEAR(fn map)", "NEAR(fn map, 1)", "NEAR(pub data, 0) OR other", "NEAR(fn)", "NEAR(fn, x)", "NEAR()", 'NEAR("write map" fn, 2)', "signature:NEAR(fn map, 1)", "near"])
def test_fulltext_like_fts5(spark, query):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(name, kind, signature, file_path)")
    con.executemany("insert into t values (?, ?, ?, ?)", SYMBOLS)
    df = spark.createDataFrame(SYMBOLS, "name string, kind string, signature string, file_path string")
    try:
        want = {n: round(-s, 6) for n, s in con.execute("select name, rank from t where t match ?", (query,))}
    except sqlite3.OperationalError:
        with pytest.raises(fulltext.QueryError):
            fulltext.match(df, query, ("name",), None)
        return
    assert {r.name: round(r.score, 6) for r in fulltext.match(df, query, ("name",), None).collect()} == want


def test_indexed_fulltext_like_fts5(spark, tmp_path):
    """A random table, by index and without one: the same rows and scores as FTS5's."""
    import random

    r = random.Random(7)
    text = lambda n: " ".join(r.choice(["ab", "abc", "b", "cc", "Dé", "x_y"]) for _ in range(r.randrange(n)))
    rows = [(i, text(4), text(2), text(14), text(6)) for i in range(60)]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(name, kind, signature, file_path)")
    con.executemany("insert into t values (?, ?, ?, ?)", [x[1:] for x in rows])
    df = spark.createDataFrame(rows, "id long, name string, kind string, signature string, file_path string").repartition(3)
    fulltext.build(df, "id", str(tmp_path / "index"))
    for query in ("ab", "ab cc", "ab*", "cc OR x_y", '"ab cc"', '"b a"*', "^ab", "^ab OR name:b", "NEAR(ab cc, 1)", "NEAR(ab b cc, 2)", "NEAR(de cc, 0) NOT b", 'NEAR("ab b" x, 3)', "signature:NEAR(ab* cc)", "absent", "de AND (b OR cc)"):
        want = {i - 1: round(-s, 6) for i, s in con.execute("select rowid, rank from t where t match ?", (query,))}
        assert {x.key: round(x.score, 6) for x in fulltext.match_indexed(spark, str(tmp_path / "index"), query, None).collect()} == want, query
        assert {x.id: round(x.score, 6) for x in fulltext.match(df, query, ("id",), None).collect()} == want, query
    best = fulltext.match_indexed(spark, str(tmp_path / "index"), "cc", 5)
    assert best.count() == 5 and "Scan" in (plan := best._jdf.queryExecution().toString()) and "EqualTo(term,cc)" in plan


def test_projects(tmp_path):
    for name in ("b/.git", "a/.git", "a/src", "plain"):
        (tmp_path / name).mkdir(parents=True)
    both = [str(tmp_path / "a"), str(tmp_path / "b")]
    assert projects.discover(str(tmp_path)) == both == projects.discover(str(tmp_path / "a"))
    assert projects.find_root(str(tmp_path / "a/src")) == both[0] and projects.owner(str(tmp_path / "a/src/x.rs")) is None
    with pytest.raises(git.GitError):
        git.diff_base(str(tmp_path), "--output=x")


def test_density(spark):
    got = spark.createDataFrame([("a" * 1000,), ("a" * 10,), (None,)], "t string").select(extract.gzip_density("t").alias("d")).collect()
    assert 0 < got[0].d < 0.15 and got[1].d is None and got[2].d is None
    names = spark.createDataFrame([("a/b.rs",), (".x/b.rs",), ("Makefile",), ("a.bin",)], "p string")
    assert [r[0] for r in names.select(tree.mappable(F.col("p"))).collect()] == [True, False, True, False] and tree.is_scannable(".gitignore")


def test_stream(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("QUARRY_LEDGER", str(tmp_path / "log"))
    now = datetime.now(UTC)
    for back, impact in ((9, 5), (9, 6), (0, 7)):
        events.record("map_hit", "p", impact, now - timedelta(days=back))
    events.record("map_hit", "p", 1, now - timedelta(days=200))
    assert events.read(spark).count() == 3 and events.read(spark, "q").count() == 0 and events.purge() == 1
    for _ in range(2):
        stream.start(stream.daily(stream.read(spark, str(tmp_path / "log"))), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    closed = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.project_path, r.events, r.tokens_saved) for r in closed] == [("p", 2, 11)]


def _run(capsys, *argv):
    code = cli.main(list(argv))
    return code, capsys.readouterr().out


@pytest.mark.skipif(shutil.which("git") is None, reason="needs git")
def test_command_line(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("QUARRY_LEDGER", str(tmp_path / "log"))
    monkeypatch.setattr(cli, "session", lambda: spark)
    root = tmp_path / "repo"
    (root / "src").mkdir(parents=True)
    (root / "src/core.rs").write_text("pub fn greet() {}\n\npub fn farewell() {}\n")
    for i in range(20):
        (root / f"src/m{i}.rs").write_text("use crate::core::greet;\nfn run() { greet() }\n")
    (root / "README.md").write_text("# Hello\n")
    subprocess.run("git init -q -b main && echo .quarry/ > .gitignore && git add -A && git -c user.name=a -c user.email=a@b commit -qm x", shell=True, cwd=root, check=True)
    monkeypatch.chdir(root)
    assert cli.main(["find", "x"]) == 1
    assert _run(capsys, "scan") == (0, "Scanned 22 files, 22 symbols, 20 imports → .quarry/map.md\n")
    assert _run(capsys, "scan", "--check")[0] == 0
    assert "src/core.rs:1-1  pub fn greet()" in _run(capsys, "sketch", "greet")[1]
    assert re.match(r"  fn      greet +src/core.rs:1", _run(capsys, "find", "greet")[1])
    assert _run(capsys, "callers", "greet")[1].startswith("20 file(s) import greet:\n  src/m0.rs:1\n")
    assert "arch: Rust 95%, Markdown 5%" in _run(capsys, "arch")[1]
    (root / "src/core.rs").write_text("pub fn greet() { }\n\npub fn farewell() {}\n")
    (root / "new.py").write_text("x = 1\n")
    out = _run(capsys, "impact")[1]
    assert "Changed: fn greet (src/core.rs:1) — 20 importers | Risk: CRITICAL" in out and "farewell" not in out and "New: new.py" in out and "src/m7.rs" in out
    assert _run(capsys, "scan", "--check")[0] == 1 and "stale" in _run(capsys, "arch")[1]
    read = {"cwd": str(root), "tool_input": {"file_path": str(root / "src/core.rs")}}
    assert "src/core.rs — pub fn greet(), pub fn farewell() (~" in json.loads(hooks.pre_read(read))["hookSpecificOutput"]["additionalContext"]
    assert "additionalContext" not in hooks.pre_read({"cwd": str(root), "tool_input": {"file_path": str(root / "no.rs")}})
    started = json.loads(hooks.session_start({"cwd": str(root)}, lambda: spark))["hookSpecificOutput"]
    assert started["additionalContext"].startswith("[quarry] arch: Rust 9") and not hooks.is_stale(str(root))
    assert {r.path for r in build.load(spark, str(root / ".quarry"), "files").collect()} >= {"new.py", "README.md"}
    assert "Map hits:                   1" in _run(capsys, "gain")[1] and "50.0% hit rate" in _run(capsys, "status")[1]
    assert "23 files (today" in _run(capsys, "status", "--all")[1]

"""Queries over source files made from the driver's tables, with SQL that states the rows they must give.

A template holds {k} where a row's key goes, so that every row of a table becomes a file of its own. What is expected
of a template is listed as SQL values with the same places for the key.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import describe, protocol, scalars
from quarry.operators import extract, graph, ledger, search, stale
from quarry.plans import build
from quarry.plans import relations as R
from quarry.sources import mapfile, tree

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], ORACLE_SQL[name] = query, sql


def _put(template: str, key: Column) -> Column:
    return F.replace(F.lit(template), F.lit("{k}"), key.cast("string"))


def _literal(value) -> str:
    if isinstance(value, bool) or value is None:
        return "null" if value is None else str(value).lower()
    return str(value) if isinstance(value, int | float) else "'" + value.replace("'", "''") + "'"


def _expected(table: str, key: str, columns: dict[str, str], rows: list[tuple]) -> str:
    """Each row of the table with each of the listed rows; text columns take the key."""
    values = ", ".join(f"({', '.join(map(_literal, r))})" for r in rows)
    out = ", ".join(f"replace(v.{c}, '{{k}}', {key}::varchar) as {c}" if t == "text" else f"v.{c}::{t} as {c}" for c, t in columns.items())
    return f"select {out} from {table} cross join (values {values}) v({', '.join(columns)})"


def _parts(spark: SparkSession, d: str) -> DataFrame:
    """The keys of all parts, dealt out: a small table lies in a split or two, but its files take long to read."""
    return R.table(spark, d, "part").select("p_partkey").repartition(spark.sparkContext.defaultParallelism)


def _sources(spark: SparkSession, d: str, path: str, text: str) -> DataFrame:
    """One file for each part."""
    key = F.col("p_partkey")
    return _parts(spark, d).select(_put(path, key).alias("path"), _put(text, key).alias("content"))


RUST = """use crate::core::{run{k}, self, Other as O, deep::{One, Two as T}};
use crate::top{k};
use std::fs;
/* pub fn commented() {} use crate::no::No; */
#[derive(Debug)] pub struct Foo{k}<T> { a: T }
impl<T> Display for a::Foo{k}<T> {
    pub fn new() -> Self { let s = "fn x() {"; Foo {} }
    fn hidden(&self) {}
}
fn private{k}() {} pub(crate) enum Kind { A }
pub const MAX: usize = {k};
trait Shape { fn area(&self); }
"""
JAVASCRIPT = """import def, { a as b, c } from './utils{k}';
import * as ns from './ns';
import lib from 'lib';
const { x, y: z } = require('./lib{k}');
export class Widget{k} extends Base {
  static make() { return /[{]/ }
  #secret({ a }) { if (a) { } }
  field = () => { }
}
export const one{k} = 1, two = async () => { }, three = function () { };
// import no from './no'
function local(a = `${ {} }`) { } enum Color { Red }
const fs = require('fs');
type Id = string | { a: number };
"""
PYTHON = '''"""
from .fake import no
"""
from ..pkg{k} import (a as b,  # comment
    c)
from . import d
import os

@cached
def public{k}(
    x,
):
    return '{'

class _Hidden:
    def method(self): pass

async def go(): pass
'''
GO = """package main

import (
	"fmt"
	u "a/b/util{k}"
)

type (
	Thing{k} struct {
		x int
	}
	alias interface{}
)

func (t *Thing{k}) Do() {
}

func helper() {}
type ID int
"""
_SYMBOL = {"file_path": "text", "name": "text", "kind": "text", "signature": "text", "line_start": "bigint", "line_end": "bigint", "exported": "boolean"}
_IMPORT = {"source_file": "text", "imported_name": "text", "raw_path": "text", "line_number": "bigint"}
_CODE = {
    "rust": ("src/m{k}.rs", RUST, [
        ("Foo{k}", "struct", "pub struct Foo{k}<T>", 5, 5, True), ("Foo{k}::new", "method", "pub fn new() -> Self", 7, 7, True), ("Foo{k}::hidden", "method", "fn hidden(&self)", 8, 8, False),
        ("private{k}", "fn", "fn private{k}()", 10, 10, False), ("Kind", "enum", "pub(crate) enum Kind", 10, 10, True), ("MAX", "const", "pub const MAX: usize = {k}", 11, 11, True), ("Shape", "trait", "trait Shape", 12, 12, False),
    ], [("run{k}", "crate::core", 1), ("Other", "crate::core", 1), ("One", "crate::core::deep", 1), ("Two", "crate::core::deep", 1), ("top{k}", "crate", 2)], "pub struct Foo{k}, pub enum Kind, pub const MAX, impl Display, fn private{k}(), trait Shape"),
    "javascript": ("web/m{k}.js", JAVASCRIPT, [
        ("x", "const", "", 0, 0, False), ("Widget{k}", "class", "class Widget{k} extends Base", 5, 9, True), ("Widget{k}::make", "method", "static make()", 6, 6, True), ("Widget{k}::#secret", "method", "#secret(", 7, 7, True),
        ("one{k}", "const", "const one{k} = 1, two = async () =>", 10, 10, True), ("two", "fn", "const one{k} = 1, two = async () =>", 10, 10, True), ("three", "fn", "const one{k} = 1, two = async () =>", 10, 10, True),
        ("local", "fn", "function local(a = `$", 12, 12, False), ("Color", "enum", "enum Color", 12, 12, False), ("Id", "type", "type Id = string |", 14, 14, False),
    ][1:], [("default", "./utils{k}", 1), ("a", "./utils{k}", 1), ("c", "./utils{k}", 1), ("x", "./lib{k}", 4), ("y", "./lib{k}", 4)], "export class Widget{k}, export const one{k}, export const two(), export const three(), function local(), enum Color, type Id"),
    "python": ("app/m{k}.py", PYTHON, [("public{k}", "fn", "def public{k}( x, ): return '", 10, 13, True), ("_Hidden", "class", "class _Hidden:", 15, 16, False), ("go", "fn", "async def go(): pass", 18, 18, True)],
        [("a", "..pkg{k}", 4), ("c", "..pkg{k}", 4), ("d", ".", 6)], "def public{k}(), def go(), class _Hidden"),
    "go": ("cmd/m{k}.go", GO, [
        ("Thing{k}", "type", "type ( Thing{k} struct", 8, 13, True), ("alias", "type", "type ( Thing{k} struct", 8, 13, False), ("Do", "method", "func (t *Thing{k}) Do()", 15, 16, True), ("helper", "fn", "func helper()", 18, 18, False), ("ID", "type", "type ID int", 19, 19, True),
    ], [("fmt", "fmt", 4), ("util{k}", "a/b/util{k}", 5)], "type Thing{k}, func Do(), type ID, func helper()"),
}


def _code(name: str) -> None:
    path, text, symbols, imports, declared = _CODE[name]
    found = lambda s, d, what: extract.parsed(_sources(s, d, path, text), only=(what,))
    _add(f"extract_symbols_{name}", lambda s, d: extract.symbols(found(s, d, "symbols")).drop("ord"), _expected("part", "p_partkey", _SYMBOL, [(path, *r) for r in symbols]))
    none = lambda s: s.createDataFrame([], "path string")
    _add(f"extract_imports_{name}", lambda s, d: extract.imports(found(s, d, "imports"), none(s)).drop("target_path"), _expected("part", "p_partkey", _IMPORT, [(path, *r) for r in imports]))
    _add(f"describe_{name}", lambda s, d: found(s, d, "declared").select("path", "declared"), _expected("part", "p_partkey", {"path": "text", "declared": "text"}, [(path, declared)]))


for _name in _CODE:
    _code(_name)

_CLAUSES = "const a{k} = 1;\nfunction b() { }\nclass C { m() { } }\nconst d = 2;\nexport { a{k}, b as e };\nmodule.exports = { C };\n"
_CLAUSE_ROWS = [("w/x{k}.js", "a{k}", True), ("w/x{k}.js", "b", True), ("w/x{k}.js", "C", True), ("w/x{k}.js", "C::m", True), ("w/x{k}.js", "d", False)]
_CLAUSE = {"file_path": "text", "name": "text", "exported": "boolean"}
_add("extract_symbols_export_clauses", lambda s, d: extract.symbols(extract.parsed(_sources(s, d, "w/x{k}.js", _CLAUSES), resolve_export_clauses=True, only=("symbols",))).select(*_CLAUSE), _expected("part", "p_partkey", _CLAUSE, _CLAUSE_ROWS))

# sources with their imports, the files that are there, and what each import means
_EDGES = [
    ("web/a/m{k}.ts", "import {p} from './t{k}'; import {q} from '../d{k}';\nimport {r} from './t{k}.js'\nimport {s} from './none'\n", [("p", "web/a/t{k}.tsx"), ("q", "web/d{k}/index.js"), ("r", "web/a/t{k}.js"), ("s", "")]),
    ("app/x/m{k}.py", "from .b{k} import p\nfrom ..c{k} import q\nfrom . import r\nfrom ...z import s\n", [("p", "app/x/b{k}.py"), ("q", "app/c{k}/__init__.py"), ("r", "app/x/__init__.py"), ("s", "")]),
    ("src/m{k}.rs", "use crate::n{k}::p;\nuse crate::o{k}::{q, i::r};\nuse crate::s;\nuse crate::none::t;\n", [("p", "src/n{k}.rs"), ("q", "src/o{k}/mod.rs"), ("r", "src/o{k}/i.rs"), ("s", "src/lib.rs"), ("t", "")]),
    ("cmd/m{k}.go", 'package p\nimport "a/b{k}"\n', [("b{k}", "")]),
]
_THERE = ["web/a/t{k}.tsx", "web/a/t{k}.js", "web/d{k}/index.js", "web/d{k}/index.jsx", "app/x/b{k}.py", "app/x/b{k}/__init__.py", "app/c{k}/__init__.py", "app/x/__init__.py", "src/n{k}.rs", "src/n{k}/mod.rs", "src/o{k}/mod.rs", "src/o{k}/i.rs", "src/lib.rs", "a/b{k}.go"]


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    made = F.explode(F.array(*(F.struct(_put(p, key).alias("path"), _put(t, key).alias("content")) for p, t, _ in _EDGES))).alias("f")
    files = _parts(spark, d).select(made).select("f.*")
    listing = R.table(spark, d, "part").select(F.explode(F.array(*(_put(p, key) for p in _THERE))).alias("path")).distinct()
    return extract.imports(extract.parsed(files, only=("imports",)), listing).select("source_file", "imported_name", "target_path")


_add("resolve_imports", _resolved, _expected("part", "p_partkey", {"source_file": "text", "imported_name": "text", "target_path": "text"}, [(p, *r) for p, _, rows in _EDGES for r in rows]))

_PATTERNS = [
    ("a.sh", "# x\nfunction one{k} {\n}\ntwo() {\n}\n", "shell: one{k}, two"), ("b.bash", "echo {k}\n", "shell script"), ("a.md", "intro\n# Title {k}\n# Next\n", "Title {k}"), ("b.mdx", "## no\n", "markdown document"),
    ("a.html", "<html><title> Page {k} </title>", "Page {k}"), ("b.htm", "<title></title>", "HTML document"), ("a.css", ".a{k} { }\n#b { }\nbody { }\n.c { }\n.d { }\n.e { }\n", "styles: .a{k}, #b, body, .c, .d"), ("b.less", "@x: 1;\n", "stylesheet"),
    ("a.sql", "create table t{k} (a int);\nCREATE TABLE IF NOT EXISTS \"u\" (b int);\n", "tables: t{k}, u"), ("b.sql", "select {k}", "SQL script"), ("compose.{k}.yml", "services:\n  web{k}:\n  db-2:\n", "compose services: web{k}, db-2"),
    ("ci.yml", "name: Build {k}\non: push\njobs:\n", "GHA: Build {k}"), ("cd.yaml", "on: push\njobs:\n  x: {k}\n", "GitHub Actions workflow"), ("x.yaml", "a: {k}\n", "YAML configuration"), ("a.schema.json", "{}", "JSON schema"), ("a.json", "{\"k\": {k}}", "JSON data"),
    ("a.graphql", "type Query{k} {\n}\ntype User {\n}\n", "types: Query{k}, User"), ("b.gql", "scalar X", "GraphQL schema"), ("a.tf", 'resource "aws_x" "r{k}" {\n}\n  resource "no" "no" {\n', "resources: aws_x.r{k}"), ("b.hcl", "x = {k}", "Terraform configuration"),
    ("a.xml", "<root{k} a='1'>", "XML: <root{k}>"), ("b.xml", "<?xml version='1.0'?><!-- {k} -->", "XML document"), ("a.vue", "export default {\n name: 'My{k}'\n}", "Vue: My{k}"), ("b.vue", "<template/>", "Vue component"),
    ("a.svelte", "<script>let a = {k}</script>", "Svelte component"), ("b.svelte", "<p>{k}</p>", "Svelte template"), ("a.rb", "module M{k}\nend\nclass C\n  class Inner\n", "M{k}, C"), ("b.rb", "puts {k}", "Ruby source"),
    ("A.java", "public class A{k} {\n}\ninterface B {\n}\nenum C {\n}\nclass D {\n}\n", "A{k}, B, C"), ("b.kt", "fun x() = {k}", "JVM source"), ("a.c", "int f{k}(int a) {\nstatic void g(void) {\n return if (x)\n", "f{k}, g"), ("b.hpp", "#define X {k}\n", "C/C++ source"),
    ("a.swift", "struct S{k} {\n}\nprotocol P {\n}\n", "S{k}, P"), ("b.swift", "let x = {k}", "Swift source"), ("a.proto", "service S{k} {\n}\nmessage M {\n}\nmessage N {\n}\n", "services: S{k}; messages: M, N"), ("b.proto", "syntax = \"proto3\"; // {k}", "Protocol Buffers"),
    ("a.ini", "x = {k}", "ini source file"), ("Cargo.toml", "[package]", "Rust package manifest"), ("README.md", "# Read {k}", "Project documentation"),
]


def _described(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("s_suppkey")
    made = F.explode(F.array(*(F.struct(_put(n, key).alias("name"), _put(t, key).alias("content")) for n, t, _ in _PATTERNS))).alias("f")
    files = R.table(spark, d, "supplier").select("s_suppkey", made).select("s_suppkey", "f.*")
    return files.select("s_suppkey", "name", describe.describe(F.col("name"), scalars.extension(F.col("name")), F.col("content")).alias("description"))


_add("describe_patterns", _described, "select s_suppkey, name, description from (" + _expected("supplier", "s_suppkey", {"name": "text", "description": "text"}, [(n, e) for n, _, e in _PATTERNS]).replace("select ", "select s_suppkey, ", 1) + ")")
_known = lambda s, d: R.table(s, d, "nation").select("n_nationkey", F.explode(F.array(*map(F.lit, [*describe.KNOWN_FILES, "readme.md", "other.txt"]))).alias("name"))
_add("known_file_names", lambda s, d: _known(s, d).select("n_nationkey", "name", describe.known_label(F.col("name")).alias("label")), _expected("nation", "n_nationkey", {"name": "text", "label": "text"}, [*describe.KNOWN_FILES.items(), ("readme.md", None), ("other.txt", None)]).replace("select ", "select n_nationkey, ", 1))

_PATHS = [("src/a{k}.rs", True, True), ("Makefile", True, True), ("x/Dockerfile", True, True), (".gitignore", True, False), ("a{k}.exe", False, False), ("noext{k}", False, False), (".hidden/a{k}.py", True, False), ("b/.x/c.ts", True, False), ("a.tar.gz", False, False), ("w.lock", True, True), ("dir.rs/plain", False, False), ("A.RS", False, False), ("p/.env", False, False), ("q/LICENSE", True, True)]
_paths = lambda s, d: R.table(s, d, "supplier").select(F.explode(F.array(*(_put(p, F.col("s_suppkey")) for p, _, _ in _PATHS))).alias("path"))
_add("scan_predicates", lambda s, d: _paths(s, d).select("path", tree.scannable(F.col("path")).alias("scannable"), tree.mappable(F.col("path")).alias("mappable")), _expected("supplier", "s_suppkey", {"path": "text", "scannable": "boolean", "mappable": "boolean"}, _PATHS))

_MAP = "# Source map\n\n<!-- Generated: 2024-01-02T03:04:05Z | Files: {k} -->\n\n## .\n\n- `a{k}.rs` — fn main(), struct X (~{k} tok, dense)\nnot an entry\n\n## src/x/\r\n\n- `b.py` — two (~12) parts (~7 tok)\r\n- `c.md` - old dash (~3 tok, repetitive)\n- `d.go` — no count\n"
_maps = lambda s, d: R.table(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("map"), _put(_MAP, F.col("s_suppkey")).alias("text"))
_MAP_ROWS = [("a{k}.rs", "fn main(), struct X", "{k}", 0.55), ("src/x/b.py", "two (~12) parts", "7", None), ("src/x/c.md", "old dash", "3", 0.10), ("src/x/d.go", "no count", "0", None)]
_add("map_read", lambda s, d: mapfile.parse(_maps(s, d)), "select s_suppkey::varchar as map, path, description, token_estimate::bigint as token_estimate, density from (" + _expected("supplier", "s_suppkey", {"path": "text", "description": "text", "token_estimate": "text", "density": "double"}, _MAP_ROWS).replace("select ", "select s_suppkey, ", 1) + ")")
_HEADERS = [("<!-- Generated: 2024-01-02T03:04:05Z | Files: {k} -->", True), ("# x\n\n\n\n<!-- Generated: 2024-01-02T03:04:05Z | Files: {k} -->\n", True), ("\n\n\n\n\n<!-- Generated: 2024-01-02T03:04:05Z | Files: {k} -->", False), ("<!-- Generated: yesterday | Files: {k} -->", False), ("<!-- Generated: 2024-01-02T03:04:05Z | Files: x{k} -->", False), ("", False)]
_add("map_header", lambda s, d: R.table(s, d, "supplier").select("s_suppkey", F.posexplode(F.array(*(_put(t, F.col("s_suppkey")) for t, _ in _HEADERS))).alias("n", "text")).select("s_suppkey", "n", mapfile.header(F.col("text")).alias("h")).select("s_suppkey", "n", F.unix_seconds("h.generated_at").alias("at"), "h.file_count"), f"select s_suppkey, v.n::int as n, case when v.ok then 1704164645::bigint end as at, case when v.ok then s_suppkey end as file_count from supplier cross join (values {', '.join(f'({i}, {str(ok).lower()})' for i, (_, ok) in enumerate(_HEADERS))}) v(n, ok)")

_add("point_lookup", lambda s, d: search.entry(R.snapshot(s, d, True), "33"), f"select * from {R.STORED} where path = '33'")
_add("stored_mtimes", lambda s, d: stale.stored_mtimes(R.snapshot(s, d, True).withColumn("mtime_ms", F.when(F.col("mtime_ms") % 3 > 0, F.col("mtime_ms")))), f"select path, mtime_ms from {R.STORED} where mtime_ms % 3 > 0")
_QUALIFIED = f"(select * replace (case when exported then kind || '::NEW' else 'new' end as name) from {R.SYMBOLS})"
_qualified = lambda s, d: R.symbols(s, d).withColumn("name", F.when(F.col("exported"), F.concat("kind", F.lit("::NEW"))).otherwise("new"))
_add("sketch_ranked", lambda s, d: search.with_position(search.sketch(_qualified(s, d), "new"), F.desc("exported"), "file_path", "line_start", "signature", "kind").filter("position < 50").select("position", "file_path", "line_start", "exported"), f"select position::int as position, file_path, line_start, exported from (select *, row_number() over (order by exported desc, file_path, line_start, signature, kind) - 1 as position from {_QUALIFIED}) where position < 50")
_add("daily_bars", lambda s, d: ledger.daily_bars(R.events(s, d)), """
with t as (select ts::date as day, count(*) as events, coalesce(sum(case when event_kind not in ('session_start', 'first_edit', 'first_edit_turns', 'arch_hit') then token_impact end), 0)::bigint as tokens_saved from """ + R.EVENTS + """ group by 1 order by 1 desc limit 30),
b as (select *, greatest(round(12 * greatest(tokens_saved, 0) / greatest(max(tokens_saved) over (), 1)), 0)::int as n from t) select day, events, tokens_saved, repeat('█', n) || repeat('░', 12 - n) as bar from b""")
_payload = lambda: F.to_json(F.struct(F.concat(F.lit("/w/"), F.col("user_id").cast("string")).alias("cwd"), F.struct(F.when(F.col("event_id") % 3 > 0, F.concat(F.lit('a"b/'), F.col("event_id").cast("string"), F.lit(".py"))).alias("file_path")).alias("tool_input")))
_add("hook_payload", lambda s, d: R.table(s, d, "events").select("event_id", protocol.payload(_payload()).alias("p")).select("event_id", "p.*"), "select event_id, '/w/' || user_id as cwd, case when event_id % 3 > 0 then 'a\"b/' || event_id || '.py' end as file_path from events")
_add("hook_answer", lambda s, d: R.table(s, d, "events").select("event_id", protocol.answer("PreToolUse", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("seen "), F.col("event_type"))).otherwise(""), F.when(F.col("event_id") % 5 == 0, "allow")).alias("answer")), """
select event_id, '{"hookSpecificOutput":{"hookEventName":"PreToolUse"' || case when event_id % 5 = 0 then ',"permissionDecision":"allow"' else '' end || case when event_id % 2 = 0 then ',"additionalContext":"seen ' || event_type || '"' else '' end || '}}' as answer from events""")
_add("unquote", lambda s, d: R.table(s, d, "supplier").select("s_suppkey", scalars.unquote(F.concat(F.lit("`'\""), F.col("s_name"), F.lit("\"'"))).alias("text")), "select s_suppkey, trim(s_name, '''\"`') as text from supplier")


def folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.gettempdir()
    return f"{base.removeprefix('file:').rstrip('/')}/quarry-{uuid.uuid4().hex}"


def _appended(spark: SparkSession, d: str) -> DataFrame:
    """Two appends to a log on disk, read back."""
    path, rows = folder(spark), R.events(spark, d)
    for half in (0, 1):
        ledger.append(rows.filter(F.pmod("id", F.lit(2)) == half), path)
    return spark.read.parquet(path).drop("day")


_add("ledger_append", _appended, f"select * from {R.EVENTS}")

# a tree with one file of each kind for every nation, and what no scan may show
_TREE = [("src/n{k}.rs", "use crate::core::Item;\npub fn of_{k}() {}\n"), ("web/n{k}.ts", "import { of } from './base';\nexport const name{k} = 1, other = 2;\n"), ("doc/n{k}.md", "# Nation {k}\n"), ("src/empty{k}.py", "  \n"), ("gen/n{k}.py", "x = 1\n"), ("node_modules/n{k}.js", "x\n"), (".git/n{k}.py", "x\n"), ("log/n{k}.log", "x\n")]
_FIXED = [("src/core.rs", "pub struct Item;\nimpl Item { pub fn new() -> Self { Item } }\n"), ("web/base/index.js", "export function of() {}\n"), (".gitignore", "gen/\n*.log\n**/skipped.md\n"), ("skipped.md", "# no\n"), ("doc/.gitignore", "!skipped.md\n"), ("doc/skipped.md", "# Kept\n")]


def _scanned(spark: SparkSession, d: str) -> str:
    """The folder of an index over the tree of all nations."""
    root = folder(spark)
    keys = [r.n_nationkey for r in R.table(spark, d, "nation").select("n_nationkey").toLocalIterator()]
    for path, text in [*_FIXED, *((p.replace("{k}", str(k)), t.replace("{k}", str(k))) for p, t in _TREE for k in keys)]:
        os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
        with open(f"{root}/{path}", "w", encoding="utf-8") as f:
            f.write(text)
    build.scan(spark, root)
    return f"{root}/.quarry"


_FILES = [("src/n{k}.rs", "pub fn of_{k}()"), ("web/n{k}.ts", "export const name{k}, export const other"), ("doc/n{k}.md", "Nation {k}")]
_ONCE = [("src/core.rs", "pub struct Item, impl Item"), ("web/base/index.js", "export function of()"), ("doc/skipped.md", "Kept")]
_ALL = [(p, t) for p, t in (*_TREE, *_FIXED)]
_BYTES = {p: t for p, t in _ALL}
_RATIOS = {"md": 4.0}


def _files_sql(rows: list[tuple[str, str]]) -> str:
    values = ", ".join(f"({_literal(p)}, {_literal(e)}, {_literal(_BYTES[p])}, {_RATIOS.get(p.rsplit('.', 1)[-1], 3.5)})" for p, e in rows)
    fill = lambda c: f"replace(v.{c}, '{{k}}', n_nationkey::varchar)"
    return f"select distinct {fill('path')} as path, {fill('description')} as description, ceil(strlen({fill('content')}) / v.ratio)::bigint as token_estimate from nation cross join (values {values}) v(path, description, content, ratio)"


_SCANNED = _files_sql([*_FILES, *_ONCE])
_add("scan_files", lambda s, d: build.load(s, _scanned(s, d), "files").select("path", "description", "token_estimate"), _SCANNED)
_add("scan_order", lambda s, d: build.load(s, _scanned(s, d), "files").select("path", F.monotonically_increasing_id().alias("row")).select("path", F.row_number().over(search.W.orderBy("row")).alias("position")), f"select path, row_number() over (order by path)::int as position from ({_SCANNED})")
_add("scan_stamps", lambda s, d: build.load(s, _scanned(s, d), "files").select("path", (F.col("content_hash").isNotNull() & (F.col("mtime_ms") > 1_600_000_000_000)).alias("stamped"), F.col("density").isNull().alias("short")), f"select path, true as stamped, true as short from ({_SCANNED})")
_add("scan_listing", lambda s, d: build.load(s, _scanned(s, d), "listing").select("path", "size"), f"select path, strlen(content)::bigint as size from (select distinct replace(v.path, '{{k}}', n_nationkey::varchar) as path, replace(v.content, '{{k}}', n_nationkey::varchar) as content from nation cross join (values {', '.join(f'({_literal(p)}, {_literal(t)})' for p, t in _ALL if p.split('/')[0] in ('src', 'web', 'doc') and not p.endswith('.gitignore'))}) v(path, content))")
_add("scan_symbols", lambda s, d: build.load(s, _scanned(s, d), "symbols").select("file_path", "name", "kind", "exported"), "select distinct * from (" + _expected("nation", "n_nationkey", {"file_path": "text", "name": "text", "kind": "text", "exported": "boolean"}, [("src/n{k}.rs", "of_{k}", "fn", True), ("web/n{k}.ts", "name{k}", "const", True), ("web/n{k}.ts", "other", "const", True), ("src/core.rs", "Item", "struct", True), ("src/core.rs", "Item::new", "method", True), ("web/base/index.js", "of", "fn", True)]) + ")")
_add("scan_imports", lambda s, d: build.load(s, _scanned(s, d), "imports").select("source_file", "imported_name", "target_path"), _expected("nation", "n_nationkey", {"source_file": "text", "imported_name": "text", "target_path": "text"}, [("src/n{k}.rs", "Item", "src/core.rs"), ("web/n{k}.ts", "of", "web/base/index.js")]))
_add("scan_count", lambda s, d: tree.count(s, os.path.dirname(_scanned(s, d))), "select 4 * count(*) + 3 as files from nation")
_add("scan_map", lambda s, d: mapfile.read(s, f"{_scanned(s, d)}/{mapfile.NAME}").select("path", "description", "token_estimate"), _SCANNED)
_architecture = lambda s, d: build.read_architecture(_scanned(s, d))
_add("scan_architecture", lambda s, d: s.createDataFrame([(lambda a: (a["languages"], a["hotspots"], a["file_count"]))(_architecture(s, d))], "languages string, hotspots string, file_count bigint"), "with n as (select count(*) as n from nation) select 'Rust ' || round(100.0 * (n + 1) / (3 * n + 3))::int || '%, Markdown ' || round(100.0 * (n + 1) / (3 * n + 3))::int || '%, TypeScript ' || round(100.0 * n / (3 * n + 3))::int || '%, JavaScript ' || round(100.0 / (3 * n + 3))::int || '%' as languages, 'src/ (' || n || ' imports-in), web/base/ (' || n || ' imports-in)' as hotspots, (3 * n + 3)::bigint as file_count from n".replace("'Rust '", "'Markdown '", 1).replace("'%, Markdown '", "'%, Rust '", 1))

from quarry.lang.reader import candidates, imports, signature, symbols
from quarry.operators import extract
from quarry.sources import tree

RUST = """use crate::core::{run, self, Other as O};
// fn commented() {}
pub struct Foo<T> { a: T }
impl<T> Display for Foo<T> {
    pub fn new() -> Self { let s = "fn x() {"; Foo {} }
    fn hidden(&self) {}
}
fn private() {}
pub const MAX: usize = 3;
"""
JS = """import def, { a as b, c } from './utils';
import * as ns from './ns';
const { x, y: z } = require('./lib');
export class Widget {
  static make() { return 1 }
  #secret() { if (a) { } }
}
export const arrow = () => { return 1 };
function local() {}
"""
PYTHON = "from .pkg import a, b as c\nimport os\n\ndef public(x):\n    return '{'\n\nclass _Hidden:\n    def method(self): pass\n"
GO = 'package main\n\nimport (\n\t"fmt"\n\t"a/b/util"\n)\n\ntype Thing struct {\n}\n\nfunc (t *Thing) Do() {\n}\n\nfunc helper() {}\n'


def brief(text, ext):
    return [(s.name, s.kind, s.line_start, s.line_end, s.exported) for s in symbols(text, ext)]


def test_symbols():
    assert brief(RUST, "rs") == [("Foo", "struct", 3, 3, True), ("Foo::new", "method", 5, 5, True), ("Foo::hidden", "method", 6, 6, False), ("private", "fn", 8, 8, False), ("MAX", "const", 9, 9, True)]
    assert brief(JS, "ts") == [("Widget", "class", 4, 7, True), ("Widget::make", "method", 5, 5, True), ("Widget::#secret", "method", 6, 6, True), ("arrow", "fn", 8, 8, True), ("local", "fn", 9, 9, False)]
    assert brief(PYTHON, "py") == [("public", "fn", 4, 5, True), ("_Hidden", "class", 7, 8, False)]
    assert brief(GO, "go") == [("Thing", "type", 8, 9, True), ("Do", "method", 11, 12, True), ("helper", "fn", 14, 14, False)]
    assert symbols("fn broken( {", "rs")[0].name == "broken" and symbols("x", "md") == []


def test_imports():
    assert [(i.name, i.raw_path) for i in imports(RUST, "rs")] == [("run", "crate::core"), ("Other", "crate::core")]
    assert [(i.name, i.raw_path) for i in imports(JS, "ts")] == [("default", "./utils"), ("a", "./utils"), ("c", "./utils"), ("x", "./lib"), ("y", "./lib")]
    assert [(i.name, i.raw_path, i.line) for i in imports(PYTHON, "py")] == [("a", ".pkg", 1), ("b", ".pkg", 1)]
    assert [(i.name, i.raw_path, i.line) for i in imports(GO, "go")] == [("fmt", "fmt", 4), ("util", "a/b/util", 5)]


def test_signature_and_candidates():
    assert signature("pub fn a(\n  x: u8,\n) -> u8 {\n x }") == "pub fn a( x: u8, ) -> u8"
    assert len(signature("é" * 300).encode()) <= 200
    assert candidates("../x", "a/b/c.ts", "ts")[1] == "a/x.ts" and candidates(".", "p/q.py", "py") == ["p/__init__.py"]
    assert candidates("crate::map::scan", "src/m.rs", "rs") == ["src/map/scan.rs", "src/map/scan/mod.rs"]


def test_tree_to_tables(spark, tmp_path):
    for path, text in {"src/core.rs": RUST, "src/main.rs": "use crate::core::private;\n", "pkg/__init__.py": "", "pkg/m.py": "from . import z\n", "node_modules/x.js": JS, ".hidden/a.py": "", "skip.log": "", "gen/out.py": "", ".gitignore": "gen/\n*.log\n"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / "bad.py").write_bytes(b"\xff\xfe")
    tree.register(spark)
    listing = spark.read.format("srclisting").load(str(tmp_path))
    assert [r.path for r in listing.orderBy("path").collect()] == ["bad.py", "pkg/__init__.py", "pkg/m.py", "src/core.rs", "src/main.rs"]
    files = spark.read.format("srctree").load(str(tmp_path)).filter(tree.scannable(extract.F.col("path")))
    found = extract.parsed(files)
    edges = {(r.source_file, r.imported_name): r.target_path for r in extract.imports(found, listing).collect()}
    assert edges[("src/main.rs", "private")] == "src/core.rs" and edges[("pkg/m.py", "z")] == "pkg/__init__.py"
    assert {r.name for r in extract.symbols(found).collect()} >= {"Foo", "Foo::new", "private", "MAX"}


def test_several_declarators_and_items_on_a_line():
    text = "export const a = 1, b = () => 2, { c } = x\nconst d = 3\nlet e = function () { return 1 }, f\nvar fs = require('fs'), g = [1,\n 2]; class K { m({ x }) { } static n() { } field = () => { } } function h() { }\n"
    assert brief(text, "js") == [("a", "const", 1, 1, True), ("b", "fn", 1, 1, True), ("d", "const", 2, 2, False), ("e", "fn", 3, 3, False), ("f", "const", 3, 3, False), ("g", "const", 4, 5, False), ("K", "class", 5, 5, False), ("K::m", "method", 5, 5, False), ("K::n", "method", 5, 5, False), ("h", "fn", 5, 5, False)]
    assert [s.signature for s in symbols("export class Box extends A { }", "js")] == ["class Box extends A"]
    assert brief("#[derive(Debug)] pub struct A; fn b() {} enum C { D }\n", "rs") == [("A", "struct", 1, 1, True), ("b", "fn", 1, 1, False), ("C", "enum", 1, 1, False)]


def test_regex_literals_and_templates_hide_brackets():
    text = "const r = /[{(]/g;\nfunction one() { return /}/.test(x) }\nconst t = `${y ? `{` : '('} {`;\nfunction two() { }\nconst half = a / b / c;\nfunction three() { }\n"
    assert [s.name for s in symbols(text, "js")] == ["r", "one", "t", "two", "half", "three"]


def test_go_groups_and_aliases():
    text = "package p\n\ntype (\n\tA struct {\n\t\tx int\n\t}\n\tb interface{}\n\tC = string\n)\n\ntype ID int\ntype Alias = int\nfunc (s *A) Run() error {\n}\nfunc Map[T any](x T) {\n}\n"
    assert brief(text, "go") == [("A", "type", 3, 9, True), ("b", "type", 3, 9, False), ("ID", "type", 11, 11, True), ("Run", "method", 13, 14, True), ("Map", "fn", 15, 16, True)]


def test_python_spans_and_decorators():
    text = "@cached\ndef a(\n    x,\n):\n    return 1\n\nasync def b(): pass\nclass C:\n    \'\'\'\nclass Not:\n    \'\'\'\n    def m(self): pass\n"
    assert brief(text, "py") == [("a", "fn", 2, 5, True), ("b", "fn", 7, 7, True), ("C", "class", 8, 12, True)]


def test_imports_are_not_read_from_comments_or_strings():
    assert imports("/*\nimport a from './a';\n*/\nconst t = `\nimport b from './b'\n`;\n// import c from './c'\nimport d, { type e as f, g } from \"./d\";\nimport h from 'lib'\n", "ts") == [type(i)(n, "./d", 8) for i in imports("import x from './x'", "js") for n in ("default", "e", "g")]
    assert [(i.name, i.raw_path, i.line) for i in imports('"""\nfrom .fake import x\n"""\nfrom ..pkg import (a as b,  # one\n    c)\nfrom . import *\n# from .no import z\n', "py")] == [("a", "..pkg", 4), ("c", "..pkg", 4)]
    assert [(i.name, i.raw_path) for i in imports("/* use crate::no::X; */\nuse crate::a::{b::{c, d as e}, self, f::*, g};\npub use crate::top;\nuse std::fs;\nuse crate::h::I as J;\n", "rs")] == [("c", "crate::a::b"), ("d", "crate::a::b"), ("*", "crate::a::f"), ("g", "crate::a"), ("top", "crate"), ("I", "crate::h")]
    assert [(i.name, i.line) for i in imports('package p\n// import "no"\nimport f "fmt"\nimport (\n\t"a/b"\n\t. "c" // "d"\n)\n', "go")] == [("fmt", 3), ("b", 5), ("c", 6)]


def test_imports_are_resolved_without_broadcasting_the_listing(spark):
    text = "from .a import x\nfrom .a import y\nfrom . import z\nfrom .none import w\n"
    files = spark.createDataFrame([("p/m.py", text), ("p/m.py", text), ("q/n.go", 'import "a"\n'), ("r.md", None)], "path string, content string")
    listing = spark.createDataFrame([("p/a.py",), ("p/a/__init__.py",), ("p/__init__.py",), ("p/__init__.py",)], "path string")
    found = extract.imports(extract.parsed(files, only=("imports",)), listing)
    plan = found._jdf.queryExecution().executedPlan().toString()  # before a run, which would add the final plan
    got = sorted((r.source_file, r.imported_name, r.target_path, r.raw_path, r.line_number) for r in found.collect())
    once = [("p/m.py", "w", "", ".none", 4), ("p/m.py", "x", "p/a.py", ".a", 1), ("p/m.py", "y", "p/a.py", ".a", 2), ("p/m.py", "z", "p/__init__.py", ".", 3)]
    assert got == sorted([*once, *once, ("q/n.go", "a", "", "a", 1)])
    assert "Broadcast" not in plan and plan.count("MapInArrow") == 1


def test_only_what_is_wanted_is_read(spark, monkeypatch):
    files = spark.createDataFrame([("a/b.js", "import { c } from './c';\nexport class D { m() { } }\n", 7), ("x.py", None, None)], "path string, content string, size int")
    whole = extract.parsed(files)
    assert whole.columns == ["path", "size", "declared", "density", "symbols", "imports"]
    for name in extract.PARSED:
        part = extract.parsed(files, only=(name,))
        assert part.columns == ["path", "size", name] and part.collect() == whole.select("path", "size", name).collect()
    batch = extract.pa.RecordBatch.from_pydict({"path": ["m.js"], "content": ["export class D { }"]})
    monkeypatch.setattr("quarry.lang.reader.imports", lambda *a: 1 / 0)
    monkeypatch.setattr("quarry.lang.summary.summary", lambda *a: 1 / 0)
    (out,) = extract._parse([batch], {"symbols": extract.to_arrow_type(whole.schema["symbols"].dataType)})
    assert [s["name"] for s in out["symbols"][0].as_py()] == ["D"]

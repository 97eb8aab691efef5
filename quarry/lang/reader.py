"""Top-level declarations of a source text.

Comments and string contents are blanked first (same length, same lines). What is left is walked statement by
statement at bracket depth 0, or by lines at indentation 0 in Python. Broken files yield what can be read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass, replace

_C_LIKE = r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\])*(?:\"|\Z)"
_JS_REGEX = r"(?:(?<=[(,=:\[!&|?{};\n>])|(?<=return)|(?<=typeof)|\A)[ \t]*/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*"
_BLANKED = {
    "rust": re.compile(rf"{_C_LIKE}|b?r(#*)\".*?(?:\"\1|\Z)|'(?:\\.[^']*|[^'\\\n])'", re.S),
    "js": re.compile(rf"{_C_LIKE}|'(?:\\.|[^'\\\n])*'|`(?:\\.|\$\{{(?:[^{{}}`]|`[^`]*`)*\}}|[^`\\])*(?:`|\Z)|{_JS_REGEX}", re.S),
    "go": re.compile(rf"{_C_LIKE}|`[^`]*(?:`|\Z)|'(?:\\.[^']*|[^'\\\n])'", re.S),
    "python": re.compile(r"#[^\n]*|(?:'''|\"\"\")(?:\\.|.)*?(?:'''|\"\"\"|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S),
}
LANGUAGES = {"rs": "rust", "js": "js", "jsx": "js", "mjs": "js", "cjs": "js", "ts": "js", "tsx": "js", "py": "python", "go": "go"}


@dataclass(frozen=True)
class Symbol:
    name: str
    kind: str
    signature: str
    line_start: int
    line_end: int
    exported: bool
    word: str = ""
    """What a variable is declared with; not a column."""


@dataclass(frozen=True)
class Import:
    name: str
    raw_path: str
    line: int


def blanked(text: str, lang: str, quotes: bool = False) -> str:
    """The text without comments and strings; with quotes, strings of one line keep theirs around underscores."""

    def blank(m: re.Match) -> str:
        s = m[0]
        if quotes and len(s) > 1 and s[0] == s[-1] and s[0] in "\"'`" and "\n" not in s and s[:3] not in ("'''", '"""') and (s[0] != "`" or lang == "go"):
            return s[0] + "_" * (len(s) - 2) + s[-1]
        return re.sub(r"[^\n]", " ", s)

    return _BLANKED[lang].sub(blank, text)


def signature(text: str) -> str:
    """Up to the first brace, else the first semicolon, else the first line; spaces collapsed, at most 200 bytes."""
    cut = text.split("{", 1)[0] if "{" in text else text.split(";", 1)[0] if ";" in text else text.split("\n", 1)[0]
    flat = " ".join(cut.split())
    raw = flat.encode()
    return flat if len(raw) <= 200 else raw[:197].decode(errors="ignore") + "..."


_MARK = re.compile(r"[{}()\[\];\n]")
_GOES_ON_AFTER, _GOES_ON_BEFORE = set(",=+-*/%&|?:<([{!~^."), set(".,+-*/%&|?:=<>([`)]}")


def _closing(code: str, at: int) -> int:
    """Past the bracket that closes the one at `at`."""
    depth = 0
    for m in _MARK.finditer(code, at):
        depth += (m[0] in "([{") - (m[0] in ")]}")
        if depth == 0 and m[0] in ")]}":
            return m.end()
    return len(code)


def _item_end(code: str, at: int) -> int:
    """The end of an item: its closing brace, or the first ; outside any bracket."""
    depth = 0
    for m in _MARK.finditer(code, at):
        c = m[0]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth <= 0 and c == "}":
                return m.end()
        elif depth == 0 and c == ";":
            return m.end()
    return len(code.rstrip())


def _statement_end(code: str, at: int) -> int:
    """The end of a statement that a line may end: a ; or a line break outside brackets that no operator stands at."""
    depth = 0
    for m in _MARK.finditer(code, at):
        c = m[0]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth < 0:
                return m.start()
        elif depth == 0 and c == ";":
            return m.end()
        elif depth == 0:
            before, after = code[at : m.start()].rstrip(), code[m.end() : m.end() + 200].lstrip()
            if before and (before[-1] not in _GOES_ON_AFTER and not before.endswith("=>")) and (not after or after[0] not in _GOES_ON_BEFORE):
                return m.start()
    return len(code.rstrip())


def _past(code: str, at: int) -> int:
    """Past what is no item: a statement, a block or an attribute."""
    depth, attribute = 0, code[at] in "#@"
    for m in _MARK.finditer(code, at):
        c = m[0]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth <= 0 and (c == "}" or attribute or depth < 0):
                return m.end()
        elif depth == 0:
            return m.end()
    return len(code)


_BETWEEN = re.compile(r"[\s;]*")


def _walk(code: str, at: int, stop: int, read: Callable[[int], int | None]) -> None:
    """Calls read at the beginning of each statement within [at, stop); it gives the end of an item, or nothing."""
    while (at := _BETWEEN.match(code, at).end()) < stop:
        at = max(read(at) or _past(code, at), at + 1)


def _parts(code: str, a: int, b: int) -> list[tuple[int, int]]:
    """[a, b) cut at the commas outside brackets."""
    cuts, depth = [a - 1], 0
    for m in re.compile(r"[{}()\[\],]").finditer(code, a, b):
        depth += (m[0] in "([{") - (m[0] in ")]}")
        if depth == 0 and m[0] == ",":
            cuts.append(m.start())
    return [(x + 1, y) for x, y in zip(cuts, [*cuts[1:], b], strict=True)]


_RUST = re.compile(r"(?P<pub>pub(?:\s*\([^)]*\))?\s+)?(?:(?:default|async|unsafe|const(?=\s+(?:unsafe\s+|async\s+|extern\s+)*fn)|extern(?:\s+\S+)?)\s+)*(?P<kind>fn|struct|enum|trait|const|static|mod)\s+(?:mut\s+)?(?P<name>\w+)")
_IMPL = re.compile(r"(?:unsafe\s+)?impl\b(?P<head>[^{;]*)\{")
_JS = re.compile(r"(?P<pub>export\s+(?:default\s+)?)?(?:(?P<fn>(?:async\s+)?function)\s+(?P<f>[\w$]+)|(?P<class>class)\s+(?P<c>[\w$]+)|(?P<type>type|interface)\s+(?P<t>[\w$]+)(?=\s*[<={]|\s+extends\b)|(?P<enum>(?:const\s+)?enum)\s+(?P<e>[\w$]+)|(?P<var>const|let|var)(?=[\s{\[]))")
_JS_METHOD = re.compile(r"(?:(?:public|private|protected|static|readonly|override|async|get|set)\s+)*\*?\s*(?P<name>#?[\w$]+)\s*(?:<[^>]*>)?(?=\()")
_JS_NAME = re.compile(r"\s*([\w$]+)")
_PY = re.compile(r"(?:async\s+)?(?P<kind>def|class)\s+(?P<name>\w+)")
_GO = re.compile(r"func\s+(?P<recv>\([^)]*\)\s*)?(?P<fn>\w+)|type\s*(?P<many>\()|type\s+(?P<type>\w+)")
_GO_SPEC = re.compile(r"(\w+)(?!\s*=)\b(?!\s*=)")


def _base_type(head: str) -> str:
    """The concrete type of an impl: after `for` if there is one, without generics and path."""
    flat = re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", head)))
    flat = re.split(r"\bwhere\b", re.split(r"\bfor\b", flat)[-1])[0]
    words = re.findall(r"[\w:]+", flat)
    return words[-1].split("::")[-1] if words else ""


def _value(code: str, a: int, b: int) -> int | None:
    """Where the value of the declarator [a, b) begins."""
    depth = 0
    for m in re.compile(r"[{}()\[\]]|=(?![=>])").finditer(code, a, b):
        if m[0] == "=" and depth == 0:
            return m.end() + len(code[m.end() : b]) - len(code[m.end() : b].lstrip())
        depth += (m[0] in "([{") - (m[0] in ")]}")
    return None


def _is_function(code: str, at: int, end: int) -> bool:
    """An arrow function or a function expression."""
    if m := re.compile(r"(?:async\s+)?function\b(?P<many>\s*\*)?").match(code, at, end):
        return not m["many"]
    at = re.compile(r"(?:async\b\s*)?(?:<[^>(]*>)?\s*").match(code, at, end).end()
    if at < end and code[at] == "(":
        return bool(re.compile(r"\s*(?::[^=;]*)?=>").match(code, _closing(code, at), end))
    return bool(re.compile(r"[\w$]+\s*=>").match(code, at, end))


def symbols(text: str, ext: str) -> list[Symbol]:
    lang = LANGUAGES.get(ext)
    if lang is None:
        return []
    code, out = blanked(text, lang), []
    breaks = [m.start() for m in re.finditer("\n", text)]
    line = lambda at: bisect_left(breaks, at) + 1

    def add(name: str, kind: str, a: int, b: int, exported: bool, word: str = "") -> int:
        out.append(Symbol(name, kind, signature(text[a:b]), line(a), line(max(a, b - 1)), exported, word))
        return b

    def rust(a: int) -> int | None:
        if m := _RUST.match(code, a):
            return add(m["name"], m["kind"], a, _item_end(code, m.end()), bool(m["pub"]))
        if m := _IMPL.match(code, a):
            end, owner = _item_end(code, m.end() - 1), _base_type(m["head"])

            def method(i: int) -> int | None:
                f = _RUST.match(code, i)
                return add(f"{owner}::{f['name']}", "method", i, _item_end(code, f.end()), bool(f["pub"])) if f and f["kind"] == "fn" else None

            _walk(code, m.end(), end - 1, method)
            return end
        return None

    def js(a: int) -> int | None:
        m = _JS.match(code, a)
        if m is None:
            return None
        a, exported = m.end("pub") if m["pub"] else a, bool(m["pub"])
        if m["var"]:
            end = _statement_end(code, m.end())
            for x, y in _parts(code, m.end(), end - (code[end - 1 : end] == ";")):
                name, value = _JS_NAME.match(code, x, y), _value(code, x, y)
                if name and (value is None or not re.compile(r"require\s*\(").match(code, value, y)):
                    add(name[1], "fn" if value is not None and _is_function(code, value, y) else "const", a, end, exported, m["var"])
            return end
        if m["type"] == "type":
            return add(m["t"], "type", a, _statement_end(code, m.end()), exported)
        name, kind = next((m[k[0]], "type" if k == "type" else k) for k in ("fn", "class", "type", "enum") if m[k])
        body = code.find("{", _closing(code, code.find("(", m.end())) if kind == "fn" and "(" in code[m.end() :] else m.end())
        end = _closing(code, body) if body >= 0 else _item_end(code, m.end())
        at = len(out)
        add(name, kind, a, end, exported)
        if kind == "class" and body >= 0:

            def method(i: int) -> int | None:
                f = _JS_METHOD.match(code, i)
                past = _closing(code, f.end()) if f and f["name"] not in ("if", "for", "while", "switch", "catch") else None
                opened = past and re.compile(r"[^;{}=]*\{").match(code, past, end)
                return add(f"{name}::{f['name']}", "method", i, _closing(code, opened.end() - 1), exported) if opened else None

            _walk(code, body + 1, end - 1, method)
        assert len(out) > at
        return end

    def go(a: int) -> int | None:
        m = _GO.match(code, a)
        if m is None:
            return None
        if m["fn"]:
            return add(m["fn"], "method" if m["recv"] else "fn", a, _statement_end(code, m.end()), m["fn"][:1].isupper())
        if m["type"]:
            end = _statement_end(code, m.end())
            if not re.compile(r"\s*=").match(code, m.end()):
                add(m["type"], "type", a, end, m["type"][:1].isupper())
            return end
        end = _closing(code, m.start("many"))

        def spec(i: int) -> int:
            if s := _GO_SPEC.match(code, i):
                add(s[1], "type", a, end, s[1][:1].isupper())
            return _statement_end(code, i)

        _walk(code, m.end("many"), end - 1, spec)
        return end

    if lang == "python":
        depth, starts, last = 0, [], 0
        for m in re.finditer(r"^(?=\S)", code, re.M):
            depth = max(0, depth + sum(code.count(c, last, m.start()) for c in "([{") - sum(code.count(c, last, m.start()) for c in ")]}"))
            last = m.start()
            if depth == 0:
                starts.append(m.start())
        plain = _BLANKED[lang].sub(lambda m: " " * len(m[0]) if m[0][0] == "#" else m[0], text)
        for a, b in zip(starts, [*starts[1:], len(code)], strict=False):
            if m := _PY.match(code, a):
                add(m["name"], "fn" if m["kind"] == "def" else "class", a, a + len(plain[a:b].rstrip()), not m["name"].startswith("_"))
        return out
    _walk(code, 0, len(code), {"rust": rust, "js": js, "go": go}[lang])
    return out


_EXPORTS = re.compile(r"^export\s*(?:type\s*)?\{([^}]*)\}|^module\.exports\s*=\s*(?:\{([^}]*)\}|([\w$]+)\s*;?\s*$)", re.M)
_ESM = re.compile(r"(?:^|;)[ \t]*(?P<word>import)\s+(?:type\s+)?(?P<what>[^;'\"]*?)\s*from\s*['\"](?P<path>_+)['\"]", re.M)
_CJS = re.compile(r"^(?:const|let|var)\s*\{(?P<what>[^}]*)\}\s*=\s*require\(\s*['\"](?P<path>_+)['\"]\s*\)", re.M)
_FROM = re.compile(r"^from[ \t]+(?P<path>\.[\w.]*)[ \t]+import[ \t]+(?P<what>\([^)]*\)|[^\n;]+)", re.M)
_USE = re.compile(r"(?:^|[;}])[ \t]*(?P<word>(?:pub(?:\([^)]*\))?\s+)?use)\s+(?P<tree>crate::[^;]*);", re.M)
_GO_IMPORT = re.compile(r"^import\s*(?:\((?P<many>[^)]*)\)|(?:[\w.]+\s+)?(?P<one>[\"`]_+[\"`]))", re.M)


def _names(what: str, alias: str) -> list[str]:
    parts = (p.strip() for p in what.strip().strip("(){}").replace("\\\n", " ").replace("\n", " ").split(","))
    return [re.split(alias, re.sub(r"^type\s+", "", p))[0].strip() for p in parts if p]


def _leaves(tree: str, module: str = "") -> list[tuple[str, str]]:
    """(module, original name) of each leaf of a use tree."""
    tree = tree.strip()
    if "{" not in tree:
        path = re.split(r"\s+as\s+|\s", tree)[0]
        full = f"{module}::{path}" if module else path
        above, _, name = full.rpartition("::")
        return [(above, name)] if name and name != "self" else []
    head, rest = tree.split("{", 1)
    module = "::".join(x for x in (module, head.strip().removesuffix("::").strip()) if x)
    inner = rest[: rest.rfind("}")] if "}" in rest else rest
    return [leaf for a, b in _parts(inner, 0, len(inner)) for leaf in _leaves(inner[a:b], module)]


def exported_names(text: str) -> set[str]:
    """Names in export clauses and in what module.exports is set to."""
    out: set[str] = set()
    for m in _EXPORTS.finditer(blanked(text, "js")):
        for part in (m[1] or m[2] or m[3] or "").split(","):
            name = re.split(r"\s+as\s+|:", part.strip().removeprefix("type "))[0].strip()
            out |= {name} if re.fullmatch(r"[\w$]+", name) else set()
    return out


def with_export_clauses(found: list[Symbol], text: str) -> list[Symbol]:
    """JS symbols where names in export clauses count as exported, and with a class its methods."""
    named = exported_names(text)
    return [replace(s, exported=s.exported or s.name.split("::")[0] in named) for s in found]


def imports(text: str, ext: str) -> list[Import]:
    """Original names of relative (JS, Python), crate (Rust) and all (Go) imports; comments and strings hold none."""
    lang, out = LANGUAGES.get(ext), []
    if lang is None:
        return []
    code = blanked(text, lang, quotes=lang in ("js", "go"))
    breaks = [m.start() for m in re.finditer("\n", text)]
    line = lambda at: bisect_left(breaks, at) + 1
    if lang == "js":
        for m in _ESM.finditer(code):
            at = line(m.start("word"))
            path = text[m.start("path") : m.end("path")]
            if path.startswith("."):
                head, _, rest = m["what"].partition("{")
                default = head.split(",")[0].strip()
                out += [Import("default", path, at)] if default and not default.startswith("*") else []
                out += [Import(n, path, at) for n in _names(rest, r"\s+as\s+")] if rest else []
        for m in _CJS.finditer(code):
            path = text[m.start("path") : m.end("path")]
            out += [Import(re.split(r"\s*=", n)[0], path, line(m.start())) for n in _names(m["what"], ":") if not n.startswith("...")] if path.startswith(".") else []
    elif lang == "python":
        out += [Import(n, m["path"], line(m.start())) for m in _FROM.finditer(code) for n in _names(m["what"], r"\s+as\s+") if n != "*"]
    elif lang == "rust":
        out += [Import(name, module, line(m.start("word"))) for m in _USE.finditer(code) for module, name in _leaves(m["tree"])]
    else:
        for m in _GO_IMPORT.finditer(code):
            group = "many" if m["many"] is not None else "one"
            for p in re.compile(r"[\"`](_+)[\"`]").finditer(code, m.start(group), m.end(group)):
                path = text[p.start(1) : p.end(1)]
                out.append(Import(path.rsplit("/", 1)[-1], path, line(p.start()) if group == "many" else line(m.start())))
    return sorted(out, key=lambda i: i.line)


def candidates(raw_path: str, source: str, ext: str) -> list[str]:
    """Files that an import may mean, in the order in which they are tried."""
    here = source.split("/")[:-1]

    def joined(parts: list[str]) -> str:
        out: list[str] = []
        for p in parts:
            if p == "..":
                out = out[:-1]
            elif p not in ("", "."):
                out.append(p)
        return "/".join(out)

    lang = LANGUAGES.get(ext)
    if lang == "js":
        stem = joined([*here, *raw_path.split("/")])
        return [stem + e for e in ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")]
    if lang == "python":
        dots = len(raw_path) - len(raw_path.lstrip("."))
        base = here[: max(0, len(here) - dots + 1)]
        rest = [p for p in raw_path.lstrip(".").split(".") if p]
        stem = joined([*base, *rest])
        return [f"{stem}.py", f"{stem}/__init__.py".lstrip("/")] if rest else [f"{stem}/__init__.py".lstrip("/")]
    if lang == "rust":
        rest = raw_path.split("::")[1:]
        return [f"src/{'/'.join(rest)}.rs", f"src/{'/'.join(rest)}/mod.rs"] if rest else ["src/lib.rs"]
    return []

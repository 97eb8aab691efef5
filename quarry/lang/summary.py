"""What a code file declares, in one line: exported declarations first, each group in the order of the source."""

from __future__ import annotations

import re

from quarry.lang import reader

COLLECTED, SHOWN = 30, 8
_COMPONENT = ("HTMLElement", "LitElement", "customElement")
_DEFAULT = re.compile(r"^export\s+default\s+(?:(?P<fn>(?:async\s+)?(?:function\b|\([^)]*\)\s*=>|[\w$]+\s*=>))|(?P<class>class\b)|(?P<object>\{)|(?P<call>[\w$.]+)\s*\(|(?P<name>[\w$]+)\s*;?\s*$)", re.M)
_FIRST_TYPE = re.compile(r"(?:<(?:[^<>]|<[^<>]*>)*>)?\s*!?\s*(?:\w+::)*(\w+)")


def _javascript(text: str) -> list[tuple[str, bool]]:
    named, out, lines = reader.exported_names(text), [], text.split("\n")
    code = reader.blanked(text, "js")
    for s in reader.symbols(text, "ts"):
        if s.kind == "method":
            continue
        body = "\n".join(lines[s.line_start - 1 : s.line_end])
        label = None if s.word else {"fn": f"function {s.name}()", "class": f"class {s.name}", "type": f"type {s.name}", "enum": f"enum {s.name}"}[s.kind]
        if label is None:
            label = f"{s.word} {s.name}{'()' if s.kind == 'fn' else ''}"
        elif s.kind == "class" and any(w in body for w in _COMPONENT):
            label += " (web component)"
        start = re.match(r"\s*export\s+(default\s+)?", body)
        prefix = "" if not s.exported else "export default " if start and start[1] else "export "
        out.append((s.line_start, prefix + label if prefix or s.name not in named else f"export {label}", s.exported or s.name in named))
    seen = {line for line, _, _ in out}
    for m in _DEFAULT.finditer(code):
        line = code.count("\n", 0, m.start()) + 1
        if line not in seen:
            what = "function" if m["fn"] else "class" if m["class"] else "{...}" if m["object"] else f"{m['call']}(...)" if m["call"] else m["name"]
            out.append((line, f"export default {what}", True))
    return [(label, exported) for _, label, exported in sorted(out, key=lambda x: x[0])]


def _rust(text: str) -> list[tuple[str, bool]]:
    found = [(s.line_start, f"{'pub ' if s.exported else ''}{s.kind} {s.name}{'()' if s.kind == 'fn' else ''}", s.exported) for s in reader.symbols(text, "rs") if s.kind != "method"]
    code = reader.blanked(text, "rust")
    for m in re.finditer(r"^(?:unsafe\s+)?impl\b(?=[^{;]*\{)", code, re.M):
        if first := _FIRST_TYPE.match(code, m.end()):
            found.append((code.count("\n", 0, m.start()) + 1, f"impl {first[1]}", False))
    return [(label, exported) for _, label, exported in sorted(found, key=lambda x: x[0])]


def declarations(text: str, ext: str) -> list[tuple[str, bool]]:
    """(label, exported) of top-level declarations; impl blocks go by their first type."""
    lang = reader.LANGUAGES.get(ext)
    if lang == "js":
        return _javascript(text)
    if lang == "rust":
        return _rust(text)
    word = {"fn": "def" if lang == "python" else "func", "method": "func"}
    found = reader.symbols(text, ext)
    if lang == "go":  # the first of grouped types stands for all
        found = [s for s, before in zip(found, [None, *found], strict=False) if not (before and s.kind == before.kind == "type" and s.line_start == before.line_start)]
    return [(f"{word.get(s.kind, s.kind)} {s.name}{'()' if s.kind in word else ''}", s.exported) for s in found]


def summary(text: str, ext: str) -> str:
    found = sorted(declarations(text, ext)[:COLLECTED], key=lambda d: not d[1])
    return ", ".join(label for label, _ in found[:SHOWN])

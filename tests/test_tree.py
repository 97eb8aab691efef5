"""Ignore rules and text-map look-ups on the driver; no session."""

import os

import pytest

from quarry import hooks
from quarry.sources import mapfile, tree


def put(root, files):
    for path, text in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)


def test_ignore_rules_of_all_places(tmp_path, monkeypatch):
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "config"))
    monkeypatch.setenv("GIT_CONFIG_GLOBAL", os.devnull)
    put(tmp_path, {"config/git/ignore": "*.tmp.py\nkept.py\n"})
    put(tmp_path / "repo", {
        ".git/info/exclude": "/sub/private/\n", ".gitignore": "**/build/\n*.gen.py\n/sub/only_here.py\n", "sub/.gitignore": "!kept.py\ndocs/**/*.md\n!docs/a/b/keep.md\n[ab]1.py\nq?.py\n#no.py\nspace.py   \n",
        "sub/a.py": "", "sub/x.tmp.py": "", "sub/kept.py": "", "sub/private/p.py": "", "sub/deep/build/b.py": "", "sub/build/b.py": "", "sub/y.gen.py": "", "sub/only_here.py": "", "sub/in/only_here.py": "",
        "sub/docs/one.md": "", "sub/docs/a/b/two.md": "", "sub/docs/a/b/keep.md": "", "sub/a1.py": "", "sub/c1.py": "", "sub/q1.py": "", "sub/q12.py": "", "sub/#no.py": "", "sub/space.py": "", "sub/node_modules/m.js": "", "sub/.hid/x.py": "",
    })
    assert tree.walk(str(tmp_path / "repo/sub")) == ["#no.py", "a.py", "c1.py", "docs/a/b/keep.md", "in/only_here.py", "kept.py", "q12.py"]
    assert "sub/a.py" in tree.walk(str(tmp_path / "repo")) and "sub/private/p.py" not in tree.walk(str(tmp_path / "repo"))
    put(tmp_path, {"plain/a.py": "", "plain/b.tmp.py": ""})
    assert tree.walk(str(tmp_path / "plain")) == ["a.py"]


def test_unreadable_folders_are_skipped(tmp_path, monkeypatch):
    put(tmp_path, {"a/x.py": "", "b/y.py": ""})
    real = os.scandir
    monkeypatch.setattr(os, "scandir", lambda p: (_ for _ in ()).throw(PermissionError(p)) if str(p).endswith("/a") else real(p))
    assert tree.walk(str(tmp_path)) == ["b/y.py"]


@pytest.mark.parametrize(("path", "want"), [
    ("top.rs", {"path": "top.rs", "description": "fn main()", "token_estimate": 12, "density": 0.55}), ("src/x/b.py", {"path": "src/x/b.py", "description": "two (~1) parts", "token_estimate": 7, "density": None}),
    ("src/x/top.rs", None), ("src/x/c.md", {"path": "src/x/c.md", "description": "no count", "token_estimate": 0, "density": None}),
])
def test_look_up_in_the_text_map(tmp_path, path, want):
    put(tmp_path, {mapfile.NAME: "# Source map\n\n## .\n\n- `top.rs` — fn main() (~12 tok, dense)\n\n## src/x\n\n- `b.py` — two (~1) parts (~7 tok)\n- `c.md` — no count\n"})
    assert hooks.lookup(str(tmp_path), path) == want
    assert hooks.lookup(str(tmp_path / "absent"), path) is None

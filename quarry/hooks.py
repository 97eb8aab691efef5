"""Editor hooks: one JSON object in, at most one out. They look up single rows, so no session starts unless a scan is due."""

from __future__ import annotations

import json
import os
import time
from datetime import UTC, datetime

import pyarrow.dataset as ds

from quarry.plans import build
from quarry.sources import events, mapfile, projects, tree

STALE_DAYS, DRIFT, ARCHITECTURE_FROM = 7, 0.03, 20


def answer(event: str, context: str = "", permission: str | None = None) -> str:
    out = {"hookEventName": event, **({"permissionDecision": permission} if permission else {}), **({"additionalContext": context} if context else {})}
    return json.dumps({"hookSpecificOutput": out}, ensure_ascii=False)


def _project(payload: dict) -> tuple[str, str]:
    """(root, file_path) of a payload."""
    cwd, path = payload.get("cwd"), (payload.get("tool_input") or {}).get("file_path")
    cwd, path = cwd if isinstance(cwd, str) else ".", path if isinstance(path, str) else ""
    return projects.find_root(cwd) or (projects.find_root(path) if path else None) or os.path.abspath(cwd), path


def lookup(folder: str, path: str) -> dict | None:
    """One file's entry by path; row groups are sorted by it, so others are skipped. Without an index, from the text map."""
    version = build.current(folder)
    if version is None:
        return mapfile.find(folder, path)
    found = ds.dataset(os.path.join(version, "files"), format="parquet").to_table(filter=ds.field("path") == path).to_pylist()
    return found[0] if found else None


def entry_text(entry: dict) -> str:
    density = entry["density"]
    label = "" if density is None or 0.15 <= density < 0.5 else ", repetitive" if density < 0.15 else ", dense"
    return f"{entry['path']} — {entry['description']} (~{entry['token_estimate']} tok{label})"


def pre_read(payload: dict) -> str:
    root, path = _project(payload)
    owned = projects.owner(path) if path else None
    if owned is None:
        return answer("PreToolUse")
    home, relative = owned
    entry = lookup(projects.state_dir(home), relative)
    events.record("map_hit" if entry else "map_miss", home, entry["token_estimate"] if entry else 0)
    lines = [f"[quarry] map: {entry_text(entry)}"] if entry else []
    return answer("PreToolUse", "\n".join([*lines, *([f"[quarry] foreign: {home}"] if home != root else [])]))


def _header(folder: str) -> tuple[datetime, int] | None:
    try:
        with open(os.path.join(folder, mapfile.NAME), encoding="utf-8") as f:
            for line in (next(f, "") for _ in range(5)):
                if line.startswith("<!-- Generated: "):
                    stamp, _, count = line.removeprefix("<!-- Generated: ").rstrip().removesuffix(" -->").partition(" | Files: ")
                    return datetime.fromisoformat(stamp).astimezone(UTC), int(count)
    except (OSError, ValueError):
        pass
    return None


header = _header


def is_stale(root: str) -> bool:
    """No header; or another set or time of source files than stored; without a stored listing, old or of another size."""
    folder = projects.state_dir(root)
    known = _header(folder)
    if known is None:
        return True
    now = [p for p in tree.walk(root) if tree.is_scannable(p)]
    version = build.current(folder)
    if version is not None:
        stored = {r["path"]: r["mtime_ms"] for r in ds.dataset(os.path.join(version, "listing"), format="parquet").to_table(columns=["path", "mtime_ms"]).to_pylist() if tree.is_scannable(r["path"])}
        return stored != {p: int(os.stat(os.path.join(root, p)).st_mtime * 1000) for p in now}
    at, count = known
    return time.time() - at.timestamp() >= STALE_DAYS * 86400 or abs(len(now) - count) / max(count, 1) > DRIFT


def session_start(payload: dict, session) -> str | None:
    """Scans a stale project (session gives the Spark session) and tells its architecture if it is large enough."""
    root, _ = _project(payload)
    folder = projects.initialized(root)
    if is_stale(root):
        build.scan(session(), root)
    known = build.read_architecture(folder)
    shown = known is not None and known["file_count"] >= ARCHITECTURE_FROM
    events.record("arch_hit" if shown else "arch_miss", root)
    events.record("session_start", root)
    events.purge()
    return answer("SessionStart", architecture_text(known)) if shown else None


def architecture_text(known: dict) -> str:
    return "\n".join([f"[quarry] arch: {known['languages']}", *([f"[quarry] arch: hotspots: {known['hotspots']}"] if known["hotspots"] else [])])

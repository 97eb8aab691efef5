"""Repositories on the driver's disk and the folder that holds a project's index."""

from __future__ import annotations

import os

STATE = ".quarry"


def is_repository(folder: str) -> bool:
    return os.path.exists(os.path.join(folder, ".git"))


def find_root(start: str) -> str | None:
    """The nearest folder at or above start with a repository or an index."""
    at = os.path.abspath(start)
    while True:
        if is_repository(at) or os.path.isdir(os.path.join(at, STATE)):
            return at
        above = os.path.dirname(at)
        if above == at:
            return None
        at = above


def child_repositories(base: str) -> list[str]:
    with os.scandir(base) as found:
        return sorted(e.path for e in found if e.is_dir() and is_repository(e.path))


def discover(base: str) -> list[str]:
    """Child repositories of base; its siblings if it is a repository without any; base itself if it is one."""
    base = os.path.abspath(base)
    found, own = child_repositories(base), is_repository(base)
    if own and not found:
        found = child_repositories(os.path.dirname(base))
    return sorted({*found, *([base] if own else [])})


def state_dir(root: str) -> str:
    return os.path.join(root, STATE)


def initialized(root: str) -> str:
    """The state folder, made if missing."""
    os.makedirs(state_dir(root), exist_ok=True)
    return state_dir(root)


def required(root: str) -> str:
    if not os.path.isdir(state_dir(root)):
        raise FileNotFoundError(f"{root} has no index yet; run: quarry scan")
    return state_dir(root)


def owner(path: str) -> tuple[str, str] | None:
    """(root, relative path) of the project with an index that holds a file."""
    root = find_root(os.path.dirname(os.path.abspath(path)))
    if root is None or not os.path.isdir(state_dir(root)):
        return None
    return root, os.path.relpath(os.path.abspath(path), root)

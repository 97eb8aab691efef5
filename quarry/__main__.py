"""python -m quarry COMMAND: the engine on one's own source trees."""

from __future__ import annotations

import argparse
import json
import os
import sys
from datetime import UTC, datetime

from pyspark.sql import functions as F

from quarry import hooks
from quarry.functions.scalars import bar, format_duration, format_tokens
from quarry.operators import fulltext, graph, ledger, search, stale
from quarry.plans import build
from quarry.session import get_session
from quarry.sources import events, git, mapfile, projects


def session():
    spark = get_session("quarry", None if os.environ.get("SPARK_REMOTE") or os.environ.get("MASTER") else "local[*]", **{"spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _root(context: str | None) -> str:
    return projects.find_root(context or ".") or os.path.abspath(context or ".")


def scan(a: argparse.Namespace) -> int:
    if a.all:
        return scan_all(os.path.abspath(a.path or "."))
    root, spark = _root(a.path), session()
    if a.check:
        stored = build.load(spark, projects.required(root), "files")
        report = stale.staleness(build.entries(build.parsed(spark, root)), stored).first().report
        print(f"Map is up to date ({stored.count()} files)" if report == "up to date" else f"Map is stale: {report}", file=sys.stdout if report == "up to date" else sys.stderr)
        return int(report != "up to date")
    n = build.scan(spark, root)
    print(f"Scanned {n['files']} files, {n['symbols']} symbols, {n['imports']} imports → {projects.STATE}/{mapfile.NAME}")
    return 0


def scan_all(base: str) -> int:
    found, errors, spark = projects.discover(base), 0, None
    if not found:
        print(f"No git repos found under {base}", file=sys.stderr)
        return 1
    for root in found:
        try:
            spark = spark or session()
            n = build.scan(spark, root)
            print(f"  ✓ {os.path.basename(root):<24} ({n['files']} files, {n['symbols']} symbols)", file=sys.stderr)
        except Exception as e:  # noqa: BLE001 one repository's failure must not stop the others
            errors += 1
            print(f"  ✗ {os.path.basename(root):<24} ({e})", file=sys.stderr)
    print(f"\n{len(found)} repos found, {len(found) - errors} scanned{f', {errors} errored' if errors else ''}", file=sys.stderr)
    return int(errors > 0)


def sketch(a: argparse.Namespace) -> int:
    root = _root(a.context)
    found = search.sketch(build.load(session(), projects.required(root), "symbols"), a.symbol).collect()
    events.record("sketch_hit" if found else "sketch_miss", root)
    for r in found:
        print(f"  {r.file_path}:{r.line_start}-{r.line_end}  {r.signature}")
    if not found:
        print(f"No symbols found: {a.symbol}")
    return 0


def find(a: argparse.Namespace) -> int:
    folder, spark = projects.required(_root(a.context)), session()
    found = fulltext.find(build.load(spark, folder, "symbols"), build.load(spark, folder, "imports"), a.query, a.limit, build.term_index(folder)).collect()
    for r in found:
        print(f"  {r.kind:6}  {r.name:<30}  {r.file_path}:{r.line_start}")
    if not found:
        print(f"No symbols found: {a.query}")
    return 0


def callers(a: argparse.Namespace) -> int:
    folder, spark = projects.required(_root(a.context)), session()
    edges = graph.importers(build.load(spark, folder, "imports"), build.load(spark, folder, "symbols")).filter(F.col("imported_name") == a.symbol)
    found = graph.callers(edges).orderBy("source_file").collect()
    print(f"{len(found)} file(s) import {a.symbol}:" if found else f"No importers found for: {a.symbol}")
    for r in found:
        print(f"  {r.source_file}:{r.lines}")
    return 0


def impact(a: argparse.Namespace) -> int:
    root = _root(a.context)
    folder = projects.required(root)
    if not git.is_repository(root):
        print("Not a git repository.", file=sys.stderr)
        return 1
    pointer, commit = os.path.join(folder, build.POINTER), git.last_commit_s(root)
    if commit and os.path.exists(pointer) and os.stat(pointer).st_mtime < commit:
        print("Warning: the index is older than the last commit; run: quarry scan", file=sys.stderr)
    base = git.diff_base(root, a.base)
    text, new = git.diff(root, base), [] if base else git.untracked(root)
    spark = session()
    changed = git.hunks(spark.createDataFrame([(text,)], "diff string"))
    symbols, imports = build.load(spark, folder, "symbols"), build.load(spark, folder, "imports")
    found = graph.impact(symbols, changed, imports).orderBy(F.desc("importer_count"), "file_path", "line_start").collect()
    if not found:
        print("No tracked symbol changes detected." if new else "No symbol changes detected.")
    for r in found:
        print(f"Changed: {r.kind} {r.name}{'' if r.exported else ' (private)'} ({r.file_path}:{r.line_start}) — {r.importer_count} importers | Risk: {r.risk}")
    files = [r.source_file for r in graph.affected_files(symbols, changed, imports).orderBy("source_file").collect()] if found else []
    if files:
        print("\nAffected files (deduplicated):", *(f"  {f}" for f in files), sep="\n")
    if new:
        print("\nUntracked new files (git add and scan them for detail):", *(f"  New: {f}" for f in new), sep="\n")
    return 0


def arch(a: argparse.Namespace) -> int:
    root = _root(a.context)
    known = build.read_architecture(projects.state_dir(root))
    if known is None:
        print(f'Architecture summary not found. Run `quarry scan "{root}"` to generate it.')
    else:
        print(f'Architecture summary is stale. Run `quarry scan "{root}"` to refresh.' if hooks.is_stale(root) else hooks.architecture_text(known))
    return 0


def _gain(spark, project: str | None):
    log = events.read(spark, project)
    return ledger.gain(log).withColumns({"saved": format_tokens(F.col("tokens_saved")), "edit": format_duration(F.col("avg_first_edit")), **{f"{n}_bar": bar(F.col(f"{n}_rate") / 100, 24) for n in ("map", "sketch", "arch")}}).first(), log


def gain(a: argparse.Namespace) -> int:
    project = None if a.everywhere else _root(None)
    g, log = _gain(session(), project)
    print(f"Usage — {project or 'all projects'}")
    for label, value in (("Total events:", g.total_events), ("Map hits:", g.n_map_hit), ("Map misses:", g.n_map_miss), ("Sketch hits:", g.n_sketch_hit), ("Sketch misses:", g.n_sketch_miss), ("Tokens saved:", g.saved)):
        print(f"{label:<18} {value:>10}")
    print(f"{'Hit rate:':<18} {g.map_bar} {g.map_rate:.1f}%")
    for name in ("sketch", "arch"):
        if g[f"n_{name}_hit"] + g[f"n_{name}_miss"]:
            print(f"{name.capitalize() + ' rate:':<18} {g[f'{name}_bar']} {g[f'{name}_rate']:.1f}%")
    if g.n_first_edit:
        turns = f", {g.avg_first_edit_turns:.1f} turns ({g.n_first_edit_turns} samples)" if g.n_first_edit_turns else ""
        print(f"{'First edit:':<18} {g.edit:>10}  ({g.n_first_edit} samples){turns}")
    rows = ledger.daily_bars(log).withColumn("saved", format_tokens(F.col("tokens_saved"))).orderBy(F.desc("day")).collect()
    for i, r in enumerate(rows, 1):
        print(f" {i:>2}.  {r.day!s:<12} {r.events:>7}  {r.saved:>8}  {r.bar}")
    return 0


def status(a: argparse.Namespace) -> int:
    root = _root(None)
    if not a.all:
        folder = projects.state_dir(root)
        if not os.path.isdir(folder):
            print(f"No {projects.STATE}/ directory found at {root}; run: quarry scan")
            return 0
        known = hooks.header(folder)
        print(f"Status: {root}\n\nMap:     {f'{known[1]} files (last scan: {known[0]:%Y-%m-%d %H:%M})' if known else 'not generated (run: quarry scan)'}")
        g, _ = _gain(session(), root)
        print(f"Ledger:  {g.total_events} events, {g.map_rate:.1f}% hit rate, ~{g.saved} tokens saved")
        return 0
    found = projects.discover(root)
    print(f"Status: {len(found)} projects\n" if found else f"No git repos found under {root}")
    width = max([10, *(len(os.path.basename(p)) for p in found)])
    for p in found:
        name, known = f"{os.path.basename(p):<{width}}", hooks.header(projects.state_dir(p))
        if not os.path.isdir(projects.state_dir(p)):
            print(f"  - {name}  no {projects.STATE}/")
        elif known is None:
            print(f"  ? {name}  map: not generated")
        else:
            age = (datetime.now(UTC) - known[0]).days
            old = age >= hooks.STALE_DAYS
            print(f"  {'!' if old else '✓'} {name}  map: {known[1]} files ({f'{age}d ago' if age else 'today':<8}){'  [stale]' if old else ''}")
    return 0


def hook(a: argparse.Namespace) -> int:
    payload = json.load(sys.stdin)
    out = hooks.pre_read(payload) if a.event == "pre-read" else hooks.session_start(payload, session)
    if out:
        print(out)
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quarry")
    commands = parser.add_subparsers(dest="command", required=True)
    add = lambda name, run: (p := commands.add_parser(name), p.set_defaults(run=run))[0]
    p = add("scan", scan)
    either = p.add_mutually_exclusive_group()
    either.add_argument("--check", action="store_true")
    either.add_argument("--all", action="store_true")
    p.add_argument("path", nargs="?")
    for name, run, argument in (("sketch", sketch, "symbol"), ("find", find, "query"), ("callers", callers, "symbol"), ("impact", impact, ""), ("arch", arch, "")):
        p = add(name, run)
        if argument:
            p.add_argument(argument)
        p.add_argument("-C", "--context")
        if name == "find":
            p.add_argument("--limit", type=int, default=20)
        if name == "impact":
            p.add_argument("--base")
    add("gain", gain).add_argument("--global", dest="everywhere", action="store_true")
    add("status", status).add_argument("--all", action="store_true")
    add("hook", hook).add_argument("event", choices=("pre-read", "session-start"))
    a = parser.parse_args(argv)
    try:
        return a.run(a)
    except (FileNotFoundError, git.GitError, json.JSONDecodeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())

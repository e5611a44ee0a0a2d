"""The reports as a program: `python -m quillon COMMAND`. Exit code 0, 1 if a strict check finds something, 2 for what cannot be answered or is blocked."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from quillon import project
from quillon.operators import guard
from quillon.project import Opened, Problem
from quillon.sources import transcripts, trees

# Commands with their options, which clients call by these names.
COMMANDS = {
    "map": ("a module: purpose, parts, public items, dependencies", {"path": str, "depth": 1, "fields": False, "private": False}),
    "show": ("one item, module or range of lines", {"symbol": str}),
    "howto": ("recipes, or the one with these words", {"topic": list}),
    "deps": ("what a module depends on, or who depends on it", {"path": str, "depth": 1, "reverse": False}),
    "check": ("missing documentation, broken links, syntax errors", {"path": None, "strict": False, "changed": None}),
}
KEYWORDS = {
    "rust": frozenset("pub fn struct enum trait impl mod use const static type macro_rules crate async unsafe".split()),
    "typescript": frozenset("export default function class interface type const let var enum async abstract declare namespace public private protected static readonly import".split()),
}
TYPES = {"rust": ("rust",), "typescript": ("ts", "js", "typescript", "javascript")}


def answer(at: Opened, command: str, given: dict) -> tuple[str, int]:
    """Text and exit code of a command with its options."""
    g = {n: v for n, v in COMMANDS[command][1].items() if not isinstance(v, type)} | {k: v for k, v in given.items() if v is not None}
    if command == "map":
        return at.reports.map(at.scope(g["path"]), int(g["depth"]), bool(g["fields"]), bool(g["private"])), 0
    if command == "deps":
        return at.reports.deps(at.scope(g["path"]), int(g["depth"]) - 1, bool(g["reverse"])), 0
    if command == "howto":
        topic = g.get("topic") or []
        return at.reports.howto(" ".join([topic] if isinstance(topic, str) else topic) or None), 0
    if command == "show":
        try:
            return at.reports.page_of(g["symbol"], lambda q: project.split_query(q, at.project.language)), 0
        except ValueError as e:
            raise Problem(str(e)) from e
    more = project.changed(at.files.sparkSession, at, g["changed"]) if g["changed"] else ()
    text, bad = at.reports.check(at.scope(g["path"]), *more)
    return text, int(bad and bool(g["strict"]))


def guarded(at: Opened, call: dict, cwd: Path) -> str | None:
    """Why a tool call is blocked; null lets it through."""
    spark, given = at.files.sparkSession, dict(call.get("tool_input") or {})
    for name in ("file_path", "path"):
        if given.get(name):
            full = (cwd / given[name]).resolve()
            if not full.is_relative_to(at.root):
                return None
            given[name] = str(full.relative_to(at.root))
    row = [(1, call.get("tool_name"), json.dumps(given))]
    calls = spark.createDataFrame(row, "call_id long, tool_name string, tool_input string")
    language, cat = at.project.language, at.reports.cat
    asked = guard.requests(calls, trees.EXTENSIONS[language], TYPES[language], KEYWORDS[language])
    names = cat.items.select("name").union(cat.modules.where("size(module) > 0").selectExpr("element_at(module, -1)"))
    r = guard.judged(calls, asked, cat.files, names).first()
    return None if r.verdict == "allow" else {"whole": "reads a whole file: show its map first, then read lines", "range": "reads lines with a shell: read them by offset and limit", "search": "searches for names: `show` and `deps` resolve them"}[r.reason]


def stopped(spark: SparkSession, at: Opened, call: dict) -> str | None:
    """What a session's own changes leave undocumented; null if nothing, or if it was said before."""
    if call.get("stop_hook_active") or not call.get("transcript_path"):
        return None
    files, base = project.changed(spark, at, "HEAD")
    edited, commands = transcripts.touched(transcripts.read_sessions(spark, f"file://{call['transcript_path']}"))
    paths = {str(Path(r.path).relative_to(at.root)) if Path(r.path).is_relative_to(at.root) else r.path for r in edited.select("path").collect()}
    said = "\n".join(r.commands for r in commands.collect())
    mine = [(r.path, r.is_new) for r in files.collect() if r.path in paths or r.path in said]
    if not mine:
        return None
    text, bad = at.reports.check([], spark.createDataFrame(mine, "path string, is_new boolean"), base)
    return f"document what this session added:\n{text}" if bad else None


def hooked(kind: str, text: str, spark: Callable[[], SparkSession]) -> tuple[int, str]:
    """Answer to a hook's JSON: (2, why) blocks. Whatever is unclear is let through."""
    try:
        call = json.loads(text)
        cwd = Path(call.get("cwd") or ".").resolve()
        if kind == "guard" and call.get("tool_name") not in ("Read", "Grep", "Bash"):
            return 0, ""
        root = project.find_root(cwd)
        if root is None:
            return 0, ""
        at = project.opened(spark(), root)
        why = guarded(at, call, cwd) if kind == "guard" else stopped(spark(), at, call)
    except Exception:  # noqa: BLE001  a guard that fails must not stand in the way
        return 0, ""
    return (2, why + "\n") if why else (0, "")


def served(lines: Iterable[str], open_: Callable[[], Opened]) -> Iterator[dict]:
    """Replies to JSON-RPC requests, one a line. Notifications get none; the project is read anew for each call."""
    for line in filter(str.strip, lines):
        try:
            asked = json.loads(line)
        except ValueError:
            yield {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
            continue
        if not isinstance(asked, dict) or "id" not in asked:
            continue
        reply, params = {"jsonrpc": "2.0", "id": asked["id"]}, asked.get("params") or {}
        method = asked.get("method")
        if method == "initialize":
            yield reply | {"result": {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "quillon", "version": "1"}}}
        elif method == "ping":
            yield reply | {"result": {}}
        elif method == "tools/list":
            yield reply | {"result": {"tools": [_tool(n) for n in COMMANDS]}}
        elif method == "tools/call":
            try:
                if params.get("name") not in COMMANDS:
                    raise Problem(f"no tool {params.get('name')}")
                text, bad = answer(open_(), params["name"], params.get("arguments") or {})[0], False
            except (Problem, KeyError) as e:
                text, bad = str(e), True
            yield reply | {"result": {"content": [{"type": "text", "text": text}], "isError": bad}}
        else:
            yield reply | {"error": {"code": -32601, "message": f"no method {method}"}}


def _tool(name: str) -> dict:
    about, options = COMMANDS[name]
    kinds = {n: "boolean" if v is False else "integer" if isinstance(v, int) else "string" for n, v in options.items()}
    needed = [n for n, v in options.items() if v is str]
    return {"name": name, "description": about, "inputSchema": {"type": "object", "properties": {n: {"type": k} for n, k in kinds.items()}, "required": needed}}


def usage_table(rows: DataFrame) -> str:
    """transcripts.usage() as a table of fixed width."""
    cells = [["" if v is None else str(v) for v in r] for r in rows.collect()]
    widths = [max(map(len, c)) for c in zip(rows.columns, *cells)]
    line = lambda r: "  ".join(v.ljust(w) if i < 2 else v.rjust(w) for i, (v, w) in enumerate(zip(r, widths))).rstrip()
    return "\n".join(map(line, [rows.columns, *cells])) + "\n"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("quillon", description="Reports on the structure and documentation of source trees.")
    top.add_argument("--root", type=Path)
    sub = top.add_subparsers(dest="command", required=True)
    for name, (about, options) in COMMANDS.items():
        p = sub.add_parser(name, help=about, aliases=["out"] if name == "howto" else [])
        for option, default in options.items():
            if option in ("path", "symbol"):
                p.add_argument(option, nargs=None if default is str else "?")
            elif default is list:
                p.add_argument(option, nargs="*")
            elif option == "changed":
                p.add_argument("--changed", nargs="?", const="HEAD", metavar="REVISION")
            elif default is False:
                p.add_argument(f"--{option}", action="store_true")
            else:
                p.add_argument(f"--{option}", type=int, default=default)
    sub.add_parser("mcp", help="answer JSON-RPC requests on standard input")
    sub.add_parser("hook", help="answer a hook's JSON on standard input").add_argument("kind", choices=("guard", "stop"))
    use = sub.add_parser("usage", help="how sessions read sources")
    use.add_argument("sessions")
    use.add_argument("--tool", default="quillon")
    use.add_argument("--extension", default=".rs")
    use.add_argument("--mark", default="guard")
    use.add_argument("--since")
    use.add_argument("--all", action="store_true")
    return top


def run(args: list[str], spark: Callable[[], SparkSession], text: Iterable[str] = ()) -> tuple[int, str, str]:
    """(exit code, standard output, standard error). text: lines of standard input."""
    g = parser().parse_args(args)
    command = "howto" if g.command == "out" else g.command

    def open_() -> Opened:
        near = Path(getattr(g, "path", None) or ".")
        root = g.root.resolve() if g.root else project.find_root(near if near.exists() else Path("."))
        if root is None:
            raise Problem("no project here: no folder above has a manifest")
        return project.opened(spark(), root)

    if command == "hook":
        code, why = hooked(g.kind, "".join(text), spark)
        return code, "", why
    if command == "mcp":
        return 0, "".join(json.dumps(r) + "\n" for r in served(text, open_)), ""
    try:
        if command == "usage":
            sessions = transcripts.read_sessions(spark(), g.sessions)
            return 0, usage_table(transcripts.usage(sessions, g.tool, g.extension, g.mark, g.since, g.all)), ""
        out, code = answer(open_(), command, {k: v for k, v in vars(g).items() if k in COMMANDS[command][1]})
        return code, out, ""
    except Problem as e:
        return 2, "", f"{e}\n"


def main() -> int:
    spark = lambda: SparkSession.builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.log.level", "ERROR").getOrCreate()
    if "mcp" in sys.argv[1:2]:  # replies as the requests come
        for reply in served(sys.stdin, lambda: project.opened(spark(), project.find_root(Path(".")) or Path("."))):
            print(json.dumps(reply), flush=True)
        return 0
    code, out, err = run(sys.argv[1:], spark, sys.stdin if sys.argv[1:2] == ["hook"] else ())
    sys.stdout.write(out)
    sys.stderr.write(err)
    return code

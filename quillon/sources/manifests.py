"""Project manifests and settings: TOML, JSON and JSON with comments. Small files, read on the driver; many of them go through manifests()."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.functions.shell import lexical
from quillon.runtime import ship

_TABLES = ("dependencies", "dev-dependencies", "build-dependencies")
_JSON_TABLES = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
#: Directories that are looked for, in this order, if the settings name none.
SOURCE_DIRS = ("src", "source", "lib")
#: Package that switches the framework's own relations on.
PACK = "bevy"


@dataclass
class Project:
    name: str
    language: str
    externals: list[str] = field(default_factory=list)
    source_dir: str = "src"
    pack: bool = False
    workspace: bool = False


def cargo(text: str) -> Project | None:
    """A crate's manifest; null if it is none (a workspace without a package is none)."""
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return None
    if not isinstance(data.get("package"), dict):
        return None
    places = [data, *(t for t in data.get("target", {}).values() if isinstance(t, dict))]
    names = sorted({n.replace("-", "_") for p in places for t in _TABLES for n in p.get(t, {})})
    name = data["package"].get("name")
    return Project(name if isinstance(name, str) else "crate", "rust", names, pack=PACK in names, workspace="workspace" in data)


def package_json(text: str, folder: str = "", dirs: tuple[str, ...] = (), source: str | None = None) -> Project | None:
    """A package's manifest. folder: the name it has otherwise. dirs: directories that exist beside it; source: the one that the settings name."""
    try:
        data = json.loads(text)
    except ValueError:
        return None
    if not isinstance(data, dict):
        return None
    names = sorted({n for t in _JSON_TABLES for n in data.get(t) or {}})
    return Project(data.get("name") or folder or "package", "typescript", names, source or next((d for d in SOURCE_DIRS if d in dirs), ""), workspace="workspaces" in data)


_NOTES = re.compile(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?(?:\*/|\Z)', re.S)
_TRAILING = re.compile(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', re.S)


def without_comments(text: str) -> str:
    """JSON without comments and trailing commas; strings are left alone."""
    for pattern in (_NOTES, _TRAILING):
        text = pattern.sub(lambda m: m[1] or "", text)
    return text


def inherited(name: str, read: Callable[[str], str | None], depth: int = 5) -> dict:
    """The settings in file `name` over those that it extends, `depth` files deep. read: text of a file below the root, null without it."""
    text = read(name)
    try:
        data = json.loads(without_comments(text)) if text is not None else {}
    except ValueError:
        data = {}
    options = data.get("compilerOptions") or {}
    parent = data.get("extends")
    if depth and isinstance(parent, str) and parent.startswith("."):
        base = name.rpartition("/")[0]
        target = re.sub(r"(^|/)\./", r"\1", f"{base}/{parent}".lstrip("/"))
        options = inherited(target if target.endswith(".json") else f"{target}.json", read, depth - 1) | options
    return options


def aliases(options: dict, source_dir: str = "") -> list[tuple[str | None, bool, list[str]]]:
    """(prefix, exact, module path) for the names that compiler options give folders below source_dir; the base folder has a null prefix."""

    def below(path: str) -> list[str] | None:
        full = lexical(path, options.get("baseUrl") or "")
        top = [p for p in source_dir.split("/") if p not in ("", ".")]
        parts = None if full is None else [p for p in full.split("/") if p]
        return None if parts is None or parts[: len(top)] != top else parts[len(top) :]

    out = []
    for pattern, targets in (options.get("paths") or {}).items():
        target = first_text(targets)
        path = below(target.removesuffix("*")) if target is not None else None
        if path is not None:
            out.append((pattern.removesuffix("*"), not pattern.endswith("*"), path))
    base = below("") if options.get("baseUrl") is not None else None
    return out + ([(None, False, base)] if base is not None else [])


def first_text(value: object) -> str | None:
    """The first string in nested JSON, depth first."""
    if isinstance(value, str):
        return value
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return next((s for s in map(first_text, inner) if s is not None), None)


def settings(text: str | None) -> dict:
    """A project's own settings (TOML): source, relations (call, name) and docs.fact_prefixes. Unknown keys and broken text are errors."""
    data = tomllib.loads(text) if text else {}
    unknown = set(data) - {"source", "relations", "docs"} | {k for r in data.get("relations", []) for k in set(r) - {"call", "name"}} | set(data.get("docs", {})) - {"fact_prefixes"}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return {"source": data.get("source"), "relations": [(r["name"], r["call"]) for r in data.get("relations", [])], "fact_prefixes": data.get("docs", {}).get("fact_prefixes", [])}


def manifests(files: DataFrame) -> DataFrame:
    """files: project_id, path (of a Cargo.toml or package.json), source -> project_id, name, language, externals, source_dir, pack. Of several, Cargo first."""
    ship(files.sparkSession)
    schema = "project_id string, priority int, name string, language string, externals array<string>, source_dir string, pack boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for project, path, text in zip(*(b.column(c).to_pylist() for c in ("project_id", "path", "source"))):
                rust = path.endswith("Cargo.toml")
                found = cargo(text or "") if rust else package_json(text or "", str(project))
                if found:
                    rows.append((project, 0 if rust else 1, found.name, found.language, found.externals, found.source_dir, found.pack))
            columns = zip(*rows) if rows else [()] * 7
            types = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["project_id", "priority", "name", "language", "externals", "source_dir", "pack"])

    from quillon.operators.order import first_wins

    return first_wins(files.select("project_id", "path", "source").mapInArrow(run, schema), ["project_id"], ["priority"]).drop("priority")

"""One project on the driver's disk: its root, manifest, settings and catalog, and what changed in it since a revision."""

from __future__ import annotations

import re
import subprocess
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from quillon.operators import code
from quillon.plans.reports import Reports
from quillon.sources import manifests, script, trees

MANIFESTS = ("Cargo.toml", "package.json")
SETTINGS = "quillon.toml"


class Problem(Exception):
    """What a user has to put right."""


def _read(path: Path) -> str | None:
    return path.read_text("utf-8", "replace") if path.is_file() else None


def described(root: Path) -> manifests.Project | None:
    """The project in a folder by its manifest; null without a usable one."""
    own = manifests.settings(_read(root / SETTINGS))
    if (text := _read(root / MANIFESTS[0])) is not None and (found := manifests.cargo(text)):
        return found
    if (text := _read(root / MANIFESTS[1])) is None:
        return None
    dirs = tuple(p.name for p in root.iterdir() if p.is_dir())
    return manifests.package_json(text, root.name, dirs, own["source"])


def find_root(start: Path) -> Path | None:
    """The nearest folder with a manifest, from start upwards."""
    start = start.resolve()
    return next((d for d in (start, *start.parents) if d.is_dir() and described(d)), None)


def split_query(text: str, language: str) -> list[str]:
    """Segments of a name: Rust parts with :: and /, scripts with dots too."""
    return script.split_query(text) if language == "typescript" else [p for p in re.split(r"::|/", text) if p]


@dataclass
class Opened:
    root: Path
    project: manifests.Project
    files: DataFrame
    reports: Reports

    def scope(self, query: str | None) -> list[str]:
        """The module that a path on disk or a module's name means."""
        if not query or query in (".", "crate"):
            return []
        found = self.reports.module_of(query)
        if found is not None:
            return found
        segments = split_query(query, self.project.language)
        anchored = segments[:1] == ["crate"]
        rows = code.find(self.reports.cat, segments[1:] if anchored else segments, anchored).where("what = 'module'").select("module").collect()
        if len(rows) != 1:
            raise Problem("; ".join("/".join(r.module) for r in rows) or f"no module {query}")
        return list(rows[0].module)


def opened(spark: SparkSession, root: Path) -> Opened:
    """The catalog and reports of the project in root. A project without its source folder is an error that says so."""
    project = described(root)
    if project is None:
        raise Problem(f"no {' or '.join(MANIFESTS)} in {root}")
    if not (root / project.source_dir).is_dir():
        hint = "; this is a workspace: name one of its members with --root" if project.workspace else ""
        raise Problem(f"no folder {project.source_dir} in {root}{hint}")
    own = manifests.settings(_read(root / SETTINGS))
    names = manifests.aliases(manifests.inherited("tsconfig.json", lambda n: _read(root / n)), project.source_dir) if project.language == "typescript" else []
    files = trees.read_tree(spark, f"file://{root}", project.source_dir, project.language, project.name)
    files = _not_ignored(spark, root, files)
    cat = trees.catalog(files, project.language, project.source_dir)
    present = spark.createDataFrame([(project.name, p) for p in listed(root)], "project_id string, target string")
    reports = Reports(cat, project.externals, own["relations"], project.pack, project.source_dir, present, own["fact_prefixes"], names)
    return Opened(root, project, files, reports)


def _git(root: Path, *args: str) -> str | None:
    """What git says, null if it fails or is not there."""
    try:
        done = subprocess.run(["git", "-C", str(root), *args], capture_output=True, text=True, errors="replace", timeout=60)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout if done.returncode == 0 else None


def _paths(text: str | None) -> set[str]:
    return {p for p in (text or "").split("\0") if p}


def listed(root: Path) -> list[str]:
    """Paths of all files and folders of a project: what git knows or would add, else what is not hidden."""
    found = _git(root, "ls-files", "--cached", "--others", "--exclude-standard", "-z")
    files = _paths(found) if found is not None else {str(p.relative_to(root)) for p in root.rglob("*") if p.is_file() and not any(x.startswith(".") or x in ("target", "node_modules") for x in p.relative_to(root).parts)}
    return sorted(files | {str(d) for f in files for d in Path(f).parents if str(d) != "."})


def _not_ignored(spark: SparkSession, root: Path, files: DataFrame) -> DataFrame:
    """files without those that the project's ignore files leave out."""
    out = _git(root, "ls-files", "--others", "--ignored", "--exclude-standard", "-z")
    gone = spark.createDataFrame([(p,) for p in _paths(out)], "path string")
    return files.join(gone, "path", "left_anti") if out else files


def changed(spark: SparkSession, at: Opened, revision: str) -> tuple[DataFrame, DataFrame]:
    """(path, is_new) of source files that differ from a revision or are not tracked, and (path, owner, name, signature) of the items they had."""
    root = at.root
    if _git(root, "rev-parse", "--is-inside-work-tree") is None:
        raise Problem("changes can only be told in a git repository")
    if _git(root, "rev-parse", "--verify", "--quiet", revision + "^{commit}") is None:
        raise Problem(f"no git revision {revision}")
    names = _paths(_git(root, "diff", "--name-only", "-z", "--relative", revision, "--")) | _paths(_git(root, "ls-files", "--others", "--exclude-standard", "-z"))
    names = sorted(n for n in names if (root / n).is_file())
    before = {n: _git(root, "show", f"{revision}:./{n}") for n in names}
    old = spark.createDataFrame([(at.project.name, n, text) for n, text in before.items() if text is not None], "project_id string, path string, source string")
    items = trees.parsed(old, at.project.language, at.project.source_dir).selectExpr("path", "inline(items)").select("path", "owner", "name", "signature")
    return spark.createDataFrame([(n, before[n] is None) for n in names], "path string, is_new boolean"), items


def session_folder(path: str) -> str:
    """The name that a project's folder has among stored sessions."""
    return re.sub(r"[^A-Za-z0-9]", "-", path)

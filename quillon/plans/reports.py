"""The questions that are asked of one project, answered as text: deps, check, howto, show and map.

Plans are DataFrames over the whole catalog; only what a report prints is collected, at most a line for each file, item or section of the scope.
"""

from __future__ import annotations

import re
from copy import copy
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import docs, paths
from quillon.operators import code, documents, graph, links
from quillon.runtime import materialize
from quillon.sources.manifests import PACK
from quillon.sources.trees import Catalog


def field_line(label: str, text: str) -> str:
    """label padded to 14 characters, never cut."""
    return f"{label.ljust(14)}{text}".rstrip()


def aligned(rows: list[tuple[str, str]], indent: str = "  ") -> list[str]:
    width = max((len(a) for a, _ in rows), default=0)
    return [f"{indent}{a.ljust(width)}  {b}" if b else f"{indent}{a}" for a, b in rows]


def counted(n: int, noun: str) -> str:
    return f"{n} {noun}" + ("" if n == 1 else "s")


def page(lines: list[str]) -> str:
    """Lines as text: never two blank ones, one line feed at the end."""
    out: list[str] = []
    for line in lines:
        if line or (out and out[-1]):
            out.append(line)
    return "\n".join(out).rstrip("\n") + "\n"


@dataclass
class Node:
    label: str
    text: str = ""
    notes: list[str] = field(default_factory=list)
    children: list[Node] = field(default_factory=list)


def drawn(nodes: list[Node], before: str = "") -> list[str]:
    width, out = max((len(n.label) for n in nodes), default=0), []
    for i, n in enumerate(nodes):
        last = i == len(nodes) - 1
        below = before + ("    " if last else "│   ")
        out.append(f"{before}{'└── ' if last else '├── '}{n.label.ljust(width)}  {n.text}".rstrip())
        out += [f"{below}  {note}" for note in n.notes] + drawn(n.children, below)
    return out


def item_line(item, joint: str = "::") -> str:
    """Signature, with the owner before the name, labels and [no doc]. joint: what stands between owner and name."""
    signature, owned = item.signature, f"{item.owner}{joint}{item.name}"
    if item.owner is not None and f" {item.name}" in signature:
        signature = signature.replace(f" {item.name}", f" {owned}", 1)
    elif item.owner is not None and signature.startswith(item.name):
        signature = owned + signature.removeprefix(item.name)
    if item.owner is not None and joint != "::" and item.vis < 2:
        signature = f"{('private', 'protected')[item.vis]} {signature}"
    flags = [*(item.labels or []), *([] if item.documented or item.kind == "use" else ["[no doc]"])]
    return signature + (f"   {' · '.join(flags)}" if flags else "")


class Reports:
    """A catalog of one project with its externals, relation patterns and fact prefixes."""

    def __init__(self, cat: Catalog, externals: list[str] = (), patterns: list[tuple[str, str]] = (), pack: bool = False, source_dir: str = "src", present: DataFrame | None = None, facts: list[str] = (), aliases: list[tuple[str | None, bool, list[str]]] = ()):
        spark = cat.files.sparkSession
        self.facts, self.joint = list(facts), "::" if cat.language == "rust" else "."
        self.cat, self.patterns, self.pack, self.source_dir = cat, list(patterns), pack, source_dir
        project = cat.files.select("project_id").first()
        self.project = project.project_id if project else ""
        self.externals = spark.createDataFrame([(self.project, e) for e in externals], "project_id string, name string")
        named = spark.createDataFrame([(self.project, *a) for a in aliases], "project_id string, prefix string, exact boolean, target array<string>")
        self.present = present if present is not None else cat.files.select("project_id", F.col("path").alias("target"))
        self.references = materialize(code.resolved(cat, self.externals, named), "references")
        self.edges = code.edges(self.references)

    def name(self, module: list[str], root: str = "crate") -> str:
        if self.cat.language != "rust":
            return "/".join(module) or "(root)"
        return "::".join([root, *module]) if root else "::".join(module) or "crate (root)"

    def _under(self, df: DataFrame, scope: list[str]) -> DataFrame:
        return df.where(paths.is_under("module", F.array(*map(F.lit, scope)).cast("array<string>")))

    def _externals(self, scope: list[str]) -> str:
        rows = code.external_uses(self.references, scope, self.cat.language).collect()
        order = sorted(rows, key=lambda r: (r.tests_only, -(r.main_files or r.test_files), r.package))
        return " · ".join(f"(tests) {r.package}" if r.tests_only else f"{r.package} {r.main_files}" for r in order)

    def _fans(self, scope: list[str]) -> tuple[int, int]:
        return tuple(graph.grouped(graph.crossing(self.edges, scope, i), end, scope, 0, F.count("*").alias("n")).count() for i, end in ((False, "target"), (True, "source")))

    def deps(self, scope: list[str], depth: int = 0, reverse: bool = False) -> str:
        """What scope depends on, or with reverse what depends on it, grouped where it leaves scope and `depth` levels below."""
        n = self._under(self.cat.files, scope).count()
        fans = self._fans(scope)
        head = f"{self.name(scope)}  ({counted(n, 'file')})   fan-out {fans[0]} · fan-in {fans[1]}"
        end = "source" if reverse else "target"
        crossing = materialize(graph.crossing(self.edges, scope, reverse), "crossing")
        levels = []
        for k in range(depth + 1):
            rows = graph.grouped(crossing, end, scope, k, F.count_distinct("file_id").alias("files"), F.array_sort(F.collect_set("symbol")).alias("symbols"))
            levels.append({tuple(r.key): r for r in rows.collect()})
        notes = self._lines(crossing, end, scope, depth) if reverse else {}

        def nodes(k: int, above: tuple) -> list[Node]:
            own = [r for key, r in levels[k].items() if key[: len(above)] == above and (not k or len(key) > len(above))]
            out = []
            for r in sorted(own, key=lambda r: (-r.files, r.key)):
                below = nodes(k + 1, tuple(r.key)) if k < depth else []
                symbols = "" if reverse or below else f"   {', '.join(r.symbols)}" if r.symbols else ""
                out.append(Node(self.name(r.key, ""), counted(r.files, "file") + symbols, [] if below else notes.get(tuple(r.key), []), below))
            return out

        tree = drawn(nodes(0, ()))
        if not crossing.count() and not reverse:
            tree = self._children(scope)
        outside = "" if reverse else self._externals(scope)
        return page([head, *tree, "", f"external    {outside}" if outside else ""])

    def _lines(self, crossing: DataFrame, end: str, scope: list[str], depth: int) -> dict[tuple, list[str]]:
        key = paths.group_key(end, F.array(*map(F.lit, scope)).cast("array<string>"), depth)
        rows = crossing.groupBy(key.alias("key"), "file_id").agg(F.min("line").alias("line"), F.array_sort(F.collect_set("symbol")).alias("symbols")).join(self.cat.files.select("file_id", "path"), "file_id")
        out: dict[tuple, list[str]] = {}
        for r in sorted(rows.collect(), key=lambda r: r.file_id):
            out.setdefault(tuple(r.key), []).append(f"{r.path}:{r.line}  {', '.join(r.symbols)}".rstrip())
        return out

    def _children(self, scope: list[str]) -> list[str]:
        """Each child of scope with its fans and what it depends on: shown where nothing leaves scope."""
        at = len(scope)
        ends = [F.slice(c, F.lit(1), F.lit(at + 1)) for c in ("source", "target")]
        inside = self._under(self.edges.withColumn("module", F.col("source")), scope)
        pairs = materialize(inside.select(ends[0].alias("source"), ends[1].alias("target"), "file_id", F.col("target").alias("to")).where((F.size("source") > at) & (F.col("source") != F.col("target"))), "pairs")
        children = sorted({tuple(r.m) for r in self._under(self.cat.modules, scope).where(F.size("module") > at).select(F.slice("module", F.lit(1), F.lit(at + 1)).alias("m")).collect()})
        out = {}
        for r in pairs.groupBy("source", "target").agg(F.count_distinct("file_id").alias("n")).collect():
            out.setdefault(tuple(r.source), []).append((-r.n, self.name(r.target, "")))
        fan_in: dict[tuple, int] = {}
        for r in self.edges.select(ends[1].alias("target"), F.col("source").alias("s")).where(~paths.is_under("s", "target")).select("target", paths.group_key("s", "target").alias("k")).distinct().groupBy("target").count().collect():
            fan_in[tuple(r.target)] = r["count"]
        nodes = []
        for c in children:
            to = sorted(out.get(c, []))
            nodes.append(Node(c[-1], f"fan-out {len(to)} · fan-in {fan_in.get(c, 0)}", ["-> " + " · ".join(f"{n} {-k}" for k, n in to)] if to else []))
        return drawn(nodes)

    def recipes(self) -> DataFrame:
        """file_id, path, module, line, title, topic, body (lines) of the sections `How to ...` of module documentation."""
        numbered = self.cat.files.where("size(module_doc) > 0").select("file_id", F.posexplode("module_doc").alias("pos", "line"))
        heads = documents.sections(numbered, "file_id").withColumn("topic", docs.topic("title")).where("topic IS NOT NULL")
        own = heads.join(self.cat.files.select("file_id", "path", "module", "module_doc", "module_doc_line"), "file_id")
        return own.select("file_id", "path", "module", (F.col("module_doc_line") + F.col("pos")).alias("line"), "title", "topic", F.slice("module_doc", F.col("pos") + 2, F.greatest("n_lines", F.lit(0)).cast("int")).alias("body"))

    def links(self) -> DataFrame:
        topics = self.recipes().select(F.lit(self.project).alias("project_id"), F.col("topic").alias("target"))
        return links.resolved_links(links.doc_links(self.cat), self.cat, self.externals, self.present, topics)

    def howto(self, query: str | None = None) -> str:
        """The list of recipes, or the one whose topic is query or has all its words; links are replaced by the places that they name."""
        found = self.recipes()
        if query is not None:
            ranked = found.withColumn("rank", docs.matches_topic("topic", query)).where("rank > 0").collect()
            ranked = [r for r in ranked if r.rank == max(x.rank for x in ranked)]
        else:
            ranked = found.collect()
        ranked.sort(key=lambda r: (r.file_id, r.line))
        if query is None or len(ranked) != 1:
            first = lambda r: next((x for x in r.body if x.strip()), "")
            width = [max((len(x) for x in c), default=0) for c in ([r.topic for r in ranked], [f"{r.path}:{r.line}" for r in ranked])]
            return page(["RECIPES", *(f"  {r.topic.ljust(width[0])}  {f'{r.path}:{r.line}'.ljust(width[1])}   {first(r)}".rstrip() for r in ranked)])
        r = ranked[0]
        places = self._places(r)
        ok = sum(p is not None for _, p in places)
        body = "\n".join(r.body)
        for link, place in places:
            body = body.replace(link, place or f"{link} (broken)", 1)
        return page([f"{r.title}   ({r.path}:{r.line}, {counted(ok, 'link')} ok)", *body.split("\n")])

    def _places(self, recipe) -> list[tuple[str, str | None]]:
        files, items = self.cat.files.select(F.col("file_id").alias("to_file"), F.col("path").alias("to_path"), F.col("lines").alias("to_lines")), self.cat.items.select(F.col("file_id").alias("to_file"), F.col("seq").alias("to_seq"), "decl_line", "start_line", "end_line")
        rows = self.links().where((F.col("file_id") == recipe.file_id) & F.col("line").between(recipe.line + 1, recipe.line + len(recipe.body))).join(files, "to_file", "left").join(items, ["to_file", "to_seq"], "left")
        example = lambda n: recipe.body[n - recipe.line - 1].lower().startswith("example")  # noqa: E731  what is to be copied is shown with its size
        out = []
        for r in sorted(rows.collect(), key=lambda r: (r.line, r.nth)):
            text = r.link.split("`")[1] if "`" in r.link else r.target
            more = f", {r.to_lines} lines" if r.to_path is not None and example(r.line) else ""
            place = text if r.to_path is None else f"{text} ({r.to_path}:{r.decl_line}{more})"
            out.append((r.link, None if r.status == "broken" else place))
        return out

    def check(self, scope: list[str] = (), changed: DataFrame | None = None, base: DataFrame | None = None) -> tuple[str, bool]:
        """Documentation, links, recipes and syntax of scope as text, and whether something is wrong with it (tests never count).

        changed: path, is_new: only these files are looked at; of those that are not new, module documentation is not asked for, and of their items
        only what is not in base (path, owner, name, signature).
        """
        if changed is not None:
            inside = self.cat.files.join(changed, "path")
            known = self.cat.files.select("project_id", "file_id", "path").join(base, "path").select("project_id", "file_id", F.coalesce("owner", F.lit("")).alias("of"), "name", "signature").withColumn("known", F.lit(True)).distinct()
            items = self.cat.items.join(inside.select("project_id", "file_id"), ["project_id", "file_id"], "left_semi").withColumn("of", F.coalesce("owner", F.lit("")))
            items = items.join(known, ["project_id", "file_id", "of", "name", "signature"], "left").where("known IS NULL").select(*self.cat.items.columns)
            docless = F.when(F.col("is_new"), F.col("module_doc")).otherwise(F.when(F.size("module_doc") > 0, F.col("module_doc")).otherwise(F.array(F.lit("not asked for"))))
            files = inside.withColumn("module_doc", docless).select(*self.cat.files.columns)
            part = copy(self)
            part.cat = replace(self.cat, placed={}, files=files, items=materialize(items, "items"), tests=self.cat.tests.join(files.select("project_id", "file_id"), ["project_id", "file_id"], "left_semi"))
            part.links = lambda: self.links().join(files.select("project_id", "file_id"), ["project_id", "file_id"], "left_semi")
            return part.check(scope)
        scope = list(scope)
        has = lambda c: docs.summary(F.array_join(c, "\n")).isNotNull()
        where = self.cat.files.select("project_id", "file_id", "path")
        mods = sorted(self._under(self.cat.files, scope).select("file_id", "path", has("module_doc").alias("ok"), "parse_errors").collect())
        items = sorted(self._under(code.public_items(self.cat), scope).join(where, ["project_id", "file_id"]).select("file_id", "seq", "path", "decl_line", "kind", "owner", "name", "documented").collect(), key=lambda r: (r.file_id, r.seq))
        tests = self._under(self.cat.tests.join(self.cat.files.select("project_id", "file_id", "module"), ["project_id", "file_id"]), scope).agg(F.count_if(has("doc")), F.count("*")).first()
        checked = [r for r in self._under(self.links().join(self.cat.files.select("project_id", "file_id", "module"), ["project_id", "file_id"]), scope).collect() if r.status != "external"]
        broken = sorted((r for r in checked if r.status == "broken"), key=lambda r: (r.file_id, r.line, r.nth))
        told = sorted(self._under(self.recipes(), scope).collect(), key=lambda r: (r.file_id, r.line))
        listed = lambda head, rows: [f"  {head}: {rows[0]}", *(" " * (len(head) + 4) + x for x in rows[1:])] if rows else []
        bare = [m.path for m in mods if not m.ok]
        open_items = [f"{i.path}:{i.decl_line} {i.kind} {'::'.join(filter(None, (i.owner, i.name)))}" for i in items if not i.documented]
        bad = [m.path for m in mods if m.parse_errors]
        out = [field_line("module docs", f"{len(mods) - len(bare)} of {counted(len(mods), 'file')}"), *listed("missing", bare)]
        out += [field_line("public items", f"{len(items) - len(open_items)} of {len(items)} documented"), *listed("missing", open_items)]
        out += [field_line("tests", f"{tests[0]} of {tests[1]} with a doc line"), field_line("links", f"{len(checked)} checked, {len(broken)} broken"), *listed("broken", [f"{r.path}:{r.line} {r.link}" for r in broken])]
        out += [field_line("recipes", " · ".join(f"{r.topic} ({r.path}:{r.line})" for r in told) or "none"), field_line("syntax errors", ", ".join(bad) or "none")]
        return page(out), bool(bare or open_items or broken or bad)

    def show(self, query: list[str]) -> str:
        """The contract of the one item that query names: signature, documentation, fields, methods, relations, users and callers.

        Nothing or several: ValueError with the candidates.
        """
        where = self.cat.files.select("project_id", "file_id", "path", "module")
        anchored = query[:1] == ["crate"]
        found = code.find(self.cat, query[1:] if anchored else query, anchored).where("what = 'item'").select("project_id", "file_id", "seq")
        rows = sorted(self.cat.items.join(found, ["project_id", "file_id", "seq"], "left_semi").join(where, ["project_id", "file_id"]).collect(), key=lambda r: (r.file_id, r.seq))
        if len(rows) != 1:
            raise ValueError("; ".join(f"{self.name([*r.module, *filter(None, (r.owner, r.name))])} {r.path}:{r.decl_line}" for r in rows) or f"no symbol {'::'.join(query)}")
        r = rows[0]
        marks = code.labels(self.cat, self.pack).where((F.col("file_id") == r.file_id) & (F.col("seq") == r.seq)).first().labels
        flags = [*marks, *(["hidden"] if r.hidden else []), *(["test-only"] if r.test_only else [])]
        out = [f"{self.joint.join(filter(None, (r.owner, r.name)))}  {' · '.join([r.kind, *flags, self.name(r.module), f'{r.path}:{r.start_line}-{r.end_line}'])}", field_line("signature", r.signature)]
        out += ["doc", *(f"  {x}" for x in r.doc)] if r.doc else []
        out += ["fields", *(f"  {x}" for x in r.fields)] if r.fields else []
        marked = self.cat.items.join(where, ["project_id", "file_id"]).join(code.labels(self.cat, self.pack), ["project_id", "file_id", "seq"]).withColumn("documented", docs.is_documented("doc"))
        methods = marked.where((F.col("owner") == r.name) & (F.col("module") == F.array(*map(F.lit, r.module)).cast("array<string>"))).collect() if r.owner is None else []
        out += ["methods", *(f"  {item_line(m, self.joint)}" for m in sorted(methods, key=lambda m: (m.file_id, m.seq)))] if methods else []
        made = code.relations(self.cat, self.patterns, self.pack).where(F.element_at(F.split("target", "::"), -1) == r.name).collect()
        wired = sorted(made, key=lambda x: (x.file_id, x.line, x.place))
        out += [field_line("wired by", " · ".join(f"{x.owner} {x.kind} {x.target}" for x in wired))] if wired else []
        if r.owner is None:
            used = code.users(self.references).where((F.col("symbol") == r.name) & (F.col("target") == F.array(*map(F.lit, r.module)).cast("array<string>"))).join(where, ["project_id", "file_id"]).collect()
            out += [field_line("used by", " · ".join(f"{u.path}:{u.lines}" for u in sorted(used, key=lambda u: u.file_id)))] if used else []
        called = code.callers(self.cat, self.externals, list(r.module), r.name, r.owner).join(where, ["project_id", "file_id"]).collect() if r.kind == "fn" else []
        calls = [f"{c.caller} {c.path}:{c.line}" for c in sorted(called, key=lambda c: (c.file_id, c.seq))]
        calls = [c for i, c in enumerate(calls) if not i or c != calls[i - 1]]
        out += [field_line("called by", " · ".join(calls))] if calls else []
        return page(out)

    def lines(self, path: str, low: int, high: int) -> str:
        """The items that meet lines low to high of a file: kind, name and lines of each."""
        asked = self.cat.files.where(F.col("path") == path).select("project_id", "file_id", F.lit(low).alias("from"), F.least(F.lit(high), F.col("lines")).alias("to"))
        if asked.isEmpty():
            raise ValueError(f"no file {path}")
        rows = code.items_between(self.cat, asked).collect()
        return page([f"{path}:{low}-{high}", *(f"  {r.kind} {self.joint.join(filter(None, (r.owner, r.name)))} {r.start_line}-{r.end_line}" for r in rows)])

    def module_of(self, path: str) -> list[str] | None:
        """The module of a file, or of a folder that holds some."""
        path = path.strip("/")
        own = self.cat.files.where(F.col("path") == path).select("module").first()
        if own:
            return list(own.module)
        top = [p for p in self.source_dir.split("/") if p not in ("", ".")]
        parts = [p for p in path.split("/") if p not in ("", ".")]
        if parts[: len(top)] != top:
            return None
        below = parts[len(top) :]
        known = self.cat.modules.where(F.col("module") == F.array(*map(F.lit, below)).cast("array<string>"))
        return below if not below or not known.isEmpty() else None

    def page_of(self, query: str, split) -> str:
        """What `show` answers to words of a user: lines of a file (a.rs:3-9), a module or file, or an item. split: query -> segments."""
        if span := re.fullmatch(r"(.+\.\w+):(\d+)(?:-(\d+))?", query):
            return self.lines(span[1], int(span[2]), int(span[3] or span[2]))
        if (module := self.module_of(query) if "/" in query or "." in query else None) is not None:
            return self.map(module)
        segments = split(query)
        try:
            return self.show(segments)
        except ValueError as e:
            modules = code.find(self.cat, segments[1:] if segments[:1] == ["crate"] else segments, segments[:1] == ["crate"]).where("what = 'module'").select("module").take(2)
            if len(modules) == 1 and str(e).startswith("no symbol"):
                return self.map(list(modules[0].module))
            raise

    def map(self, scope: list[str], depth: int = 1, fields: bool = False, private: bool = False) -> str:
        """A module and all below it: parts, public items (to `depth` levels), relations, dependencies, contracts, sections and recipes."""
        files = sorted(self._under(self.cat.files, scope).withColumn("purpose", docs.summary(F.array_join("module_doc", "\n"))).collect(), key=lambda f: f.file_id)
        own = next((f for f in files if f.module == scope), None)
        is_dir = own is None or not scope or any(f.module != scope for f in files)
        folder = "/".join([self.source_dir, *scope]) + "/"
        out = [field_line("MODULE", f"{self.name(scope)}   {folder if is_dir else own.path}  {counted(len(files), 'file')} · {counted(sum(f.lines for f in files), 'line')} · {self.cat.language}")]
        out += [field_line("PURPOSE", own.purpose)] if own is not None and own.purpose else []
        size: dict[tuple, int] = {}
        for f in files:
            for n in range(len(scope) + 1, len(f.module) + 1):
                size[tuple(f.module[:n])] = size.get(tuple(f.module[:n]), 0) + 1
        tops = sorted(t for t in size if len(t) == len(scope) + 1)
        out += self._shape(scope, tops, size)
        bad = [f.path for f in files if f.parse_errors]
        out += [field_line("WARNING", "syntax errors in " + ", ".join(bad))] if bad else []
        purpose = {tuple(f.module): f.purpose for f in files}

        def part(t: tuple) -> str:
            return (purpose.get(t) or "[no module doc]") + (f" ({counted(size[t], 'file')})" if size[t] > 1 else "")

        shown = [t for t in sorted(size) if len(t) <= len(scope) + depth]
        out += ["", "TREE", *aligned([("  " * (len(t) - len(scope) - 1) + t[-1] + ("/" if size[t] > 1 else ""), part(t)) for t in shown])] if shown else []
        out += self._api(scope, files, folder if is_dir else own.path.rpartition("/")[0] + "/", depth, fields, private)
        inside = self._under(self.cat.files, scope).select("project_id", "file_id")
        made = code.relations(self.cat, self.patterns, self.pack).join(inside, ["project_id", "file_id"], "left_semi").orderBy("file_id", "line", "place").collect()
        runs: list[tuple[str, str]] = []
        for r in made:
            if runs and runs[-1][0] == r.owner:
                runs[-1] = (r.owner, f"{runs[-1][1]} · {r.kind} {r.target}")
            else:
                runs.append((r.owner, f"{r.kind} {r.target}"))
        out += ["", "RELATIONS" + (f"  ({PACK} pack)" if self.pack else ""), *aligned(runs)] if runs else []
        to, by = (graph.grouped(graph.crossing(self.edges, scope, i), e, scope, 0, F.count_distinct("file_id").alias("n")).collect() for i, e in ((False, "target"), (True, "source")))
        inner = " · ".join(f"{self.name(r.key, '')} {r.n}" for r in sorted(to, key=lambda r: (-r.n, r.key)))
        used = " · ".join(self.name(r.key, "") for r in sorted(by, key=lambda r: r.key))
        deps = [(a, b) for a, b in (("internal", inner), ("external", self._externals(scope)), ("used by", used)) if b]
        out += ["", "DEPENDENCIES", *aligned(deps)] if deps else []
        titles, facts = self._sections(own)
        tests = self._under(self.cat.tests.join(self.cat.files.select("project_id", "file_id", "module"), ["project_id", "file_id"]), scope).select("file_id", "seq", "name", docs.summary(F.array_join("doc", "\n")).alias("about")).collect()
        told_tests = [(t.name, t.about) for t in sorted(tests) if t.about]
        silent = len(tests) - len(told_tests)
        rows = [f"  invariant  {x}" for x in facts] + aligned(told_tests) + ([f"  (+ {counted(silent, 'test')} without a doc line)"] if silent else [])
        out += ["", "CONTRACTS  (invariants and tests)", *rows] if rows else []
        told = sorted(self._under(self.recipes(), scope).collect(), key=lambda r: (r.file_id, r.line))
        out += [""]
        out += [field_line("DOC SECTIONS", " · ".join(titles))] if titles else []
        out += [field_line("RECIPES", " · ".join(f"howto {r.topic}" for r in told))] if told else []
        every = self._under(code.public_items(self.cat), scope).agg(F.count_if(~F.col("documented")), F.count("*")).first()
        out += [field_line("UNDOCUMENTED", f"{every[0]} of {every[1]} public items in this module")] if every[0] else []
        return page(out)

    def _shape(self, scope: list[str], tops: list[tuple], size: dict[tuple, int]) -> list[str]:
        edges = materialize(graph.siblings(self.edges, scope), "siblings")
        s = graph.shape(self.cat.files.sparkSession.createDataFrame([(t[-1],) for t in tops], "node string"), edges).first()
        if s.shape == "none":
            return []
        hubs = sorted(r.target + ("/" if size.get((*scope, r.target), 0) > 1 else "") for r in edges.select("target").distinct().collect())
        loops: dict[str, list[str]] = {}
        for r in graph.cycles(edges).collect() if s.shape == "mesh" else ():
            loops.setdefault(r.cycle, []).append(r.node)
        text = {"mesh": "mesh: cycles " + " · ".join(" <-> ".join(sorted(x)) for _, x in sorted(loops.items())), "flat": f"flat: {counted(s.nodes, 'part')}, no imports between them", "star": f"star: {counted(s.leaves, 'part')} -> {', '.join(hubs)}, no other sibling imports, no cycles", "layered": f"layered: {counted(s.edges, 'sibling import')}, no cycles"}
        return [field_line("SHAPE", text[s.shape])]

    def _api(self, scope: list[str], files: list, folder: str, depth: int, fields: bool, private: bool) -> list[str]:
        near = self._under(self.cat.items.join(self.cat.files.select("project_id", "file_id", "module"), ["project_id", "file_id"]), scope).where(F.size("module") <= len(scope) + depth).where("NOT hidden")
        near = near.join(code.labels(self.cat, self.pack), ["project_id", "file_id", "seq"]).withColumns({"documented": docs.is_documented("doc"), "about": docs.summary(F.array_join("doc", "\n")), "facts": docs.facts("doc", self.facts) if self.facts else F.array().cast("array<string>")})
        items = sorted(near.collect(), key=lambda i: (i.file_id, i.seq))
        out, path = [], {f.file_id: f.path for f in files}
        at = None
        for i in items:
            if i.test_only or i.vis < (0 if private else 1):
                continue
            if i.file_id != at:
                at = i.file_id
                out.append(f"## {path[at].removeprefix(folder)}")
            out.append(f"  {item_line(i, self.joint)}")
            if i.kind != "use" and i.about:
                out += [f"      {i.about}", *(f"      {f}" for f in i.facts if f not in i.about)]
            out += [f"      · {f}" for f in i.fields] if fields else []
        hidden = [f"{i.name} ({i.signature.removeprefix('use ').rstrip(';')})" for i in items if i.test_only]
        out += [f"  test-only: {' · '.join(hidden)}"] if hidden else []
        return ["", "PUBLIC API", *out] if out else []

    def _sections(self, own) -> tuple[list[str], list[str]]:
        """Titles of a module's own sections that are neither recipes nor invariants, and its invariants."""
        if own is None or not own.module_doc:
            return [], []
        numbered = self.cat.files.where(F.col("file_id") == own.file_id).select("file_id", F.posexplode("module_doc").alias("pos", "line"))
        titles, facts = [], []
        for r in documents.sections(numbered, "file_id").withColumn("topic", docs.topic("title")).orderBy("pos").collect():
            if r.title.lower() == "invariants":
                body = own.module_doc[r.pos + 1 : r.stop]
                facts += [x.strip().removeprefix("- ").removeprefix("* ") for x in body if x.strip()]
            elif r.topic is None:
                titles.append(r.title)
        return titles, facts

"""Resolution of names in source trees and what follows from it: edges, external uses, relations, definitions and callers.

All functions work on the tables of sources.trees.Catalog, for any number of projects at once; project_id is part of every key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillon.functions import docs, paths
from quillon.runtime import bounded, materialize
from quillon.sources import script
from quillon.sources.trees import Catalog

#: By language: packages that come with it.
STANDARD = {"rust": ("std", "core", "alloc", "proc_macro", "test"), "typescript": script.BUILTINS}
_REF = ["project_id", "file_id", "seq"]
#: Framework pack: method -> kind of relation and which part is its target.
PACK = {
    "add_systems": "system",
    "add_observer": "observer",
    "observe": "observer",
    "init_resource": "resource",
    "insert_resource": "resource",
    "add_event": "event",
    "add_message": "event",
    "init_state": "state",
    "add_plugins": "plugin",
}
#: Derived traits that a framework gives a meaning.
DERIVED = {"Component": "component", "Resource": "resource", "Event": "event", "Message": "event", "EntityEvent": "event", "SystemParam": "system param", "States": "state", "SubStates": "state", "Bundle": "bundle", "Asset": "asset"}


def _absolute(rows: DataFrame, cat: Catalog, declared: DataFrame) -> DataFrame:
    """rows (project_id, module, segs, ...) with tag and abs, by the first segment. declared: project_id, first, declared.

    crate, self and super are arithmetic; standard and declared packages come before child modules; what is none of these stays `name`. Only names
    that are none of the others are looked for among the modules, each once for a module; the rows themselves meet no more than the hits.
    """
    first = F.get("segs", F.lit(0))
    named = rows.withColumn("first", first).join(declared, ["project_id", "first"], "left")
    plain = ~F.col("first").isin("crate", "self", "super", *STANDARD["rust"]) & F.col("declared").isNull()
    asked = named.where(plain).select("project_id", F.concat("module", F.array("first")).alias("child")).distinct()
    hits = materialize(asked.join(cat.modules.select("project_id", F.col("module").alias("child")).hint("merge"), ["project_id", "child"]), "children")
    named = named.withColumn("child", F.concat("module", F.array("first"))).join(bounded(hits).withColumn("is_child", F.lit(True)), ["project_id", "child"], "left")
    others = F.transform("segs", lambda s: s != "super")
    ups = F.coalesce(F.nullif(F.array_position(others, True), F.lit(0)).cast("int") - 1, F.size("segs"))
    rest = lambda n: F.slice("segs", n + 1, F.size("segs"))
    kept = F.slice("module", F.lit(1), F.greatest(F.size("module") - ups, F.lit(0)))
    tag = (
        F.when(F.col("first").isNull(), "other")
        .when(F.col("first").isin("crate", "self"), "internal")
        .when(F.col("first") == "super", F.when(ups > F.size("module"), "unresolved").otherwise("internal"))
        .when(F.col("first").isin(*STANDARD["rust"]) | F.col("declared"), "external")
        .when(F.col("is_child"), "internal")
        .otherwise("name")
    )
    where = F.when(F.col("first") == "crate", rest(F.lit(1))).when(F.col("first") == "self", F.concat("module", rest(F.lit(1)))).when(F.col("first") == "super", F.concat(kept, rest(ups))).otherwise(F.concat("module", "segs"))
    return named.withColumns({"tag": tag, "abs": where}).drop("declared", "child", "is_child")


def resolved(cat: Catalog, externals: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Every reference with tag (internal, external, unresolved or other), package, target module and symbol. externals: project_id, name.

    aliases (of scripts only): project_id, prefix, exact, target (a module's path): what names stand for that start with prefix (or are it, if
    exact); a null prefix is the folder that other names are looked for in.
    """
    if cat.language == "typescript":
        return resolve_script(cat.located("refs"), cat, externals, aliases)
    return resolve(cat.located("refs"), cat, externals)


def normal_module(path: Column) -> Column:
    """A script module's path without a source extension on its last part and without a trailing index."""
    last = F.regexp_replace(F.element_at(path, -1), rf"(?<=.)\.({'|'.join(script.EXTENSIONS)})$", "")
    ahead = F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0)))
    return F.when(F.size(path) == 0, path).when(last == "index", ahead).otherwise(F.concat(ahead, F.array(last)))


def resolve_script(rows: DataFrame, cat: Catalog, externals: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """rows (project_id, file_id, seq, module, segments, anchored, ...) with tag, package, target and symbol.

    Anchored paths are modules' already. Others are, in this order, what the longest alias makes of them, what lies in the base folder (if its first
    segment is a module there), a package that is declared or comes with the language, or nothing known.
    """
    first = F.get("segments", F.lit(0))
    rows = rows.drop("import")
    if aliases is None:
        aliases = rows.sparkSession.createDataFrame([], "project_id string, prefix string, exact boolean, target array<string>")
    joined = F.array_join("segments", "/")
    # what a path means depends on its project only, so each is looked up once
    bare = materialize(rows.where("NOT anchored").select("project_id", "segments").distinct(), "bare")
    rules = bounded(aliases.where("prefix IS NOT NULL"))
    fits = bare.join(rules, "project_id").where(F.when(F.col("exact"), joined == F.col("prefix")).otherwise(F.startswith(joined, F.col("prefix"))))
    rest = F.filter(F.split(F.substring(joined, F.length("prefix") + 1, F.length(joined)), "/"), lambda x: x != "")
    claimed = fits.groupBy("project_id", "segments").agg(F.min_by(F.concat("target", rest), F.struct(-F.length("prefix"), "prefix")).alias("claimed"))
    bases = bounded(aliases.where("prefix IS NULL").select("project_id", F.col("target").alias("base")))
    known = cat.modules.select("project_id", "module").hint("merge")
    lying = bare.join(bases, "project_id").withColumn("module", F.concat("base", F.array(first))).join(known, ["project_id", "module"]).select("project_id", "segments", F.concat("base", "segments").alias("lying"))
    meant = claimed.join(lying, ["project_id", "segments"], "full").withColumn("anchored", F.lit(False))
    named = rows.join(bounded(materialize(meant, "meant")), ["project_id", "segments", "anchored"], "left")
    declared = bounded(externals.select("project_id", F.col("name").alias("first"), F.lit(True).alias("declared")).distinct())
    named = named.withColumn("first", first).join(declared, ["project_id", "first"], "left")
    taken = F.coalesce("claimed", "lying")
    where = F.when(F.col("anchored"), F.col("segments")).when(taken.isNotNull(), normal_module(taken))
    tag = F.when(where.isNotNull(), "internal").when(F.col("first").isin(*STANDARD["typescript"]) | F.coalesce("declared", F.lit(False)), "external").otherwise("other")
    every = materialize(named.withColumns({"tag": tag, "abs": where}).drop("claimed", "lying", "declared"), "resolved")
    return _aimed(every, cat)


def resolve(rows: DataFrame, cat: Catalog, externals: DataFrame) -> DataFrame:
    """rows (project_id, file_id, seq, module, segments, ...) with tag, package, target and symbol; file_id and seq name a row.

    A name that is nothing else is looked up once among the imports of its file: the first of them, inline paths included, that ends with it.
    """
    declared = bounded(externals.select("project_id", F.col("name").alias("first")).distinct()).withColumn("declared", F.lit(True))
    if "import" not in rows.columns:
        imports = cat.refs.where("NOT glob AND size(segments) > 1").groupBy("project_id", "file_id", F.element_at("segments", -1).alias("last"))
        imports = imports.agg(F.min_by("segments", "seq").alias("import"))
        rows = rows.withColumn("last", F.get("segments", F.lit(0))).join(imports, ["project_id", "file_id", "last"], "left").drop("last")
    known = materialize(_absolute(rows.withColumn("segs", F.col("segments")), cat, declared), "known")
    direct = known.where("tag <> 'name'").drop("import")
    named = known.where("tag = 'name'").drop("tag", "abs", "first")
    followed = named.where("import IS NOT NULL").withColumn("segs", F.concat("import", F.slice("segs", F.lit(2), F.size("segs"))))
    again = _absolute(followed, cat, declared).withColumn("tag", F.when(F.col("tag") == "name", "other").otherwise(F.col("tag"))).drop("import")
    none = named.where("import IS NULL").withColumns({"tag": F.lit("other"), "abs": F.array().cast("array<string>"), "first": F.lit(None).cast("string")}).drop("import")
    every = reduce(DataFrame.unionByName, (direct, again, none))
    return _aimed(every, cat).drop("segs")


def _aimed(every: DataFrame, cat: Catalog) -> DataFrame:
    """rows (project_id, first, tag, abs) with package and, if internal, target, the deepest module on the way to abs, and symbol, the segment behind it.

    Every path is looked up once for its project; rows meet only what was found, which has a row for each unlike path.
    """
    inside, outside = every.where("tag = 'internal'"), every.where("tag <> 'internal'")
    asked = inside.select("project_id", "abs").distinct()
    steps = asked.select("project_id", "abs", F.explode(paths.prefixes("abs")).alias("module")).join(cat.modules.hint("merge"), ["project_id", "module"])
    best = bounded(materialize(steps.groupBy("project_id", "abs").agg(F.max(F.size("module")).alias("n")), "targets"))
    found = inside.join(best, ["project_id", "abs"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    found = found.withColumns({"target": F.slice("abs", F.lit(1), F.col("n")), "symbol": F.get("abs", F.col("n"))}).drop("n")
    outside = outside.withColumns({"target": F.lit(None).cast("array<string>"), "symbol": F.lit(None).cast("string")})
    return found.unionByName(outside).withColumn("package", F.when(F.col("tag") == "external", F.col("first"))).drop("first", "abs")


def edges(references: DataFrame) -> DataFrame:
    """project_id, file_id, line, source (module), target, symbol of internal references outside of tests; a multiset."""
    rows = references.where("tag = 'internal' AND NOT in_test")
    return rows.select("project_id", "file_id", "seq", "line", F.col("module").alias("source"), "target", F.when(F.col("glob"), "*").otherwise(F.col("symbol")).alias("symbol"))


def unresolved(references: DataFrame) -> DataFrame:
    return references.where("tag = 'unresolved'").select("project_id", "file_id", "line", F.array_join("segments", "::").alias("path"))


def external_uses(references: DataFrame, scope: list[str] | None = None, language: str = "rust") -> DataFrame:
    """Packages by the files that use them outside of tests and in them; those of the language are left out."""
    rows = references.where("tag = 'external'").where(~F.col("package").isin(*STANDARD[language]))
    if scope:
        rows = rows.where(paths.is_under("module", F.array(*map(F.lit, scope))))
    main, test = (F.count_distinct(F.when(F.col("in_test") == t, F.col("file_id"))) for t in (False, True))
    return rows.groupBy("project_id", "package").agg(main.alias("main_files"), test.alias("test_files")).withColumn("tests_only", F.col("main_files") == 0)


def owner_name() -> Column:
    """Type.name for a method, module::name for a function, name at the root, (module) outside of functions. Columns owner, module."""
    free = F.when(F.size("module") > 0, F.concat_ws("::", F.element_at("module", -1), F.col("owner.name"))).otherwise(F.col("owner.name"))
    return F.when(F.col("owner").isNull(), "(module)").when(F.col("owner.ty").isNotNull(), F.concat_ws(".", "owner.ty", "owner.name")).otherwise(free)


def brief(arg: Column) -> Column:
    """<closure> for closures, `Name {..}` for struct literals, else the argument."""
    t = F.regexp_replace(arg, r"^\s+|\s+$", "")
    head = F.regexp_extract(t, r"^([^{(][^{]*?)\s*\{", 1)
    return F.when(t.rlike(r"^(move ?)?\|"), "<closure>").when(head != "", F.concat(head, F.lit(" {..}"))).otherwise(t)


def captured(pattern: str) -> Column:
    """What a call pattern takes from a call, null if it does not fit. Columns method, generics, callee, args.

    The call is written method::<generics>, or as its callee. $T captures between the rightmost fit of what stands before it and the end of what
    stands after; without $T the first argument counts. Both must begin at a segment.
    """
    full = F.when(F.col("method").isNull(), F.col("callee")).when(F.col("generics").isNull(), F.col("method")).otherwise(F.concat("method", F.lit("::<"), "generics", F.lit(">")))
    bare = "".join(pattern.split())
    quote = lambda s: "\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    if "$T" in bare:
        before, after = bare.split("$T", 1)
        # the rightmost fit decides, and must then stand at a segment and capture something
        tail = F.regexp_extract(full, f"^(?s)(.*){quote(before)}(.*){quote(after)}$", 1)
        taken = F.regexp_extract(full, f"^(?s).*{quote(before)}(.*){quote(after)}$", 1)
        return F.when(full.rlike(f"(?s)^.*{quote(before)}.*{quote(after)}$") & ((tail == "") | F.endswith(tail, F.lit("::"))) & (taken != ""), taken)
    start = F.regexp_extract(full, f"(?s)^(.*){quote(bare)}$", 1)
    return F.when(F.endswith(full, F.lit(bare)) & ((start == "") | F.endswith(start, F.lit("::"))), F.coalesce(F.get("args", F.lit(0)), F.lit("")))


def relations(cat: Catalog, patterns: list[tuple[str, str]], pack: bool = False) -> DataFrame:
    """project_id, file_id, line, place, owner, kind, target: what functions wire up. patterns: (name, call pattern). pack: the framework's own calls.

    Test code is left out. Of equal relations of a file the first stays; place orders those of a line as they stand in the source.
    """
    calls = cat.located("calls").where("NOT in_test")
    found = []
    if pack:
        first, second = (brief(F.get("args", F.lit(i))) for i in (0, 1))
        typed = F.coalesce("generics", first)
        kind = F.element_at(F.create_map(*(F.lit(x) for kv in PACK.items() for x in kv)), F.col("method"))
        target = F.when(F.col("method") == "add_systems", F.when(second.isNotNull(), F.concat(second, F.lit(" ("), first, F.lit(")")))).when(F.col("method").isin("init_resource", "add_event", "add_message", "init_state"), typed).otherwise(first)
        found.append(calls.withColumns({"idx": F.lit(-1), "is_ref": F.lit(0), "kind": kind, "target": target}))
        heads = F.transform("segments", lambda s: ~s.isin("super", "self", "crate"))
        rest = F.when(F.array_position(heads, True) > 0, F.slice("segments", F.greatest(F.array_position(heads, True).cast("int"), F.lit(1)), F.size("segments"))).otherwise(F.array().cast("array<string>"))
        plugins = cat.located("refs").where("NOT in_test AND owner IS NOT NULL AND size(segments) > 1 AND element_at(segments, -1) = 'plugin'")
        found.append(plugins.withColumns({"idx": F.lit(0), "is_ref": F.lit(1), "kind": F.lit("plugin"), "target": F.array_join(rest, "::")}))
    for i, (name, pattern) in enumerate(patterns):
        found.append(calls.withColumns({"idx": F.lit(i), "is_ref": F.lit(0), "kind": F.lit(name), "target": captured(pattern)}))
    if not found:
        return calls.limit(0).select("project_id", "file_id", "line", F.lit("").alias("place"), F.lit("").alias("owner"), F.lit("").alias("kind"), F.lit("").alias("target"))
    place = F.struct("is_ref", "seq", "idx")
    rows = reduce(DataFrame.unionByName, (f.where("kind IS NOT NULL AND target IS NOT NULL").select("project_id", "file_id", "line", place.alias("place"), owner_name().alias("owner"), "kind", "target") for f in found))
    first = rows.groupBy("project_id", "file_id", "owner", "kind", "target").agg(F.min(F.struct("line", "place")).alias("at"))
    return first.select("project_id", "file_id", "at.line", "at.place", "owner", "kind", "target")


def labels(cat: Catalog, pack: bool = False) -> DataFrame:
    """project_id, file_id, seq, labels: framework labels of derives, then `impl Trait` of the same module for items without an owner."""
    items = cat.located("items")
    derived = F.filter(F.transform("derives", lambda d: F.element_at(F.create_map(*(F.lit(x) for kv in DERIVED.items() for x in kv)), d)), lambda x: x.isNotNull()) if pack else F.array().cast("array<string>")
    impls = cat.located("trait_impls").groupBy("project_id", "module", F.col("ty").alias("name"))
    impls = impls.agg(F.transform(F.array_sort(F.collect_list(F.struct("file_id", "seq", "trait_name"))), lambda t: F.concat(F.lit("impl "), t["trait_name"])).alias("impls"))
    joined = items.join(impls, ["project_id", "module", "name"], "left")
    own = F.when(F.col("owner").isNull(), F.coalesce("impls", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    return joined.select(*_REF, F.concat(derived, own).alias("labels"))


def public_items(cat: Catalog, least: int = 1) -> DataFrame:
    """Visible items that are not re-exports, with documented."""
    return cat.located("items").where(f"NOT hidden AND NOT test_only AND kind <> 'use' AND vis >= {least}").withColumn("documented", docs.is_documented("doc"))


def find(cat: Catalog, segments: list[str], anchored: bool = False) -> DataFrame:
    """What a name means: (project_id, what, module, file_id, seq), modules before items. The path must be the end of the full name, or all of it if anchored.

    Of several modules only the one that is the path itself, if there is one. A segment before the name may be the item's owner. Re-exports count
    only where no other item fits.
    """
    want = F.array(*map(F.lit, segments)).cast("array<string>")
    fits = (lambda m, s: m == s) if anchored else paths.has_suffix
    modules = cat.modules.where(fits(F.col("module"), want) if segments else F.size("module") == 0)
    per = W.partitionBy("project_id")
    modules = modules.withColumns({"n": F.count("*").over(per), "exact": F.col("module") == want}).withColumn("any", F.max("exact").over(per)).where("n = 1 OR NOT any OR exact")
    modules = modules.select("project_id", F.lit("module").alias("what"), "module", F.lit(None).cast("int").alias("file_id"), F.lit(None).cast("int").alias("seq"))
    if not segments:
        return modules
    name, prefix = segments[-1], segments[:-1]
    ahead, above = (F.array(*map(F.lit, p)).cast("array<string>") for p in (prefix, prefix[:-1]))
    here = fits(F.col("module"), ahead) if prefix else F.lit(True)
    owned = F.when(F.col("owner") == prefix[-1], fits(F.col("module"), above)).otherwise(here) if prefix else here
    items = cat.located("items").where(F.col("name") == name).where(owned).withColumn("rank", F.when(F.col("kind") == "use", 1).otherwise(0))
    items = items.withColumn("best", F.min("rank").over(per)).where("rank = best")
    return modules.union(items.select("project_id", F.lit("item").alias("what"), "module", "file_id", "seq"))


def users(references: DataFrame) -> DataFrame:
    """Lines of every file that name an item: project_id, target, symbol, file_id, lines (distinct, ascending, by commas)."""
    named = edges(references).where("symbol IS NOT NULL")
    return named.groupBy("project_id", "target", "symbol", "file_id").agg(F.array_join(F.array_sort(F.collect_set("line")), ",").alias("lines"))


def callers(cat: Catalog, externals: DataFrame, module: list[str], name: str, owner: str | None = None) -> DataFrame:
    """project_id, file_id, seq, line, caller of the calls of one item by path, outside of tests; calls on a receiver cannot be told.

    A method is called as Self::name inside its own type and module, or by way of a path that resolves to its type; a function by a path that
    resolves to it. In the item's own module a single segment that resolves to nothing means it too.
    """
    segs = F.filter(F.split(docs.without_generics(F.regexp_replace("callee", "::<", "<")), "::"), lambda x: x != "")
    calls = cat.located("calls").where("NOT in_test AND method IS NULL").withColumn("segs", segs).where(F.element_at(F.when(F.size("segs") > 0, F.col("segs")), -1) == name)
    before = F.slice("segs", F.lit(1), F.greatest(F.size("segs") - 1, F.lit(0)))
    here = F.col("module") == F.array(*map(F.lit, module)).cast("array<string>")
    calls = calls.withColumns({"segments": before if owner else F.col("segs"), "local": here})
    own = calls.limit(0)
    if owner:
        of_self = (F.size("segments") > 0) & (F.element_at(F.when(F.size("segments") > 0, F.col("segments")), -1) == "Self")
        own = calls.where(of_self & F.col("local") & (F.col("owner.ty") == owner))
        calls = calls.where(F.element_at(F.when(F.size("segments") > 0, F.col("segments")), -1) == owner)
    found = resolve(calls.select(*_REF, "line", "owner", "module", "segments", "local"), cat, externals)
    hit = (F.col("tag") == "internal") & (F.col("target") == F.array(*map(F.lit, module)).cast("array<string>")) & (F.col("symbol") == F.element_at("segments", -1))
    loose = (F.col("tag") == "other") & F.col("local") & (F.size("segments") == 1)
    free = F.when(F.size("module") > 0, F.concat_ws("::", F.element_at("module", -1), F.col("owner.name"))).otherwise(F.col("owner.name"))
    caller = F.when(F.col("owner").isNull(), "(module)").when(F.col("owner.ty").isNotNull(), F.concat_ws("::", "owner.ty", "owner.name")).otherwise(free).alias("caller")
    return found.where(hit | loose).select(*_REF, "line", caller).union(own.select(*_REF, "line", caller))


def items_between(cat: Catalog, asked: DataFrame) -> DataFrame:
    """asked: project_id, file_id, from, to (lines). The items that meet each range, by start line; re-exports and test-only items are left out."""
    rows = cat.items.where("kind <> 'use' AND NOT test_only")
    cell = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / 100), F.floor(F.col(b) / 100)))
    dealt = rows.withColumn("cell", cell("start_line", "end_line"))
    wanted = asked.where("from <= to").withColumn("cell", cell("from", "to"))
    met = dealt.join(wanted, ["project_id", "file_id", "cell"]).where("start_line <= to AND end_line >= from")
    return met.where(F.col("cell") == F.floor(F.greatest("start_line", "from") / 100)).select("project_id", "file_id", "from", "to", "seq", "start_line", "end_line", "kind", "owner", "name").orderBy("project_id", "file_id", "from", "start_line")


def check_counts(cat: Catalog, scope: list[str] | None = None) -> DataFrame:
    """One row for each project: documented and all modules' files, public items and tests, and files with syntax errors."""
    inside = (lambda df: df.where(paths.is_under("module", F.array(*map(F.lit, scope))))) if scope else (lambda df: df)
    text = lambda c: docs.summary(F.array_join(c, "\n"))
    files = inside(cat.files).groupBy("project_id").agg(F.count_if(text("module_doc").isNotNull()).alias("module_docs"), F.count("*").alias("modules"), F.count_if("parse_errors").alias("syntax_errors"))
    items = inside(public_items(cat)).groupBy("project_id").agg(F.count_if("documented").alias("documented"), F.count("*").alias("public_items"))
    tests = inside(cat.located("tests")).groupBy("project_id").agg(F.count_if(text("doc").isNotNull()).alias("test_docs"), F.count("*").alias("tests"))
    return files.join(items, "project_id", "left").join(tests, "project_id", "left").na.fill(0)

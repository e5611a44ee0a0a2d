"""Links in documentation: [[file]], [[howto:topic]], [`name`] and [`text`](name). Code spans are passed over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import docs, paths
from quillon.operators.code import STANDARD
from quillon.sources.trees import Catalog

_LINK = r"\[\[[^\[\]]+\]\]|\[`[^`]+`\](?:\((?:[^()]|\([^()]*\))*\))?"
_ANY = rf"{_LINK}|(`+)(?!`).*?(?<!`)\1(?!`)"
_FIND = {"file": r"^\[\[(?!howto:)(.+)\]\]$", "howto": r"^\[\[howto:(.+)\]\]$", "path": r"^\[`[^`]+`\]\((.*)\)$", "text": r"^\[`([^`]+)`\]$"}


def scanned(line: Column | str) -> Column:
    """The links of a line, in order, as they stand there."""
    return F.filter(F.regexp_extract_all(paths.col(line), F.lit(_ANY), 0), lambda x: x.rlike(f"^(?:{_LINK})$"))


def cleaned(target: Column) -> Column:
    """What a link names: behind the first @, without (), ! and generics."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(target), "^[^@]*@", ""), r"\(\)$|!$", "")
    return docs.without_generics(bare)


def doc_links(cat: Catalog) -> DataFrame:
    """project_id, file_id, path, module, line, link, kind (file, howto or symbol), target of every link in module and item documentation."""
    files = cat.files.select("project_id", "file_id", "path", "module")
    tops = cat.files.select("project_id", "file_id", F.col("module_doc_line").alias("first"), F.posexplode("module_doc").alias("at", "text"))
    items = cat.items.select("project_id", "file_id", F.col("start_line").alias("first"), F.posexplode("doc").alias("at", "text"))
    found = tops.union(items).select("project_id", "file_id", (F.col("first") + F.col("at")).alias("line"), F.posexplode(scanned("text")).alias("nth", "link")).join(files, ["project_id", "file_id"])
    part = {k: F.regexp_extract("link", p, 1) for k, p in _FIND.items()}
    kind = F.when(part["howto"] != "", "howto").when(part["file"] != "", "file").otherwise("symbol")
    target = F.when(kind == "howto", F.lower(F.trim(part["howto"]))).when(kind == "file", F.trim(part["file"])).otherwise(cleaned(F.when(part["path"] != "", part["path"]).otherwise(part["text"])))
    return found.select("project_id", "file_id", "path", "module", "line", "nth", "link", kind.alias("kind"), target.alias("target"))


def names(cat: Catalog) -> DataFrame:
    """project_id, full (path), rank, file_id, seq of everything that a path can name: modules, items by module and, for methods, by owner too."""
    mods = cat.modules.where("size(module) > 0").select("project_id", F.col("module").alias("full"), F.lit(0).alias("rank"), F.lit(-1).alias("file_id"), F.lit(-1).alias("seq"))
    items = cat.items.join(cat.files.select("project_id", "file_id", "module"), ["project_id", "file_id"])
    rank = F.when(F.col("kind") == "use", 2).otherwise(1)
    plain = items.select("project_id", F.concat("module", F.array("name")).alias("full"), rank.alias("rank"), "file_id", "seq")
    owned = items.where("owner IS NOT NULL").select("project_id", F.concat("module", F.array("owner", "name")).alias("full"), rank.alias("rank"), "file_id", "seq")
    return mods.union(plain).union(owned)


def resolved_links(links: DataFrame, cat: Catalog, externals: DataFrame, present: DataFrame, topics: DataFrame) -> DataFrame:
    """links with status (at, exists, external or broken) and, for at, to_file and to_seq (-1 for a module).

    externals: project_id, name. present: project_id, target (files on disk). topics: project_id, target. A path from crate, self or super must
    be a full name; standard and declared packages are external; other names must be the end of a full name, the first match counts (modules, then
    in order of files); a name that its file imports is external too.
    """
    segs = F.filter(F.split("target", "::"), lambda s: s != "")
    rows = links.withColumn("segs", segs).withColumn("first", F.get("segs", F.lit(0)))
    ups = F.coalesce(F.nullif(F.array_position(F.transform("segs", lambda s: s != "super"), True), F.lit(0)).cast("int") - 1, F.size("segs"))
    above = F.slice("module", F.lit(1), F.greatest(F.size("module") - ups, F.lit(0)))
    full = F.when(F.col("first") == "crate", F.slice("segs", 2, 100)).when(F.col("first") == "self", F.concat("module", F.slice("segs", 2, 100))).when((F.col("first") == "super") & (ups <= F.size("module")), F.concat(above, F.slice("segs", ups + 1, F.size("segs"))))
    rows = rows.withColumns({"full": full, "anchored": F.col("first").isin("crate", "self", "super"), "last": F.when(full.isNotNull(), F.element_at(F.when(F.size(full) > 0, full), -1)).otherwise(F.element_at(F.when(F.size("segs") > 0, F.col("segs")), -1))})
    key = ["project_id", "file_id", "line", "nth"]
    known = names(cat).withColumnsRenamed({"full": "name", "file_id": "to_file", "seq": "to_seq"}).withColumn("last", F.element_at("name", -1))
    fits = F.when(F.col("anchored"), F.coalesce(F.col("name") == F.col("full"), F.lit(False))).otherwise(paths.has_suffix("name", "segs"))
    hits = rows.where("kind = 'symbol'").select(*key, "segs", "full", "anchored", "last").join(known, ["project_id", "last"]).where(fits)
    best = hits.groupBy(*key).agg(F.min(F.struct("rank", "to_file", "to_seq")).alias("hit"))
    imports = cat.refs.where("size(segments) > 1").select("project_id", "file_id", F.element_at("segments", -1).alias("first"), F.lit(True).alias("imported")).distinct()
    packages = externals.select("project_id", F.col("name").alias("first"), F.lit(True).alias("declared")).distinct()
    out = rows.join(best, key, "left").join(imports, ["project_id", "file_id", "first"], "left").join(packages, ["project_id", "first"], "left")
    out = out.join(present.select("project_id", "target", F.lit(True).alias("there")).distinct(), ["project_id", "target"], "left").join(topics.select("project_id", "target", F.lit(True).alias("told")).distinct(), ["project_id", "target"], "left")
    whole = F.col("anchored") & (F.size("full") == 0)
    symbol = F.when(F.col("anchored"), F.when(F.col("hit").isNotNull() | F.coalesce(whole, F.lit(False)), "at").otherwise("broken")).when(F.col("first").isin(*STANDARD) | F.col("declared"), "external").when(F.col("hit").isNotNull(), "at").when(F.col("imported"), "external").otherwise("broken")
    status = F.when(F.col("kind") == "file", F.when(F.col("there"), "exists").otherwise("broken")).when(F.col("kind") == "howto", F.when(F.col("told"), "exists").otherwise("broken")).otherwise(symbol)
    return out.select(*key, "path", "link", "kind", "target", status.alias("status"), F.when(status == "at", F.coalesce("hit.to_file", F.lit(-1))).alias("to_file"), F.when(status == "at", F.coalesce("hit.to_seq", F.lit(-1))).alias("to_seq"))

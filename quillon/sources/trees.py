"""Source trees as flat tables: files, items, refs, calls, trait_impls, tests and modules."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillon.functions import paths
from quillon.runtime import materialize, ship
from quillon.sources import rust, script

_OWNER = "struct<ty: string, name: string>"
_ITEM = "struct<kind: string, name: string, vis: tinyint, signature: string, doc: array<string>, start_line: int, decl_line: int, end_line: int, fields: array<string>, derives: array<string>, owner: string, hidden: boolean, test_only: boolean>"
_REF = f"struct<segments: array<string>, glob: boolean, anchored: boolean, line: int, in_test: boolean, owner: {_OWNER}, import: array<string>>"
_CALL = f"struct<callee: string, method: string, generics: string, args: array<string>, line: int, in_test: boolean, owner: {_OWNER}>"
PARSED = (
    "project_id string, path string, module array<string>, lines int, module_doc array<string>, module_doc_line int, parse_errors boolean, "
    f"items array<{_ITEM}>, refs array<{_REF}>, calls array<{_CALL}>, trait_impls array<struct<ty: string, trait_name: string>>, tests array<struct<name: string, doc: array<string>>>"
)
EXTENSIONS = {"rust": ("rs",), "typescript": script.EXTENSIONS}
_CHILDREN = ("items", "refs", "calls", "trait_impls", "tests")
#: Files that one task parses: at least so many if there are few, at most so many if there are many.
TASK_FILES = (50, 4000)


#: By language: module of a file by its path below the source directory, and what is in a source of a folder there.
_ADAPTERS = {"rust": (rust.module_of, lambda source, folder: rust.parse(source)), "typescript": (script.module_of, script.parse)}


def _adapter(language: str):
    if language not in _ADAPTERS:
        raise ValueError(f"no parser for {language}")
    return _ADAPTERS[language]


def read_tree(spark: SparkSession, root: str, source_dir: str, language: str, project_id: str = "") -> DataFrame:
    """project_id, path (below root), source of the files of one language below root/source_dir. Hidden and dependency folders are left out.

    Files are listed first by name only; contents are read of those that stay. Text that is not UTF-8 counts as empty.
    """
    base = f"{root.rstrip('/')}/{source_dir}".rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{%s}" % ",".join(EXTENSIONS[language])).load(base)
    plain = F.regexp_replace("path", "^[a-z]+:/*", "/")
    top = root.split(":")[-1].rstrip("/").replace("//", "/")
    below = F.substring(plain, F.lit(len("/" + top.strip("/") + "/") + 1), F.length(plain))
    named = files.select("path", below.alias("below"))
    names = named.where(~F.col("below").rlike(r"(^|/)(\.[^/]*|target|node_modules)/"))
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise("")
    return files.join(names, "path", "left_semi").select(F.lit(project_id).alias("project_id"), below.alias("path"), text.alias("source"))


def parsed(files: DataFrame, language: str, source_dir: str = "src", numbered: bool = False) -> DataFrame:
    """files (project_id, path, source) -> a row for each file that belongs to a module, with what is in it as arrays in source order.

    A reference has `import`: of the imports of its file, inline paths included, the first that ends with its first segment. numbered: with part (the
    partition) and nth, the place among the rows of its project there.
    """
    module_of, parse = _adapter(language)
    ship(files.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skip = [p for p in source_dir.split("/") if p not in ("", ".")]
        part, last, nth = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            rows = []
            for project, path, source in zip(*(batch.column(c).to_pylist() for c in ("project_id", "path", "source"))):
                parts = path.split("/")
                module = module_of(parts[len(skip) :]) if parts[: len(skip)] == skip else None
                if module is None:
                    continue
                found = vars(parse(source or "", parts[len(skip) : -1]))
                for kind in ("refs", "calls"):
                    for r in found[kind]:
                        r["owner"] = {"ty": r["owner"][0], "name": r["owner"][1]} if r["owner"] else None
                imports: dict[str, list[str]] = {}
                for r in found["refs"]:
                    if not r["glob"] and len(r["segments"]) > 1:
                        imports.setdefault(r["segments"][-1], r["segments"])
                for r in found["refs"]:
                    r["import"] = imports.get(r["segments"][0]) if r["segments"] else None
                nth = nth + 1 if project == last else 0
                last = project
                rows.append({"project_id": project, "path": path, "module": module, "part": part, "nth": nth} | found)
            yield pa.RecordBatch.from_pylist(rows, schema=_arrow(numbered))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # what a parser makes has no cycles; looking for some takes up to a third of the time
        try:
            yield from read(batches)
        finally:
            gc.enable()

    return files.select("project_id", "path", "source").mapInArrow(run, PARSED + (", part int, nth int" if numbered else ""))


def _arrow(numbered: bool = False) -> pa.Schema:
    text, texts, flag, small = pa.string(), pa.list_(pa.string()), pa.bool_(), pa.int32()
    owner = pa.struct([("ty", text), ("name", text)])
    item = pa.struct([("kind", text), ("name", text), ("vis", pa.int8()), ("signature", text), ("doc", texts), ("start_line", small), ("decl_line", small), ("end_line", small), ("fields", texts), ("derives", texts), ("owner", text), ("hidden", flag), ("test_only", flag)])
    ref = pa.struct([("segments", texts), ("glob", flag), ("anchored", flag), ("line", small), ("in_test", flag), ("owner", owner), ("import", texts)])
    call = pa.struct([("callee", text), ("method", text), ("generics", text), ("args", texts), ("line", small), ("in_test", flag), ("owner", owner)])
    impl, test = pa.struct([("ty", text), ("trait_name", text)]), pa.struct([("name", text), ("doc", texts)])
    place = [("part", small), ("nth", small)] if numbered else []
    return pa.schema([("project_id", text), ("path", text), ("module", texts), ("lines", small), ("module_doc", texts), ("module_doc_line", small), ("parse_errors", flag), ("items", pa.list_(item)), ("refs", pa.list_(ref)), ("calls", pa.list_(call)), ("trait_impls", pa.list_(impl)), ("tests", pa.list_(test)), *place])


@dataclass
class Catalog:
    """The tables of one or more projects. Child tables have project_id, file_id and seq, the place in the file.

    placed: child tables by name that also have in_file (the path) and module of their file, so that no join is needed for these.
    """

    files: DataFrame
    items: DataFrame
    refs: DataFrame
    calls: DataFrame
    trait_impls: DataFrame
    tests: DataFrame
    modules: DataFrame
    language: str
    placed: dict[str, DataFrame] = field(default_factory=dict)

    def located(self, child: str) -> DataFrame:
        """A child table with in_file (the path) and module of its files."""
        if child in self.placed:
            return self.placed[child]
        return getattr(self, child).join(self.files.select("project_id", "file_id", F.col("path").alias("in_file"), "module"), ["project_id", "file_id"])


def catalog(files: DataFrame, language: str, source_dir: str = "src") -> Catalog:
    """Parses once, writes the result to the shared folder and reads every table from there.

    Files are numbered in order of their path's parts, for each project: they are dealt out and sorted by that order before they are parsed, however
    few partitions they came in, and a file's number is its place in its partition behind the files of its project in earlier ones.
    """
    files = files.select("project_id", "path", "source").where("project_id IS NOT NULL")
    count, (few, many) = files.count(), TASK_FILES
    parts = max(1, min(-(-count // few), 2 * files.sparkSession.sparkContext.defaultParallelism), -(-count // many))
    order = [F.col("project_id"), F.split("path", "/")]
    rows = materialize(parsed(files.repartitionByRange(parts, *order).sortWithinPartitions(*order), language, source_dir, numbered=True), "parsed")
    # only projects that go on from an earlier partition have files there: one for each partition at most
    earlier = F.sum("n").over(W.partitionBy("project_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    earlier = rows.groupBy("project_id", "part").agg(F.count("*").alias("n")).select("project_id", "part", earlier.alias("earlier")).where("earlier > 0")
    earlier = F.broadcast(materialize(earlier, "earlier"))
    base = rows.join(earlier, ["project_id", "part"], "left").withColumn("file_id", (F.col("nth") + F.coalesce("earlier", F.lit(0))).cast("int")).drop("part", "nth", "earlier")
    placed = {c: base.select("project_id", "file_id", F.col("path").alias("in_file"), "module", F.posexplode(c).alias("seq", "x")).select("project_id", "file_id", "seq", "x.*", "in_file", "module") for c in _CHILDREN}
    tables = {c: df.drop("in_file", "module", "import") for c, df in placed.items()}
    own = base.drop(*_CHILDREN).withColumn("path_parts", F.split("path", "/"))
    modules = base.select("project_id", F.explode(paths.prefixes("module")).alias("module")).distinct()
    return Catalog(own, modules=modules, language=language, placed=placed, **tables)

"""Judging tool calls against the tables of a project: reads of long files that are indexed, and searches for names that are resolved.

Everything that is unclear is let through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import shell
from quillon.runtime import materialize, ship

#: Whole-file reads of indexed files up to this many lines pass.
WHOLE_FILE_LINES = 100
#: Unlike calls of which a Python process remembers what they ask for; the same few are made again and again.
ASKED_KEPT = 4096
REQUEST = "call_id long, pos int, kind string, how string, paths array<string>, names array<string>, low long, high long"
_ARROW = pa.schema([("call_id", pa.int64()), ("pos", pa.int32()), ("kind", pa.string()), ("how", pa.string()), ("paths", pa.list_(pa.string())), ("names", pa.list_(pa.string())), ("low", pa.int64()), ("high", pa.int64())])
INPUT = "struct<file_path: string, offset: long, limit: long, pattern: string, path: string, glob: string, type: string, command: string>"


def requests(calls: DataFrame, extensions: tuple[str, ...], types: tuple[str, ...] = (), keywords: frozenset[str] = frozenset()) -> DataFrame:
    """calls: call_id, tool_name, tool_input (JSON text; paths relative to the root). A row for each read or search that may concern the project.

    Unreadable input, other tools and searches of other languages give no row. They are left out before any Python runs.
    """
    ship(calls.sparkSession)
    given = calls.select("call_id", "tool_name", F.from_json("tool_input", INPUT).alias("i")).where("tool_name IN ('Read', 'Grep', 'Bash')")
    rows = given.select("call_id", "tool_name", "i.*").where("coalesce(file_path, pattern, command) IS NOT NULL")

    def asked(tool: str, file_path, offset, limit, pattern, path, glob, type, command) -> tuple[dict, ...]:
        found = []
        if tool == "Read" and file_path and not (offset or limit):
            found = [{"pos": 0, "kind": "whole", "how": "Read", "paths": [shell.lexical(file_path)]}]
        elif tool == "Grep" and pattern:
            other = glob and not any(e in glob for e in extensions) or type and type not in types
            found = [] if other else [{"pos": 0, "kind": "search", "how": "Grep", "paths": [shell.lexical(path or ".")], "pattern": pattern}]
        elif tool == "Bash" and command:
            found = shell.requests(command, extensions)
        out = []
        for f in found:
            pattern = f.pop("pattern", None)
            names = shell.alternatives(pattern, keywords) if pattern else None
            if f["kind"] != "search" or names:
                out.append({"names": names, "low": None, "high": None} | f)
        return tuple(out)

    columns = ("tool_name", "file_path", "offset", "limit", "pattern", "path", "glob", "type", "command")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered = lru_cache(ASKED_KEPT)(asked)
        for b in batches:
            given = zip(b.column("call_id").to_pylist(), *(b.column(c).to_pylist() for c in columns))
            yield pa.RecordBatch.from_pylist([{"call_id": call} | f for call, *rest in given for f in remembered(*rest)], schema=_ARROW)

    return rows.mapInArrow(run, REQUEST)


def judged(calls: DataFrame, asked: DataFrame, files: DataFrame, names: DataFrame) -> DataFrame:
    """For every call: call_id, verdict (allow or block), reason, how. asked: requests(); files: path, lines; names: name (of items and modules).

    whole: a read of an indexed file of more than WHOLE_FILE_LINES lines. range: lines of an indexed file. search: every alternative is a known name,
    and the path is an indexed file or a folder with some. The first request that is blocked decides.
    """
    asked = materialize(asked, "asked")  # read four times below; as a plan its commands would be parsed as often
    path = F.explode("paths").alias("path")
    reads = asked.where("kind <> 'search'").select("call_id", "pos", "kind", "how", path).join(files.select("path", "lines"), "path")
    blocked = reads.where((F.col("kind") == "range") | (F.col("lines") > WHOLE_FILE_LINES)).select("call_id", "pos", "kind", "how")
    parts = F.split("path", "/")
    folders = files.select(F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("path")).distinct()
    searches = asked.where("kind = 'search'")
    inside = searches.select("call_id", "pos", path).join(folders, "path").select("call_id", "pos").distinct()
    last = F.element_at(F.split("name", "::"), -1)
    known = searches.select("call_id", "pos", F.size("names").alias("n"), F.explode(F.array_distinct("names")).alias("name")).withColumn("name", last)
    hits = known.join(names.select("name").distinct().withColumn("hit", F.lit(1)), "name", "left").groupBy("call_id", "pos").agg((F.count("*") == F.count("hit")).alias("all")).where("all")
    symbols = searches.select("call_id", "pos", "kind", "how").join(inside, ["call_id", "pos"], "left_semi").join(hits, ["call_id", "pos"], "left_semi")
    first = blocked.union(symbols).groupBy("call_id").agg(F.min(F.struct("pos", "kind", "how")).alias("b"))
    return calls.select("call_id").join(first, "call_id", "left").select("call_id", F.when(F.col("b").isNull(), "allow").otherwise("block").alias("verdict"), F.col("b.kind").alias("reason"), F.col("b.how").alias("how"))

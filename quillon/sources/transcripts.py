"""Session transcripts: JSON lines, a file for each session. Lines that are not JSON are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.usage import floor_share

COUNTERS = ("tool", "ranged", "whole", "shell", "grep", "blocked")


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """session, at (order in the file), record (variant) of every readable line of path/*.jsonl. Files are not split, so lines keep their order."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]*)\.jsonl$", 1)
    text = spark.read.option("wholetext", False).text(path if path.endswith(".jsonl") else f"{path}/*.jsonl", pathGlobFilter="*.jsonl")
    rows = text.select(name.alias("session"), F.monotonically_increasing_id().alias("at"), F.try_parse_json("value").alias("record"))
    return rows.where("record IS NOT NULL")


def _get(record: str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col(record), path, kind)


def uses(sessions: DataFrame) -> DataFrame:
    """session, at, seq, tool, input (variant) of every tool use of the assistant."""
    parts = sessions.where(_get("record", "$.type") == "assistant").select("session", "at", F.posexplode(_get("record", "$.message.content", "array<variant>")).alias("seq", "part"))
    return parts.where(_get("part", "$.type") == "tool_use").select("session", "at", "seq", _get("part", "$.name").alias("tool"), _get("part", "$.input", "variant").alias("input"))


def results(sessions: DataFrame) -> DataFrame:
    """session, at, seq, text of every tool result: its content, or the texts of its parts joined by spaces."""
    parts = sessions.where(_get("record", "$.type") == "user").select("session", "at", F.posexplode(_get("record", "$.message.content", "array<variant>")).alias("seq", "part"))
    inner = F.transform(_get("part", "$.content", "array<variant>"), lambda v: F.coalesce(F.try_variant_get(v, "$.text", "string"), F.lit("")))
    plain = F.when(F.schema_of_variant(_get("part", "$.content", "variant")) == "STRING", _get("part", "$.content"))
    return parts.where(_get("part", "$.type") == "tool_result").select("session", "at", "seq", F.coalesce(plain, F.array_join(inner, " "), F.lit("")).alias("text"))


def touched(sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(session, path) of edited files, and (session, commands): all shell commands in order, one a line."""
    used = uses(sessions)
    edited = used.where("tool IN ('Edit', 'Write', 'MultiEdit', 'NotebookEdit')").select("session", _get("input", "$.file_path").alias("path")).where("path IS NOT NULL").distinct()
    run = used.where("tool = 'Bash'").select("session", "at", "seq", _get("input", "$.command").alias("command")).where("command IS NOT NULL")
    joined = run.groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "seq", "command"))), lambda x: x["command"]), "\n").alias("commands"))
    return edited, joined


def usage(sessions: DataFrame, tool: str, extension: str, mark: str, since: str | None = None, everything: bool = False) -> DataFrame:
    """date, session, COUNTERS and share for each session, ordered by date and session, and a row `total`.

    tool: whole calls of an MCP server or words of shell commands with this name; mark: text of results that block. Sessions that began before
    `since` (a date) are left out, and those that count nothing unless `everything`. share: tool in all reads, whole percents.
    """
    started = sessions.groupBy("session").agg(F.substring(F.min_by(_get("record", "$.timestamp"), F.when(_get("record", "$.timestamp").isNotNull(), F.col("at"))), 1, 10).alias("date"))
    u, name, command, path = uses(sessions), F.col("tool"), F.coalesce(_get("input", "$.command"), F.lit("")), F.coalesce(_get("input", "$.file_path"), F.lit(""))
    reads = (name == "Read") & F.endswith(path, F.lit(extension))
    ranged = F.coalesce(_get("input", "$.offset", "long"), F.lit(0)) + F.coalesce(_get("input", "$.limit", "long"), F.lit(0)) > 0
    words = lambda pattern: F.when(name == "Bash", F.regexp_count(command, F.lit(pattern))).otherwise(0)
    one = lambda c: F.when(c, 1).otherwise(0)
    made = {"tool": words(rf"\b{tool} \w+") + one(F.startswith(name, F.lit("mcp__")) & F.contains(name, F.lit(tool))), "ranged": one(reads & ranged), "whole": one(reads & ~ranged), "shell": words(r"\b(?:cat|sed|head|tail|less|grep|rg)\b[^|;&\n]*\.%s\b" % extension.lstrip(".")), "grep": one(name == "Grep")}
    rows = u.select("session", *(c.cast("long").alias(n) for n, c in made.items()), F.lit(0).cast("long").alias("blocked"))
    rows = rows.unionByName(results(sessions).select("session", *(F.lit(0).cast("long").alias(n) for n in made), one(F.contains("text", F.lit(mark))).cast("long").alias("blocked")))
    counted = started.join(rows.groupBy("session").agg(*(F.sum(n).alias(n) for n in COUNTERS)), "session", "left").na.fill(0, list(COUNTERS))
    if since:
        counted = counted.where(F.coalesce("date", F.lit("")) >= since)
    if not everything:
        counted = counted.where(" + ".join(COUNTERS) + " > 0")
    total = counted.agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in COUNTERS))  # a row even without sessions
    both = counted.select(F.lit(0).alias("last"), F.coalesce("date", F.lit("?")).alias("date"), "session", *COUNTERS)
    both = both.union(total.select(F.lit(1), F.lit("total"), F.lit(None).cast("string"), *COUNTERS))
    both = both.withColumn("reads", F.col("tool") + F.col("ranged") + F.col("whole") + F.col("shell") + F.col("grep"))
    shown = both.select("date", "session", *COUNTERS, floor_share("tool", "reads").alias("share"), "last")
    return shown.orderBy("last", "date", "session").drop("last")

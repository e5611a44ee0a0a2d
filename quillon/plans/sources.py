"""Queries over source text: every customer becomes a file of a project (its nation), which the parsers and the resolution then read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import code, guard
from quillon.sources import manifests, transcripts, trees
from quillon.sources.trees import Catalog

#: {k}: the customer, {m}: the first customer of its nation, {seg}: its segment, {doc}: a line of documentation where it has money.
RUST = """//! Customer {k}.
//!
//! Of segment {seg}.

use crate::c{m}::Own as First;
use crate::c{m}::{self, make};
use serde::Deserialize;
use std::fmt;
use super::super::gone;

/// Holds {k}.
/// More.
#[derive(Clone, Debug)]
pub struct Own {
    pub at: u8,
    kept: i32,
}

impl Own {
    /// Makes one.
    pub fn new(at: u8) -> Self {
        make({k});
        Self::up();
        serde::load(at)
    }
    pub(crate) fn up() {}
}

impl Default for Own {
    fn default() -> Self {
        Own::new(1)
    }
}

{doc}pub fn make(n: u8) {}

#[doc(hidden)]
pub fn secret() {}

#[cfg(test)]
mod tests {
    /// Works.
    #[test]
    fn works() {
        crate::c{m}::make(1);
    }
}
"""
SCRIPT = """/**
 * Customer {k}.
 */

import { Own as First, make } from './c{m}'
import fs from 'node:fs'
import deep from '@kit/pack/deep'
import { far } from '@/c{m}'
import '../out'

/** Holds {k}. */
export class Own implements Held<{ a: 1 }> {
  private kept = {k}
  /**
   * Makes one.
   * @param at where
   */
  static make(at: number): Own { return new Own(`${at} }`) }
  #hidden() {}
}

{doc}export const make = (n: number): Own => Own.make(n)
function inner() {}
export type Segment = '{seg}'
export { inner as outer }
"""


def _files(spark: SparkSession, sf: str, text: str, extension: str, documented: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    first = rows.groupBy("c_nationkey").agg(F.min("c_custkey").alias("m"))
    rows = rows.repartition("c_custkey")  # a small file is one partition; the texts are many times its size
    put: Column = F.lit(text)
    doc = F.when(F.col("c_acctbal") > 0, documented).otherwise("")
    for name, value in (("k", F.col("c_custkey").cast("string")), ("m", F.col("m").cast("string")), ("seg", F.col("c_mktsegment")), ("doc", doc)):
        put = F.replace(put, F.lit("{%s}" % name), value)
    path = F.concat(F.lit("src/c"), F.col("c_custkey").cast("string"), F.lit(extension))
    return rows.join(first, "c_nationkey").select(F.col("c_nationkey").cast("string").alias("project_id"), path.alias("path"), put.alias("source"))


def _rust(spark: SparkSession, sf: str) -> Catalog:
    return trees.catalog(_files(spark, sf, RUST, ".rs", "/// Of money.\n"), "rust")


def _script(spark: SparkSession, sf: str) -> Catalog:
    return trees.catalog(_files(spark, sf, SCRIPT, ".ts", "/** Of money. */\n"), "typescript")


def _items(cat: Catalog) -> DataFrame:
    text = lambda c, by: F.array_join(c, by).alias(c)
    kept = ("seq", "kind", "owner", "name", F.col("vis").cast("int").alias("vis"), "signature", text("doc", "|"), "start_line", "decl_line", "end_line", text("fields", "|"), text("derives", "|"), "hidden")
    return cat.located("items").select(F.col("in_file").alias("path"), *kept)


def _references(found: DataFrame) -> DataFrame:
    return found.select(F.col("in_file").alias("path"), "seq", "line", F.array_join("segments", "::").alias("name"), "in_test", "tag", "package", F.array_join("target", "::").alias("target"), "symbol")


def _declared(cat: Catalog, name: str) -> DataFrame:
    return cat.files.select("project_id", F.lit(name).alias("name")).distinct()


def rust_items(spark: SparkSession, sf: str) -> DataFrame:
    """Items of all files, in order."""
    return _items(_rust(spark, sf))


def rust_references(spark: SparkSession, sf: str) -> DataFrame:
    """References of all files and what they mean."""
    cat = _rust(spark, sf)
    return _references(code.resolved(cat, _declared(cat, "serde")))


def rust_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Calls of all files with who makes them."""
    cat = _rust(spark, sf)
    return cat.located("calls").select(F.col("in_file").alias("path"), "seq", "callee", F.array_join("args", ",").alias("args"), "line", "in_test", code.owner_name().alias("caller"))


def rust_users(spark: SparkSession, sf: str) -> DataFrame:
    """By item of the nation's first customer: files that use it outside of tests, and the lines of the first of them."""
    cat = _rust(spark, sf)
    used = code.users(code.resolved(cat, _declared(cat, "serde")))
    return used.groupBy(F.col("project_id").cast("int").alias("project_id"), F.array_join("target", "::").alias("target"), "symbol").agg(F.count("*").alias("files"), F.min("lines").alias("lines"))


def rust_check(spark: SparkSession, sf: str) -> DataFrame:
    """Documentation of every project in numbers."""
    out = code.check_counts(_rust(spark, sf))
    return out.select(F.col("project_id").cast("int").alias("project_id"), *(F.col(c).cast("long").alias(c) for c in out.columns if c != "project_id"))


def symbol_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """What the names Own::new, make, secret and c1 mean in every project."""
    cat = _rust(spark, sf)
    out = None
    for name in ("Own::new", "make", "c1", "c1::secret"):
        rows = code.find(cat, name.split("::")).withColumn("asked", F.lit(name))
        out = rows if out is None else out.union(rows)
    return out.groupBy("asked", "what", F.col("project_id").cast("int").alias("project_id")).agg(F.count("*").alias("found"), F.min(F.array_join("module", "::")).alias("first_module"))


def script_items(spark: SparkSession, sf: str) -> DataFrame:
    """Items of all files, in order."""
    return _items(_script(spark, sf))


def script_references(spark: SparkSession, sf: str) -> DataFrame:
    """Imports of all files and what they mean; @/ stands for the source folder."""
    cat = _script(spark, sf)
    rules = cat.files.select("project_id", F.lit("@/").alias("prefix"), F.lit(False).alias("exact"), F.array().cast("array<string>").alias("target")).distinct()
    return _references(code.resolved(cat, _declared(cat, "@kit/pack"), rules))


def manifest_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest for every supplier: TOML for even keys, JSON for odd ones, both for those that 5 divides."""
    rows = spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey", "s_nationkey")
    key, dep = F.col("s_suppkey").cast("string"), F.concat(F.lit("dep-"), F.col("s_nationkey").cast("string"))
    toml = F.concat(F.lit('[package]\nname = "t'), key, F.lit('"\n[dependencies]\n"'), dep, F.lit('" = "1"\nbevy = "1"\n[target."cfg(unix)".dev-dependencies]\nlibc = "1"\n'))
    json = F.concat(F.lit('{"name": "j'), key, F.lit('", "dependencies": {"'), dep, F.lit('": "1"}, "peerDependencies": {"react": "1"}}'))
    even, both = F.col("s_suppkey") % 2 == 0, F.col("s_suppkey") % 5 == 0
    files = rows.where(even | both).select(key.alias("project_id"), F.lit("Cargo.toml").alias("path"), toml.alias("source"))
    files = files.union(rows.where(~even | both).select(key, F.lit("package.json"), json))
    out = manifests.manifests(files)
    return out.select("project_id", "name", "language", F.array_join("externals", ",").alias("externals"), "source_dir", "pack")


def guard_judged(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as a call of a tool: whole reads, ranges and searches by its number, judged against the files of suppliers."""
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id").repartition("event_id").select("event_id", (F.col("event_id") % 97).cast("string").alias("n"), (F.col("event_id") % 8).alias("kind"))
    path, name = F.concat(F.lit("src/f"), F.col("n"), F.lit(".rs")), F.concat(F.lit("Name"), F.col("n"))
    inputs = [
        ("Read", F.to_json(F.struct(path.alias("file_path")))),
        ("Read", F.to_json(F.struct(path.alias("file_path"), F.lit(5).alias("offset")))),
        ("Grep", F.to_json(F.struct(name.alias("pattern"), F.lit("src").alias("path")))),
        ("Grep", F.to_json(F.struct(F.lit("some words").alias("pattern")))),
        ("Bash", F.to_json(F.struct(F.concat(F.lit("cd x && cat -n "), path, F.lit(" | head -3")).alias("command")))),
        ("Bash", F.to_json(F.struct(F.concat(F.lit("sed -n '3,9p' "), path).alias("command")))),
        ("Bash", F.to_json(F.struct(F.concat(F.lit("grep -rn --include='*.rs' 'fn "), name, F.lit("' src; ls")).alias("command")))),
        ("Edit", F.lit("not json")),
    ]
    of = lambda i: F.element_at(F.array(*(F.lit(x[i]) if i == 0 else x[i] for x in inputs)), F.col("kind").cast("int") + 1)
    calls = events.select(F.col("event_id").alias("call_id"), of(0).alias("tool_name"), of(1).alias("tool_input"))
    made = spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey").where("s_suppkey < 97")
    files = made.select(F.concat(F.lit("src/f"), F.col("s_suppkey").cast("string"), F.lit(".rs")).alias("path"), (F.col("s_suppkey") * 4).cast("int").alias("lines"))
    names = made.where("s_suppkey % 3 = 0").select(F.concat(F.lit("Name"), F.col("s_suppkey").cast("string")).alias("name"))
    asked = guard.requests(calls, ("rs",), ("rust",), frozenset(["fn", "pub"]))
    return guard.judged(calls, asked, files, names).select(F.col("call_id").alias("event_id"), "verdict", "reason", "how")


def session_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Events as lines of their user's session: reads, ranges, searches, commands and results, counted."""
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "ts", (F.col("event_id") % 6).cast("int").alias("kind"))
    use = lambda tool, given: f'"type":"assistant","message":{{"content":[{{"type":"tool_use","name":"{tool}","input":{given}}}]}}'
    lines = [use("Read", '{"file_path":"a.rs"}'), use("Read", '{"file_path":"a.rs","limit":3}'), use("Grep", "{}"), use("Bash", '{"command":"quillon map x; cat b.rs"}'), '"type":"user","message":{"content":[{"type":"tool_result","content":"guard: no"}]}', '"type":"user","message":{"content":"plain"}']
    record = F.concat(F.lit('{"timestamp":"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('",'), F.element_at(F.array(*map(F.lit, lines)), F.col("kind") + 1), F.lit("}"))
    sessions = events.select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("at"), F.try_parse_json(record).alias("record"))
    return transcripts.usage(sessions, "quillon", ".rs", "guard:", everything=True)


QUERIES = {f.__name__: f for f in (rust_items, rust_references, rust_calls, rust_users, rust_check, symbol_lookup, script_items, script_references, manifest_rows, guard_judged, session_usage)}

_C = """c AS (SELECT CAST(c_custkey AS VARCHAR) AS k, CAST(min(c_custkey) OVER (PARTITION BY c_nationkey) AS VARCHAR) AS m, c_nationkey AS p, c_mktsegment AS seg,
  CAST(c_acctbal > 0 AS INTEGER) AS d FROM customer)"""


def _rows(values: str, columns: str) -> str:
    """One row of values for each customer; {k} and {m} in texts stand for it and the first of its nation."""
    return f"c CROSS JOIN (VALUES {values}) AS v({columns})"


def _put(column: str) -> str:
    return f"replace(replace(replace({column}, '{{k}}', k), '{{m}}', m), '{{seg}}', seg)"


def _item_sql(values: str, extension: str) -> str:
    # moved: by how much the lines move that stand behind the optional line of documentation
    return f"""WITH {_C} SELECT 'src/c' || k || '{extension}' AS path, CAST(seq AS INTEGER) AS seq, kind, owner, name, CAST(vis AS INTEGER) AS vis, {_put('signature')} AS signature,
  CASE WHEN name = 'make' AND owner IS NULL THEN CASE d WHEN 1 THEN 'Of money.' ELSE '' END ELSE {_put('doc')} END AS doc,
  CAST(a + CASE WHEN moved > 1 THEN d ELSE 0 END AS INTEGER) AS start_line, CAST(b + CASE WHEN moved > 0 THEN d ELSE 0 END AS INTEGER) AS decl_line,
  CAST(e + CASE WHEN moved > 0 THEN d ELSE 0 END AS INTEGER) AS end_line, fields, derives, hidden
FROM {_rows(values, 'seq, kind, owner, name, vis, signature, doc, a, b, e, moved, fields, derives, hidden')}"""


def _reference_sql(values: str, extension: str) -> str:
    return f"""WITH {_C} SELECT 'src/c' || k || '{extension}' AS path, CAST(seq AS INTEGER) AS seq, CAST(line + CASE WHEN line > 34 THEN d ELSE 0 END AS INTEGER) AS line, {_put('name')} AS name, in_test, tag, package,
  {_put('target')} AS target, symbol FROM {_rows(values, 'seq, line, name, in_test, tag, package, target, symbol')}"""


_RUST_REFERENCES = """(0, 5, 'crate::c{m}::Own', false, 'internal', NULL, 'c{m}', 'Own'), (1, 6, 'crate::c{m}', false, 'internal', NULL, 'c{m}', NULL),
  (2, 6, 'crate::c{m}::make', false, 'internal', NULL, 'c{m}', 'make'), (3, 7, 'serde::Deserialize', false, 'external', 'serde', NULL, NULL),
  (4, 8, 'std::fmt', false, 'external', 'std', NULL, NULL), (5, 9, 'super::super::gone', false, 'unresolved', NULL, NULL, NULL),
  (6, 23, 'Self::up', false, 'other', NULL, NULL, NULL), (7, 24, 'serde::load', false, 'external', 'serde', NULL, NULL),
  (8, 31, 'Own::new', false, 'internal', NULL, 'c{m}', 'Own'), (9, 45, 'crate::c{m}::make', true, 'internal', NULL, 'c{m}', 'make')"""
ORACLES = {
    "rust_items": _item_sql(
        """(0, 'struct', NULL, 'Own', 2, 'struct Own', 'Holds {k}.|More.', 11, 14, 17, 0, 'pub at: u8|kept: i32', 'Clone|Debug', false),
  (1, 'fn', 'Own', 'new', 2, 'fn new(at: u8) -> Self', 'Makes one.', 20, 21, 25, 0, '', '', false), (2, 'fn', 'Own', 'up', 1, 'pub(crate) fn up()', '', 26, 26, 26, 0, '', '', false),
  (3, 'fn', NULL, 'make', 2, 'fn make(n: u8)', '', 35, 35, 35, 1, '', '', false), (4, 'fn', NULL, 'secret', 2, 'fn secret()', '', 37, 38, 38, 2, '', '', true)""",
        ".rs",
    ),
    "rust_references": _reference_sql(_RUST_REFERENCES, ".rs"),
    "rust_calls": f"""WITH {_C} SELECT 'src/c' || k || '.rs' AS path, CAST(seq AS INTEGER) AS seq, {_put('callee')} AS callee, {_put('args')} AS args, CAST(line + CASE WHEN line > 34 THEN d ELSE 0 END AS INTEGER) AS line, in_test, {_put('caller')} AS caller
FROM {_rows("(0, 'make', '{k}', 22, false, 'Own.new'), (1, 'Self::up', '', 23, false, 'Own.new'), (2, 'serde::load', 'at', 24, false, 'Own.new'), (3, 'Own::new', '1', 31, false, 'Own.default'), (4, 'crate::c{m}::make', '1', 45, true, 'c{k}::works')", "seq, callee, args, line, in_test, caller")}""",
    "rust_users": f"""WITH {_C} SELECT p AS project_id, 'c' || min(m) AS target, symbol, count(*) AS files, lines
FROM {_rows("('Own', '5,31'), ('make', '6')", "symbol, lines")} GROUP BY p, symbol, lines""",
    "rust_check": f"WITH {_C} SELECT p AS project_id, count(*) AS module_docs, count(*) AS modules, 0::BIGINT AS syntax_errors, CAST(2 * count(*) + sum(d) AS BIGINT) AS documented, 4 * count(*) AS public_items, count(*) AS test_docs, count(*) AS tests FROM c GROUP BY p",
    "symbol_lookup": f"""WITH {_C} SELECT asked, what, p AS project_id, count(*) AS found, min('c' || k) AS first_module
FROM {_rows("('Own::new', 'item'), ('make', 'item'), ('c1', 'module'), ('c1::secret', 'item')", "asked, what")} WHERE asked NOT LIKE 'c1%' OR k = '1' GROUP BY p, asked, what""",
    "script_items": _item_sql(
        """(0, 'class', NULL, 'Own', 2, 'class Own implements Held<{ a: 1 }>', 'Holds {k}.', 11, 12, 20, 0, 'private kept', '', false),
  (1, 'fn', 'Own', 'make', 2, 'static make(at: number): Own', 'Makes one.', 14, 18, 18, 0, '', '', false), (2, 'fn', 'Own', '#hidden', 0, '#hidden()', '', 19, 19, 19, 0, '', '', false),
  (3, 'fn', NULL, 'make', 2, 'const make = (n: number): Own =>', '', 22, 22, 22, 1, '', '', false), (4, 'fn', NULL, 'inner', 2, 'function inner()', '', 23, 23, 23, 2, '', '', false),
  (5, 'type', NULL, 'Segment', 2, 'type Segment = ''{seg}''', '', 24, 24, 24, 2, '', '', false)""",
        ".ts",
    ),
    "script_references": _reference_sql(
        """(0, 5, 'c{m}::Own', false, 'internal', NULL, 'c{m}', 'Own'), (1, 5, 'c{m}::make', false, 'internal', NULL, 'c{m}', 'make'), (2, 6, 'fs', false, 'external', 'fs', NULL, NULL),
  (3, 7, '@kit/pack::deep', false, 'external', '@kit/pack', NULL, NULL), (4, 8, '@::c{m}::far', false, 'internal', NULL, 'c{m}', 'far')""",
        ".ts",
    ),
    "manifest_rows": """SELECT CAST(s_suppkey AS VARCHAR) AS project_id, CASE WHEN t THEN 't' ELSE 'j' END || s_suppkey AS name, CASE WHEN t THEN 'rust' ELSE 'typescript' END AS language,
  CASE WHEN t THEN 'bevy,dep_' || s_nationkey || ',libc' ELSE 'dep-' || s_nationkey || ',react' END AS externals, CASE WHEN t THEN 'src' ELSE '' END AS source_dir, t AS pack
FROM (SELECT *, s_suppkey % 2 = 0 OR s_suppkey % 5 = 0 AS t FROM supplier)""",
    "guard_judged": """WITH e AS (SELECT event_id, event_id % 97 AS n, event_id % 8 AS kind FROM events),
j AS (SELECT event_id, CASE WHEN kind = 0 AND s_suppkey * 4 > 100 THEN 'whole:Read' WHEN kind = 2 AND s_suppkey % 3 = 0 THEN 'search:Grep' WHEN kind = 4 AND s_suppkey * 4 > 100 THEN 'whole:cat'
  WHEN kind = 5 AND s_suppkey IS NOT NULL THEN 'range:sed' WHEN kind = 6 AND s_suppkey % 3 = 0 THEN 'search:grep' END AS why FROM e LEFT JOIN supplier ON s_suppkey = n AND s_suppkey < 97)
SELECT event_id, CASE WHEN why IS NULL THEN 'allow' ELSE 'block' END AS verdict, nullif(split_part(why, ':', 1), '') AS reason, nullif(split_part(why, ':', 2), '') AS how FROM j""",
    "session_usage": """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS session, event_id, ts, event_id % 6 AS kind FROM events),
s AS (SELECT strftime(arg_min(ts, event_id), '%Y-%m-%d') AS date, session, count(*) FILTER (kind = 3) AS tool, count(*) FILTER (kind = 1) AS ranged, count(*) FILTER (kind = 0) AS whole, count(*) FILTER (kind = 3) AS shell,
  count(*) FILTER (kind = 2) AS grep, count(*) FILTER (kind = 4) AS blocked FROM e GROUP BY session),
b AS (SELECT * FROM s UNION ALL SELECT 'total', NULL, CAST(coalesce(sum(tool), 0) AS BIGINT), CAST(coalesce(sum(ranged), 0) AS BIGINT), CAST(coalesce(sum(whole), 0) AS BIGINT), CAST(coalesce(sum(shell), 0) AS BIGINT), CAST(coalesce(sum(grep), 0) AS BIGINT), CAST(coalesce(sum(blocked), 0) AS BIGINT) FROM s)
SELECT *, CASE WHEN tool + ranged + whole + shell + grep > 0 THEN CAST(tool * 100 // (tool + ranged + whole + shell + grep) AS VARCHAR) ELSE '-' END AS share FROM b""",
}

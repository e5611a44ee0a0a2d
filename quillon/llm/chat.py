"""Chat formatting: calls and their results are linked, ordered, validated and written as canonical JSON. DataFrame operations only.

A call has an identifier and may follow earlier calls. Results are linked to calls by a hash join on conversation and identifier. The level of a call
is the longest path of calls before it: runs of calls that follow one call each are jumped by doubling pointers, so long chains take few rounds, and
only calls that wait for several are settled one after the other. Levels order calls before their results and both before what follows, without
sorting a conversation in one task. Arguments are checked against a schema for each tool. Canonical JSON has its keys in order and no white space,
in arguments too (their null members stay: they are what was said); members of a message that are null are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.runtime import materialize

#: By tool: argument -> type (string, integer, number or boolean), whether it is required, least and greatest length or value.
SCHEMAS = {"reply": {"text": ("string", True, 1, 2_000), "turn": ("integer", True, 0, None)}}
_DDL = {"string": "string", "integer": "bigint", "number": "double", "boolean": "boolean"}
_KINDS = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "DECIMAL"], "boolean": ["BOOLEAN"]}


def valid_arguments(name: Column, arguments: Column, schemas: dict = SCHEMAS) -> Column:
    """Whether arguments (JSON text) fit the schema of the tool: an object, no unknown members, required ones there, types and limits kept.

    Unknown tools and text that is not JSON are not valid; a null member counts as missing.
    """
    parsed = F.try_parse_json(F.coalesce(arguments, F.lit("null")))
    verdict = F.lit(False)
    for tool, fields in schemas.items():
        keys = F.json_object_keys(arguments)
        fits = F.coalesce(F.size(F.array_except(keys, F.array(*map(F.lit, fields)))) == 0, F.lit(False))
        for field, (kind, required, least, most) in fields.items():
            value = F.try_variant_get(parsed, f"$.{field}", _DDL[kind])
            exact = F.regexp_extract(F.schema_of_variant(F.try_variant_get(parsed, f"$.{field}", "variant")), "^[A-Z]+", 0).isin(_KINDS[kind])
            measure = F.length(value) if kind == "string" else value
            ok = exact & value.isNotNull()
            for limit, holds in ((least, lambda m, x: m >= x), (most, lambda m, x: m <= x)):
                if limit is not None and kind != "boolean":
                    ok = ok & holds(measure, F.lit(limit))
            fits = fits & F.coalesce(ok, F.lit(False)) if required else fits & F.coalesce(ok, value.isNull() & ~F.coalesce(exact, F.lit(False)))
        verdict = F.when(name == tool, fits).otherwise(verdict)
    return F.coalesce(verdict, F.lit(False))


def canonical(arguments: Column) -> Column:
    """JSON text with the keys of all its objects in order and no white space; text that is no JSON stays as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(arguments)), arguments)


def levels(calls: DataFrame, key: list[str]) -> DataFrame:
    """calls: key columns, call_id, after (an identifier or an array of them) -> distinct key, call_id, depth: calls on the longest path before it.

    Null in and behind a cycle. Unknown and null identifiers in `after` do not count. Several rows with one identifier are one call that follows what
    any of them follows.
    """
    after = F.col("after") if calls.schema["after"].dataType.typeName() == "array" else F.array("after")
    # structs with null members are equal to each other, null keys are not
    known = calls.where("call_id IS NOT NULL").select(F.struct(*key).alias("k"), "call_id", after.alias("after"))
    names = known.select("k", "call_id").distinct()
    edges = known.select("k", "call_id", F.explode("after").alias("p")).where("p IS NOT NULL").distinct()
    edges = edges.join(names.withColumnRenamed("call_id", "p"), ["k", "p"])
    edges = materialize(edges.select("k", "call_id", "p"), "edges")
    before = edges.groupBy("k", "call_id").agg(F.count("*").alias("n"), F.min("p").alias("p"))
    one = F.coalesce(F.col("n") == 1, F.lit(False))
    nodes = names.join(before, ["k", "call_id"], "left").withColumn("open", one)
    nodes = materialize(nodes.select("k", "call_id", F.when(F.col("open"), F.col("p")).otherwise(F.col("call_id")).alias("base"), F.col("open").cast("long").alias("dist"), "open", F.coalesce("n", F.lit(0)).alias("n")), "chains")
    total, step = nodes.count(), 1
    while step < total and not nodes.where("open").isEmpty():  # base: the call that is reached over calls that follow one each
        over = nodes.select("k", F.col("call_id").alias("base"), F.col("base").alias("next"), F.col("dist").alias("more"), F.col("open").alias("still"))
        nodes = materialize(nodes.join(over, ["k", "base"]).select("k", "call_id", F.col("next").alias("base"), (F.col("dist") + F.col("more")).alias("dist"), F.col("still").alias("open"), "n"), "chains")
        step *= 2
    settled = nodes.where("n = 0").select("k", F.col("call_id").alias("base"), F.lit(0).cast("long").alias("depth"))
    waiting = nodes.where("n > 1")
    if not waiting.isEmpty():
        bases = nodes.select("k", F.col("call_id").alias("p"), "base", "dist", "open")
        needs = materialize(edges.join(waiting.select("k", "call_id"), ["k", "call_id"], "left_semi").join(bases, ["k", "p"]).select("k", "call_id", "base", "dist", "open"), "needs")
        while True:
            judged = needs.join(settled, ["k", "base"], "left").groupBy("k", "call_id")
            ready = judged.agg(F.max(F.col("depth") + F.col("dist") + 1).alias("depth"), F.count_if(F.col("open") | F.col("depth").isNull()).alias("missing")).where("missing = 0")
            ready = materialize(ready.select("k", F.col("call_id").alias("base"), "depth"), "ready")
            if ready.isEmpty():
                break
            settled = materialize(settled.unionByName(ready), "settled")
            needs = materialize(needs.join(ready.select("k", F.col("base").alias("call_id")), ["k", "call_id"], "left_anti"), "needs")
    return nodes.where("NOT open").join(settled, ["k", "base"]).select("k", "call_id", (F.col("depth") + F.col("dist")).alias("depth")).join(names, ["k", "call_id"], "right").select("k.*", "call_id", "depth")


def linked(calls: DataFrame, results: DataFrame, key: list[str], schemas: dict = SCHEMAS) -> DataFrame:
    """calls: key, call_id, after, name, arguments (JSON text). results: key, call_id, content. Other columns stay and are null where the
    other side has none of that name; columns that are named like those of the result are not taken over. after: an identifier or an array of them.

    A row for each call and each result: key, kind, call_id, linked, valid, level, json. A call is linked if it has a result, a result if it has a
    call; orphans stay (a result without a call has no level). Keys may be null and are then compared as equal.
    """
    depth = materialize(levels(calls, key), "levels")

    def joined(rows: DataFrame, other: DataFrame, how: str = "left") -> DataFrame:
        names = [*key, "call_id"]
        other = other.withColumnsRenamed({n: f"__{n}" for n in names})
        on = [F.col(n).eqNullSafe(F.col(f"__{n}")) for n in names]
        return rows.join(other, on, how).drop(*(f"__{n}" for n in names))

    answered = results.where("call_id IS NOT NULL").select(*key, "call_id").distinct().withColumn("answered", F.lit(True))
    said = joined(joined(calls, depth), answered)
    call = F.to_json(F.struct(canonical(F.col("arguments")).alias("arguments"), F.col("call_id").alias("id"), F.col("name").alias("name"), F.lit("call").alias("type")))
    call_rows = said.select(*key, F.lit("call").alias("kind"), "call_id", F.coalesce("answered", F.lit(False)).alias("linked"), valid_arguments(F.col("name"), F.col("arguments"), schemas).alias("valid"), (F.col("depth") * 2 + 1).alias("level"), call.alias("json"), *_rest(calls, key))
    known = joined(results, depth.withColumn("known", F.lit(True)))
    result = F.to_json(F.struct(F.col("content").alias("content"), F.col("call_id").alias("id"), F.lit("result").alias("type")))
    result_rows = known.select(*key, F.lit("result").alias("kind"), "call_id", F.coalesce("known", F.lit(False)).alias("linked"), F.coalesce("known", F.lit(False)).alias("valid"), (F.col("depth") * 2 + 2).alias("level"), result.alias("json"), *_rest(results, key))
    return call_rows.unionByName(result_rows, allowMissingColumns=True)


def _rest(rows: DataFrame, key: list[str]) -> list[str]:
    return [c for c in rows.columns if c not in {*key, "call_id", "after", "name", "arguments", "content", "kind", "linked", "valid", "level", "json"}]


def formatted(messages: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as calls and results, ordered by conversation and level.

    A user's turn t is a call `conv:t` of the tool reply, which follows the call of turn t - 2; the assistant's turn after it is its result. Every
    other role is a message of level 0. A row for each row: conv_id, turn, kind, call_id, linked, valid, level, json. A null conversation or turn
    has no identifier and is linked with nothing; an assistant's turn without a call before it has no level. Null text is left out of the JSON,
    and fails the schema. Repeated rows are formatted each.
    """
    rows = messages.select("conv_id", "turn", "role", "text")

    def name(back: int) -> Column:
        return F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))

    def ident(back: int) -> Column:
        return F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), name(back))

    arguments = F.to_json(F.struct("text", "turn"))
    calls = rows.where("role = 'user'").select("conv_id", "turn", ident(0).alias("call_id"), ident(2).alias("after"), F.lit("reply").alias("name"), arguments.alias("arguments"))
    results = rows.where("role = 'assistant'").select("conv_id", "turn", ident(1).alias("call_id"), F.col("text").alias("content"))
    others = rows.where("role IS NULL OR role NOT IN ('user', 'assistant')")
    message = F.to_json(F.struct(F.col("text").alias("content"), F.col("role").alias("role"), F.lit("message").alias("type")))
    rest = others.select("conv_id", "turn", F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit(False).alias("linked"), F.lit(True).alias("valid"), F.lit(0).cast("long").alias("level"), message.alias("json"))
    out = linked(calls, results, ["conv_id"]).unionByName(rest)
    return out.select("conv_id", "turn", "kind", "call_id", "linked", "valid", "level", "json").orderBy("conv_id", F.col("level").asc_nulls_last(), "turn")


def op3_chat(spark: SparkSession, sf: str) -> DataFrame:
    return formatted(spark.read.parquet(f"{sf}/conversations.parquet"))


ORACLE = """
WITH RECURSIVE c AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'user'),
r AS (SELECT conv_id, turn, 0 AS depth FROM c WHERE NOT EXISTS (SELECT 1 FROM c p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 2)
  UNION ALL SELECT c.conv_id, c.turn, r.depth + 1 FROM c JOIN r ON c.conv_id = r.conv_id AND c.turn = r.turn + 2),
a AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'assistant')
SELECT m.conv_id, m.turn, 'call' AS kind, m.conv_id || ':' || m.turn AS call_id, a.turn IS NOT NULL AS linked, length(m.text) BETWEEN 1 AND 2000 AND m.turn >= 0 AS valid,
  CAST(2 * r.depth + 1 AS BIGINT) AS level,
  CAST(to_json({'arguments': CAST(to_json({'text': m.text, 'turn': m.turn}) AS VARCHAR), 'id': m.conv_id || ':' || m.turn, 'name': 'reply', 'type': 'call'}) AS VARCHAR) AS json
FROM conversations m JOIN r ON r.conv_id = m.conv_id AND r.turn = m.turn LEFT JOIN a ON a.conv_id = m.conv_id AND a.turn = m.turn + 1 WHERE m.role = 'user'
UNION ALL
SELECT m.conv_id, m.turn, 'result', m.conv_id || ':' || (m.turn - 1), r.turn IS NOT NULL, r.turn IS NOT NULL, CAST(2 * r.depth + 2 AS BIGINT),
  CAST(to_json({'content': m.text, 'id': m.conv_id || ':' || (m.turn - 1), 'type': 'result'}) AS VARCHAR)
FROM conversations m LEFT JOIN r ON r.conv_id = m.conv_id AND r.turn = m.turn - 1 WHERE m.role = 'assistant'
UNION ALL
SELECT conv_id, turn, 'message', NULL, false, true, 0, CAST(to_json({'content': text, 'role': role, 'type': 'message'}) AS VARCHAR)
FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant')"""

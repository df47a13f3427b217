"""Tool calls in chats: linked with their results by identifier, put in topological order, checked against schemas, and written as canonical JSON.

DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

#: How try_variant_get reads a schema's types.
TYPES = {"string": "string", "integer": "bigint", "number": "double", "boolean": "boolean", "object": "map<string,variant>", "array": "array<variant>"}


def canonical(value: Column) -> Column:
    """JSON text with sorted keys and without white space; null where value is no JSON."""
    return F.to_json(F.try_parse_json(value))


def argument_errors(name: Column, arguments: Column, schemas: dict[str, dict]) -> Column:
    """What is wrong with a call's arguments, as an array of strings, empty if nothing is.

    schemas: for each tool its JSON schema's properties (name: type) and required names. A tool without a
    schema, arguments that are no JSON object, missing and surplus arguments and wrong types are errors.
    """
    parsed = F.try_parse_json(arguments)
    kind = F.schema_of_variant(parsed)
    out = F.array(F.lit("unknown tool"))
    for tool, schema in sorted(schemas.items()):
        props, needed = schema.get("properties", {}), set(schema.get("required", ()))
        checks = []
        for prop, p in sorted(props.items()):
            path = "$[" + json.dumps(prop, ensure_ascii=False).replace('"', "'") + "]"
            found = F.try_variant_get(parsed, path, "variant")
            fits = F.try_variant_get(parsed, path, TYPES[p["type"]]).isNotNull()
            shape = F.schema_of_variant(found)
            exact = {"string": shape == "STRING", "boolean": shape == "BOOLEAN", "integer": shape == "BIGINT", "number": shape.rlike("^(BIGINT|DOUBLE|DECIMAL)"), "object": shape.startswith("OBJECT"), "array": shape.startswith("ARRAY")}[p["type"]]
            checks.append(F.when(found.isNull(), F.lit(f"missing {prop}") if prop in needed else None).when(~(fits & exact), F.lit(f"wrong type of {prop}")))
        keys = F.json_object_keys(arguments)
        surplus = F.transform(F.array_sort(F.array_except(keys, F.array(*map(F.lit, sorted(props))) if props else F.array().cast("array<string>"))), lambda k: F.concat(F.lit("surplus "), k))
        wrong = F.concat(F.filter(F.array(*checks) if checks else F.array().cast("array<string>"), lambda e: e.isNotNull()), surplus)
        out = F.when(name == tool, F.when(parsed.isNull() | ~kind.startswith("OBJECT"), F.array(F.lit("no object"))).otherwise(wrong)).otherwise(out)
    return F.when(name.isNull(), F.array(F.lit("unknown tool"))).otherwise(out)


def levels(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """(call_id, level): topological places. calls: call_id, turn; needs: call_id, on (an id that the call's arguments use).

    Where every need points to an earlier turn, the turn is the place already. Calls with a need that doesn't are moved behind
    what they need, round by round; calls in a circle, and what waits for them, get a null level. Needs of unknown ids are ignored.
    """
    at = calls.select("call_id", F.col("turn").cast("long").alias("level"))
    known = needs.join(at.select(F.col("call_id").alias("on"), F.col("level").alias("on_level")), "on").join(at, "call_id")
    edges = known.select("call_id", "on").distinct()
    if known.where("on_level >= level").isEmpty():
        return at
    edges = cut(edges)
    # Longest ways: a call's level is above those of all that it needs. A circle never settles, so what has
    # more rounds than there are calls in the largest chain is found by peeling first.
    waiting, done = edges, None
    while True:
        ready = waiting.select(F.col("on").alias("c")).distinct().join(waiting.select(F.col("call_id").alias("c")).distinct(), "c", "left_anti")
        left = cut(waiting.join(ready, waiting["on"] == ready["c"], "left_anti"))
        if left.count() == waiting.count():
            break
        waiting = left
    circle = waiting.select("call_id").distinct() if not waiting.isEmpty() else None
    if circle is not None:
        circle = cut(circle.withColumn("bad", F.lit(True)))
        edges = cut(edges.join(circle, "call_id", "left_anti"))
    done = cut(at)
    while True:
        up = edges.join(done.select(F.col("call_id").alias("on"), F.col("level").alias("l")), "on").groupBy("call_id").agg((F.max("l") + 1).alias("least"))
        new = cut(done.join(up, "call_id", "left").select("call_id", F.greatest("level", F.coalesce("least", "level")).alias("level"), (F.coalesce("least", "level") > F.col("level")).alias("moved")))
        moved = not new.where("moved").isEmpty()
        done = new.drop("moved")
        if not moved:
            break
    return done.join(circle, "call_id", "left").select("call_id", F.when(F.col("bad"), None).otherwise(F.col("level")).alias("level")) if circle is not None else done


def link_tool_calls(calls: DataFrame, results: DataFrame, needs: DataFrame | None, schemas: dict[str, dict]) -> DataFrame:
    """A row for each call: conv_id, call_id, level, status, errors, json.

    calls: conv_id, call_id, turn, name, arguments (JSON). results: call_id, turn, content. Ids are hash-joined.
    Repeated ids are brought together before the join, so a much repeated one makes no pairs: of calls the first by turn, name and
    arguments counts, of results the first by turn and content. status: `linked`, `unanswered`, or `early` (the result stands before the
    call). A result whose call is missing gives a row with status `orphan`. Null ids link with nothing: such calls are
    unanswered, such results orphans, each kind as one row. errors joins what argument_errors says by "; ".
    json is canonical: sorted keys, no white space, arguments in canonical form or, if they are no JSON, as a string.
    """
    first = calls.groupBy("call_id").agg(F.min(F.struct("turn", "name", "arguments", "conv_id")).alias("c"), F.count(F.lit(1)).alias("n_calls"))
    first = first.select("call_id", "c.*", "n_calls")
    answer = results.groupBy("call_id").agg(F.min(F.struct("turn", "content")).alias("r"), F.count(F.lit(1)).alias("n_results"))
    answer = answer.select(F.col("call_id").alias("r_id"), F.col("r.turn").alias("r_turn"), F.col("r.content").alias("content"), "n_results")
    both = first.withColumn("has_call", F.lit(True)).join(answer, F.col("call_id") == F.col("r_id"), "full_outer")
    if needs is not None:
        both = both.join(levels(first, needs), "call_id", "left")
    else:
        both = both.withColumn("level", F.col("turn").cast("long"))
    status = F.when(F.col("has_call").isNull(), "orphan").when(F.col("n_results").isNull(), "unanswered").when(F.col("r_turn") < F.col("turn"), "early").otherwise("linked")
    errors = F.when(F.col("has_call").isNotNull(), F.concat_ws("; ", argument_errors(F.col("name"), F.col("arguments"), schemas))).otherwise(F.lit(""))
    text = lambda c: F.to_json(F.to_variant_object(F.array(F.coalesce(F.col(c), F.lit("")))))
    quoted = lambda c: F.substring(text(c), F.lit(2), F.length(text(c)) - 2)
    body = F.concat(
        F.lit('{"arguments":'), F.coalesce(canonical(F.col("arguments")), quoted("arguments")), F.lit(',"id":'), quoted("id"), F.lit(',"name":'), quoted("name"),
        F.lit(',"result":'), F.when(F.col("n_results").isNull(), F.lit("null")).otherwise(quoted("content")), F.lit(',"status":"'), status, F.lit('"}'),
    )
    both = both.withColumn("id", F.coalesce("call_id", "r_id"))
    return both.select("conv_id", F.col("id").alias("call_id"), "level", status.alias("status"), errors.alias("errors"), F.coalesce("n_calls", F.lit(0)).cast("long").alias("n_calls"), F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), body.alias("json"))


TURN = {"properties": {"prompt": {"type": "string"}, "turn": {"type": "integer"}}, "required": ["prompt", "turn"]}
TOOLS = {"reply": TURN, "system": TURN}


def op1_tool_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn takes part. A user message is a call of the tool `reply`, an assistant message the result of the call one turn before,
    and any other message a call of a tool named as its role: `system` is known, other roles and a null one are unknown tools.

    A user message needs the one two turns before; at turn 1, the system message at turn 0, if there is one. A null text is a missing prompt or an empty result.
    Turns without conv_id or number have a null id and link with nothing.
    """
    chat = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    at = lambda d: F.concat(F.col("conv_id").cast("string"), F.lit("-"), (F.col("turn") - d).cast("string"))
    user, result = F.col("role") == "user", F.col("role").eqNullSafe("assistant")
    arguments = F.to_json(F.struct(F.col("turn"), F.col("text").alias("prompt")))
    calls = chat.where(~result).select("conv_id", at(0).alias("call_id"), "turn", F.when(user, "reply").otherwise(F.col("role")).alias("name"), arguments.alias("arguments"))
    results = chat.where(result).select(at(1).alias("call_id"), "turn", F.col("text").alias("content"))
    needs = chat.where(user & (F.col("turn") >= 1)).select(at(0).alias("call_id"), F.when(F.col("turn") == 1, at(1)).otherwise(at(2)).alias("on"))
    return link_tool_calls(calls, results, needs, TOOLS)


OP1_SQL = """
with c as (
  select conv_id || '-' || turn as call_id, min(conv_id) as conv_id, min(turn) as turn, count(*) as n_calls, min(text) as prompt,
    min(case when role = 'user' then 'reply' else role end) as name
  from conversations where role is distinct from 'assistant' group by all),
r as (
  select conv_id || '-' || (turn - 1) as r_id, min({'t': turn, 'x': text}) as first, count(*) as n_results
  from conversations where role = 'assistant' group by all),
f as (
  select call_id, min(conv_id) as conv_id, min(turn) as turn, sum(n_calls) as n_calls, min(prompt) as prompt, min(name) as name from c group by call_id),
j as (select * from f full join r on call_id = r_id),
s as (
  select *, case when call_id is null then 'orphan' when r_id is null then 'unanswered' else 'linked' end as status from j)
select conv_id, coalesce(call_id, r_id) as call_id, turn as level, status,
  case when call_id is null then '' when name is null or name not in ('reply', 'system') then 'unknown tool' when prompt is null then 'missing prompt' else '' end as errors,
  cast(coalesce(n_calls, 0) as bigint) as n_calls, cast(coalesce(n_results, 0) as bigint) as n_results,
  '{"arguments":' || case when call_id is null then '""' else '{' || case when prompt is null then '' else '"prompt":' || to_json(prompt) || ',' end || '"turn":' || turn || '}' end ||
  ',"id":"' || coalesce(call_id, r_id) || '","name":' || to_json(coalesce(name, '')) || ',"result":' ||
  case when r_id is null then 'null' else to_json(coalesce(first.x, '')) end || ',"status":"' || status || '"}' as json
from s
"""

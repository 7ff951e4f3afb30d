"""Operator 9: chat formatting with tool-call linking, in DataFrame and SQL functions only.

Messages are rows (conversation, turn, role, text).  An assistant's text that is a
JSON object with a list ``tool_calls`` makes calls, given as (id, name, arguments) or
as (id, function: (name, arguments)); a text of role ``tool`` that is a JSON object
with ``tool_call_id`` is a result.  Arguments may name earlier results as
``{"$ref": "<call id>"}``.  Of such an object ``content`` becomes the content, and
members of other names are kept as ``extra``; every other text is plain content, also
if it looks like JSON or code.

* Calls and results are hash-joined by conversation and identifier.  A repeated
  call id belongs to its first call; further results of a call are ``extra``.
* Messages are put in topological order: a result follows its call, and a call
  follows the results it refers to.  ``order_turn`` is the latest turn among a
  message and all it depends on, ``order_level`` its depth; sorting by
  (conv_id, order_turn, order_level, turn) keeps the given order wherever it
  allows.  Chains of messages with one predecessor are resolved by pointer
  doubling, so rounds grow with the logarithm of a chain and with the depth of
  messages that wait for several; messages on or behind a cycle keep their turn and
  get level -1.  No conversation is ever gathered, however long.
* Arguments are checked against tool schemas (name, parameter, type, required).
* Each message is written as canonical JSON: keys in alphabetical order, no
  spaces, null fields left out.

Cases: null text gives a message without content; a null conversation id links
with nothing; null turns sort first and stay null; text that is no JSON object
is plain content; repeated rows are one message of the graph and each is
returned; clashing extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, maybe_broadcast

CALLS = "array<struct<id:string,name:string,arguments:string,function:struct<name:string,arguments:string>>>"
#: Rows of a schema table that are broadcast after they were counted.
BROADCAST_SCHEMAS = 100_000
#: Production tool schemas: name, parameter, type, required.
TOOL_SCHEMAS = (
    ("search", "query", "string", True),
    ("search", "limit", "integer", False),
    ("calculator", "expression", "string", True),
    ("weather", "city", "string", True),
    ("weather", "days", "integer", False),
    ("weather", "metric", "boolean", False),
    ("fetch", "url", "string", True),
    ("fetch", "headers", "object", False),
    ("fetch", "ranges", "array", False),
    ("fetch", "timeout", "number", False),
)
#: SQL test of a variant's type name for each schema type.
TYPE_TESTS = {
    "string": "kind = 'STRING'",
    "integer": "kind = 'BIGINT'",
    "number": "kind rlike '^(BIGINT|DOUBLE|DECIMAL)'",
    "boolean": "kind = 'BOOLEAN'",
    "object": "kind rlike '^OBJECT'",
    "array": "kind rlike '^ARRAY'",
    "null": "kind = 'VOID'",
}


def schema_table(spark: SparkSession, schemas=TOOL_SCHEMAS) -> DataFrame:
    return spark.createDataFrame(list(schemas), "name string, parameter string, type string, required boolean")


def parsed(messages: DataFrame) -> DataFrame:
    """Adds node (128-bit identity of a message), calls, result_of, content and extra; all from the message alone."""
    opened = "text rlike '^\\\\s*\\\\{' and try_parse_json(text) is not null"
    flat = "transform(raw, c -> named_struct('id', c.id, 'name', coalesce(c.name, c.function.name), 'arguments', coalesce(c.arguments, c.function.arguments)))"
    return (
        messages.select(
            "conv_id", "turn", "role", "text",
            F.expr("md5(concat_ws('|', coalesce(cast(conv_id as string), 'null'), coalesce(cast(turn as string), 'null'), if(role is null, 'null', concat(length(role), ':', role)), if(text is null, 'null', concat(':', text))))").alias("node"),
            F.expr(f"if(role = 'assistant' and {opened}, from_json(get_json_object(text, '$.tool_calls'), '{CALLS}'), null)").alias("raw"),
            F.expr(f"if(role = 'tool' and {opened}, get_json_object(text, '$.tool_call_id'), null)").alias("result_of"),
        )
        .withColumn("calls", F.expr(flat))
        .withColumn("members", F.expr("if(calls is not null or result_of is not null, from_json(text, 'map<string,variant>'), null)"))
        .select(
            "conv_id", "turn", "role", "text", "node", "calls", "result_of",
            F.expr("if(calls is not null or result_of is not null, get_json_object(text, '$.content'), text)").alias("content"),
            F.expr("map_filter(members, (k, v) -> k not in ('content', 'role', if(calls is null, 'tool_call_id', 'tool_calls')))").alias("extra"),
        )
    )


def topological(nodes: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, order_turn, order_level) for nodes that stand in edges (before, after).

    ``order_level`` is the longest way to a node, ``order_turn`` the latest turn on any
    way to it.  A way is (before, after, step, via): level and latest turn that it adds;
    before is null where it starts at a node without predecessors.  In each turn the
    nodes with one way in jump to where that way comes from, by pointer doubling, and
    the ways that start at them are drawn from there, so that parallel ones fall together.
    """
    edges = scratch.keep(edges.distinct(), "edges")
    known = edges.select(F.col("before").alias("node")).unionByName(edges.select(F.col("after").alias("node"))).distinct()
    turns = scratch.keep(known.join(nodes, "node").groupBy("node").agg(F.max("turn").alias("turn")), "turns")
    roots = scratch.keep(turns.join(edges.select(F.col("after").alias("node")), "node", "left_anti"), "roots")
    starts = roots.select(F.col("node").alias("before"), F.col("turn").alias("via"), F.lit(True).alias("root"))
    ways = edges.join(starts, "before", "left").select(F.when(F.col("root").isNull(), F.col("before")).alias("before"), "after", F.lit(1).alias("step"), "via")
    hung = []
    while True:
        turn = len(hung)
        ways = scratch.keep(ways.groupBy("before", "after").agg(F.max("step").alias("step"), F.max("via").alias("via")), f"ways-{turn}")
        counts = ways.groupBy("after").agg(F.count("*").alias("n"))
        own = turns.withColumnRenamed("node", "after")
        single = ways.join(counts.where("n = 1"), "after").join(own, "after").select(F.col("after").alias("node"), "before", "step", F.greatest("via", "turn").alias("via"))
        single = scratch.keep(single, f"single-{turn}")
        size = single.count()
        if not size:  # nothing is left, or all that is left lies on or behind a ring
            break
        inside = single.select(F.col("node").alias("before"))
        for jump in range(size.bit_length() + 1):
            if single.join(inside, "before", "left_semi").isEmpty():
                break
            hop = single.select(F.col("node").alias("before"), F.col("before").alias("to"), F.col("step").alias("more"), F.col("via").alias("on"), F.lit(True).alias("moves"))
            single = single.join(hop, "before", "left").select(
                "node", F.when(F.col("moves"), F.col("to")).otherwise(F.col("before")).alias("before"), (F.col("step") + F.coalesce("more", F.lit(0))).alias("step"), F.greatest("via", "on").alias("via")
            )
            single = scratch.keep(single, f"single-{turn}-{jump}")
        hung.append(single.join(inside, "before", "left_anti"))  # what still points inside runs in a ring
        jumps = hung[-1].select(F.col("node").alias("before"), F.col("before").alias("to"), F.col("step").alias("more"), F.col("via").alias("on"), F.lit(True).alias("moves"))
        rest = ways.join(counts.where("n > 1").select("after"), "after", "left_semi").join(jumps, "before", "left")
        ways = rest.select(
            F.when(F.col("moves"), F.col("to")).otherwise(F.col("before")).alias("before"), "after", (F.col("step") + F.coalesce("more", F.lit(0))).alias("step"), F.greatest("via", "on").alias("via")
        )
    solved = roots.select("node", F.col("turn").alias("order_turn"), F.lit(0).alias("order_level"))
    for turn, part in reversed(list(enumerate(hung))):
        at = solved.select(F.col("node").alias("before"), F.col("order_turn").alias("late"), "order_level")
        ends = part.join(at, "before", "left").where("before is null or order_level is not null")
        ends = ends.select("node", F.greatest("via", "late").alias("order_turn"), (F.col("step") + F.coalesce("order_level", F.lit(0))).alias("order_level"))
        solved = solved.unionByName(scratch.keep(ends, f"ends-{turn}"))
    rings = turns.join(solved, "node", "left_anti").select("node", F.col("turn").alias("order_turn"), F.lit(-1).alias("order_level"))
    return solved.unionByName(rings)


def argument_errors(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """(node, pos, errors): sorted faults of each call against the schemas; none for valid calls."""
    schemas = schemas.where("name is not null and parameter is not null")
    few = maybe_broadcast(schemas, BROADCAST_SCHEMAS) is not schemas
    held = F.broadcast if few else (lambda table: table)
    tools = schemas.select("name").distinct()
    base = calls.select("node", "pos", "name", "arguments")
    unknown = base.join(held(tools), "name", "left_anti").select("node", "pos", F.concat(F.lit("unknown tool "), F.coalesce("name", F.lit("null"))).alias("error"))
    named = base.join(held(tools), "name", "left_semi").withColumn("v", F.expr("try_parse_json(arguments)"))
    broken = named.where("v is null or not schema_of_variant(v) rlike '^OBJECT'").select("node", "pos", F.lit("arguments are no object").alias("error"))
    whole = named.where("v is not null and schema_of_variant(v) rlike '^OBJECT'")
    given = whole.select("node", "pos", "name", F.explode(F.expr("from_json(arguments, 'map<string,variant>')")).alias("parameter", "value")).select(
        "node", "pos", "name", "parameter", F.expr("schema_of_variant(value)").alias("kind")
    )
    matched = given.join(held(schemas), ["name", "parameter"], "left")
    tests = " ".join(f"when type = '{t}' then {sql}" for t, sql in TYPE_TESTS.items())
    wrong = matched.where(f"type is null or not (case {tests} else true end)").select(
        "node", "pos", F.expr("if(type is null, concat('unexpected ', parameter), concat(parameter, ' is no ', type))").alias("error")
    )
    needed = whole.select("node", "pos", "name").join(held(schemas.where("required")), "name")
    missing = needed.join(given, ["node", "pos", "name", "parameter"], "left_anti").select("node", "pos", F.concat(F.lit("missing "), "parameter").alias("error"))
    every = unknown.unionByName(broken).unionByName(wrong).unionByName(missing)
    return every.groupBy("node", "pos").agg(F.sort_array(F.collect_set("error")).alias("errors"))


def format_chats(
    messages: DataFrame, schemas: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per message: conv_id, turn, role, order_turn, order_level, n_calls, n_answered, result_of, link, errors, json."""
    spark = messages.sparkSession
    scratch = Scratch(spark, "chat")
    schemas = schema_table(spark) if schemas is None else schemas
    rows = parsed(messages.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"),
    ))
    calls = scratch.keep(
        rows.where("calls is not null").select("node", "conv_id", "turn", F.posexplode("calls").alias("pos", "c")).select("node", "conv_id", "turn", "pos", "c.*").distinct(),
        "calls",
    )
    results = scratch.keep(rows.where("result_of is not null").select("node", "conv_id", "turn", "result_of").distinct(), "results")
    first_call = calls.where("id is not null").groupBy("conv_id", "id").agg(F.min(F.struct("turn", "pos", "node")).alias("c"))
    first_result = results.groupBy("conv_id", F.col("result_of").alias("id")).agg(F.min(F.struct("turn", "node")).alias("r"))
    linked = scratch.keep(
        first_call.join(first_result, ["conv_id", "id"], "left").select("conv_id", "id", F.col("c.node").alias("call_node"), F.col("c.pos").alias("pos"), F.col("r.node").alias("result_node")), "linked"
    )
    answers = results.join(linked.select("conv_id", F.col("id").alias("result_of"), "call_node"), ["conv_id", "result_of"])
    refs = calls.select("node", "conv_id", F.explode(F.expr("regexp_extract_all(arguments, '\"\\\\$ref\"\\\\s*:\\\\s*\"([^\"]+)\"', 1)")).alias("id"))
    edges = answers.select(F.col("call_node").alias("before"), F.col("node").alias("after")).unionByName(
        refs.join(linked, ["conv_id", "id"]).select(F.coalesce("result_node", "call_node").alias("before"), F.col("node").alias("after"))
    ).where("before is not null")
    nodes = calls.select("node", "turn").unionByName(results.select("node", "turn")).distinct()
    order = topological(nodes, edges, scratch)
    errors = argument_errors(calls, schemas)
    by_call = calls.join(linked.select(F.col("call_node").alias("node"), "pos", "result_node"), ["node", "pos"], "left").join(errors, ["node", "pos"], "left")
    by_node = by_call.groupBy("node").agg(
        F.count("*").alias("n_calls"), F.count("result_node").alias("n_answered"),
        F.array_join(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("errors", F.array().cast("array<string>")).alias("errors")))), lambda c: F.transform(c["errors"], lambda e: F.concat_ws(": ", c["pos"].cast("string"), e)))), "; ").alias("errors"),
    )
    links = results.join(linked.withColumnRenamed("id", "result_of"), ["conv_id", "result_of"], "left").select(
        "node", F.expr("case when call_node is null then 'orphan' when result_node = node then 'linked' else 'extra' end").alias("link")
    )
    written = F.expr(
        "to_json(named_struct('content', content, 'extra', if(size(extra) > 0, to_variant_object(extra), null), 'role', role, 'tool_call_id', result_of, 'tool_calls', "
        "transform(calls, c -> named_struct('arguments', coalesce(try_parse_json(c.arguments), to_variant_object(named_struct('raw', c.arguments))), 'id', c.id, 'name', c.name)), 'turn', turn))"
    )
    return (
        rows.join(order, "node", "left").join(by_node, "node", "left").join(links, "node", "left")
        .select(
            "conv_id", "turn", "role",
            F.when(F.col("order_level").isNull(), F.col("turn")).otherwise(F.col("order_turn")).alias("order_turn"),
            F.coalesce("order_level", F.lit(0)).alias("order_level"),
            F.coalesce("n_calls", F.lit(0)).cast("long").alias("n_calls"), F.coalesce("n_answered", F.lit(0)).cast("long").alias("n_answered"),
            "result_of", "link", F.coalesce("errors", F.lit("")).alias("errors"), written.alias("json"),
        )
    )

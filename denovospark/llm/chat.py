"""Operator 9: chat formatting with linked tool calls, in DataFrame operations alone.

Messages become canonical JSON, one row each, in an order in which every call follows the calls it builds on, and every result
follows its call. Calls and results meet in a hash join by conversation and identifier. A call's depth is found level by level:
calls without dependencies first, then those whose dependencies are all placed; what is never placed is on a cycle, and says
so. Arguments are checked against the schema of the tool that they name. The order is a key of columns and nothing is
gathered by conversation, so a conversation may hold any share of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

CALLS = "conv_id bigint, turn bigint, call_id string, name string, arguments map<string,string>, depends_on array<string>"
RESULTS = "conv_id bigint, turn bigint, call_id string, content string"
TOOLS = "name string, parameter string, kind string, required boolean"


def json_string(text: Column) -> Column:
    """A JSON string literal: the shortest escapes, nothing but quotes, backslashes and control characters escaped."""
    out = F.regexp_replace(text, r'(["\\])', r"\\$1")
    for raw, said in (("\n", "n"), ("\r", "r"), ("\t", "t"), ("\b", "b"), ("\f", "f")):
        out = F.replace(out, F.lit(raw), F.lit(f"\\{said}"))
    rest = F.aggregate(
        F.sequence(F.lit(0), F.lit(31)), out, lambda s, c: F.when(F.instr(s, F.char(c)) > 0, F.replace(s, F.char(c), F.concat(F.lit("\\u00"), F.lpad(F.lower(F.hex(c)), 2, "0")))).otherwise(s)
    )
    return F.concat(F.lit('"'), F.when(out.rlike(r"[\x00-\x1f]"), rest).otherwise(out), F.lit('"'))


def _object(pairs: list[tuple[str, Column]]) -> Column:
    """Keys in order; a null value leaves its key out."""
    said = [F.when(v.isNotNull(), F.concat(F.lit(f'"{k}":'), v)) for k, v in sorted(pairs, key=lambda p: p[0])]
    return F.concat(F.lit("{"), F.concat_ws(",", *said), F.lit("}"))


def json_map(values: Column, quoted: Column) -> Column:
    """A map of strings as an object with sorted keys; the values of the keys in ``quoted`` are strings, others literals."""
    keys = F.array_sort(F.map_keys(values))
    said = F.transform(keys, lambda k: F.concat(json_string(k), F.lit(":"), F.when(F.coalesce(F.array_contains(quoted, k), F.lit(True)), json_string(F.element_at(values, k))).otherwise(F.element_at(values, k))))
    return F.concat(F.lit("{"), F.array_join(said, ","), F.lit("}"))


def of_kind(value: Column, kind: Column) -> Column:
    """Whether a value's text is of the schema's kind."""
    return (
        F.when(kind == "integer", value.rlike(r"^-?(0|[1-9]\d*)$")).when(kind == "number", value.rlike(r"^-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?$"))
        .when(kind == "boolean", value.isin("true", "false")).otherwise(value.isNotNull())
    )


def check_arguments(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """``calls`` (with a row key ``call``) and their problem: unknown tool, missing, unexpected or ill-typed argument; null if none. Also which arguments are strings."""
    known = tools.groupBy("name").agg(F.collect_set(F.struct("parameter", "kind", "required")).alias("parameters"))  # a tool's parameters
    joined = calls.join(known, "name", "left")
    names = F.transform(F.filter("parameters", lambda p: p["parameter"].isNotNull()), lambda p: p["parameter"])
    given = F.coalesce(F.map_keys("arguments"), F.array().cast("array<string>"))
    missing = F.exists("parameters", lambda p: F.coalesce(p["required"], F.lit(False)) & ~F.array_contains(given, p["parameter"]))
    ill = F.exists("parameters", lambda p: F.array_contains(given, p["parameter"]) & ~F.coalesce(of_kind(F.element_at("arguments", p["parameter"]), p["kind"]), F.lit(False)))
    problem = (
        F.when(F.col("parameters").isNull(), "unknown tool").when(missing, "missing argument")
        .when(F.size(F.array_except(given, names)) > 0, "unexpected argument").when(ill, "ill-typed argument")
    )
    literal = F.filter("parameters", lambda p: p["kind"].isin("integer", "number", "boolean"))
    quoted = F.when(problem.isNull(), F.array_except(given, F.transform(literal, lambda p: p["parameter"]))).otherwise(given)
    return joined.withColumn("problem", problem).withColumn("quoted", quoted).drop("parameters")


def depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth): 0 without dependencies in the conversation, else one more than the deepest. No row for calls on or behind a cycle.

    A round settles the edges to calls that were placed before, places the calls without open edges, and then lets all edges to a call with a single open
    edge jump over it, adding up lengths. So chains halve in every round, and a graph takes about as many rounds as the logarithm of its chains, plus
    the levels at which calls with several needs wait for each other. ``least`` is what a call's settled edges demand; a round that places nothing leaves cycles.
    """
    key = ["conv_id", "call_id"]
    ids = calls.select(*key).distinct()
    edges = calls.select(*key, F.explode("depends_on").alias("needs")).distinct()
    edges = edges.join(ids.withColumnRenamed("call_id", "needs"), ["conv_id", "needs"], "left_semi")
    edges = materialize(edges.withColumn("length", F.lit(1)), "chat-edges")
    held = edges.select(*key).distinct()
    done = [ids.join(held, key, "left_anti").withColumn("depth", F.lit(0))]
    if edges.isEmpty():
        return done[0]
    done[0] = ready = materialize(done[0], "chat-ready")
    waiting = held.withColumn("least", F.lit(0))
    while True:
        met = edges.join(ready.select("conv_id", F.col("call_id").alias("needs"), "depth"), ["conv_id", "needs"], "left")
        by_call = met.groupBy(*key).agg(
            F.max(F.col("depth") + F.col("length")).alias("found"), F.count(F.when(F.col("depth").isNull(), 1)).alias("open"),
            F.min(F.when(F.col("depth").isNull(), F.struct("needs", "length"))).alias("only"),
        )
        state = waiting.join(by_call, key, "left").select(*key, F.greatest("least", F.coalesce("found", F.lit(0))).alias("least"), F.coalesce("open", F.lit(0)).alias("open"), "only")
        state = materialize(state, "chat-state")
        ready = state.filter("open = 0").select(*key, F.col("least").alias("depth"))
        if ready.isEmpty():
            break
        done.append(ready)
        waiting = state.filter("open > 0").select(*key, "least")
        # an edge to a call with one open edge goes on to what that needs, and demands what that call demands of itself
        single = state.filter("open = 1").select("conv_id", F.col("call_id").alias("needs"), F.col("least").alias("over"), F.col("only.needs").alias("beyond"), F.col("only.length").alias("more"))
        still = met.filter("depth is null").select(*key, "needs", "length").join(single, ["conv_id", "needs"], "left")
        jumped = still.groupBy(*key, F.coalesce("beyond", "needs").alias("needs")).agg(F.max(F.col("length") + F.coalesce("more", F.lit(0))).alias("length"), F.max(F.col("over") + F.col("length")).alias("over"))
        jumped = materialize(jumped, "chat-edges")
        demands = jumped.groupBy(*key).agg(F.max("over").alias("over"))
        waiting = waiting.join(demands, key, "left").select(*key, F.greatest("least", F.coalesce("over", F.lit(0))).alias("least"))
        edges = jumped.select(*key, "needs", "length")
        if len(done) % 16 == 0:
            waiting = materialize(waiting, "chat-waiting")
    placed = done[0]
    for more in done[1:]:
        placed = placed.unionByName(more)
    return materialize(placed, "chat-depths")


def link_calls(calls: DataFrame, results: DataFrame, tools: DataFrame) -> DataFrame:
    """A row for every call and every result: (conv_id, depth, step, part, turn, call_id, status, json).

    Sort by conv_id, depth, step, part, turn for the order: step is the call's turn, part 0 the call and 1 its results. status
    of a call is ok, or its problem, or "no result", or "cycle"; of a result ok, or "orphan" without a call, whose step is its
    own turn. Null identifiers link with nothing; repeated calls of one identifier count as the first by turn and, within a turn, by name and arguments, and the others say "repeated";
    null arguments are an empty object. Empty tables give an empty result. Extra columns are not read.
    """
    calls = calls.select("conv_id", "turn", "call_id", "name", F.coalesce("arguments", F.create_map().cast("map<string,string>")).alias("arguments"), F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"))
    results = results.select("conv_id", "turn", "call_id", "content")
    # equal calls of a turn are told apart by their place in a table that is written first
    rank = F.struct("turn", "name", F.array_sort(F.map_entries("arguments")).alias("arguments"), "at")
    calls = materialize(calls.withColumn("at", F.monotonically_increasing_id()), "chat-calls")
    first = calls.filter("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min(rank).alias("one"))
    first = materialize(first.select("conv_id", "call_id", F.col("one.turn").alias("step"), F.col("one.at").alias("first")), "chat-first")
    order = depths(calls.filter("conv_id is not null and call_id is not null"))
    answered = results.select("conv_id", "call_id").distinct().withColumn("answered", F.lit(True))
    rows = check_arguments(calls, tools).join(first, ["conv_id", "call_id"], "left").join(order, ["conv_id", "call_id"], "left").join(answered, ["conv_id", "call_id"], "left")
    status = (
        F.when(F.col("step").isNotNull() & F.col("depth").isNull(), "cycle").when(F.col("at") != F.col("first"), "repeated")
        .otherwise(F.coalesce(F.col("problem"), F.when(F.col("answered").isNull(), "no result"), F.lit("ok")))
    )
    said = _object([("role", F.lit('"assistant"')), ("id", json_string(F.col("call_id"))), ("name", json_string(F.col("name"))), ("arguments", json_map(F.col("arguments"), F.col("quoted")))])
    one = rows.select("conv_id", F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("step", "turn").alias("step"), F.lit(0).alias("part"), "turn", "call_id", status.alias("status"), said.alias("json"))
    linked = results.join(first, ["conv_id", "call_id"], "left").join(order, ["conv_id", "call_id"], "left")
    said = _object([("role", F.lit('"tool"')), ("id", json_string(F.col("call_id"))), ("content", json_string(F.col("content")))])
    two = linked.select("conv_id", F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("step", "turn").alias("step"), F.lit(1).alias("part"), "turn", "call_id", F.when(F.col("step").isNull(), "orphan").otherwise("ok").alias("status"), said.alias("json"))
    return one.unionByName(two)


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and tools of plain conversations: a user's turn calls the tool ``reply``, the assistant's next turn is its result.

    The identifier is the turn that asks; an ask depends on the one two turns before, which the turn in between answers. Other roles are calls of a tool
    of their own name. The first number in a text is the argument ``count``, a whole number by the schema, so that dates, amounts and phone numbers fail.
    """
    text = F.coalesce("text", F.lit(""))
    count = F.regexp_extract(text, "[0-9][0-9.,:/-]*", 0)
    plain = F.create_map(F.lit("length"), F.length(text).cast("string"), F.lit("prompt"), text)
    asks = conversations.filter("role is null or role <> 'assistant'")
    calls = asks.select(
        "conv_id", "turn", F.col("turn").cast("string").alias("call_id"), F.when(F.col("role") == "user", "reply").otherwise(F.col("role")).alias("name"),
        F.when(count == "", plain).otherwise(F.map_concat(plain, F.create_map(F.lit("count"), count))).alias("arguments"), F.array((F.col("turn") - 2).cast("string")).alias("depends_on"),
    )
    results = conversations.filter("role = 'assistant'").select("conv_id", "turn", (F.col("turn") - 1).cast("string").alias("call_id"), text.alias("content"))
    parameters = (("prompt", "string", True), ("length", "integer", True), ("count", "integer", False))
    tools = conversations.sparkSession.createDataFrame([(n, *p) for n in ("reply", "system") for p in parameters], TOOLS)
    return calls, results, tools

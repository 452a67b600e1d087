"""Chat formatting: tool calls linked to their results, put in order, checked, and written as canonical JSON.

Messages are rows (conv_id, turn, role, text). An assistant's text may be a JSON object with `tool_calls`
(id, name, arguments, after: ids whose results it needs); a message of role `tool` names its `tool_call_id`.
Calls and results meet in a hash join by conversation and identifier. Their order is topological: a call's
level is one more than the highest level of the calls it waits for, in whatever turn these are and their results
come; a result has its call's level. Chains are halved in every round (pointer doubling). Arguments are checked against their tool's schema. Every message
becomes one JSON object with sorted keys and no spaces, so equal messages have equal texts.

A row stays a row: conversations are not gathered, so one of any length is no large group.

Defined results: a null role is `user`, a null text empty; calls and results without conversation, turn or identifier are
kept and marked `no link`; of calls that repeat an identifier within a conversation the earliest stands (by turn, then by
place in its message), of results likewise, and the others are kept and marked `repeated`, both without a level; calls
without a result and results without a call are kept and marked; calls in a cycle or waiting for a later turn get level -1;
results before their call are marked; invalid arguments are marked with the reason; texts of any length stay whole; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, stored

_CALL = "array<struct<id string, name string, arguments string, after array<string>>>"
#: Production schemas: (tool, argument, JSON type, required).
SCHEMAS = [("reply", "chars", "integer", True), ("reply", "prompt", "string", True), ("reply", "lines", "integer", False)]


def schema_table(spark: SparkSession, schemas=SCHEMAS) -> DataFrame:
    """(name, argument, type, required): one row per argument, given by the caller as a list."""
    return spark.createDataFrame(schemas, "name string, argument string, type string, required boolean")


def messages(table: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return table.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("user")).alias("role"), text.alias("text"))


def parse_calls(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, call_id, name, arguments, after, place) of assistants' tool_calls objects; place is the order within one."""
    parsed = F.from_json("text", f"struct<tool_calls {_CALL}>")
    calls = rows.where(F.col("role") == "assistant").where(F.col("text").startswith("{")).select("conv_id", "turn", F.posexplode(parsed["tool_calls"]).alias("place", "c"))
    return calls.where(F.col("c").isNotNull()).select("conv_id", "turn", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.coalesce("c.arguments", F.lit("{}")).alias("arguments"), F.coalesce("c.after", F.array().cast("array<string>")).alias("after"), "place")


def parse_results(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, call_id, content) of messages of role tool."""
    parsed = F.from_json("text", "struct<tool_call_id string, content string>")
    found = rows.where(F.col("role") == "tool").select("conv_id", "turn", parsed["tool_call_id"].alias("call_id"), parsed["content"].alias("content"))
    return found.where("call_id IS NOT NULL OR content IS NOT NULL").fillna("", ["content"])


def turns_as_calls(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain conversations seen as calls of a tool `reply`: a user's turn asks, the assistant's next one answers.

    Each call waits for the call two turns earlier, if that was the user's as well.
    """
    before = F.col("turn") - 2
    asked = rows.where(F.col("role") == "user")
    call_id = F.concat_ws(":", F.lit("turn"), F.col("turn").cast("string"))
    arguments = F.to_json(F.struct(F.length("text").cast("long").alias("chars"), (F.size(F.split("text", "\n", -1))).alias("lines"), F.col("text").alias("prompt")))
    calls = asked.select("conv_id", "turn", call_id.alias("call_id"), F.lit("reply").alias("name"), arguments.alias("arguments"), F.when(before >= 0, F.array(F.concat(F.lit("turn:"), before.cast("string")))).otherwise(F.array().cast("array<string>")).alias("after"), F.lit(0).alias("place"))
    results = rows.where(F.col("role") == "assistant").select("conv_id", "turn", F.concat(F.lit("turn:"), (F.col("turn") - 1).cast("string")).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def _split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(firsts, others): of each conversation and identifier the earliest row, by turn and place in it, and the rest with a `status`.

    Equal rows meet as counts before anything is shuffled; others are repeats, or have nothing to link by."""
    rest = ["turn", *sorted((c for c in df.columns if c not in ("conv_id", "call_id", "turn")), key=lambda c: c != "place")]
    rows = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    has_link = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull() & F.col("turn").isNotNull()
    first = rows.where(has_link).groupBy("conv_id", "call_id").agg(F.min(F.struct(*rest)).alias("_v"))
    again = rows.where(has_link).join(first, ["conv_id", "call_id"]).withColumn("_n", F.col("_n") - F.struct(*rest).eqNullSafe(F.col("_v")).cast("int"))
    others = again.where("_n > 0").drop("_v").withColumn("status", F.lit("repeated")).unionByName(rows.where(~has_link).withColumn("status", F.lit("no link")))
    copies = others.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n").cast("long")))).drop("_n")
    return first.select("conv_id", "call_id", "_v.*"), copies


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): 0 for calls that wait for none, else one above the highest waited for, of any turn.

    Identifiers that are no call are not waited for. -1 marks calls in a cycle, behind one, or waiting for a call of a
    later turn or behind such a one. An edge has a weight, the levels it spans. Every round resolves the calls whose needs
    are all resolved; an edge to a call that waits for one call only then goes on to that one, so the rounds follow
    the logarithm of a chain's length. Where calls wait for several that wait for several, they follow the length."""
    edges = calls.select("conv_id", "call_id", "turn", F.explode(F.array_distinct("after")).alias("need"))
    known = calls.select("conv_id", F.col("call_id").alias("need"), F.col("turn").alias("need_turn"))
    later = F.coalesce(F.col("need_turn") > F.col("turn"), F.lit(False))
    # A call that waits for a later turn waits for itself: it is never resolved.
    edges = edges.join(known, ["conv_id", "need"]).select("conv_id", "call_id", F.when(later, F.col("call_id")).otherwise(F.col("need")).alias("need"), F.lit(1).alias("span"))
    # Of a waiting call: `best`, the level its resolved needs ask for, and its open needs.
    left = stored(edges.distinct().withColumn("best", F.lit(0)), "needs")
    waiting = left.select("conv_id", "call_id").distinct()
    solved = stored(calls.select("conv_id", "call_id").join(waiting, ["conv_id", "call_id"], "left_anti").select("conv_id", "call_id", F.lit(0).alias("level")), "level")
    parts = [solved]
    while left.limit(1).count():
        done = solved.select("conv_id", F.col("call_id").alias("need"), F.col("level").alias("of"))
        met = left.join(done, ["conv_id", "need"], "left")
        met = stored(met.select("conv_id", "call_id", F.when(F.col("of").isNull(), F.col("need")).alias("need"), "span", F.greatest("best", F.col("of") + F.col("span")).alias("best")), "met")
        whole = met.groupBy("conv_id", "call_id").agg(F.max("best").alias("best"), F.count("need").alias("open"), F.max("need").alias("next"), F.max(F.when(F.col("need").isNotNull(), F.col("span"))).alias("more"))
        whole = stored(whole, "waiting")
        solved = stored(whole.where("open = 0").select("conv_id", "call_id", F.col("best").alias("level")), "level")
        if not solved.limit(1).count():
            parts.append(whole.select("conv_id", "call_id", F.lit(-1).alias("level")))
            break
        parts.append(solved)
        one = whole.where("open = 1").select("conv_id", F.col("call_id").alias("need"), "next", "more", F.col("best").alias("low"))
        on = met.where("need is not null").join(one, ["conv_id", "need"], "left")
        on = on.select("conv_id", "call_id", F.coalesce("next", "need").alias("need"), (F.col("span") + F.coalesce("more", F.lit(0))).alias("span"), F.greatest("best", F.when(F.col("next").isNotNull(), F.col("span") + F.col("low"))).alias("best"))
        # What is asked by a resolved need counts for all open ones; of edges that now end at one call the longest does.
        on = on.join(whole.select("conv_id", "call_id", F.col("best").alias("own")), ["conv_id", "call_id"])
        last, left = left, stored(on.groupBy("conv_id", "call_id", "need").agg(F.max("span").alias("span"), F.max(F.greatest("best", "own")).alias("best")), "needs")
        discard(last, met, whole)
    return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def checked(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """calls with `problem`: null, or the first of unknown tool, missing, unexpected or badly typed argument.

    The schemas are a caller's list, so they are gathered into one map per tool and sent to the tasks.
    """
    spec = schemas.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("argument", "type", "required"))).alias("spec"))
    found = calls.join(F.broadcast(spec), "name", "left").withColumn("_values", F.from_json("arguments", "map<string,variant>"))
    got = lambda s: F.struct(s["argument"].alias("argument"), s["type"].alias("type"), s["required"].alias("required"), F.map_contains_key("_values", s["argument"]).alias("given"), F.schema_of_variant(F.try_element_at("_values", s["argument"])).alias("kind"))
    found = found.withColumns({"_keys": F.map_keys("_values"), "_spec": F.transform("spec", got)})
    # A variant's kinds under the JSON types.
    kinds = F.create_map(*(F.lit(x) for pair in {"BIGINT": "integer", "DOUBLE": "number", "DECIMAL": "number", "BOOLEAN": "boolean", "STRING": "string", "VOID": "null", "OBJECT": "object", "ARRAY": "array"}.items() for x in pair))

    def fits(s):
        kind = F.try_element_at(kinds, F.regexp_extract(s["kind"], r"^[A-Z]+", 0))
        return (kind == s["type"]) | ((kind == "integer") & (s["type"] == "number"))

    missing = F.filter("_spec", lambda s: s["required"] & ~s["given"])
    extra = F.array_except("_keys", F.transform("spec", lambda s: s["argument"]))
    bad = F.filter("_spec", lambda s: s["given"] & ~F.coalesce(fits(s), F.lit(False)))
    found = found.withColumns({"_missing": missing, "_extra": extra, "_bad": bad})
    problem = (
        F.when(F.col("spec").isNull(), F.concat(F.lit("unknown tool "), F.coalesce("name", F.lit("null"))))
        .when(F.col("_values").isNull(), F.lit("arguments are no JSON object"))
        .when(F.size("_missing") > 0, F.concat(F.lit("missing "), F.col("_missing")[0]["argument"]))
        .when(F.size("_extra") > 0, F.concat(F.lit("unexpected "), F.array_min("_extra")))
        .when(F.size("_bad") > 0, F.concat(F.lit("bad type of "), F.col("_bad")[0]["argument"]))
    )
    return found.withColumn("problem", problem).select(*calls.columns, "problem")


def canonical(*fields):
    """A JSON object of (key, value column or raw JSON column) in key order without spaces; nulls are left out."""
    parts = [F.when(v.isNotNull(), F.concat(F.lit(f'"{k}":'), v)) for k, v in sorted(fields, key=lambda x: x[0])]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def quoted(value):
    """A string as JSON text."""
    return F.regexp_extract(F.to_json(F.array(value)), r"(?s)^\[(.*)\]$", 1)


def format_chat(table: DataFrame, calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """(conv_id, level, turn, kind, call_id, status, message): one row per message, call and result.

    In the order (conv_id, level, turn, kind) every call precedes its result and follows what it waits for;
    messages have a null level.
    """
    (calls, more_calls), (results, more_results) = _split(stored(calls, "found")), _split(stored(results, "found"))
    calls, results = stored(checked(calls, schemas), "calls"), stored(results, "results")
    calls = calls.join(levels(calls), ["conv_id", "call_id"])
    left = calls.select("conv_id", "call_id", "turn", "name", "arguments", "after", "problem", "level")
    right = results.select("conv_id", "call_id", F.col("turn").alias("result_turn"), "content")
    linked = left.join(right, ["conv_id", "call_id"], "full")
    # The parsed object as text has its keys sorted and no spaces.
    arguments = F.coalesce(F.try_parse_json("arguments").cast("string"), quoted(F.col("arguments")))
    call_text = canonical(("arguments", arguments), ("id", quoted(F.col("call_id"))), ("name", quoted(F.col("name"))), ("type", F.lit('"call"')))
    result_text = canonical(("content", quoted(F.col("content"))), ("id", quoted(F.col("call_id"))), ("type", F.lit('"result"')))
    others = [d.select("conv_id", F.lit(None).cast("int").alias("level"), "turn", F.lit(kind).alias("kind"), "call_id", "status", text.alias("message")) for d, kind, text in ((more_calls, "call", call_text), (more_results, "result", result_text))]
    has_call, has_result = F.col("turn").isNotNull(), F.col("result_turn").isNotNull()
    status = F.coalesce("problem", F.when(~has_call, F.lit("no call")), F.when(~has_result, F.lit("no result")), F.when(F.col("result_turn") < F.col("turn"), F.lit("early result")), F.lit("ok"))
    pair = F.filter(
        F.array(
            F.when(has_call, F.struct(F.col("turn").alias("turn"), F.lit("call").alias("kind"), call_text.alias("message"))),
            F.when(has_result, F.struct(F.col("result_turn").alias("turn"), F.lit("result").alias("kind"), result_text.alias("message"))),
        ),
        lambda x: x.isNotNull(),
    )
    rows = linked.select("conv_id", "level", "call_id", status.alias("status"), F.explode(pair).alias("p"))
    tools = rows.select("conv_id", "level", F.col("p.turn").alias("turn"), F.col("p.kind").alias("kind"), "call_id", "status", F.col("p.message").alias("message"))
    plain = messages(table)
    text = canonical(("content", quoted(F.col("text"))), ("role", quoted(F.col("role"))), ("type", F.lit('"message"')))
    return plain.select("conv_id", F.lit(None).cast("int").alias("level"), "turn", F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit("ok").alias("status"), text.alias("message")).union(tools).union(others[0]).union(others[1])


def op2_chat(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = messages(table)
    calls, results = turns_as_calls(rows)
    parsed_calls, parsed_results = parse_calls(rows), parse_results(rows)
    return format_chat(table, calls.union(parsed_calls.select(calls.columns)), results.union(parsed_results.select(results.columns)), schema_table(spark))

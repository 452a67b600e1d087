"""Levels of tool calls over all their dependencies."""

import duckdb

from cellmorph.llm import chat
from cellmorph.llm.queries import QUERIES

CALLS = "conv_id long, turn long, call_id string, name string, arguments string, after array<string>"


def found(spark, calls):
    rows = [(1, t, i, "reply", "{}", list(after)) for i, t, after in calls]
    return {r["call_id"]: r["level"] for r in chat.levels(spark.createDataFrame(rows, CALLS)).collect()}


def test_levels_follow_chains_of_turns(spark):
    chain = [(f"c{i}", 2 * i, [f"c{i - 1}"] if i else []) for i in range(40)]
    assert found(spark, chain) == {f"c{i}": i for i in range(40)}


def test_levels_of_branches_and_cycles(spark):
    calls = [("a", 1, []), ("b", 3, ["a"]), ("c", 5, ["b"]), ("d", 7, ["a", "c"]), ("e", 9, ["d", "b", "gone"]), ("x", 1, ["y"]), ("y", 1, ["x"]), ("z", 3, ["y", "a"]), ("late", 1, ["e"]), ("after", 3, ["late"])]
    assert found(spark, calls) == {"a": 0, "b": 1, "c": 2, "d": 3, "e": 4, "x": -1, "y": -1, "z": -1, "late": -1, "after": -1}


def test_a_call_follows_the_late_result_it_waits_for(spark):
    said = lambda i, after: f'{{"tool_calls":[{{"id":"{i}","name":"reply","arguments":"{{}}","after":{after}}}]}}'
    rows = [(1, 1, "assistant", said("a", "[]")), (1, 3, "assistant", said("b", '["a"]')), (1, 5, "tool", '{"tool_call_id":"a","content":"ok"}')]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    m = chat.messages(table)
    out = chat.format_chat(table, chat.parse_calls(m), chat.parse_results(m), chat.schema_table(spark)).where("kind <> 'message'").orderBy("conv_id", "level", "turn", "kind").collect()
    assert [(r["kind"], r["call_id"]) for r in out] == [("call", "a"), ("result", "a"), ("call", "b")]


def test_op2_levels_follow_conversations(spark):
    sf = "/root/testdata/sf0.001"
    by = {(c, t): role for c, t, role in duckdb.sql(f"select conv_id, turn, role from '{sf}/conversations.parquet'").fetchall()}

    def level(c, t):
        return 1 + level(c, t - 2) if t >= 2 and by.get((c, t - 2)) == "user" else 0

    got = {(r["conv_id"], r["turn"]): r["level"] for r in QUERIES["op2_chat"](spark, sf).where("kind = 'call'").collect()}
    assert got == {(c, t): level(c, t) for (c, t), role in by.items() if role == "user"}
    assert max(got.values()) > 0

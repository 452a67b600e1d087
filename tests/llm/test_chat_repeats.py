"""Calls and results that repeat an identifier or have nothing to link by stay as marked rows."""

import collections
import json

from cellmorph.llm import chat


def test_first_in_order_stands_and_repeats_stay(spark):
    call = lambda i, name: {"id": i, "name": name, "arguments": json.dumps({"chars": 1, "prompt": "x"})}
    said = lambda *calls: json.dumps({"tool_calls": list(calls)})
    rows = [
        (1, 1, "assistant", said(call("a", "reply"), call("a", "other"), {"name": "reply", "arguments": "{}"})), (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": "ok"})), (1, 3, "tool", json.dumps({"tool_call_id": "a", "content": "later"})),
        (1, 4, "assistant", said(call("a", "reply"))), (None, 1, "assistant", said(call("n", "reply"))), (1, None, "assistant", said(call("b", "reply"))), (2, 1, "assistant", said(call("c", "reply"))), (2, 1, "assistant", said(call("c", "reply"))), (1, 9, "tool", json.dumps({"content": "no id"})),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumnsRenamed({}).selectExpr("*", "1 AS place", "2 AS status").repartition(3)
    m = chat.messages(table)
    found = [r for r in chat.format_chat(table, chat.parse_calls(m), chat.parse_results(m), chat.schema_table(spark)).collect() if r["kind"] != "message"]
    got = collections.Counter((r["conv_id"], r["turn"], r["kind"], r["call_id"], r["status"], json.loads(r["message"]).get("name", json.loads(r["message"]).get("content"))) for r in found)
    assert got == collections.Counter(
        {
            (1, 1, "call", "a", "ok", "reply"): 1, (1, 1, "call", "a", "repeated", "other"): 1, (1, 4, "call", "a", "repeated", "reply"): 1, (1, 1, "call", None, "no link", "reply"): 1, (1, 2, "result", "a", "ok", "ok"): 1, (1, 3, "result", "a", "repeated", "later"): 1,
            (None, 1, "call", "n", "no link", "reply"): 1, (1, None, "call", "b", "no link", "reply"): 1, (2, 1, "call", "c", "no result", "reply"): 1, (2, 1, "call", "c", "repeated", "reply"): 1, (1, 9, "result", None, "no link", "no id"): 1,
        }
    )
    assert all(r["level"] is None for r in found if r["status"] in ("repeated", "no link"))

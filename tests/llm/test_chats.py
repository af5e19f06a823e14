import json

import pandas as pd

from corvane.llm.chats import ORACLE, SCHEMAS, dependency_levels, link_tool_calls, op1_chat_formatting, turns_as_calls
from tests.llm.compare import duck, same
from tests.llm.conftest import SF

SCHEMA = "conv_id long, turn long, role string, content string, kind string, call_id string, tool string, arguments string, json string"


def test_equals_sql(spark):
    assert same(op1_chat_formatting(spark, SF), duck(SF), ORACLE) > 80


def test_links_and_problems(spark):
    rules = {"add": {"a": {"type": "integer", "required": True}, "tag": {"type": "string"}}}
    rows = [
        (1, 0, "assistant", None, "call", "x", "add", '{"tag": "t", "a": 1}'), (1, 1, "tool", "2", "result", "x", None, None),
        (1, 2, "tool", "?", "result", "y", None, None), (1, 3, "assistant", None, "call", "z", "add", '{"a": "1"}'),
        (2, 5, "assistant", None, "call", "w", "sub", "[1]"), (2, 4, "tool", 'say "é"\n', "result", "w", None, None),
        (3, 0, "assistant", None, "call", None, "add", None), (3, 1, "assistant", None, "call", "d", "add", '{"a": 2}'),
        (3, 2, "assistant", None, "call", "d", "add", '{"a": 3}'), (None, 0, "tool", "", "result", "d", None, None), (3, 3, "user", "hi", "message", None, None, None),
    ]
    got = {(r.conv_id, r.turn): r for r in link_tool_calls(spark.createDataFrame([(*r, "j") for r in rows], SCHEMA), rules).collect()}
    assert len(got) == len(rows)
    status = {k: r.status for k, r in got.items()}
    assert status == {(1, 0): "answered", (1, 1): "linked", (1, 2): "orphan", (1, 3): "unanswered", (2, 5): "unanswered", (2, 4): "linked", (3, 0): "unidentified", (3, 1): "repeated", (3, 2): "repeated", (None, 0): "unidentified", (3, 3): "message"} | {(2, 5): "answered"}
    assert got[1, 3].problems == "a: no integer" and got[2, 5].problems == "arguments: no object; unknown tool" and got[3, 0].problems == "a: missing"
    assert (got[2, 4].order_turn, got[2, 4].order_rank) == (5, 1) > (got[2, 5].order_turn, got[2, 5].order_rank)
    assert got[1, 0].json == '{"arguments":{"a":1,"tag":"t"},"call_id":"x","role":"assistant","tool":"add","turn":0}'
    assert json.loads(got[2, 4].json)["content"] == 'say "é"\n'


def test_edges(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (1, 2, "user", ""), (2, 0, None, "x"), (None, 0, "user", "a\tb"), (3, 0, "user", "w " * 200), (3, 0, "user", "w " * 200), (4, 1, "assistant", "o")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    data = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    assert same(link_tool_calls(turns_as_calls(frame), SCHEMAS), duck(SF, conversations=data), ORACLE) == 8
    assert link_tool_calls(turns_as_calls(frame.limit(0)), SCHEMAS).count() == 0


def test_levels(spark):
    rows = [(1, "a", []), (1, "b", ["a"]), (1, "c", ["a", "b"]), (1, "p", ["q"]), (1, "q", ["p"]), (2, "x", ["gone"]), (2, "y", None)]
    got = {(r.conv_id, r.call_id): r.level for r in dependency_levels(spark.createDataFrame(rows, "conv_id long, call_id string, depends_on array<string>")).collect()}
    assert got == {(1, "a"): 0, (1, "b"): 1, (1, "c"): 2, (1, "p"): None, (1, "q"): None, (2, "x"): None, (2, "y"): 0}


def test_levels_of_messages_and_odd_names(spark):
    rules = {"t": {"it's": {"type": "integer", "required": True}, "a.b": {"type": "string", "required": True}, 'q"\\': {"type": "boolean", "required": True}}}
    good = json.dumps({"it's": 1, "a.b": "x", 'q"\\': True})
    rows = [
        (1, 0, "assistant", None, "call", "a", "t", good, []), (1, 1, "tool", "1", "result", "a", None, None, None), (1, 2, "assistant", None, "call", "b", "t", "{}", ["a"]),
        (1, 3, "tool", "2", "result", "b", None, None, None), (1, 4, "user", "x", "message", None, None, None, None), (1, 5, "assistant", None, "call", "c", "t", '{"it\'s": "1", "a.b": 2, "q\\"\\\\": 3}', ["b", "a"]),
        (2, 0, "assistant", None, "call", "a", "t", good, ["gone"]), (2, 1, "tool", None, "result", "zz", None, None, None),
    ]
    kind = "conv_id long, turn long, role string, content string, kind string, call_id string, tool string, arguments string, depends_on array<string>"
    got = {(r.conv_id, r.turn): (r.level, r.problems) for r in link_tool_calls(spark.createDataFrame(rows, kind), rules).collect()}
    assert [got[k][0] for k in sorted(got)] == [0, 1, 2, 3, 0, 4, None, None]
    assert got[1, 0][1] == "" and got[1, 2][1] == 'it\'s: missing; a.b: missing; q"\\: missing'
    assert got[1, 5][1] == 'it\'s: no integer; a.b: no string; q"\\: no boolean'


def test_very_long_texts(spark):
    text = "wörd \"quoted\" " * 200_000
    frame = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    got = {r.turn: r for r in link_tool_calls(turns_as_calls(frame), SCHEMAS).collect()}
    assert json.loads(got[0].json)["arguments"] == {"prompt": text, "words": 400_000} and json.loads(got[1].json)["content"] == text
    assert got[0].problems == "words: maximum"

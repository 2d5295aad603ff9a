"""Tool calls: links, order, validation and canonical JSON."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import toolcalls

TOOLS = {"add": {"properties": {"a": {"type": "integer"}, "b": {"type": "number"}, "l": {"type": "array"}}, "required": ["a"], "additionalProperties": False}}
SHAPE = "conv_id long, turn long, role string, text string"


def calls(*c):
    return json.dumps({"tool_calls": [dict(zip(("id", "name", "arguments"), x, strict=True)) for x in c]})


def result(i, content):
    return json.dumps({"tool_call_id": i, "content": content})


def rows_of(spark, messages):
    df = spark.createDataFrame(messages, SHAPE).withColumns({"level": F.lit("x"), "name": F.lit(1)})
    return toolcalls.link(df, TOOLS).collect()


def test_links_order_faults_and_json(spark):
    messages = [
        (1, 0, "user", "hi"),
        (1, 1, "assistant", calls(("x", "add", {"b": 1.5, "a": 1}), ("y", "add", '{"a": "{{x}}"}'))),
        (1, 2, "tool", result("x", {"z": 1, "b": [1, 2]})),
        (1, 3, "tool", result("x", "again")),
        (1, 4, "tool", result("q", "o")),
        (2, 0, "assistant", calls(("p", "add", '{"a":1,"k":"{{q}}"}'), ("q", "add", '{"a":2,"k":"{{p}}"}'), ("r", "nope", "{}"), ("s", "add", 'not "json'), (None, "add", {"l": [1]}))),
        (2, 1, "assistant", None),
        (2, 2, "assistant", "plain"),
        (3, 0, "tool", "{}"),
        (3, 1, "tool", result("late", 1)),
        (3, 2, "assistant", calls(("late", "add", {"a": 1}))),
        (None, 0, "assistant", calls(("n", "add", {"a": 1}))),
    ]
    got = {(r.conv_id, r.call_id, r.kind, r.result_turn if r.kind == "result" else r.turn): r for r in rows_of(spark, messages)}
    status = {k: (r.status, r.level, r.faults) for k, r in got.items()}
    assert status == {
        (1, "x", "call", 1): ("answered", 0, []),
        (1, "y", "call", 1): ("open", 0, ["type of a"]),
        (1, "x", "result", 2): ("linked", 0, []),
        (1, "x", "result", 3): ("repeated", None, []),
        (1, "q", "result", 4): ("orphan", None, []),
        (2, "p", "call", 0): ("circular", None, ["unknown k"]),
        (2, "q", "call", 0): ("circular", None, ["unknown k"]),
        (2, "r", "call", 0): ("open", 0, ["unknown tool"]),
        (2, "s", "call", 0): ("open", 0, ["not JSON"]),
        (2, None, "call", 0): ("open", None, ["missing a"]),
        (3, None, "result", 0): ("orphan", None, []),
        (3, "late", "result", 1): ("orphan", None, []),
        (3, "late", "call", 2): ("open", 0, []),
        (None, "n", "call", 0): ("open", None, []),
    }
    for r in got.values():
        value = json.loads(r.json)
        assert r.json == json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert json.loads(got[1, "x", "call", 1].json) == {"arguments": {"a": 1, "b": 1.5}, "id": "x", "name": "add"}
    assert json.loads(got[2, "s", "call", 0].json)["arguments"] == 'not "json'


def test_chains_are_ordered_and_each_result_follows_its_call(spark):
    chain = [(1, i, "assistant", calls((f"c{i}", "add", {"a": 1, "l": [f"{{{{c{i + 1}}}}}"]}))) for i in range(6)]
    chain += [(1, 10 + i, "tool", result(f"c{i}", i)) for i in range(6)]
    rows = sorted(rows_of(spark, chain), key=lambda r: (r.level, r.turn, r.nth, r.kind))
    assert [(r.call_id, r.kind) for r in rows] == [(f"c{i}", kind) for i in reversed(range(6)) for kind in ("call", "result")]


def test_a_long_conversation_takes_few_rounds(spark, monkeypatch):
    saved = []
    monkeypatch.setattr(toolcalls, "save", lambda df, label, save=toolcalls.save: (saved.append(label), save(df, label))[1])
    back = [(1, i, "assistant", calls((f"c{i}", "add", {"a": 1, "l": [f"{{{{c{i - 1}}}}}"]}))) for i in range(2000)]
    assert {r.level for r in rows_of(spark, back)} == {0} and saved.count("step") == 0
    there = [(1, i, "assistant", calls((f"c{i}", "add", {"a": 1, "l": [f"{{{{c{i + 1}}}}}"]}))) for i in range(600)]
    assert sorted(r.level for r in rows_of(spark, there)) == list(range(600)) and saved.count("step") <= 12


def test_a_tangle_takes_one_step(spark, monkeypatch):
    """Calls that each need the next two: one level for each, found without rounds; circles and what is behind them too."""
    saved = []
    monkeypatch.setattr(toolcalls, "save", lambda df, label, save=toolcalls.save: (saved.append(label), save(df, label))[1])
    tangle = [(1, i, "assistant", calls((f"c{i:02}", "add", {"a": 1, "l": [f"{{{{c{i + 1:02}}}}}", f"{{{{c{i + 2:02}}}}}"]}))) for i in range(40)]
    assert [r.level for r in sorted(rows_of(spark, tangle), key=lambda r: r.call_id)] == list(range(39, -1, -1)) and saved.count("step") == 0
    tangle.append((1, 50, "assistant", calls(("c40", "add", {"a": 1, "l": ["{{c38}}"]}))))  # c38 to c40 are a circle, and all are before it
    assert {r.level for r in rows_of(spark, tangle)} == {None} and saved.count("step") == 0


def plain_levels(conversation):
    """Level of each call, None on a circle or behind one, by depth-first search; conversation: {id: (place, needs)}."""
    levels, open_ = {}, set()

    def level(i):
        if i in levels:
            return levels[i]
        if i in open_:
            return None
        open_.add(i)
        out = 0
        for need in conversation[i][1]:
            if need in conversation:
                below = level(need)
                out = None if below is None or out is None else max(out, below + (conversation[need][0] >= conversation[i][0]))
        open_.discard(i)
        levels[i] = out
        return out

    # what is reached while its circle is open may be settled too early: only those that reach a circle
    reach = lambda i, seen: [x for n in conversation[i][1] if n in conversation and n not in seen for x in (seen.add(n), n)[1:] + tuple(reach(n, seen))]
    circular = {i for i in conversation if i in reach(i, set())}
    behind = {i for i in conversation if i in circular or circular & set(reach(i, set()))}
    return {i: None if i in behind else level(i) for i in conversation}


@pytest.mark.parametrize("small", [0, 30, toolcalls.SMALL])
def test_random_messages_equal_a_plain_version(spark, monkeypatch, small):
    """In rounds, within rows, and some of each."""
    monkeypatch.setattr(toolcalls, "levels", lambda first, _, levels=toolcalls.levels: levels(first, small))
    rng = random.Random(4)
    messages = []
    for conv in range(60):
        n = rng.randrange(1, 14)
        names = [f"k{i}" for i in range(n)]
        for turn in range(n + rng.randrange(4)):
            made = []
            for _ in range(rng.randrange(1, 3)):
                near = [x for x in names if rng.random() < (0.12 if conv % 2 else 0.3)]
                made.append((rng.choice(names), rng.choice(["add", "nope"]), {"a": 1, "l": [f"{{{{{x}}}}}" for x in near]}))
            messages.append((conv, turn, "assistant", calls(*made)))
            if rng.random() < 0.8:
                messages.append((conv, turn + rng.randrange(2), "tool", result(rng.choice([*names, "other"]), turn)))
    got = rows_of(spark, messages)
    want = []
    for conv in range(60):
        made = [(turn, nth, c) for v, turn, role, text in messages if v == conv and role == "assistant" for nth, c in enumerate(json.loads(text)["tool_calls"])]
        first = {}
        for turn, nth, c in made:
            first.setdefault(c["id"], (turn, nth, c))
        needs = {i: ((turn, nth), [x[2:-2] for x in c["arguments"]["l"]]) for i, (turn, nth, c) in first.items()}
        level = plain_levels(needs)
        answers = {}
        tools = sorted((turn, json.loads(text)["tool_call_id"]) for v, turn, role, text in messages if v == conv and role == "tool")
        for turn, i in tools:
            if i in first and turn > first[i][0] and i not in answers:
                answers[i] = turn
        for turn, nth, c in made:
            mine = first[c["id"]][:2] == (turn, nth)
            status = "repeated" if not mine else "circular" if level[c["id"]] is None else "answered" if c["id"] in answers else "open"
            want.append((conv, c["id"], "call", turn, nth, status, level[c["id"]] if mine else None))
        used = set()
        for turn, i in tools:
            linked = i in answers and answers[i] == turn and i not in used
            used |= {i} if linked else set()
            status = "linked" if linked else "repeated" if i in first and turn > first[i][0] else "orphan"
            want.append((conv, i, "result", turn, None, status, level[i] if linked else None))
    assert {r[5] for r in want} >= {"circular", "repeated", "answered", "open", "linked", "orphan"} and max(r[6] or 0 for r in want) > 1
    ours = [(r.conv_id, r.call_id, r.kind, r.turn if r.kind == "call" else r.result_turn, r.nth if r.kind == "call" else None, r.status, r.level) for r in got]
    assert sorted(ours, key=str) == sorted(want, key=str)


def test_canonical_json(spark):
    forms = [
        ("100", "100"), ("100.0", "100"), ("1e2", "100"), ("1.0E+2", "100"), ("-0.0", "0"), ("0.10", "0.1"), ("12.50", "12.5"), ("1e400", "1e400"), ("10e399", "1e400"),
        ("1e-9", "1e-9"), ("0.0000010", "0.000001"), ("1.5e-3", "0.0015"), ("1e99999999999", "1e99999999999"),
        ("123456789012345678901234567890123456789012345", "123456789012345678901234567890123456789012345"), ("3.14159265358979323846264338327950288419716939937510", "3.1415926535897932384626433832795028841971693993751"),
        ('{"b":1.0,"a":[true,null,"n1","s","\\u0041\\/"]}', '{"a":[true,null,"n1","s","A/"],"b":1}'), (' { "é" : "x" } ', '{"é":"x"}'), ("[]", "[]"), ("{}", "{}"),
        ('{"a":1,"a":2}', None), ("01", None), ("1.", None), ("'a'", None), ("{a:1}", None), ("NaN", None), ("-", None), ('"open', None), ("", None), (None, None), ("[1,]", None), ("1] [2", None), ("{} {}", None), ("[] ]", None), ("1 x", None), (" 7 ", "7"), ('{"a":"b" }', '{"a":"b"}'),
        ('"' + "x\\n" * 50_000 + '"', '"' + "x\\n" * 50_000 + '"'),
    ]
    df = spark.createDataFrame(forms, "t string, want string")
    assert [r.got for r in df.select(toolcalls.canonical(F.col("t")).alias("got")).collect()] == [w for _, w in forms]


def test_schemas(spark):
    schema = {
        "properties": {"n": {"type": ["integer", "null"], "minimum": 0, "maximum": 10}, "e": {"enum": ["x", 1.0, {"k": [1]}]}, "any": {}, "deep": {"type": "object", "properties": {"list": {"type": "array", "items": {"type": "string"}}}, "required": ["list"]}, "f": {"type": "boolean"}},
        "required": ["n", "elsewhere"],
    }
    cases = [
        ('{"n":1.0,"elsewhere":0,"more":1}', []),
        ('{"n":null,"elsewhere":null,"any":[1],"f":true}', []),
        ('{"n":123456789012345678901234567890,"elsewhere":1}', ["maximum of n"]),
        ('{"n":-1,"e":"y"}', ["minimum of n", "missing elsewhere", "value of e"]),
        ('{"n":"1","elsewhere":1,"e":{"k":[1.0]},"f":"true"}', ["type of f", "type of n"]),
        ('{"n":1.5,"elsewhere":1,"e":1}', ["type of n"]),
        ('{"n":1,"elsewhere":1,"deep":{}}', ["missing deep.list"]),
        ('{"n":1,"elsewhere":1,"deep":{"list":["a",1,2]}}', ["type of deep.list[]"]),
        ('{"n":1,"elsewhere":1,"deep":[]}', ["type of deep"]),
        ("[1]", ["type of arguments"]),
        ("{", ["not JSON"]),
    ]
    df = spark.createDataFrame([(1, i, "assistant", calls((f"c{i}", "t", a))) for i, (a, _) in enumerate(cases)], SHAPE)
    got = {r.call_id: r.faults for r in toolcalls.link(df, {"t": schema}).collect()}
    assert [got[f"c{i}"] for i in range(len(cases))] == [f for _, f in cases]
    with pytest.raises(ValueError):
        toolcalls.link(df, {"t": {"properties": {"n": {"pattern": "x"}}}})


def test_repeats_and_empty(spark):
    twice = [(1, 0, "assistant", calls(("x", "add", {"a": 1})))] * 2 + [(1, 1, "tool", result("x", 1))] * 2
    assert sorted(r.status for r in rows_of(spark, twice)) == ["answered", "linked", "repeated", "repeated"]
    assert rows_of(spark, []) == []


def test_turns_become_messages(spark):
    turns = [(0, 0, "system", "s"), (0, 1, "user", 'say "é"'), (0, 2, "assistant", "a"), (0, 5, "user", None), (2, 0, "assistant", "alone"), (3, 5, "user", "x"), (4, 2, "user", "y"), (4, 4, "user", "z"), (5, 5, "user", "w"), (6, 10, "user", "v")]
    rows = toolcalls.link(toolcalls.from_turns(spark.createDataFrame(turns, SHAPE)), toolcalls.TURN_TOOLS).collect()
    got = {(r.conv_id, r.turn, r.kind): (r.call_id, r.name, r.status, r.level, tuple(r.faults)) for r in rows}
    assert got == {
        (0, 0, "call"): ("c0", "configure", "open", 0, ()),
        (0, 1, "call"): ("c1", "reply", "answered", 0, ("missing text",)),
        (0, 1, "result"): ("c1", "reply", "linked", 0, ()),
        (0, 5, "call"): ("c5", "reply", "open", 0, ("not JSON",)),
        (2, 0, "result"): ("c-1", None, "orphan", None, ()),
        (3, 5, "call"): ("c5", "reply", "open", 0, ("type of turn",)),
        (4, 2, "call"): ("c0", "reply", "circular", None, ()),
        (4, 4, "call"): ("c4", "guess", "open", 0, ("unknown tool",)),
        (5, 5, "call"): ("c5", "reply", "open", 0, ("missing text",)),
        (6, 10, "call"): ("c10", "reply", "open", 0, ("type of turn",)),
    }

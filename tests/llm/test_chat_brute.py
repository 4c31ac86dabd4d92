"""Linking and order against a model that walks one conversation at a time."""

import json
import random

import pytest

from tidemark.llm import chat

TURNS = "conv_id long, turn long, role string, text string"


def model(rows):
    """``(conv, turn) -> kind, anchor, depth, slot`` of turns in one conversation, parsed already."""
    first = {}
    for turn, calls, _ in sorted(rows, key=lambda r: r[0]):
        for slot, (id_, needs) in enumerate(calls or []):
            first.setdefault(id_, (turn, slot, sorted(needs - {id_})))
    any_needs = any(n in first for _, _, needs in first.values() for n in needs)
    before = {}  # node -> nodes that it comes one after, or (turns) at
    for id_, (turn, _, needs) in first.items():
        before.setdefault(("t", turn), set())
        before[("c", id_)] = {("t", turn)}
        for n in needs:
            if n in first:
                node = ("c", id_) if first[n][0] == turn else ("t", turn)
                before.setdefault(node, set()).add(("c", n))
    own = lambda node: node[1] if node[0] == "t" else first[node[1]][0]
    depth, anchor = {}, {}
    while ready := [x for x in before if x not in depth and all(y in depth for y in before[x])]:
        for x in ready:
            depth[x] = max([depth[y] + 1 for y in before[x]], default=0)
            anchor[x] = max([anchor[y] for y in before[x]] + [own(x)])
    stuck = {first[i][0] for i in first if ("c", i) not in depth}
    out = {}
    for turn, calls, result_of in rows:
        if calls is not None:
            mine = [i for i, f in first.items() if f[0] == turn]
            if turn in stuck:
                out[turn] = ("cycle", turn, 0, 0)
            elif calls and not mine:
                out[turn] = ("duplicate_call", turn, 0, 0)
            else:
                out[turn] = ("call", anchor.get(("t", turn), turn), depth.get(("t", turn), 0), 0)
        elif result_of is None:
            out[turn] = ("plain", turn, 0, 0)
        elif result_of not in first:
            out[turn] = ("orphan_result", turn, 0, 0)
        else:
            at, slot, _ = first[result_of]
            node = ("c", result_of)
            out[turn] = ("result", at, 1, slot) if at in stuck or not any_needs and node not in depth else ("result", anchor[node], depth[node], slot)
    return out


def conversation(rng):
    rows, names = [], "abcdefgh"[: rng.randrange(2, 9)]
    for turn in rng.sample(range(30), rng.randrange(1, 14)):
        kind = rng.random()
        if kind < 0.5:
            calls = [(rng.choice(names), {rng.choice(names) for _ in range(rng.choice([0, 0, 1, 2]))}) for _ in range(rng.choice([1, 1, 2, 3]))]
            rows.append((turn, list(dict(calls).items()), None))
        elif kind < 0.9:
            rows.append((turn, None, rng.choice(names)))
        else:
            rows.append((turn, None, None))
    return rows


def text_of(row):
    turn, calls, result_of = row
    if calls is not None:
        return "assistant", json.dumps({"tool_calls": [{"id": i, "name": "say", "arguments": {"xs": [[{"$result": n}] for n in sorted(needs)]}} for i, needs in calls]})
    if result_of is not None:
        return "tool", json.dumps({"tool_call_id": result_of, "content": "ok"})
    return "user", "hello"


@pytest.mark.parametrize("seed,row_calls", [(1, 256), (2, 0), (3, 5)])
def test_equals_the_model(spark, monkeypatch, seed, row_calls):
    monkeypatch.setattr(chat, "ROW_CALLS", row_calls)
    rng = random.Random(seed)
    talks = {k: conversation(rng) for k in range(150)}
    rows = [(k, r[0], *text_of(r)) for k, talk in talks.items() for r in talk]
    found = {(r.conv_id, r.turn): (r.kind, r.anchor, r.depth, r.slot) for r in chat.format_chats(spark.createDataFrame(rows, TURNS), {"say": {}}).collect()}
    expected = {(k, turn): v for k, talk in talks.items() for turn, v in model(talk).items()}
    assert found == expected
    # in the order of the keys, results follow their calls and calls what they need
    for k, talk in talks.items():
        order = sorted(expected[k, r[0]][1:] + (r[0],) for r in talk)
        place = {key[-1]: n for n, key in enumerate(order)}
        firsts = {}
        for turn, calls, _ in sorted(talk, key=lambda r: r[0]):
            for id_, needs in calls or []:
                firsts.setdefault(id_, (turn, needs))
        for turn, _, result_of in talk:
            if expected[k, turn][0] == "result":
                assert place[firsts[result_of][0]] < place[turn]


DEEP = '{"tool_calls":[{"id":"d","name":"say","arguments":{"x":' + "[" * 3000 + '{"$result":"e"}' + "]" * 3000 + "}}]}"
ODD = {
    "a list as name": ('{"tool_calls":[{"id":"x","name":["x"],"arguments":{}}]}', "call", False),
    "deep arguments": (DEEP, None, None),
    "bottomless": ('{"tool_calls":' + "[" * 200_000, "malformed", False),
    "half a pair": ('{"tool_calls":[{"id":"x","name":"say","arguments":{"x":"\\ud800"}}]}', "malformed", False),
    "a whole pair": ('{"tool_calls":[{"id":"x","name":"say","arguments":{"x":"\\ud83d\\ude00"}}]}', "call", True),
    "a huge integer": ('{"tool_calls":[{"id":"x","name":"count","arguments":{"n":' + "9" * 400 + "}}]}", "call", True),
    "digits beyond all use": ('{"tool_calls":[{"id":"x","name":"count","arguments":{"n":' + "9" * 9000 + "}}]}", "malformed", False),
    "not a number": ('{"tool_calls":[{"id":"x","name":"count","arguments":{"n":NaN}}]}', "malformed", False),
    "too large": ('{"tool_calls":[{"id":"x","name":"count","arguments":{"n":1e999}}]}', "malformed", False),
    "an id that is none": ('{"tool_calls":[{"id":[1],"name":"say","arguments":{}}]}', "call", False),
    "null calls": ('{"tool_calls":[null,3,"x"]}', "call", False),
    "a half pair in a string of arguments": ('{"tool_calls":[{"id":"x","name":"say","arguments":"{\\"x\\":\\"\\\\ud800\\"}"}]}', "call", False),
}


def test_odd_json_is_no_crash(spark):
    rows = [(n, 0, "assistant", text) for n, (text, _, _) in enumerate(ODD.values())] + [(100, 0, "tool", '{"tool_call_id":"\\udfff"}'), (101, 0, "tool", '{"tool_call_id":7}')]
    found = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, TURNS), {"say": {}, "count": {"properties": {"n": {"type": "integer"}}}}).collect()}
    for n, (name, (_, kind, valid)) in enumerate(ODD.items()):
        if kind:
            assert (found[n].kind, found[n].valid) == (kind, valid), name
    assert found[1].kind in ("call", "malformed")
    assert found[100].kind == "malformed" and found[101].kind == "plain"
    for r in found.values():
        if r.conv_id != 1:
            json.loads(r.message, parse_constant=lambda x: pytest.fail(x), parse_int=str)


def test_schema_checks():
    p = chat.problems
    assert p(10**400, {"type": "integer"}) == p(2.0, {"type": "integer"}) == p(None, {"type": ["string", "null"]}) == []
    assert p(True, {"enum": [1]}) == ["$: not in enum"] and p("", {"minLength": 1}) == ["$: shorter than 1"]
    assert p([{"$result": "x"}, 1], {"items": {"type": "string"}}) == ["$[1]: not of type string"]


def test_conversations_as_tool_calls(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a"), (1, 3, "user", ""), (1, 4, "assistant", "b"), (2, 1, "assistant", "nobody asked"), (None, 0, "user", None), (3, None, "user", "x")]
    found = {(r.conv_id, r.turn): r for r in chat.format_chats(chat.as_tool_calls(spark.createDataFrame(rows, TURNS)), chat.ANSWER).collect()}
    assert len(found) == len(rows)
    got = {k: (r.kind, r.anchor, r.depth, r.valid) for k, r in found.items() if k[0] in (1, 2)}
    assert got == {(1, 0): ("plain", 0, 0, True), (1, 1): ("call", 1, 0, True), (1, 2): ("result", 1, 1, True), (1, 3): ("call", 3, 2, False), (1, 4): ("result", 3, 3, True), (2, 1): ("orphan_result", 1, 0, False)}
    assert not found[None, 0].valid


def test_null_turns_and_a_long_text(spark):
    long = json.dumps({"tool_calls": [{"id": "x", "name": "say", "arguments": {"t": "word " * 400_000}}]})
    rows = [(1, None, "assistant", long), (1, None, "assistant", long), (1, 5, "tool", '{"tool_call_id":"x"}'), (2, 1, "user", "u " * 500_000)]
    found = chat.format_chats(spark.createDataFrame(rows, TURNS)).collect()
    assert sorted(r.kind for r in found) == ["call", "call", "plain", "result"]
    assert all(len(r.message) > 900_000 for r in found if r.kind != "result")

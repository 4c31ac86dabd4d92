import json

import pytest

from tidemark.llm import chat, licenses


def brute_matches(text):
    units = (text or "").split("\n")
    import re

    units += [p for p in re.split("\n[ \t\r]*\n", text or "") if "\n" in p]
    out = []
    for u in units:
        a = set(licenses.template_bigrams(u))
        for name, t in licenses.TEMPLATES.items():
            b = set(licenses.template_bigrams(t))
            if a and 2 * len(a & b) / (len(a) + len(b)) >= licenses.THRESHOLD:
                out.append((name, round(2 * len(a & b) / (len(a) + len(b)), 9)))
    return sorted(out)


def test_scan_equals_brute_force(make_docs, odd):
    mit = licenses.TEMPLATES["MIT-permission"]
    wrapped = "\n".join([mit[:80], mit[80:300], mit[300:]])
    rows = odd + [
        (20, "Intro.\nAll rights reserved.\nmore"),
        (21, "ALL  RIGHTS, reserved!"),
        (22, f"Copyright 2020\n\n{wrapped}\n\nText."),
        (23, mit.replace("free of charge", "gratis").replace("publish, ", "")),
        (24, "Licensed under the Apache License, Version 2.0. See below."),
        (25, "licensed " * 40),
        (26, "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ]
    found = licenses.scan(make_docs(rows)).collect()
    got = sorted((str(r.doc_id), sorted((m.license, round(m.dice, 9)) for m in r.matches)) for r in found)
    assert got == sorted((str(i), brute_matches(t)) for i, t in rows)
    best = {r.doc_id: r.license for r in licenses.best_license(licenses.scan(make_docs(rows))).collect()}
    assert best[20] == best[21] == "all-rights-reserved" and best[22] == best[23] == "MIT-permission" and best[25] is None
    assert best[26] == "CC-BY-SA-4.0"
    assert licenses.scan(make_docs([])).count() == 0


def test_embedded_notices(make_docs):
    mit = licenses.TEMPLATES["MIT-permission"]
    block = "\n".join(["/*", " * Some program.", " *", *(f" * {mit[i : i + 70]}" for i in (0, 70)), " *", " */", "int main() { return 0; }"])
    prose = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen."
    header = "# A tool that does things, by its authors.\n# " + licenses.TEMPLATES["GPL-header"].replace("redistribute", "redistribute\n#").replace("Foundation,", "Foundation,\n#") + "\n#\n# More."
    words = mit.split()
    whole = "\n".join(["/*", " * Some program.", " *", *(" * " + " ".join(words[i : i + 9]) for i in range(0, len(words), 9)), " *", " * " + "more words follow here " * 40, " */"])
    rows = [
        (1, "Copyright (c) 2019 Example Corporation. All rights reserved."),
        (2, "See the documentation for details. Released under the MIT License."),
        (3, f"{prose} {licenses.TEMPLATES['CC-BY-4.0']} {prose}"),
        (4, whole),
        (5, header),
        (6, block),  # not enough of the notice
        (7, f"{prose}\nThis project is licensed under the MIT License.\n{prose}"),
        (8, f"{prose} The rights of the license holder are reserved by the following persons."),
        (9, f"{prose} " * 2000 + "All rights reserved. " + prose),
    ]
    found = {r.doc_id: r for r in licenses.best_license(licenses.scan(make_docs(rows))).collect()}
    assert [found[i].license for i in range(1, 10)] == ["all-rights-reserved", "MIT", "CC-BY-4.0", "MIT-permission", "GPL-header", None, "MIT-line", None, "all-rights-reserved"]
    assert [found[i].dice for i in (1, 2, 3, 4, 5, 7)] == [1.0] * 6
    assert found[7].n_licenses == 1  # a line that is a notice is no other


def test_native_plan(make_docs):
    plan = licenses.scan(make_docs([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Exchange", "Join"))


TURNS = "conv_id long, turn long, role string, text string"
SCHEMAS = {"add": {"properties": {"a": {"type": "integer"}, "b": {"type": "number"}}, "required": ["a", "b"], "additionalProperties": False}, "say": {}}


def call(*calls):
    return json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]})


def result(id_, content="ok"):
    return json.dumps({"tool_call_id": id_, "content": content})


def formatted(spark, rows, schemas=SCHEMAS):
    df = chat.format_chats(spark.createDataFrame(rows, TURNS).selectExpr("*", "'x' AS kind", "1 AS depth"), schemas)
    found = sorted(df.collect(), key=lambda r: (r.conv_id is None, r.conv_id or 0, r.anchor, r.depth, r.slot, r.turn))
    return found


def test_results_follow_their_calls(spark):
    rows = [
        (1, 0, "user", "hi"),
        (1, 1, "tool", result("c2")),  # before its call
        (1, 2, "assistant", call(("c1", "add", {"b": 2, "a": 1}), ("c2", "say", {}))),
        (1, 3, "user", "meanwhile"),
        (1, 4, "tool", result("c1", "3")),
        (1, 5, "tool", result("nobody")),
        (2, 0, "tool", result("c1")),  # another conversation's call
    ]
    found = formatted(spark, rows)
    assert [(r.conv_id, r.turn, r.kind) for r in found] == [(1, 0, "plain"), (1, 2, "call"), (1, 4, "result"), (1, 1, "result"), (1, 3, "plain"), (1, 5, "orphan_result"), (2, 0, "orphan_result")]
    assert found[1].message == '{"role":"assistant","tool_calls":[{"arguments":{"a":1,"b":2},"id":"c1","name":"add"},{"arguments":{},"id":"c2","name":"say"}]}'
    assert [r.valid for r in found] == [True, True, True, True, True, False, False]


def test_arguments_are_checked(spark):
    bad = [{"a": 1}, {"a": "1", "b": 2}, {"a": 1, "b": 2, "c": 3}, {"a": True, "b": 1}, "text"]
    rows = [(i, 0, "assistant", call(("x", "add", a))) for i, a in enumerate(bad)] + [(9, 0, "assistant", call(("x", "unknown", {}))), (10, 0, "assistant", call(("x", "add", '{"a": 1, "b": 2.5}')))]
    found = {r.conv_id: r for r in formatted(spark, rows)}
    assert [found[i].valid for i in (0, 1, 2, 3, 4, 9, 10)] == [False] * 6 + [True]
    assert list(found[0].errors) == ["x: $.b: missing"]


def test_calls_wait_for_results_they_need(spark):
    need = lambda *ids: {"xs": [{"$result": i} for i in ids]}
    rows = [
        (1, 0, "assistant", call(("late", "say", need("mid")))),
        (1, 1, "assistant", call(("mid", "say", need("first")))),
        (1, 2, "assistant", call(("first", "say", {}))),
        (1, 3, "tool", result("late")),
        (1, 4, "tool", result("mid")),
        (1, 5, "tool", result("first")),
        (2, 0, "assistant", call(("a", "say", need("b")))),
        (2, 1, "assistant", call(("b", "say", need("a")))),
    ]
    found = formatted(spark, rows)
    assert [r.turn for r in found if r.conv_id == 1] == [2, 5, 1, 4, 0, 3]
    assert {r.kind for r in found if r.conv_id == 2} == {"cycle"}


@pytest.mark.parametrize("row_calls", [256, 20])
def test_long_chains_are_no_cycles(spark, monkeypatch, row_calls):
    monkeypatch.setattr(chat, "ROW_CALLS", row_calls)
    n = 200
    rows = [(1, k, "assistant", call((f"c{k}", "say", {"x": {"$result": f"c{k + 1}"}} if k < n - 1 else {}))) for k in range(n)]
    rows += [(1, n + k, "tool", result(f"c{k}")) for k in range(n)]
    rows += [(2, 0, "assistant", call(("a", "say", {"x": {"$result": "b"}}))), (2, 1, "assistant", call(("b", "say", {"x": {"$result": "a"}})))]
    found = formatted(spark, rows)
    assert [r.turn for r in found if r.conv_id == 1] == [t for k in reversed(range(n)) for t in (k, n + k)]
    assert all(r.valid for r in found if r.conv_id == 1)
    assert {r.kind for r in found if r.conv_id == 2} == {"cycle"}


def test_turns_with_calls_of_several_depths(spark):
    need = lambda *ids: {"xs": [{"$result": i} for i in ids]}
    rows = [
        (1, 1, "assistant", call(("x", "say", {}))),
        (1, 2, "tool", result("x")),
        (1, 3, "assistant", call(("a", "say", {}), ("b", "say", need("x")))),
        (1, 4, "tool", result("a")),
        (1, 5, "tool", result("b")),
        # waits for a's result, so for the whole turn 3, though it comes first
        (1, 0, "assistant", call(("c", "say", need("a")))),
        (1, 6, "tool", result("c")),
        # needs inside a turn put its results in order
        (2, 0, "assistant", call(("q", "say", need("p")), ("p", "say", {}))),
        (2, 1, "tool", result("q")),
        (2, 2, "tool", result("p")),
        # each turn waits for the other, though no call waits for itself
        (3, 0, "assistant", call(("d", "say", need("f")), ("e", "say", {}))),
        (3, 1, "assistant", call(("f", "say", need("e")))),
        (3, 2, "tool", result("e")),
        # nothing to wait for beside such conversations
        (4, 0, "tool", result("g")),
        (4, 1, "assistant", call(("g", "say", {}))),
    ]
    found = formatted(spark, rows)
    assert [r.turn for r in found if r.conv_id == 1] == [1, 2, 3, 4, 5, 0, 6]
    assert [(r.turn, r.valid) for r in found if r.conv_id == 2] == [(0, True), (2, True), (1, True)]
    assert [(r.turn, r.kind) for r in found if r.conv_id == 3] == [(0, "cycle"), (2, "result"), (1, "cycle")]
    assert [(r.turn, r.kind) for r in found if r.conv_id == 4] == [(1, "call"), (0, "result")]


def test_odd_turns(spark):
    rows = [(1, 0, None, None), (1, 1, "tool", "{broken"), (1, 2, "assistant", "{}"), (1, 3, "tool", "[1]"), (None, 0, "user", "é\n\"x\""), (None, 0, "user", "é\n\"x\""), (3, 0, "assistant", call(("d", "say", {}))), (3, 1, "assistant", call(("d", "say", {}))), (4, None, "user", "no turn"), (5, 0, "assistant", '{"tool_calls": [1, null]}')]
    found = formatted(spark, [r for r in rows if r[1] is not None])
    assert len(found) == 9
    assert [r.kind for r in found if r.conv_id == 3] == ["call", "duplicate_call"]
    assert [r.message for r in found if r.conv_id is None] == ['{"content":"é\\n\\"x\\"","role":"user"}'] * 2
    assert chat.format_chats(spark.createDataFrame(rows, TURNS)).count() == len(rows)
    assert chat.format_chats(spark.createDataFrame([], TURNS)).count() == 0


def brute_windows(text):
    """Best coefficient of each template over all windows of the text."""
    import re

    plain = lambda u: re.sub(licenses.GAP, " ", u.lower()).strip()
    whole = {plain(v) for v in licenses.TEMPLATES.values()}
    words = " ".join(u for u in map(plain, (text or "").split("\n")) if u and u not in whole).split()
    run = [f"{a} {b}" for a, b in zip(words, words[1:])]
    out = {}
    for name, t in licenses.TEMPLATES.items():
        b = set(licenses.template_bigrams(t))
        best = 0
        for i in range(len(run)):
            seen, shared = set(), 0
            for j in range(i, min(len(run), i + int(len(b) * 1.5 + 1e-9))):
                if run[j] not in seen:
                    seen.add(run[j])
                    shared += run[j] in b
                best = max(best, 2 * shared / (len(seen) + len(b)))
        if best >= licenses.THRESHOLD:
            out[name] = round(best, 9)
    return out


def test_windows_equal_brute_force(make_docs):
    import random

    rng = random.Random(4)
    prose = "the software of this text may be used in many ways by persons who like words and notices of copyright".split()
    rows = []
    for i in range(24):
        words = rng.choice(sorted(licenses.TEMPLATES.values())).split()
        for _ in range(rng.randrange(0, 1 + len(words) // 6)):  # cut, change and swell the notice
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([[], ["changed"], [words[at], "extra"]])
            words = words or ["none"]
        around = [" ".join(rng.choice(prose) for _ in range(rng.randrange(0, 30))) for _ in range(2)]
        rows.append((i, f"{around[0]} {' '.join(words)} {around[1]}".replace(". ", rng.choice([". ", ".\n * "]))))
    rows.append((90, "# " + licenses.TEMPLATES["Apache-2.0-header"] + "\nint main() { return 0; }"))
    found = {r.doc_id: {m.license: round(m.dice, 9) for m in r.embedded} for r in licenses.scan(make_docs(rows)).collect()}
    assert found == {i: brute_windows(t) for i, t in rows}
    assert sum(map(bool, found.values())) > 15
    best = {r.doc_id: r.license for r in licenses.best_license(licenses.scan(make_docs(rows))).collect()}
    assert best[90] == "Apache-2.0-header"


def test_whole_texts(make_docs):
    bsd = licenses.TEMPLATES["BSD-2-Clause-text"].replace(" 1. ", "\n\n1. ").replace(" 2. ", "\n2. ").replace(" THIS", "\n\nTHIS")
    found = licenses.best_license(licenses.scan(make_docs([(1, "Copyright 2020 A. Person\n\n" + bsd + "\n\nsome code follows here")]))).first()
    assert found.license in ("BSD-2-Clause-text", "BSD-redistribution") and found.dice > 0.95

"""Operator 9: chat formatting with linked tool calls.

Input: one row per turn (``conv_id, turn, role, text``).  An assistant turn
whose text is a JSON object with a ``tool_calls`` array makes calls
(``id, name, arguments``); a turn of role ``tool`` whose text is a JSON object
with ``tool_call_id`` is a result.  Output: one row per turn with its canonical
JSON (sorted keys, no blanks, no escapes beyond JSON's) and its place in a
topological order of the conversation:

* a result is linked to its call by a hash join on conversation and call id
  and placed after the call's turn, whatever its own turn;
* a turn with calls whose arguments name other calls' results, as
  ``{"$result": "<call id>"}``, is placed after all of them; results that calls
  of one turn need of each other are put in order after the turn.

The place is a key, ``(anchor, depth, slot, turn)``, computed per turn: no
conversation is gathered in a task, however long it is.

Defined results: null role or text is a JSON null; a text that isn't JSON is a
plain turn, and ``malformed`` if it names calls or a result but is no strict JSON
(NaN, numbers that overflow, half surrogate pairs, nesting beyond what the JSON
library follows); whole numbers of any size are integers; of several calls with
one id in a conversation the first is linked and the others are
``duplicate_call``; a result without call is ``orphan_result`` and keeps its own
turn; turns whose calls wait for each other, or for such calls, are ``cycle`` and
keep theirs, with their results after them; null conversation ids form one
conversation and null turns of a conversation are one place, before all others;
very long texts are parsed whole; repeated rows stay; empty tables give an empty
result; other columns are never read.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, cut, map_rows, table


#: Calls of a conversation that is ordered as one row.
ROW_CALLS = 256


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _kinds(value: object) -> set[str]:
    """The JSON schema types that a value has."""
    if isinstance(value, bool):
        return {"boolean"}
    if isinstance(value, (int, float)):
        whole = isinstance(value, int) or value.is_integer()
        return {"number", "integer"} if whole else {"number"}
    return {"string"} if isinstance(value, str) else {"object"} if isinstance(value, dict) else {"array"} if isinstance(value, list) else {"null"}


def problems(value: object, schema: Mapping, at: str = "$") -> list[str]:
    """What ``value`` violates of a JSON schema's ``type``, ``enum``,
    ``minLength``, ``properties``, ``required``, ``additionalProperties`` and
    ``items``.  It goes no deeper than the schema does."""
    wanted = schema.get("type")
    wanted = [wanted] if isinstance(wanted, str) else wanted
    if wanted and not _kinds(value) & set(wanted):
        return [f"{at}: not of type {' or '.join(wanted)}"]
    out = [] if "enum" not in schema or canonical(value) in map(canonical, schema["enum"]) else [f"{at}: not in enum"]
    if isinstance(value, str) and len(value) < schema.get("minLength", 0):
        out.append(f"{at}: shorter than {schema['minLength']}")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, v in sorted(value.items()):
            if k in known:
                if _reference(v) is None:
                    out += problems(v, known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: not expected")
    if isinstance(value, list) and "items" in schema:
        out += [p for i, v in enumerate(value) if _reference(v) is None for p in problems(v, schema["items"], f"{at}[{i}]")]
    return out


def _reference(value: object) -> str | None:
    """The call id that an argument takes its value from."""
    if isinstance(value, dict) and set(value) == {"$result"} and isinstance(value["$result"], str):
        return value["$result"]
    return None


def _references(value: object) -> set[str]:
    """All call ids that a value names, however deep."""
    out, todo = set(), [value]
    while todo:
        x = todo.pop()
        if (own := _reference(x)) is not None:
            out.add(own)
        else:
            todo += x.values() if isinstance(x, dict) else x if isinstance(x, list) else ()
    return out


def _refuse(what: str):
    raise ValueError(f"{what} is no JSON")


def _finite(digits: str) -> float:
    return x if math.isfinite(x := float(digits)) else _refuse("a number out of range")


def strict_json(text: str) -> object:
    """The value of a JSON text.  ValueError for whatever the format or UTF-8
    can't hold again (NaN, numbers that overflow, halves of surrogate pairs) and
    for texts nested deeper than the JSON library follows."""
    try:
        value = json.loads(text, parse_constant=_refuse, parse_float=_finite)
        if "\\ud" in text.lower():
            canonical(value).encode()
    except RecursionError:
        _refuse("so deep a nesting")
    return value


def _object(text: str | None) -> dict | None:
    if not text or not text.lstrip().startswith("{"):
        return None
    try:
        found = strict_json(text)
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def parse_turn(role: str | None, text: str | None, schemas: Mapping[str, Mapping]) -> tuple[str, str, str | None, list, list[str]]:
    """``kind, message, result_of, calls, errors`` of one turn."""
    plain = canonical({"role": role, "content": text})
    if role not in ("assistant", "tool") or not text or not text.lstrip().startswith("{"):
        return "plain", plain, None, [], []
    try:
        found = strict_json(text)
        if role == "tool" and isinstance(found.get("tool_call_id"), str):
            return "result", canonical({"role": role, **found}), found["tool_call_id"], [], []
        if role == "assistant" and isinstance(found.get("tool_calls"), list):
            return _calls(found, schemas)
    except (ValueError, RecursionError) as e:
        if '"tool_calls"' in text or '"tool_call_id"' in text:
            return "malformed", plain, None, [], [str(e)]
    return "plain", plain, None, [], []


def _calls(found: dict, schemas: Mapping[str, Mapping]) -> tuple[str, str, None, list, list[str]]:
    calls, errors, seen = [], [], []
    for call in found["tool_calls"]:
        call = call if isinstance(call, dict) else {}
        name, id_, args = call.get("name"), call.get("id"), call.get("arguments", {})
        if isinstance(args, str) and (read := _object(args)) is not None:
            args = read
        own = ["no id"] if not isinstance(id_, str) else []
        if not isinstance(name, str):
            own.append("no name")
        elif name in schemas:
            own += problems(args, {"type": "object", **schemas[name]})
        elif schemas:
            own.append(f"unknown tool {name}")
        errors += [f"{id_ if isinstance(id_, str) else canonical(id_)}: {e}" for e in own]
        seen.append({**call, "arguments": args})
        if isinstance(id_, str):
            calls.append({"id": id_, "needs": sorted(_references(args) - {id_})})
    return "call", canonical({"role": "assistant", **found, "tool_calls": seen}), None, calls, errors


def format_chats(turns: DataFrame, schemas: Mapping[str, Mapping] | None = None) -> DataFrame:
    """``conv_id, turn, anchor, depth, slot, kind, valid, errors, message``.

    Ordering each conversation by ``(anchor, depth, slot, turn)`` gives a
    topological order, however long chains of calls that need each other's
    results are.
    """
    schemas = dict(schemas or {})
    kind = dict(turns.dtypes)
    rows = columns(turns, "conv_id", "turn", "role", "text")

    def make():
        def parse(row):
            what, message, result_of, calls, errors = parse_turn(row[2], row[3], schemas)
            return [(row[0], row[1], what, message, result_of, calls, errors)]

        return parse

    parsed = map_rows(rows, f"conv_id {kind['conv_id']}, turn {kind['turn']}, kind string, message string, result_of string, calls array<struct<id:string,needs:array<string>>>, errors array<string>", make)
    parsed = cut(parsed)
    # the first call of each id: one row per key, so results can't multiply
    called = parsed.where("kind = 'call'").select("conv_id", "turn", F.posexplode("calls").alias("slot", "c")).select("conv_id", "turn", "slot", F.col("c.id").alias("call_id"), F.col("c.needs").alias("needs"))
    key = F.col("conv_id").eqNullSafe(F.col("cc"))
    first = called.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "slot", "needs")).alias("f"), F.count("*").alias("times"))
    calls = cut(first.select(F.col("conv_id").alias("cc"), "call_id", F.col("f.turn").alias("call_turn"), F.col("f.slot").alias("call_slot"), F.col("f.needs").alias("needs"), "times"))
    places = _places(calls)
    if places is None:
        own = calls.withColumns({"depth": F.lit(1), "anchor": F.col("call_turn"), "turn_depth": F.lit(0), "turn_anchor": F.col("call_turn")})
    else:
        own = calls
        for node, depth, anchor in ((_turn_node(), "turn_depth", "turn_anchor"), (_call_node(), "depth", "anchor")):
            at = places.select(F.col("cc").alias("pc"), F.col("x").alias("px"), F.col("depth").alias(depth), F.col("anchor").alias(anchor))
            own = own.join(at, F.col("cc").eqNullSafe(F.col("pc")) & (node == F.col("px")), "left").drop("pc", "px")
    # a turn with a call in a cycle keeps its place, and so do all its results
    per_turn = own.groupBy("cc", "call_turn").agg(F.max("turn_depth").alias("call_depth"), F.max("turn_anchor").alias("call_anchor"), F.max(F.col("depth").isNull()).alias("in_cycle"))
    stuck = per_turn.where("in_cycle").select(F.col("cc").alias("sc"), F.col("call_turn").alias("st"), F.col("in_cycle").alias("kept"))
    placed = own.join(stuck, F.col("cc").eqNullSafe(F.col("sc")) & F.col("call_turn").eqNullSafe(F.col("st")), "left").withColumn("kept", F.coalesce("kept", F.lit(False))) if places is not None else own.withColumn("kept", F.lit(False))
    placed = placed.select("cc", "call_id", "call_turn", "call_slot", F.when(F.col("kept"), F.col("call_turn")).otherwise(F.col("anchor")).alias("call_anchor"), F.when(F.col("kept"), 1).otherwise(F.col("depth")).alias("result_depth"))
    plain = parsed.where("kind IN ('plain', 'malformed')").select("conv_id", "turn", F.col("turn").alias("anchor"), F.lit(0).alias("depth"), F.lit(0).alias("slot"), "kind", "errors", "message")
    made = parsed.where("kind = 'call'").join(per_turn, key & F.col("turn").eqNullSafe(F.col("call_turn")), "left").select(
        "conv_id",
        "turn",
        F.when(F.coalesce("in_cycle", F.lit(False)), F.col("turn")).otherwise(F.coalesce("call_anchor", "turn")).alias("anchor"),
        F.when(F.coalesce("in_cycle", F.lit(False)), 0).otherwise(F.coalesce("call_depth", F.lit(0))).cast("int").alias("depth"),
        F.lit(0).alias("slot"),
        F.when(F.coalesce("in_cycle", F.lit(False)), "cycle").when(F.col("in_cycle").isNull() & (F.size("calls") > 0), "duplicate_call").otherwise(F.lit("call")).alias("kind"),
        "errors",
        "message",
    )
    linked = parsed.where("kind = 'result'").join(placed, key & (F.col("result_of") == F.col("call_id")), "left").select(
        "conv_id",
        "turn",
        F.coalesce("call_anchor", "turn").alias("anchor"),
        F.when(F.col("call_id").isNull(), 0).otherwise(F.col("result_depth")).cast("int").alias("depth"),
        F.coalesce("call_slot", F.lit(0)).alias("slot"),
        F.when(F.col("call_id").isNull(), "orphan_result").otherwise(F.lit("result")).alias("kind"),
        "errors",
        "message",
    )
    every = plain.unionByName(made).unionByName(linked)
    valid = (F.size("errors") == 0) & F.col("kind").isin("plain", "call", "result")
    return every.select("conv_id", "turn", "anchor", "depth", F.col("slot").cast("int").alias("slot"), "kind", valid.alias("valid"), "errors", "message")


def _turn_node():
    return F.concat(F.lit("t"), F.coalesce(F.col("call_turn").cast("string"), F.lit("")))


def _call_node():
    return F.concat(F.lit("c"), F.col("call_id"))


def order_calls(calls: list[tuple[str, int | None, list[str]]]) -> list[tuple[str, int | None, int | None]]:
    """``node, depth, anchor`` of the turns and calls of one conversation that no
    cycle leads to; ``calls`` are ``id, turn, needs``.  Linear in their size."""
    turn_of = {id_: turn for id_, turn, _ in calls}
    nodes: dict[tuple, list] = {("t", turn): [0, 0, turn] for turn in turn_of.values()}  # waits for so many, depth, anchor
    after: dict[tuple, list[tuple]] = {node: [] for node in nodes}
    for id_, turn, needs in calls:
        nodes["c", id_], after["c", id_] = [1, 0, turn], []
        after["t", turn].append(("c", id_))
    for id_, turn, needs in calls:
        for need in set(needs) & turn_of.keys():
            node = ("c", id_) if turn_of[need] == turn else ("t", turn)
            after["c", need].append(node)
            nodes[node][0] += 1
    ready, out = [n for n, state in nodes.items() if not state[0]], []
    while ready:
        node = ready.pop()
        _, depth, anchor = nodes[node]
        out.append((node[0] + ("" if node[1] is None else str(node[1])), depth, anchor))
        for x in after[node]:
            state = nodes[x]
            state[0] -= 1
            state[1] = max(state[1], depth + 1)
            state[2] = state[2] if anchor is None or state[2] is not None and state[2] >= anchor else anchor
            if not state[0]:
                ready.append(x)
    return out


def _places(calls: DataFrame) -> DataFrame | None:
    """``cc, x, depth, anchor`` of turns with calls and of the calls' results;
    None if no call needs another.  A result
    comes after its call's turn; a turn after the results that any of its calls
    needs; the result of a call that needs one of its own turn after that.

    Conversations of at most ``ROW_CALLS`` calls are ordered as one row each;
    longer ones as edges, in rounds, so that none is gathered in a task."""
    there = calls.select(F.col("cc").alias("nc"), F.col("call_id").alias("need"), F.col("call_turn").alias("need_turn"))
    needs = calls.select("cc", "call_id", "call_turn", F.explode("needs").alias("need"))
    needs = cut(needs.join(there, F.col("cc").eqNullSafe(F.col("nc")) & (needs["need"] == there["need"])).select("cc", "call_id", "call_turn", needs["need"], "need_turn"))
    if needs.isEmpty():
        return None
    kind = dict(calls.dtypes)
    sizes = calls.groupBy("cc").agg(F.count("*").alias("n")).join(needs.select(F.col("cc").alias("nc")).distinct().withColumn("waits", F.lit(True)), F.col("cc").eqNullSafe(F.col("nc")), "left")
    sizes = cut(sizes.select(F.col("cc").alias("sc"), "n", F.coalesce("waits", F.lit(False)).alias("waits")))
    of = lambda which: calls.join(sizes.where(which), F.col("cc").eqNullSafe(F.col("sc")), "left_semi")
    # conversations without needs take no part
    rest = of("NOT waits")
    place = lambda x, depth: rest.select("cc", x.alias("x"), F.lit(depth).cast("long").alias("depth"), F.col("call_turn").alias("anchor"))
    plain = place(_turn_node(), 0).distinct().unionByName(place(_call_node(), 1))
    rows = of(f"waits AND n <= {ROW_CALLS}").groupBy("cc").agg(F.collect_list(F.struct("call_id", "call_turn", "needs")).alias("calls"))

    def make():
        return lambda row: [(row[0], *node) for node in order_calls([(c["call_id"], c["call_turn"], c["needs"]) for c in row[1]])]

    found = plain.unionByName(map_rows(rows, f"cc {kind['cc']}, x string, depth long, anchor {kind['call_turn']}", make))
    if not sizes.where(f"waits AND n > {ROW_CALLS}").isEmpty():
        found = found.unionByName(_rounds(of(f"waits AND n > {ROW_CALLS}"), needs.join(sizes.where(f"n > {ROW_CALLS}"), F.col("cc").eqNullSafe(F.col("sc")), "left_semi")))
    return cut(found)


def _rounds(live: DataFrame, needs: DataFrame) -> DataFrame:
    edge = lambda x, y, w: ("cc", x.alias("x"), y.alias("y"), F.lit(w).cast("long").alias("w"), F.col("call_turn").alias("a"))
    inside = F.col("need_turn").eqNullSafe(F.col("call_turn"))
    turns = live.select(*edge(_turn_node(), F.lit(None).cast("string"), 0))
    results = live.select(*edge(_call_node(), _turn_node(), 1))
    waits = needs.select(*edge(F.when(inside, _call_node()).otherwise(_turn_node()), F.concat(F.lit("c"), F.col("need")), 1))
    return _longest(turns.unionByName(results).unionByName(waits))


def _longest(edges: DataFrame) -> DataFrame:
    """``cc, x, depth, anchor`` of every node that no cycle leads to: the weight
    of the heaviest path to it and the latest turn on any path.

    ``edges`` are ``cc, x, y, w, a``: ``x`` comes ``w`` after ``y``, or after the
    start if ``y`` is null, and ``a`` is the latest turn on the way.  Each round
    replaces an edge from a node that waits for one other at most by that node's
    own edges, so that chains halve and rounds grow with the log of their length;
    edges never get more than there were with one from the start for each node.
    A round that settles no node leaves cycles and what waits for them.
    """
    size = -1
    while True:
        edges = cut(edges.groupBy("cc", "x", "y").agg(F.max("w").alias("w"), F.max("a").alias("a")))
        open_ = edges.groupBy("cc", "x").agg(F.count("y").alias("n"))
        if (now := open_.where("n = 0").count()) == size:
            break
        size = now
        light = open_.where("n <= 1").select(F.col("cc").alias("oc"), F.col("x").alias("ox"))
        light = edges.join(light, F.col("cc").eqNullSafe(F.col("oc")) & (F.col("x") == F.col("ox"))).select(F.col("cc").alias("lc"), F.col("x").alias("via"), F.col("y").alias("ly"), F.col("w").alias("lw"), F.col("a").alias("la"))
        # weights on cycles double; no path of a table is as long as the bound
        on = edges.join(light, F.col("cc").eqNullSafe(F.col("lc")) & (F.col("y") == F.col("via")), "left")
        edges = on.select("cc", "x", F.when(F.col("via").isNull(), F.col("y")).otherwise(F.col("ly")).alias("y"), F.least(F.col("w") + F.coalesce("lw", F.lit(0)), F.lit(1 << 40)).alias("w"), F.greatest("a", "la").alias("a"))
    settled = open_.where("n = 0").select(F.col("cc").alias("oc"), F.col("x").alias("ox"))
    return edges.join(settled, F.col("cc").eqNullSafe(F.col("oc")) & (F.col("x") == F.col("ox"))).select("cc", "x", F.col("w").alias("depth"), F.col("a").alias("anchor"))


#: The tool of ``as_tool_calls``, and the schema of its arguments.
ANSWER = {"answer": {"properties": {"question": {"type": "string", "minLength": 1}, "after": {"type": "object"}}, "required": ["question"], "additionalProperties": False}}


def as_tool_calls(turns: DataFrame) -> DataFrame:
    """Plain conversations as calls of one tool, row for row: what a user says
    is a call of ``answer`` that needs the result of the call two turns before,
    what the assistant says is the result of the call one turn before."""
    turn = F.col("turn").cast("string")
    id_ = lambda back: F.concat(F.lit("u"), (F.col("turn") - back).cast("string"))
    after = F.when(F.col("turn") >= 2, F.struct(id_(2).alias("$result")))
    call = F.struct(F.concat(F.lit("u"), turn).alias("id"), F.lit("answer").alias("name"), F.struct(F.col("text").alias("question"), after.alias("after")).alias("arguments"))
    made = F.to_json(F.struct(F.array(call).alias("tool_calls")))
    given = F.to_json(F.struct(id_(1).alias("tool_call_id"), F.col("text").alias("content")))
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    role = F.when(user, "assistant").when(assistant, "tool").otherwise(F.col("role"))
    return columns(turns, "conv_id", "turn", "role", "text").select("conv_id", "turn", role.alias("role"), F.when(user, made).when(assistant, given).otherwise(F.col("text")).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given conversations hold no tool calls, so their turns enter as calls
    and results (``as_tool_calls``): each is linked, ordered and validated."""
    found = format_chats(as_tool_calls(table(spark, sf_dir, "conversations")), ANSWER)
    return found.select("conv_id", "turn", "anchor", "depth", "slot", "kind", "valid", F.size("errors").cast("long").alias("n_errors"), "message")


ORACLE_SQL = r"""
WITH u AS (  -- runs of user turns two apart: each needs the one before
  SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, run ORDER BY turn) - 1 AS j
  FROM (SELECT conv_id, turn, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS run FROM conversations WHERE role = 'user')
), x AS (
  SELECT c.*, o.j AS own, p.j AS call, to_json(c.text)::VARCHAR AS t
  FROM conversations c LEFT JOIN u o ON o.conv_id = c.conv_id AND o.turn = c.turn LEFT JOIN u p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1
)
SELECT conv_id, turn,
  CASE WHEN role = 'assistant' AND call IS NOT NULL THEN turn - 1 ELSE turn END AS anchor,
  CASE role WHEN 'user' THEN 2 * own WHEN 'assistant' THEN coalesce(2 * call + 1, 0) ELSE 0 END::BIGINT AS depth,
  0 AS slot,
  CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN CASE WHEN call IS NULL THEN 'orphan_result' ELSE 'result' END ELSE 'plain' END AS kind,
  NOT (role = 'user' AND coalesce(text, '') = '') AND NOT (role = 'assistant' AND call IS NULL) AS valid,
  CASE WHEN role = 'user' AND coalesce(text, '') = '' THEN 1 ELSE 0 END::BIGINT AS n_errors,
  CASE role
    WHEN 'user' THEN '{"role":"assistant","tool_calls":[{"arguments":{' || CASE WHEN turn >= 2 THEN '"after":{"$result":"u' || (turn - 2) || '"},' ELSE '' END || '"question":' || t || '},"id":"u' || turn || '","name":"answer"}]}'
    WHEN 'assistant' THEN '{"content":' || t || ',"role":"tool","tool_call_id":"u' || (turn - 1) || '"}'
    ELSE '{"content":' || t || ',"role":' || to_json(role) || '}' END AS message
FROM x
"""

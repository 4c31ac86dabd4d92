"""Attribution with a watermark for each log partition, event by event.

One stateful operator, keyed by log partition: it replays a micro-batch in
order of arrival against its state and emits output rows, ledger rows and
dead letters as one tagged stream.  All state sits in the state store: the
partition's latest accepted time, recent clicks by user, pending views, and
the content of every id seen, without expiry, since the horizon of duplicates
is unlimited.  So many tasks work as there are log partitions.  Clicks leave
the state by their own partition's watermark, which no view of it can need; the
batch form evicts by the least watermark of all partitions.

A second operator, keyed by id (``guarded``), knows ids over all partitions: an
output row is passed once, and a dead letter if it is invalid or differs from
the one that was passed; a click accepted in two partitions becomes a duplicate
or a conflict in the ledger.  It comes after attribution: a click of such an id
may have won a view of its own partition.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.columns import text_is_blank
from ..schema import CLICK_CONFLICT, CLICK_CONFLICT_MESSAGE, CLICKS_TOPIC, CONFLICT, DEAD_LETTER, DROPPED_LATE, DUPLICATE, INSERTED, INVALID_RECORD, PROCESSED, REPLAY, RETRY_EXHAUSTED, VIEW_CONFLICT, VIEW_CONFLICT_MESSAGE, Settings

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MINUTE = 60_000_000

_TEXT = ("record_kind", "id", "user_id", "url", "campaign_id", "click_id", "topic", "status", "processing_status", "payload", "error_type", "error_message")
_NUMBER = ("ts", "p", "offset_no", "attempt_count")
RECORD = StructType([*[StructField(n, StringType()) for n in _TEXT], *[StructField(n, LongType()) for n in _NUMBER]])


class Partition:
    """The state of one log partition during a micro-batch."""

    def __init__(self, settings: Settings, latest: int | None, pending: dict[str, list], known, clicks):
        self.lateness = settings.allowed_lateness_minutes * MINUTE
        self.window = settings.attribution_window_minutes * MINUTE
        self.view_conflicts = settings.view_conflicts
        self.latest, self.pending = latest, pending
        self.due = [(v[0], id_) for id_, v in pending.items()]
        heapq.heapify(self.due)
        self.known, self.clicks = known, clicks
        self.out: list[dict] = []

    @property
    def watermark(self) -> int | None:
        return None if self.latest is None else self.latest - self.lateness

    def handle(self, e: dict) -> None:
        if e.get("reason") is not None:
            self._letter(e, INVALID_RECORD, e["reason"])
            return
        click = e["kind"] == "click"
        content = [e["user_id"], e["ts"], e["campaign_id"] if click else e["url"]]
        key = f"{e['kind']}:{e['id']}"
        stored = self.known.get(key)
        late = self.watermark is not None and e["ts"] < self.watermark
        strict = click or self.view_conflicts
        status = INSERTED
        if stored is not None:
            same = stored[:3] == content
            status = CONFLICT if strict and not same else REPLAY if same and stored[3:] == [e["topic"], e["offset_no"]] else DUPLICATE
        if status == CONFLICT:
            self._letter(e, CLICK_CONFLICT if click else VIEW_CONFLICT, CLICK_CONFLICT_MESSAGE if click else VIEW_CONFLICT_MESSAGE)
        # the id comes before lateness for clicks, after it for views
        dropped = late and (status == INSERTED or not strict)
        result = DEAD_LETTER if status == CONFLICT else DROPPED_LATE if dropped else PROCESSED
        self._record(e, "ledger", status=status, processing_status=result)
        if dropped or status != INSERTED and strict:
            return
        self.latest = e["ts"] if self.latest is None else max(self.latest, e["ts"])
        if status == INSERTED:
            self.known.put(key, [*content, e["topic"], e["offset_no"]])
            if click:
                self.clicks.add(e["user_id"], [e["ts"], e["id"], e["campaign_id"]])
            else:
                self.pending[e["id"]] = [e["ts"], e["user_id"], e["url"], e["topic"], e["p"], e["offset_no"]]
                heapq.heappush(self.due, (e["ts"], e["id"]))
        self.finalize()

    def finalize(self) -> None:
        while self.due and self.due[0][0] <= self.watermark:
            ts, id_ = heapq.heappop(self.due)
            _, user, url, topic, p, offset = self.pending.pop(id_)
            near = [c for c in self.clicks.of(user) if ts - self.window <= c[0] <= ts]
            won = max(near, default=[None, None, None])
            self.out.append({"record_kind": "output", "id": id_, "user_id": user, "ts": ts, "url": url, "click_id": won[1], "campaign_id": won[2], "topic": topic, "p": p, "offset_no": offset})

    def _record(self, e: dict, kind: str, **more) -> None:
        own = {k: e[k] for k in ("id", "user_id", "url", "campaign_id", "topic", "ts", "p", "offset_no")}
        self.out.append({"record_kind": kind, **own, **more})

    def _letter(self, e: dict, error: str, message: str) -> None:
        self._record(e, "dead_letter", payload=e.get("payload"), error_type=error, error_message=message, attempt_count=1)


class _Known:
    """Contents of ids, read once and written at the end of a batch."""

    def __init__(self, state):
        self.state, self.read, self.fresh = state, {}, {}

    def get(self, key: str) -> list | None:
        if key not in self.read:
            found = self.state.containsKey((key,))
            self.read[key] = json.loads(self.state.getValue((key,))[0]) if found else None
        return self.read[key]

    def put(self, key: str, content: list) -> None:
        self.read[key] = self.fresh[key] = content

    def save(self) -> None:
        for key, content in self.fresh.items():
            self.state.updateValue((key,), (json.dumps(content),))


class _Clicks:
    """Recent clicks of users, those that a later view may still be given."""

    def __init__(self, state):
        self.state, self.users, self.changed = state, {}, set()

    def of(self, user: str) -> list:
        if user not in self.users:
            found = self.state.containsKey((user,))
            self.users[user] = json.loads(self.state.getValue((user,))[0]) if found else []
        return self.users[user]

    def add(self, user: str, click: list) -> None:
        self.of(user).append(click)
        self.changed.add(user)

    def save(self, cutoff: int | None, sweep: bool) -> None:
        """Write changes; a sweep also drops clicks before ``cutoff`` of users
        that this batch did not touch."""
        if sweep:
            for (user,) in list(self.state.keys()):
                self.of(user)
        for user, clicks in self.users.items():
            kept = clicks if cutoff is None else [c for c in clicks if c[0] >= cutoff]
            if not kept and (user not in self.changed or clicks):
                if self.state.containsKey((user,)):
                    self.state.removeKey((user,))
            elif user in self.changed or len(kept) < len(clicks):
                self.state.updateValue((user,), (json.dumps(kept),))


def _frame(records: list[dict]) -> pd.DataFrame:
    # plain objects: numbers with nulls stay whole numbers
    return pd.DataFrame({n: pd.Series([r.get(n) for r in records], dtype=object) for n in RECORD.names})


def _rows(frames: Iterator[pd.DataFrame], order: list[str]) -> list[dict]:
    """Rows of a key in order; they may come in several chunks."""
    batch = pd.concat(list(frames)).sort_values(order, kind="stable")
    return batch.astype(object).where(batch.notna(), None).to_dict("records")


class AttributionProcessor(StatefulProcessor):
    def __init__(self, settings: Settings):
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "ts long, swept long")
        self.pending = handle.getMapState("pending", "id string", "view string")
        self.known = handle.getMapState("known", "id string", "content string")
        self.clicks = handle.getMapState("clicks", "user_id string", "clicks string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest, swept = self.latest.get() if self.latest.exists() else (None, None)
        held = {id_: json.loads(view) for (id_,), (view,) in self.pending.iterator()}
        before = set(held)
        known, clicks = _Known(self.known), _Clicks(self.clicks)
        state = Partition(self.settings, latest, held, known, clicks)
        for e in _rows(rows, ["arrival", "offset_no"]):
            e.update({k: None if e[k] is None else int(e[k]) for k in ("ts", "p", "offset_no")})
            state.handle(e)
        known.save()
        for id_ in before - set(held):
            self.pending.removeKey((id_,))
        for id_ in set(held) - before:
            self.pending.updateValue((id_,), (json.dumps(held[id_]),))
        if state.latest is not None:
            cutoff = state.latest - state.lateness - state.window
            sweep = swept is None or cutoff - swept >= state.window
            clicks.save(cutoff, sweep)
            self.latest.update((state.latest, cutoff if sweep else swept))
        yield _frame(state.out)

    def close(self) -> None:
        pass


def attribution_records(events: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The tagged stream (``RECORD``) of ``events``: a stream of ``kind, id,
    user_id, ts (timestamp), campaign_id, url, topic, p, offset_no, arrival`` and,
    where there are any, ``payload`` and ``reason`` (of broken records).  One
    shuffle, by log partition."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    given = lambda c: F.col(c) if c in events.columns else F.lit(None).cast("string").alias(c)
    typed = events.select(
        "kind",
        F.col("id").cast("string").alias("id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"),
        "campaign_id",
        "url",
        "topic",
        F.col("p").cast("long").alias("p"),
        F.col("offset_no").cast("long").alias("offset_no"),
        F.col("arrival").cast("long").alias("arrival"),
        given("payload"),
        given("reason"),
    )
    return typed.groupBy("p").transformWithStateInPandas(AttributionProcessor(settings or Settings()), RECORD, "Append", "None")


def output_problem(r: dict) -> str | None:
    """Why an output record may not be written; as ``tables.output_problem``."""
    for name, key in (("page_view_id", "id"), ("user_id", "user_id"), ("url", "url")):
        if text_is_blank(r[key]):
            return f"{name} is missing"
    if r["ts"] is None:
        return "event_time is missing"
    return "attribution is incomplete" if text_is_blank(r["campaign_id"]) != text_is_blank(r["click_id"]) else None


#: Groups of ids in the state of the second operator; fixed for a stream's life.
GUARDS = 256


def _guarded_id(r: dict) -> str | None:
    """What the second operator knows a record by, or None if it just passes."""
    if r["record_kind"] == "output":
        return f"view|{r['id']}"
    if r["record_kind"] == "ledger" and r["topic"] == CLICKS_TOPIC and (r["status"], r["processing_status"]) == (INSERTED, PROCESSED):
        return f"click|{r['id']}"
    return None


class GuardProcessor(StatefulProcessor):
    """What was first passed for each id, over all log partitions."""

    def __init__(self, settings: Settings):
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getMapState("first", "id string", "content string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out, known = [], _Known(self.first)
        for r in _rows(rows, ["p", "offset_no"]):
            r = {n: r[n] if n in _TEXT or r[n] is None else int(r[n]) for n in RECORD.names}
            id_ = _guarded_id(r)
            if id_ is None:
                out.append(r)
                continue
            output = r["record_kind"] == "output"
            content = [r["user_id"], r["ts"], r["campaign_id"], *([r["url"], r["click_id"]] if output else [])]
            first = known.get(id_)
            letter = {**r, "record_kind": "dead_letter"}
            if output:
                problem = output_problem(r)
                if problem is None and first is not None and first != content:
                    problem = "page_view_id is stored with other content"
                if problem is not None:
                    out.append({**letter, "error_type": RETRY_EXHAUSTED, "error_message": problem, "attempt_count": self.settings.max_retries + 1})
                    continue
                if first is not None:
                    continue
            elif first is not None and first != content:
                out.append({**letter, "error_type": CLICK_CONFLICT, "error_message": CLICK_CONFLICT_MESSAGE, "attempt_count": 1})
                r.update(status=CONFLICT, processing_status=DEAD_LETTER)
            elif first is not None:
                r.update(status=DUPLICATE)
            if first is None:
                known.put(id_, content)
            out.append(r)
        known.save()
        yield _frame(out)

    def close(self) -> None:
        pass


def guarded(records: DataFrame, settings: Settings | None = None) -> DataFrame:
    """``records`` with ids known over all log partitions.  One shuffle, by
    groups of ids."""
    group = F.pmod(F.xxhash64(F.coalesce("id", F.concat_ws("|", "topic", "p", "offset_no"))), F.lit(GUARDS))
    return records.withColumn("guard", group).groupBy("guard").transformWithStateInPandas(GuardProcessor(settings or Settings()), RECORD, "Append", "None")

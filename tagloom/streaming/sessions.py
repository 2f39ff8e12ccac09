"""Per-session state on streams: write reminders, recall cadence, rolling samples.

Each step function is plain: (state, event) -> (state, output). A stream holds the events of a session back until the
watermark has passed them and then feeds them in order of (time, seq), so the outcome does not depend on how events fall
into micro-batches; a timer at the next held event or at the end of the idle time wakes sessions without new events. A
session restarts after IDLE_DAYS without events, and its state is dropped then. Times are compared with the watermark in whole
milliseconds. Static frames give the same rows, streamed through one sorted partition with one session's state in memory.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.types import StringType, StructField, StructType

from tagloom.params import ReminderParams

MINUTE_US = 60_000_000
IDLE_DAYS = 30.0
# Groups of sessions whose state a stream keeps together; a micro-batch rewrites the groups it touches.
SHARDS = 2048


def trimmed_mean(values: list[int], default: float) -> float:
    ordered = sorted(values)
    cut = max(1, int(len(ordered) * 0.1))
    kept = ordered[cut : len(ordered) - cut]
    if kept:
        return sum(kept) / len(kept)
    return ordered[len(ordered) // 2] if ordered else default


def counted_chars(ring: list[int], length: int, p: ReminderParams = ReminderParams()) -> int:
    """How much of one tool output counts as growth: capped by the default, later by the trimmed mean of recent ones."""
    if length <= p.tool_default:
        return length
    if len(ring) < p.tool_warmup:
        return p.tool_default
    return min(length, int(trimmed_mean(ring, p.tool_default) + 0.5))


REMINDER_STATE = (
    "write_us bigint, nudge_us bigint, anchor_turn int, anchor_step int, anchor_chars bigint, chars bigint, active_ms bigint, active_anchor bigint, "
    "draft_turn int, draft_us bigint, delegating boolean, compress int, ring array<int>"
)
REMINDER_START = (0, 0, 0, 0, -1, 0, 0, 0, -1, 0, False, 0, [])
REMINDER_FIELDS = [part.split()[0] for part in REMINDER_STATE.split(", ")]
REMINDER_OUT = "reason string, amount bigint, delegating boolean, compressed int"


def reminder_step(s: dict, e: dict, p: ReminderParams = ReminderParams()) -> tuple[dict, tuple[str, int] | None]:
    """One event (kind, us, turn, step, chars, active_ms). Returns the state and (reason, amount) when a reminder is due.

    Steps and growth speak for themselves; active time and report turns need a report newer than the last note. All
    four anchors restart after a reminder or a note, and two reminders are never closer than the spacing.
    """
    s = dict(s)
    kind = e["kind"]
    s["active_ms"] += e["active_ms"]
    if kind == "tool":
        s["chars"] += counted_chars(s["ring"], e["chars"], p)
        s["ring"] = ([*s["ring"], e["chars"]] if e["chars"] > 0 else list(s["ring"]))[-p.tool_ring :]
    else:
        s["chars"] += e["chars"]
    if s["anchor_chars"] < 0:
        s["anchor_chars"] = s["chars"]
    if kind == "report" and e["chars"] >= p.report_chars:
        s.update(draft_turn=e["turn"], draft_us=e["us"])
    elif kind == "delegate":
        s["delegating"] = True
    elif kind == "compress":
        s["compress"] += 1
    elif kind == "write":
        s.update(
            write_us=e["us"], anchor_turn=max(s["anchor_turn"], e["turn"]), anchor_step=max(s["anchor_step"], e["step"]), anchor_chars=s["chars"],
            active_anchor=s["active_ms"], delegating=False, compress=0,
        )
        return s, None
    if s["nudge_us"] > 0 and e["us"] - s["nudge_us"] < p.spacing_minutes * MINUTE_US:
        return s, None
    steps = e["step"] - s["anchor_step"] if e["step"] >= s["anchor_step"] else e["step"]
    growth = s["chars"] - s["anchor_chars"]
    progress = s["draft_turn"] >= 0 and s["draft_us"] > s["write_us"]
    active = s["active_ms"] - s["active_anchor"]
    turns = s["draft_turn"] - s["anchor_turn"] if progress else 0
    due = None
    if p.steps > 0 and steps >= p.steps:
        due = ("steps", steps)
    elif p.growth_chars > 0 and growth >= p.growth_chars:
        due = ("growth", growth)
    elif p.report_turns > 0 and progress and turns >= p.report_turns:
        due = ("turns", turns)
    elif p.active_minutes > 0 and progress and active >= p.active_minutes * 60_000:
        due = ("active", active)
    if due:
        s.update(nudge_us=e["us"], active_anchor=s["active_ms"], anchor_turn=max(s["anchor_turn"], e["turn"]), anchor_step=e["step"], anchor_chars=s["chars"])
    return s, due


def _events(frames: Iterator[pd.DataFrame]) -> list[dict]:
    pdf = pd.concat(list(frames)).sort_values(["at", "seq"])
    us = pdf["at"].astype("datetime64[us]").astype("int64")
    return pdf.assign(us=us).to_dict("records")


@dataclass(frozen=True)
class Steps:
    """A step function with its start state; `row` gives the output columns after (session_id, seq, at)."""

    state: str
    start: tuple
    step: Callable
    row: Callable
    out: str
    idle_days: float = IDLE_DAYS

    @property
    def fields(self) -> list[str]:
        return [part.split()[0] for part in self.state.split(", ")]

    def fresh(self) -> dict:
        return {f: list(v) if isinstance(v, list) else v for f, v in zip(self.fields, self.start, strict=True)}

    def feed(self, key, s: dict, last_us: int | None, e: dict) -> tuple[dict, tuple | None]:
        """State after one event and its output row, if any."""
        if last_us is not None and e["us"] - last_us > self.idle_days * 1440 * MINUTE_US:
            s = self.fresh()
        s, hit = self.step(s, e)
        return s, None if hit is None else (key, e["seq"], pd.Timestamp(e["us"], unit="us", tz="UTC"), *self.row(s, hit))

    def schema(self, events: DataFrame) -> StructType:
        key = events.schema["session_id"].dataType.simpleString()
        return StructType.fromDDL(f"session_id {key}, seq bigint, at timestamp, {self.out}")


def _plain(e: dict) -> dict:
    """An event in plain Python values."""
    return {k: None if v is None or v is pd.NaT or v != v else v.item() if hasattr(v, "item") else v for k, v in e.items() if k != "at"}


def step_sessions(events: DataFrame, steps: Steps, late: str = "1 hour", shards: int = SHARDS) -> DataFrame:
    """Output rows of `steps` over events (session_id, seq, at and what the step reads); `at` is a timestamp. Events without
    a time or session are left out. On a stream, events later than `late` are dropped by the watermark and sessions share `shards` groups of state."""
    if events.isStreaming:
        events = events.withWatermark("at", late)
    timed = events.filter(F.col("at").isNotNull() & F.col("session_id").isNotNull()).withColumn("us", F.unix_micros("at"))
    return _stepped_stream(timed, steps, shards) if events.isStreaming else _stepped_frame(timed, steps)


def _parsed(text: str, floats: list[str]) -> dict:
    """An event from its JSON text, in which Spark writes infinite and undefined numbers as strings."""
    e = json.loads(text)
    for c in floats:
        if isinstance(e[c], str):
            e[c] = None if e[c] == "NaN" else float(e[c])
    return e


def _stepped_stream(timed: DataFrame, steps: Steps, shards: int) -> DataFrame:
    """Sessions are dealt to `shards` groups: a call costs more than the events of most sessions, so one serves all of a group.

    The state of a group lists its sessions and holds their events as text; every session keeps its own steps, times and end.
    """
    out = steps.schema(timed)
    idle_ms = int(steps.idle_days * 86_400_000)
    floats = [c for c, kind in timed.dtypes if kind in ("float", "double") and c != "session_id"]
    # A call converts every column of its group on its own, so an event travels as one text.
    body = F.to_json(F.struct(F.col("session_id").cast("string").alias("session_id"), *[c for c in timed.columns if c not in ("session_id", "at")]), {"ignoreNullFields": "false"})
    packed = timed.select(F.pmod(F.xxhash64("session_id"), F.lit(shards)).alias("shard"), "at", body.alias("body"))

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        listed, held = state.get if state.exists else ("[]", [])
        known = {name: (dict(zip(steps.fields, values, strict=True)), last_us, done_ms) for name, values, last_us, done_ms in json.loads(listed)}
        unseen = (None, None, None)
        events = [(_parsed(x, floats), x) for x in held]
        if not state.hasTimedOut:
            for pdf in frames:
                for x in pdf["body"]:
                    e = _parsed(x, floats)
                    done_ms = known.get(e["session_id"], unseen)[2]
                    if done_ms is None or e["us"] // 1000 > done_ms:
                        events.append((e, x))
        events.sort(key=lambda n: (n[0]["us"], n[0]["seq"]))
        mark = state.getCurrentWatermarkMs()
        ready = [e for e, _ in events if e["us"] // 1000 <= mark]
        held = events[len(ready) :]
        rows = []
        for e in ready:
            name = e["session_id"]
            s, last_us, _ = known.get(name, unseen)
            s, row = steps.feed(name, steps.fresh() if s is None else s, last_us, e)
            known[name] = (s, e["us"], mark)
            if row is not None:
                rows.append(row)
        waiting = {e["session_id"] for e, _ in held}
        known = {name: v for name, v in known.items() if name in waiting or v[1] // 1000 + idle_ms >= mark}
        if not held and not known:
            state.remove()
        else:
            state.update((json.dumps([(name, [s[f] for f in steps.fields], *v) for name, (s, *v) in known.items()]), [x for _, x in held]))
            wake = [v[1] // 1000 + idle_ms for name, v in known.items() if name not in waiting] + [e["us"] // 1000 - 1 for e, _ in held[:1]]
            state.setTimeoutTimestamp(max(min(wake), mark + 1))
        if rows:
            yield pd.DataFrame(rows, columns=out.names)

    named = StructType([StructField("session_id", StringType()), *out.fields[1:]])
    found = packed.groupBy("shard").applyInPandasWithState(run, named, "listed string, held array<string>", "append", "EventTimeTimeout")
    return found.withColumn("session_id", F.col("session_id").cast(out["session_id"].dataType))


def _stepped_frame(timed: DataFrame, steps: Steps) -> DataFrame:
    out = steps.schema(timed)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, s, last_us = object(), None, None
        for pdf in frames:
            rows = []
            for e in pdf.to_dict("records"):
                if e["session_id"] != current:
                    current, s, last_us = e["session_id"], steps.fresh(), None
                s, row = steps.feed(current, s, last_us, _plain(e))
                last_us = e["us"]
                if row is not None:
                    rows.append(row)
            if rows:
                yield pd.DataFrame(rows, columns=out.names)

    return timed.repartition("session_id").sortWithinPartitions("session_id", "us", "seq").mapInPandas(run, out)


def write_reminders(events: DataFrame, p: ReminderParams = ReminderParams(), late: str = "1 hour") -> DataFrame:
    """Reminders per session from (session_id, seq, at, kind, turn, step, chars, active_ms)."""
    row = lambda s, hit: (hit[0], int(hit[1]), bool(s["delegating"]), int(s["compress"]))
    return step_sessions(events, Steps(REMINDER_STATE, REMINDER_START, lambda s, e: reminder_step(s, e, p), row, REMINDER_OUT), late)


PROMPT_STATE = "write_us bigint, nudge_us bigint, stops int, progress boolean"
PROMPT_OUT = "stops int"


def prompt_reminder_step(s: dict, e: dict, minutes: float = 7.0, stops: int = 2) -> tuple[dict, int | None]:
    """Variant fed by prompt, stop and write events: progress since the anchor and enough stops or minutes."""
    s = dict(s)
    if e["kind"] == "write":
        return {**s, "write_us": e["us"], "stops": 0, "progress": False}, None
    anchor = max(s["write_us"], s["nudge_us"])
    if anchor == 0:
        s["nudge_us"] = anchor = e["us"]
    if e["kind"] == "prompt":
        s["progress"] = True
        return s, None
    s["stops"] += 1
    if s["progress"] and (s["stops"] >= stops or e["us"] - anchor >= minutes * MINUTE_US):
        return {**s, "nudge_us": e["us"], "stops": 0, "progress": False}, s["stops"]
    return s, None


def prompt_reminders(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return step_sessions(events, Steps(PROMPT_STATE, (0, 0, 0, False), prompt_reminder_step, lambda s, hit: (int(hit),), PROMPT_OUT), late)


CADENCE_STATE = "auto_turn int, auto_step int, compaction bigint, shown_key string, shown_turn int"
CADENCE_OUT = "why string, shown boolean"


def cadence_step(s: dict, e: dict, p: ReminderParams = ReminderParams()) -> tuple[dict, tuple[str, bool] | None]:
    """When recall runs: at a turn start, every few autonomous steps, or after a compaction; equal selections stay silent.

    Event (turn, step, fresh_input, compaction, key). A compaction always shows; an unchanged key shows again after
    the refresh distance.
    """
    s = dict(s)
    start = e["step"] == 1 or bool(e["fresh_input"])
    compacted = e["compaction"] > 0 and e["compaction"] != s["compaction"]
    if e["compaction"] > 0:
        s["compaction"] = e["compaction"]
    due = not start and (s["auto_turn"] != e["turn"] or e["step"] - s["auto_step"] >= p.cadence_steps)
    if not (start or due or compacted):
        return s, None
    s.update(auto_turn=e["turn"], auto_step=e["step"])
    shown = compacted or e["key"] != s["shown_key"] or e["turn"] - s["shown_turn"] >= p.refresh_turns
    if shown:
        s.update(shown_key=e["key"], shown_turn=e["turn"])
    return s, ("start" if start else "compaction" if compacted else "cadence", shown)


def recall_cadence(events: DataFrame, p: ReminderParams = ReminderParams(), late: str = "1 hour") -> DataFrame:
    step = lambda s, e: cadence_step(s, e, p)
    return step_sessions(events, Steps(CADENCE_STATE, (-1, 0, 0, "", -1), step, lambda s, hit: (hit[0], bool(hit[1])), CADENCE_OUT), late)


def rolling_samples(samples: DataFrame, keep: int = 50, late: str = "1 hour") -> DataFrame:
    """Mean and count over the newest `keep` samples per bucket after every micro-batch. Input (session_id, seq, at, omega)."""

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = list(zip(*[list(c) for c in state.get])) if state.exists else []
        new = [(e["us"], e["seq"], e["omega"]) for e in _events(frames)]
        ring = sorted([*[tuple(x) for x in old], *new])[-keep:]
        state.update(tuple([x[i] for x in ring] for i in range(3)))
        values = [x[2] for x in ring]
        yield pd.DataFrame([(key[0], len(values), sum(values) / len(values), min(values), max(values))], columns=["session_id", "n", "mean", "low", "high"])

    return samples.withWatermark("at", late).groupBy("session_id").applyInPandasWithState(
        run, "session_id bigint, n bigint, mean double, low double, high double", "us array<bigint>, seq array<bigint>, omega array<double>", "update", "NoTimeout"
    )

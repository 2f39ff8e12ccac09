"""Session jobs on streams: order across micro-batches, restarts after idle time, and equality with static frames."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tagloom.session import new_stage_path
from tagloom.streaming import sessions as P
from tagloom.streaming import windows as W

START = datetime.datetime(2024, 3, 1)
SCHEMA = "session_id string, seq bigint, at timestamp, kind string, turn int, step int, chars int, active_ms bigint"


def activity(seed=5, n=400):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        minutes = i * 3 + (60 * 24 * 40 if i > n // 2 else 0)
        kind = draw.choice(["tool", "report", "write", "delegate", "compress", "other", "other"])
        rows.append((f"s{draw.choice('aaab')}", i, START + datetime.timedelta(minutes=minutes // 2 * 2), kind, i // 20, draw.randint(0, 60), draw.randint(0, 9000), draw.randint(0, 200_000)))
    return rows


def by_hand(rows):
    out = []
    for key in sorted({r[0] for r in rows}):
        s, last = dict(zip(P.REMINDER_FIELDS, P.REMINDER_START)), None
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            us = int((r[2] - datetime.datetime(1970, 1, 1)).total_seconds()) * 1_000_000
            if last is not None and us - last > P.IDLE_DAYS * 86_400_000_000:
                s = dict(zip(P.REMINDER_FIELDS, P.REMINDER_START))
            last = us
            s, hit = P.reminder_step(s, {"us": us, "kind": r[3], "turn": r[4], "step": r[5], "chars": r[6], "active_ms": r[7]})
            if hit:
                out.append((key, r[1], hit[0], int(hit[1]), s["delegating"], s["compress"]))
    return sorted(out)


def found(frame):
    return sorted((r["session_id"], r["seq"], r["reason"], r["amount"], r["delegating"], r["compressed"]) for r in frame.collect())


def streamed(spark, parts, late):
    """Reminders of parts that arrive one after another, a micro-batch each."""
    folder = new_stage_path(spark, "session-parts")
    for rows in parts:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    rows, progress = W.drain(P.write_reminders(stream, late=late), "session-timers", "append")
    return found(rows.drop("batch")), progress


def test_static_frame_equals_rules_by_hand(spark):
    rows = activity()
    want = by_hand(rows)
    assert len(want) > 20 and len({w[0] for w in want}) == 2
    shuffled = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), SCHEMA).repartition(3)
    assert found(P.write_reminders(shuffled)) == want


@pytest.mark.parametrize("cuts", [[], [130, 260], [50, 51, 201, 330]])
def test_any_split_equals_the_static_frame(spark, cuts):
    rows = activity()
    # Events swap places within half an hour, so parts overlap in time; a later row closes all earlier ones.
    draw = random.Random(len(cuts))
    mixed = sorted(rows, key=lambda r: (r[2] + datetime.timedelta(minutes=draw.randint(0, 30)), r[1]))
    bounds = [0, *cuts, len(mixed)]
    closing = [("end", 10_000, rows[-1][2] + datetime.timedelta(days=1), "other", 0, 0, 0, 0)]
    got, progress = streamed(spark, [*(mixed[a:b] for a, b in zip(bounds, bounds[1:])), closing], "2 hours")
    assert W.dropped_by_watermark(progress) == 0
    assert got == by_hand(rows)


def test_idle_sessions_leave_the_state(spark):
    early = [(f"s{i}", i, START, "other", 0, 0, 0, 0) for i in range(5)]
    late = [("end", 100, START + datetime.timedelta(days=90), "other", 0, 0, 0, 0)]
    _, progress = streamed(spark, [early, late], "1 hour")
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 1


def test_missing_sessions_times_and_empty_input(spark):
    rows = [(None, 1, START, "other", 0, 90, 0, 0), ("a", 2, None, "other", 0, 90, 0, 0), ("a", 3, START, "other", 0, 90, 0, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert found(P.write_reminders(docs)) == [("a", 3, "steps", 90, False, 0)]
    assert P.write_reminders(docs.filter(F.lit(False))).count() == 0

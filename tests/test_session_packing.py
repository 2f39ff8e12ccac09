"""Events reach a group of sessions as one text each, with all their values, and sessions of a group stay apart."""

import datetime

import pytest

from tagloom.session import new_stage_path
from tagloom.streaming import sessions as P
from tagloom.streaming import windows as W

START = datetime.datetime(2024, 3, 1)
SCHEMA = "session_id string, seq bigint, at timestamp, big bigint, part double, name string, flag boolean"
BIG = 2**53 + 1


def test_events_travel_as_one_text_and_keep_their_values(spark):
    values = [(BIG, 0.1, 'a "b"\n', True), (None, float("nan"), None, None), (-BIG, float("inf"), "", False), (3, -1e-300, "ü", None)]
    rows = [("s", i, START + datetime.timedelta(minutes=i), *v) for i, v in enumerate(values)]
    closing = [("end", 9, START + datetime.timedelta(days=1), None, None, None, None)]
    folder = new_stage_path(spark, "packing")
    for part in (rows[2:], rows[:2], closing):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    seen = lambda s, e: (s, (str(e["big"]), repr([e["part"], e["name"], e["flag"]])))
    stepped = P.step_sessions(stream, P.Steps("n int", (0,), seen, lambda s, hit: hit, "big string, rest string"), "2 hours")
    packed = stepped._jdf.queryExecution().analyzed().children().head()
    while "to_json" not in packed.toString().splitlines()[0] and packed.children().nonEmpty():
        packed = packed.children().head()
    assert "to_json" in packed.toString().splitlines()[0] and packed.output().size() == 3
    found, _ = W.drain(stepped, "packing", "append")
    got = [(r["seq"], r["big"], r["rest"]) for r in found.filter("session_id = 's'").orderBy("seq").collect()]
    want = [(0.1, 'a "b"\n', True), (None, None, None), (float("inf"), "", False), (-1e-300, "ü", None)]
    assert got == [(i, str(v[0]), repr(list(w))) for i, (v, w) in enumerate(zip(values, want, strict=True))]


@pytest.mark.parametrize("shards", [1, 3])
def test_sessions_of_a_group_stay_apart(spark, shards):
    """Counts per session restart after idle time; state rows are groups, and idle groups leave."""
    rows = [(k, 100 * k + i, START + datetime.timedelta(minutes=i, days=40 * (i > 3 and k == 2)), None, None, None, None) for k in range(12) for i in range(6)]
    schema = SCHEMA.replace("session_id string", "session_id bigint")
    folder = new_stage_path(spark, "shards")
    early, later = [r for r in rows if r[2].month == 3], [r for r in rows if r[2].month != 3]
    closing = [(99, 9999, START + datetime.timedelta(days=120), None, None, None, None), (99, 10_000, START + datetime.timedelta(days=121), None, None, None, None)]
    for part in (early[1::2], early[::2], later, closing[:1], closing[1:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    count = lambda s, e: ({"n": s["n"] + 1}, s["n"])
    stepped = P.step_sessions(stream, P.Steps("n int", (0,), count, lambda s, hit: (hit,), "n int"), "2 hours", shards)
    assert dict(stepped.dtypes)["session_id"] == "bigint"
    found, progress = W.drain(stepped, "shards", "append")
    got = sorted((r["session_id"], r["seq"], r["n"]) for r in found.collect() if r["session_id"] != 99)
    assert got == [(k, 100 * k + i, i - 4 if k == 2 and i > 3 else i) for k in range(12) for i in range(6)]
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 1
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in progress) <= shards

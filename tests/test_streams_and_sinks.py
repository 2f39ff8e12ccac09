from pyspark.sql import functions as F

from tagloom.params import ReminderParams
from tagloom.session import new_stage_path
from tagloom.sinks import artifacts as A
from tagloom.sinks import notes as K
from tagloom.sources import logs as G
from tagloom.sources.notes import draft_queue, match_drafts, newest_per_bucket, scan_notes
from tagloom.streaming import sessions as P
from tagloom.streaming import windows as W
from tagloom.streaming.guardian import guardian_round

M = 60_000_000


def events(*rows):
    base = {"us": 0, "turn": 1, "step": 0, "chars": 0, "active_ms": 0, "kind": "other"}
    return [{**base, **r} for r in rows]


def run(rows, p=ReminderParams()):
    s, hits = dict(zip(P.REMINDER_FIELDS, P.REMINDER_START)), []
    for i, e in enumerate(rows):
        s, hit = P.reminder_step(s, e, p)
        if hit:
            hits.append((i, hit[0]))
    return hits, s


def test_reminder_anchors():
    assert run(events({"us": M, "step": 39}, {"us": 2 * M, "step": 40}, {"us": 3 * M, "step": 90}, {"us": 8 * M, "step": 90}))[0] == [(1, "steps"), (3, "steps")]
    assert run(events({"us": M, "kind": "report", "chars": 500, "turn": 1}, {"us": 2 * M, "kind": "report", "chars": 500, "turn": 2}))[0] == [(1, "turns")]
    assert run(events({"us": M, "kind": "report", "chars": 500}, {"us": 2 * M, "active_ms": 8 * 60_000}))[0] == [(1, "active")]
    assert run(events({"us": M, "active_ms": 60 * 60_000}))[0] == []
    assert run(events({"us": M, "chars": 10}, {"us": 2 * M, "chars": 50_000}))[0] == [(1, "growth")]
    assert run(events({"us": M, "kind": "report", "chars": 500}, {"us": 2 * M, "kind": "write"}, {"us": 3 * M, "active_ms": 9 * 60_000}))[0] == []
    tools = [{"us": M + i, "kind": "tool", "chars": 40_000} for i in range(8)]
    assert run(events(*tools))[0] == []
    _, s = run(events({"us": 1, "kind": "delegate"}, {"us": 2, "kind": "compress"}, {"us": 3, "kind": "write"}, {"us": 4, "kind": "compress"}))
    assert (s["delegating"], s["compress"]) == (False, 1)


def test_tool_cap():
    assert P.counted_chars([], 100) == 100
    assert P.counted_chars([1] * 7, 9000) == 4000
    assert P.counted_chars([5000] * 10, 9000) == 5000
    assert P.trimmed_mean([1], 7) == 1 and P.trimmed_mean([], 7) == 7


def test_cadence():
    s, out = dict(auto_turn=-1, auto_step=0, compaction=0, shown_key="", shown_turn=-1), []
    for turn, step, comp, key in [(1, 1, 0, "a"), (1, 5, 0, "a"), (1, 16, 0, "a"), (1, 17, 9, "a"), (2, 1, 9, "b"), (3, 1, 9, "b"), (10, 1, 9, "b")]:
        s, hit = P.cadence_step(s, {"turn": turn, "step": step, "fresh_input": False, "compaction": comp, "key": key})
        out.append(hit)
    assert out == [("start", True), None, ("cadence", False), ("compaction", True), ("start", True), ("start", False), ("start", True)]


def test_prompt_variant():
    s, hits = dict(write_us=0, nudge_us=0, stops=0, progress=False), []
    for us, kind in [(M, "prompt"), (2 * M, "stop"), (3 * M, "stop"), (4 * M, "stop"), (5 * M, "write"), (6 * M, "prompt"), (13 * M, "stop")]:
        s, hit = P.prompt_reminder_step(s, {"us": us, "kind": kind})
        hits.append(hit)
    assert hits == [None, None, 2, None, None, None, 1]


def test_late_rows_are_dropped_and_counted(spark):
    path = new_stage_path(spark, "late")
    schema = "k string, at timestamp, value double"
    row = lambda at: [("a", at, 1.0)]
    for i, at in enumerate(["2024-01-01 00:00:00", "2024-01-02 00:00:00", "2024-01-01 00:30:00"]):
        spark.createDataFrame(row(at), "k string, at string, value double").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    rows, progress = W.drain(W.event_counts(stream, ["k"], "at", "1 hour", late="10 minutes"), "late-counts", "update")
    total = W.newest(rows, ["start", "k"]).agg(F.sum("n").alias("n")).first()["n"]
    assert total + W.dropped_by_watermark(progress) == 3


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 3, i % 5, "passive" if i % 2 else "active", f"2024-01-01 00:{i:02d}:00") for i in range(40)], "event_id bigint, bucket bigint, file_id bigint, kind string, at string").withColumn("at", F.col("at").cast("timestamp"))
    df = df.unionByName(df.limit(10))
    path = str(tmp_path / "in")
    df.write.parquet(path)
    rows, _ = W.drain(W.usage(spark.readStream.schema(df.schema).parquet(path)), "usage", "update")
    key = lambda d: sorted(map(tuple, d.select("bucket", "file_id", "passive", "active").collect()))
    assert key(W.newest(rows, ["bucket", "file_id"])) == key(W.usage(df))


def tables(spark):
    return {
        "files": spark.createDataFrame([(1, "p1", "b", "x"), (2, "p2", "b", "y")], "file_id bigint, path string, bucket string, checksum string").withColumn("updated_at", F.lit(1)),
        "chunks": spark.createDataFrame([(1, 1, 0, "one"), (2, 2, 0, "two")], "chunk_id bigint, file_id bigint, chunk_index int, content string").withColumn("vector", F.array(F.lit(1.0))),
        "file_tags": spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 11, 1)], "file_id bigint, tag_id bigint, position int"),
        "tags": spark.createDataFrame([(10, "a"), (11, "b"), (12, "idle")], "tag_id bigint, name string").withColumn("vector", F.array(F.lit(0.5))),
    }


def test_upsert_keeps_ids_and_collects_orphans(spark):
    new = spark.createDataFrame([(7, "p1", "b", "z", 2, "uno", ["b", "c", "b"]), (3, "p3", "b", "w", 2, "three", ["c"])], "file_id bigint, path string, bucket string, checksum string, updated_at int, content string, tags array<string>").withColumn("vector", F.array(F.lit(2.0)))
    out = K.upsert_notes(tables(spark), new)
    assert {(r["file_id"], r["path"]) for r in out["files"].collect()} == {(1, "p1"), (2, "p2"), (3, "p3")}
    names = {r["tag_id"]: r["name"] for r in out["tags"].collect()}
    assert set(names.values()) == {"b", "c", "idle"} and names[11] == "b"
    assert {(r["file_id"], names[r["tag_id"]], r["position"]) for r in out["file_tags"].collect()} == {(1, "b", 1), (1, "c", 2), (2, "b", 1), (3, "c", 1)}
    assert {r["content"] for r in out["chunks"].collect()} == {"uno", "two", "three"}


def test_archive(spark):
    ledger = spark.createDataFrame([(1, 5), (2, 6)], "file_id bigint, passive bigint")
    rest, gone = K.archive_notes(tables(spark), spark.createDataFrame([(1,)], "file_id bigint"), ledger)
    assert [r["file_id"] for r in rest["files"].collect()] == [2] and [r["content"] for r in gone.collect()] == ["one"]
    assert rest["ledger"].count() == 1


def test_embedding_cache_embeds_each_miss_once(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id bigint, text string")
    known = spark.createDataFrame([("b",), ("old",)], "t string").select(F.sha2("t", 256).alias("sha"), F.when(F.col("t") == "b", F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array(F.lit(0.0))).cast("array<float>").alias("vector"))
    vectors, added = K.embed_with_cache(texts, known, lambda batch: [[float(len(t)), 0.0] for t in batch], 2)
    assert {r["id"]: r["vector"] for r in vectors.collect()} == {1: [1.0, 0.0], 2: [1.0, 0.0], 3: [1.0, 2.0]}
    assert added.count() == 1


def test_guardian_round_publishes_once(spark):
    root = new_stage_path(spark, "guardian")
    first = guardian_round(spark, root, tables(spark), {"none": spark.range(1)})
    again = guardian_round(spark, root, {**tables(spark), "last_snapshot": spark.createDataFrame([("b", 3)], "bucket string, files bigint")}, {"none": spark.range(2)})
    assert first["rebuilt"] and not again["rebuilt"] and first["signature"] == again["signature"]
    assert again["lost"].count() == 1 and spark.read.parquet(f"{root}/reports/none").count() == 2
    assert A.graph_signature(tables(spark)["file_tags"].repartition(3), "x") == A.graph_signature(tables(spark)["file_tags"], "x")


def test_text_sources(spark, tmp_path):
    for name, body in {"b1/n1.md": "# One\ntext\nTag: a, b", "b1/n2.md": "plain\nlast line", "b2/n3.md": "# Three\nTag: c"}.items():
        f = tmp_path / "notes" / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(body)
    notes = scan_notes(spark, f"{tmp_path}/notes/*/*.md")
    assert {(r["bucket"], r["title"], tuple(r["tags"])) for r in notes.collect()} == {("b1", "One", ("a", "b")), ("b1", "n2", ()), ("b2", "Three", ("c",))}
    assert newest_per_bucket(notes).count() == 2
    (tmp_path / "drafts").mkdir()
    (tmp_path / "drafts" / "abc123.md").write_text("bucket: b1\nsession: s1\nturn: 3\nat: 2024-01-01 00:00:00\n\n## user\nhello\n## assistant\nworld\n")
    d = draft_queue(spark, f"{tmp_path}/drafts").first()
    assert (d["draft_id"], d["turn"], d["user_text"], d["assistant_text"]) == ("abc123", 3, "hello", "world")
    m = match_drafts(spark.createDataFrame([("c12",), ("zz",)], "request string"), draft_queue(spark, f"{tmp_path}/drafts"))
    assert {r["request"]: r["status"] for r in m.collect()} == {"c12": "unique", "zz": "missing"}


def test_log_lines(spark):
    lines = ["[2024-01-01T00:00:00.5Z] [info] inject ids=D1,D2 omega=0.5 regime=dense session=s1 gate={passed:true maxKnn:0.7} elapsedMs=12", "[2024-01-01T00:00:01Z] [info] inject-skip reason=gate-below-threshold", "noise"]
    rows = G.parse_log(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert len(rows) == 2 and rows[0]["ids"] == ["D1", "D2"] and rows[0]["gate_passed"] and rows[0]["elapsed_ms"] == 12 and rows[1]["reason"] == "gate-below-threshold"
    h = G.parse_health(spark.createDataFrame([("[2024-01-01T00:00:00.000Z] round=3 components=1 hub=n/a omegaMean=n/a omegaN=0 uncovered=1/2 used=1/2",)], "value string")).first()
    assert (h["round"], h["hub"], h["omega_mean"], h["never_recalled"]) == (3, None, None, 1)


def test_approve_writes_only_what_passes(spark):
    from tagloom.plans.govern import approve

    rows = [
        (5, "p5", "b", "h", 3, "text", ["a", "b"], "T", "why"),
        (6, "p6", "b", "h", 3, "text", ["a", "b", "c"], "T", "why"),
        (7, "p7", "n", "h", 3, "text", ["a", "b", "new"], "T", "why"),
        (8, "p8", "n", "h", 3, "text", ["a", "b", "new"], "T", None),
        (9, "p9", "n", "h", 3, "text", ["a", "b", "idle"], None, "why"),
    ]
    schema = "file_id bigint, path string, bucket string, checksum string, updated_at int, content string, tags array<string>, title string, new_tag_reason string"
    drafts = spark.createDataFrame(rows, schema).withColumn("vector", F.array(F.lit(1.0)))
    counts = spark.createDataFrame([], "bucket string, tag_id bigint, files bigint, total bigint")
    outcome, after = approve(drafts, tables(spark), counts)
    assert {r["file_id"]: r["outcome"] for r in outcome.collect()} == {5: "too-few-tags", 6: "near-duplicate", 7: "written", 8: "unconfirmed-new-tags", 9: "missing-title"}
    assert {r["path"] for r in after["files"].collect()} == {"p1", "p2", "p7"}


def session_lines():
    import json

    def line(kind, at, **data):
        return json.dumps({"type": kind, "time": at, "data": data})

    m = 60_000
    call = lambda at, i, name: line("tool/call", at, name=name, callId=i)
    answer = lambda at, i, bad=False: line("tool/result", at, message={"content": [{"type": "text"}, {"toolCallId": i, "isError": bad, "content": [{"text": "x"}]}]})
    day = 24 * 60 * m
    return [
        [("s-1", call(m, "a", "note_write")), ("s-1", call(2 * m, "b", "note_read")), ("s-2", call(2 * m, "a", "note_read"))],
        [("s-1", answer(3 * m, "a")), ("s-2", answer(4 * m, "a", True)), ("s-1", call(5 * m, "c", "note_write"))],
        [("s-1", answer(200 * m, "b")), ("s-1", answer(6 * m, "c"))],
        [("s-9", call(day, "z", "tick")), ("s-9", answer(day, "y"))],
        [("s-9", call(2 * day, "z2", "tick")), ("s-9", answer(2 * day, "y2"))],
    ]


def test_calls_meet_their_results_in_batch_and_stream(spark, tmp_path):
    from tagloom.streaming.calls import answered_calls, calls_and_results, tool_counts

    parts = session_lines()
    events = G.parse_sessions(spark.createDataFrame([x for p in parts for x in p], "session_id string, value string")).withColumn("at", F.col("at").cast("timestamp"))
    key = lambda df: {(r["session_id"], r["call_id"]): (r["ms"], r["is_error"]) for r in df.filter("name <> 'tick'").collect()}
    batch = answered_calls(*calls_and_results(events))
    # The result of b comes after the bound.
    assert key(batch) == {("s-1", "a"): (120_000, False), ("s-1", "b"): (None, None), ("s-2", "a"): (120_000, True), ("s-1", "c"): (60_000, False)}
    path = str(tmp_path / "events")
    for p in parts:
        spark.createDataFrame(p, "session_id string, value string").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("session_id string, value string").option("maxFilesPerTrigger", 1).parquet(path)
    live = G.parse_sessions(stream).withColumn("at", F.col("at").cast("timestamp"))
    rows, _ = W.drain(answered_calls(*calls_and_results(live)), "calls", "append")
    assert key(rows) == key(batch)
    counts = {r["name"]: (r["calls"], r["answered"], r["unanswered"], r["errors"], r["max_ms"]) for r in tool_counts(rows.filter("name <> 'tick'"), ["name"]).collect()}
    assert counts == {"note_write": (2, 2, 0, 0, 120_000), "note_read": (2, 1, 1, 1, 120_000)}

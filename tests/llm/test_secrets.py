import re

from pyspark.sql import functions as F

from tagloom.llm import secrets
from tagloom.llm.columns import running

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


KEY = "AKIA" + "ABCDEFGHIJ234567"
OPAQUE = "aB3dE6gH9jK2mN5pQ8sT1vW4"
TEXTS = [
    None, "", "no secrets here", "ünïcödé 👩 password=abcdef123 and TOKEN: 'x.y-z_w' api_key = short", f"{KEY} x {OPAQUE} y http://db.example.com/x",
    f"{OPAQUE} alone", f"{KEY}{' ' * 800}{OPAQUE}", "secret=token:abcdef12 " + "0123456789abcdef" * 2, "password: token=abcdefgh",
    f"user=bob {OPAQUE} 10.0.0.1:5432", f"user=bob {OPAQUE}", "token=abc123 " * 1500, "deadbeef" * 3, f"{KEY}\n" * 600 + OPAQUE, "Api_Key\"='aaaaaa",
]


def test_base_spans_against_regular_expressions(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, spans string")
    got = {r["doc_id"]: r for r in secrets.find_secrets(docs, keep=["doc_id"]).collect()}
    for i, t in enumerate(TEXTS):
        assert [tuple(s) for s in got[i]["base"]] == base_spans(t or ""), t
        assert set(map(tuple, got[i]["base"])) <= set(map(tuple, got[i]["spans"]))
    extra = {i: [s["kind_no"] for s in got[i]["spans"] if s["kind_no"] > 2] for i in range(len(TEXTS))}
    assert extra[4] == [4, 5] and extra[5] == [] and extra[6] == [] and extra[9] == [3, 4, 5] and extra[10] == [] and extra[13] == [4]


def test_redaction(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id bigint, text string")
    found = secrets.find_secrets(docs, keep=["doc_id", "text"])
    got = {r["doc_id"]: r for r in found.select("*", secrets.redact(F.coalesce("text", F.lit("")), F.col("spans")).alias("clean")).collect()}
    for i, t in enumerate(TEXTS):
        want, at = "", 0
        for s in (x for x in got[i]["spans"] if x["kind_no"] != 5):
            if s["start"] > at or (at == 0 and s["start"] == 0 and not want):
                want += (t[at : s["start"]]) + secrets.MASK
            at = max(at, s["end"])
        assert got[i]["clean"] == want + (t or "")[at:], t


def test_running_results(spark):
    row = spark.range(1).select(
        running(F.sequence(F.lit(1), F.lit(2000)).cast("array<bigint>"), 0, lambda a, b: a + b).alias("s"),
        running(F.array().cast("array<bigint>"), 0, lambda a, b: a + b).alias("none"),
    ).first()
    assert row["s"] == [n * (n + 1) // 2 for n in range(1, 2001)] and row["none"] == []


def test_empty_table_and_repeated_rows(spark):
    schema = "doc_id bigint, text string, row_key string, base string"
    assert secrets.find_secrets(spark.createDataFrame([], schema), keep=["doc_id"]).count() == 0
    twice = spark.createDataFrame([(None, f"{KEY} {OPAQUE}", "", "")] * 2, schema)
    assert [len(r["spans"]) for r in secrets.find_secrets(twice, keep=["doc_id"]).collect()] == [2, 2]

from pyspark.sql import functions as F

from tagloom.functions import text as X


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "c string").select(fn(F.col("c")).alias("r")).first()["r"]


def test_tag_lines(spark):
    assert one(spark, "body\nTag: a, b、 c，d,,\nTag: x", X.parse_tag_line) == ["a", "b", "c", "d"]
    assert one(spark, "Tag: a\ntext\n  Tag： y、z", X.parse_last_tag_line) == ["y", "z"]
    assert one(spark, "no tags here", X.parse_tag_line) == []
    assert one(spark, "a\n\n\n\nTag: $x (1), y\n\nb  \n", X.strip_tag_line) == "a\n\nb"


def test_titles(spark):
    assert one(spark, "\n\n# Hello \nbody", X.heading) == "Hello"
    assert one(spark, "body\n# later", X.heading) is None
    assert one(spark, "# \nbody", X.heading) is None
    chain = lambda c: X.title_chain(F.lit("  "), c, F.lit("2024-01-02 未命名"))
    assert one(spark, "plain", chain) is None
    assert one(spark, "**a b**!", X.slug) == "a-b"
    assert one(spark, "---", X.slug) == "diary"


def test_sentences_and_tokens(spark):
    assert one(spark, "# t\nTag: a\n短句。这是一个足够长的第二句话用来超过二十个字符的下限。尾巴", X.first_sentence) == "短句。这是一个足够长的第二句话用来超过二十个字符的下限。"
    assert one(spark, "ab。cd", X.first_sentence) == "ab。"
    assert one(spark, "x" * 200, X.first_sentence) == "x" * 120 + "…"
    assert one(spark, "你好ab", X.estimate_tokens) == 3
    assert one(spark, "line\nTag: a\n\n", X.continuation_tail) == "line"


def test_names_and_citations(spark):
    assert one(spark, "mem_file-2.js", X.technical_name) is True
    assert one(spark, "abc", X.technical_name) is False
    assert one(spark, "see D12, xD3 and D4567; D7", X.citations) == ["12", "7"]


def fnv(codes):
    h = 2166136261
    for c in codes:
        h = ((h ^ c) * 16777619) % 2**32
    return h


def test_hash_vectors(spark):
    df = spark.createDataFrame([(1, "Ab ab 中文字"), (2, "!")], "id bigint, t string")
    got = {(r["id"], r["slot"]): r["weight"] for r in X.hash_slots(df, "id", "t", 64).collect()}
    raw = {}
    for token, n in (("ab", 2), ("中", 1), ("中文", 1), ("文字", 1)):
        codes = [ord(c) for c in token]
        for slot, w in ((fnv(codes) % 64, 1.0), (fnv([*codes, 0, ord("x")]) % 64, 0.5)):
            raw[slot] = raw.get(slot, 0) + n * w
    norm = sum(v * v for v in raw.values()) ** 0.5
    assert {k[1]: round(v, 9) for k, v in got.items() if k[0] == 1} == {k: round(v / norm, 9) for k, v in raw.items()}
    assert got[(2, 0)] == 1.0
    dense = {r["id"]: r["vector"] for r in X.dense_vectors(X.hash_slots(df, "id", "t", 64), "id", 64).collect()}
    assert len(dense[1]) == 64 and abs(sum(v * v for v in dense[1]) - 1) < 1e-9


def test_query_field_with_gaps(spark):
    turns = [(1, t, f"m{t}") for t in (0, 1, 300, 900, 901, 2000)] + [(1, 950, "  ")]
    df = spark.createDataFrame(turns, "session_id bigint, turn bigint, text string")
    got = {r["turn"]: r["query_text"] for r in X.query_fields(df, 4).collect()}
    assert got[2000] == "m300\nm900\nm901\nm2000"
    assert got[0] == "m0" and 950 not in got

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagloom.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, node string, path string"
TEXT = st.text(alphabet="<|\\im_endstar>\n aé👩", max_size=30)


@given(st.lists(st.tuples(TEXT, TEXT), max_size=4))
def test_escaping_round_trip(turns):
    formatted = "".join(chat.render(role, text)[0] for role, text in turns)
    assert chat.parse(formatted) == turns
    for role, text in turns:
        piece, start, end = chat.render(role, text)
        assert chat.unescape(piece[start:end]) == text and "<|" not in piece[start:end]


CONVERSATIONS = {
    1: [("system", "s"), ("user", "q"), ("assistant", "a1")],
    2: [("system", "s"), ("user", "q"), ("assistant", "a2"), ("user", "more"), ("assistant", "a3")],
    3: [("system", "s"), ("user", "q")],
    4: [("system", "s"), ("user", "q"), ("assistant", "a1")],
    5: [("user", "<|im_end|>\n"), ("assistant", ""), (None, None)],
    6: [("system", "s"), ("user", "other"), ("assistant", "x<\\|y" * 500)],
    None: [("user", "nobody"), ("assistant", "yes")],
}


def frame(spark):
    rows = [(c, i, r, t, "", "") for c, turns in CONVERSATIONS.items() for i, (r, t) in enumerate(turns)]
    return spark.createDataFrame(rows[::-1], SCHEMA)


def test_forest(spark):
    segments, paths = chat.prefix_forest(frame(spark))
    seg = {r["segment"]: r for r in segments.collect()}
    stream = "".join(r["text"] for r in sorted(seg.values(), key=lambda r: r["start"]))
    at = 0
    for r in sorted(seg.values(), key=lambda r: r["start"]):
        assert r["start"] == at
        at += len(r["text"])
    # Each prefix is emitted once.
    prefixes = {tuple(t[: i + 1]) for t in CONVERSATIONS.values() for i in range(len(t))}
    assert stream.count(chat.START) == len(prefixes)
    for row in paths.collect():
        turns = [(r or "", t or "") for r, t in CONVERSATIONS[row["conv_id"]]]
        text = "".join(stream[s["start"] : s["start"] + s["used"]] for s in row["path"])
        assert chat.parse(text) == turns
        last = seg[row["path"][-1]["segment"]]
        assert [tuple(i) for i in last["ancestors"]] == [(s["start"], s["start"] + s["used"]) for s in row["path"][:-1]]
        assert last["position"] == sum(s["used"] for s in row["path"][:-1])


def test_read_back(spark):
    segments, paths = chat.prefix_forest(frame(spark))
    got = {r["conv_id"]: r for r in chat.read_back(segments, paths).collect()}
    assert got.keys() == CONVERSATIONS.keys()
    for c, turns in CONVERSATIONS.items():
        assert chat.parse(got[c]["formatted"]) == [(r or "", t or "") for r, t in turns]
        at, said = 0, []
        for p in got[c]["parts"]:
            said += [chat.unescape(got[c]["formatted"][at + x["start"] : at + x["end"]]) for x in p["loss"]]
            at += p["used"]
        assert said == [t or "" for r, t in turns if r == "assistant"]


def test_empty(spark):
    segments, paths = chat.prefix_forest(frame(spark).filter(F.lit(False)))
    assert segments.count() == paths.count() == chat.read_back(segments, paths).count() == 0

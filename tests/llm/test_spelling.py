import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tagloom.llm import spelling

FIELDS = ["n", "n_near", "form", "form_n", "root"]


def near(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(counts, ratio=2):
    out = {}
    for w, n in counts.items():
        others = [v for v in counts if v != w and near(v, w)]
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= ratio * n else None
        out[w] = [n, len(others), form, counts[form] if form else None]
    for w, row in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        row.append(root)
    return {w: tuple(r) for w, r in out.items()}


def groups(spark, counts, **kw):
    vocab = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    return {r["word"]: tuple(r[f] for f in FIELDS) for r in spelling.spelling_groups(vocab, **kw).collect()}


@pytest.mark.parametrize("filter_bytes", [spelling.FILTER_BYTES, 128])
def test_equals_brute_force(spark, filter_bytes):
    """One pass over all filters, and many passes that cut every length."""
    r = random.Random(7)
    words = {"".join(r.choice("abé") for _ in range(r.randrange(3, 8))) for _ in range(300)} | {"x" * 5, "x" * 6, "x" * 7, "ÿ" * 6, "ÿ" * 5 + "a"}
    counts = {w: r.choice([3, 3, 4, 6, 9, 20, 41]) for w in words}
    assert groups(spark, counts, filter_bytes=filter_bytes) == brute(counts)


def test_long_words_and_words_alone(spark):
    long = "ab" * 4000
    counts = {long: 10, long[:-1]: 3, long[:50] + "c" + long[51:]: 5, "alone": 3}
    got = groups(spark, counts)
    assert got == brute(counts) and got["alone"] == (3, 0, None, None, "alone")
    assert groups(spark, {}) == {}


def test_runs_lose_the_code_point_their_checksum_names(spark):
    r = random.Random(3)
    texts = [(i, " ".join("".join(r.choice("abcÀéZ") for _ in range(r.randrange(1, 9))) for _ in range(400))) for i in range(6)]
    texts += [(7, None), (8, ""), (8, "12 34"), (9, "Same words"), (9, "Same words"), (None, "Nobody's")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id bigint, text string, word string, n int")
    expected, changed = Counter(), 0
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
                changed += 1
            expected[run] += 1
    words = spelling.noisy_words(docs)
    assert changed and {r["word"]: r["n"] for r in words.groupBy("word").agg(F.count("*").alias("n")).collect()} == expected
    kept = {w: n for w, n in expected.items() if len(w) >= 5 and n >= 3}
    assert {r["word"]: r["n"] for r in spelling.vocabulary(words).collect()} == kept
    assert groups(spark, kept) == brute(kept)
    assert spelling.vocabulary(spelling.noisy_words(docs.limit(0))).count() == 0

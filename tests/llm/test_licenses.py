import random
import re

import pytest

from tagloom.llm import licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(text, templates, percent):
    """Labels, score and phrase places by looking at every block of every width and every template."""
    words, labels, score, base, places = words_of(text), set(), 0.0, set(), []
    for label, notice in templates:
        t = words_of(notice)
        if not t:
            continue
        width = max(8, 1 << (len(t) - 1).bit_length())
        for start in range(0, len(words), width):
            share = len(set(t) & set(words[start : start + 2 * width]))
            if share * 100 >= percent * len(set(t)):
                labels.add(label)
                score = max(score, share / len(set(t)))
    for label, phrase in licenses.PHRASES:
        at = [i for i in range(len(words)) if words[i : i + len(phrase)] == phrase]
        places += at
        base |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), sorted(base), sorted(labels | base), 1.0 if places else score


def scan(spark, rows, **kw):
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], "doc_id bigint, text string, words string, row_key string")
    out = licenses.find_licenses(docs, keep=["doc_id", "words", "row_key"], **kw)
    fields = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    return [(r["row"]["doc_id"], *(r[f] for f in fields)) for r in out.collect()]


@pytest.mark.parametrize("percent", [60, 90])
def test_equals_brute_force(spark, percent):
    r = random.Random(percent)
    pool = [w for _, t in licenses.TEMPLATES for w in words_of(t)] + ["filler", "général", "4", "cc by", "all rights reserved"]
    rows = []
    for i in range(150):
        words = r.choices(pool, k=r.randrange(60))
        for _ in range(r.randrange(3)):
            notice = words_of(r.choice(licenses.TEMPLATES)[1])
            for _ in range(r.randrange(4)):
                notice[r.randrange(len(notice))] = r.choice(pool)
            at = r.randrange(len(words) + 1)
            words[at:at] = notice
        rows.append((i, r.choice([" ", "\n", "-", ". "]).join(words)))
    expected = sorted((i, *brute(t, licenses.TEMPLATES, percent)) for i, t in rows)
    got = sorted(scan(spark, rows, percent=percent))
    assert got == expected and len({tuple(x[6]) for x in got}) > 8


def test_edges(spark):
    long = "word " * 200_000 + "Licensed under CC BY-NC 4.0. " + "word " * 1000
    rows = [(1, None), (2, ""), (3, " .,;\n"), (4, "GENERAL\npublic-License"), (4, "GENERAL\npublic-License"), (None, "All rights, reserved"), (5, long), (6, "é cc by É")]
    expected = sorted(((i, *brute(t, licenses.TEMPLATES, 90)) for i, t in rows), key=str)
    assert sorted(scan(spark, rows), key=str) == expected
    assert scan(spark, []) == []
    assert [x[6] for x in scan(spark, [(1, "Released under the MIT License. cc by")], templates=[])] == [["cc-by"]]
    with pytest.raises(ValueError, match="split the list"):
        scan(spark, [(1, "x")], templates=[("many", " ".join(f"w{i}" for i in range(licenses.MAX_TEMPLATE_WORDS + 1)))])


def test_every_matching_block_is_found_with_its_place(spark):
    notice = "Released under the MIT License."
    docs = spark.createDataFrame([(1, "x " * 21 + notice + " y" * 30 + " " + notice)], "doc_id bigint, text string")
    templates = licenses.read_templates([("mit", notice)], 90)
    order = licenses.frequency_order(docs, "text", templates)
    known = licenses.in_order(templates, order)
    rows = licenses.matching_blocks(licenses.scanned(docs, known, order, "text", ["doc_id"]), known).collect()
    assert sorted((r["first_word"], r["n_shared"], r["containment"]) for r in rows) == [(16, 5, 1.0), (48, 5, 1.0), (56, 5, 1.0)]

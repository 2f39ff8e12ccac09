from collections import Counter

from pyspark.sql import functions as F

from tagloom.llm import host_rules as hr

SCHEMA = "doc_id bigint, text string, source string, host string, n_words string"


def repeated(text):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(grams)
    return len({p for i, g in enumerate(grams) if n[g] > 1 for p in range(i, i + 5)}), len(words)


def test_counts_against_brute_force(spark):
    texts = [
        None, "", " \n\t ", "a b c d e", "a b c d e a b c d e", "x " * 40, "one two three four five six one two three four five seven",
        "line\nline\n \nline two\r\nline", "a#b *$% c &|<> d", "ñ ß é x y", "a b c", " ".join(f"w{i % 7}" for i in range(3000)),
    ]
    docs = spark.createDataFrame([(i, t, "s", "clash", "clash") for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r for r in hr.document_failures(docs).collect()}
    for i, t in enumerate(texts):
        n, words = repeated(t or "")
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        assert (got[i]["n_words"], got[i]["n_repeat_words"]) == (words, n), t
        assert got[i]["n_dup_lines"] == len(lines) - len(set(lines))
    assert got[8]["n_symbols"] == 8 and got[9]["word_chars"] == 5


def test_hosts_are_shrunk_and_joined_back(spark):
    good = " ".join(f"word{i}" for i in range(30))
    rows = [(i, good, "good", "", "") for i in range(60)] + [(100 + i, "bad", "bad", "", "") for i in range(59)] + [(199, good, "bad", "", "")]
    rows += [(300, "bad", "small", "", ""), (301, good, "small", "", ""), (302, good, None, "", ""), (302, good, None, "", "")]
    failures = hr.document_failures(spark.createDataFrame(rows, SCHEMA))
    hosts = hr.host_verdicts(failures)
    verdict = {r["host"]: r for r in hosts.collect()}
    assert verdict["bad"]["host_rejected"] and not verdict["good"]["host_rejected"]
    assert 1 / 62 < verdict["small"]["rate_short"] < 59 / 60
    out = hr.judged(failures, hosts).collect()
    assert len(out) == len(rows)
    kept = Counter(r["doc_id"] for r in out if r["kept"])
    assert kept[302] == 2 and kept[301] == 1 and kept[199] == 0 and kept[300] == 0


def test_empty_table(spark):
    failures = hr.document_failures(spark.createDataFrame([], SCHEMA))
    assert hr.judged(failures, hr.host_verdicts(failures)).count() == 0

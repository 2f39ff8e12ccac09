import hashlib
import random

from pyspark.sql import functions as F

from tagloom.llm import repeats as rp
from tagloom.llm.registry import table


def brute(rows):
    seen, out = set(), {}
    for d, t in sorted(rows):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            w = hashlib.blake2b(data[i : i + 100], digest_size=12).digest()
            if w in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (len(data), sum(gone), runs, kept)
    return out


def got(docs):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in rp.remove_repeats(docs).collect()}


def cases():
    draw = random.Random(11)
    word = lambda: "".join(draw.choice("abcdefghiß") for _ in range(draw.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, line = text(60), text(9)
    rows = [(i, text(80) + passage[i : 200 + i] + text(40)) for i in range(30)]
    rows += [(100 + i, text(20) + " " + line + " " + text(30)) for i in range(40)]
    base = text(150)
    rows += [(200 + i, base[: 20 * i] + word() + base[20 * i + 5 :]) for i in range(25)]
    rows += [(300, base), (301, base), (302, "ab " * 2000), (303, "x" * 150), (304, "x" * 500), (305, passage + passage), (306, "ab " * 40 + text(30) + "ab " * 40)]
    rows += [(307, None), (308, ""), (309, "short"), (310, base[:100]), (311, base[:99]), (312, text(10) * 5), (-5, base[50:170])]
    rows += [(313, text(30)[:103] * 3), (314, "q" * 106), (315, ("abcdef" * 30)[:107])]
    return rows


def test_against_brute_force(spark):
    rows = cases()
    assert got(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)) == brute(rows)


def test_frequent_anchors_and_small_blocks_change_nothing(spark, monkeypatch):
    rows = cases()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    monkeypatch.setattr(rp, "FREQUENT_DOCS", 3)
    assert got(docs) == brute(rows)
    monkeypatch.setattr(rp, "BLOCK_BYTES", 700)
    rp._powers.cache_clear()
    assert got(docs) == brute(rows)
    rp._powers.cache_clear()


def test_heavy_anchors_change_nothing(spark, monkeypatch):
    rows = cases()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for most in (0, 400):
        monkeypatch.setattr(rp, "ANCHOR_BYTES", most)
        kinds = {r["kind"] for r in rp._resolve(rp._runs(docs, []), []).select("kind").distinct().collect()}
        assert rp.FREQUENT in kinds and (rp.FRAGMENT in kinds) == (most > 0)
        assert got(docs) == brute(rows)


def test_interval_tree_reports_occurrences_beyond_neighbours():
    a, b, c = b"A" + bytes(range(120)), b"B" + bytes(range(120)) + b"tail", b"C" + bytes(range(110)) + b"end"
    place, size, earlier = rp.maximal_repeats([a, b, c])
    assert sorted(zip(place.tolist(), size.tolist(), earlier.tolist(), strict=True)) == [(122, 120, 1), (247, 110, 1)]


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    want = brute([(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()])
    rows = rp.repeats(spark, sf).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows} == {
        d: (*v[:3], hashlib.sha256(v[3]).hexdigest()) for d, v in want.items()
    }


def test_repeated_and_null_ids(spark):
    text = "".join(chr(97 + i % 23) + str(i) for i in range(60))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, "x")], "doc_id bigint, text string")
    out = sorted(((r["doc_id"], r["n_removed"]) for r in rp.remove_repeats(docs).collect()), key=str)
    n = len(text)
    assert out == sorted([(1, 0), (1, n), (None, n), (2, 0)], key=str)
    assert rp.remove_repeats(docs.filter(F.lit(False))).count() == 0

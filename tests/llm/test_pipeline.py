import base64
import re

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tagloom.llm import bpe, decontaminate, rule_ensemble, secrets
from tagloom.llm.registry import table
from tagloom.session import cut_lineage
from tests_llm_brute import brute_components, brute_leaks

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), []
    for name, stage in cp.STAGES:
        kept = cut_lineage(stage(spark, docs, SF), "test")
        out.append((name, docs, kept))
        docs = kept
    return out


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns_and_names(stages, spark):
    documents = table(spark, SF, "documents")
    for _, _, kept in stages[:-1]:
        assert dict(kept.dtypes) == dict(documents.dtypes)
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "near duplicates", "benchmark decontamination", "secret scan", "byte-level BPE"]


def test_quality_stage(stages, spark):
    _, before, after = stages[0]
    kept = set(by_id(after))
    scores = rule_ensemble.score_quality(before, table(spark, SF, "labels"), ["doc_id"]).collect()
    assert kept == {r["doc_id"] for r in scores if r["score"] >= 0.3}
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    assert sum((d in kept) == bool(q) for d, q in labels.items()) / len(labels) > 0.97


def test_near_duplicate_stage(stages):
    _, before, after = stages[1]
    rows = by_id(before)
    want = brute_components([(d, r["text"]) for d, r in rows.items()])
    assert set(by_id(after)) == {d for d, (_, c) in want.items() if c == d} and len(want) > after.count()


def test_decontamination_stage(stages, spark):
    _, before, after = stages[2]
    bad = {d for d, _ in brute_leaks(before.collect(), table(spark, SF, "benchmark").collect())}
    assert set(by_id(after)) == set(by_id(before)) - bad and bad


def test_secret_stage(stages):
    _, before, after = stages[3]
    old, new = by_id(before), by_id(after)
    assert old.keys() == new.keys()
    changed = 0
    for d, r in new.items():
        assert not re.search(r"AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", r["text"]) and r["n_chars"] == len(r["text"])
        assert not [m for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r["text"]) if len(m[1]) >= 6]
        if r["text"] != old[d]["text"]:
            changed += 1
            pieces = r["text"].split(secrets.MASK)
            assert re.fullmatch(".+?".join(map(re.escape, pieces)), old[d]["text"], re.S)
    assert changed


def test_bpe_stage(stages):
    _, before, after = stages[4]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(bpe.DEFAULT_RANKS), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = by_id(after)
    for d, r in by_id(before).items():
        assert rows[d]["ids"] == encoding.encode_ordinary(r["text"]) and rows[d]["round_trip"]


def test_awkward_rows_pass_every_stage(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, spans string, row string, component_id int"
    good = "The river runs past the old mill and the people of the town walk there on quiet evenings. " * 2
    rows = [(1, None, "en", "a", None, 1.0, "x", "y", 3), (2, "", None, None, 0, None, None, None, None), (None, good, "en", "a", 5, 0.0, "", "", 0), (3, good, "en", "a", 5, 0.0, "", "", 0), (3, good, "en", "a", 5, 0.0, "", "", 0)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.collect()
        assert stage(spark, docs.filter(F.lit(False)), SF).count() == 0
    assert cp.byte_bpe(spark, docs, SF).filter("n_tokens = 0").count() == 2
    assert decontaminate.without(docs, decontaminate.contaminated(docs, table(spark, SF, "benchmark"))).count() == 5

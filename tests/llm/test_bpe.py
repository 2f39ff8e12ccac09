import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagloom.llm import bpe

PATH = public_tokenizers.path(bpe.DEFAULT_RANKS)


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


CASES = ["", " ", "a", "don't  stop\n\n\tnow ", "Straße größer ñandú élève", "<|endoftext|>", "\x00\x1c\x1d a\x85b c　d", "日本語テキスト 👩‍👩‍👧", "x" * 5000, "ab " * 3000, "123 4567", "ſK",
         "two  spaces here", "a b\n c d", " lead", "trail ", "a \n b", "x 's y 'll 't", "it's 'tis", "a\u00a0 b\u2003c d\x1f e \x1ff"]


@pytest.mark.parametrize("text", CASES)
def test_same_ids_as_the_rank_encoder(reference, text):
    codec = bpe.codec(PATH, public_tokenizers.PATTERN)
    assert codec.encode(text).tolist() == reference.encode_ordinary(text)
    assert bpe.decoder(PATH).decode(codec.encode(text)) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet=" \n\t'sltab1.é\u00a0\x1c", max_size=40)))
def test_random_texts(text):
    ranks = bpe.codec(PATH, public_tokenizers.PATTERN)
    assert bpe.decoder(PATH).decode(ranks.encode(text)) == text.encode()
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.ranks, special_tokens={})
    assert ranks.encode(text).tolist() == encoding.encode_ordinary(text)


def test_frames_keep_other_columns_and_null_is_empty(spark, reference):
    rows = [(1, "the cat", "kept"), (1, "the cat", "kept"), (2, None, None), (3, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, decoded string")
    out = bpe.decode_documents(bpe.encode_documents(docs, PATH), PATH, out="back").orderBy("doc_id").collect()
    assert [r["decoded"] for r in out] == ["kept", "kept", None, "x"]
    assert [bytes(r["back"]) for r in out] == [b"the cat", b"the cat", b"", b""]
    assert out[0]["ids"] == reference.encode_ordinary("the cat") and out[2]["ids"] == []
    empty = bpe.encode_documents(docs.filter(F.lit(False)), PATH)
    assert empty.count() == 0


def test_query_against_the_rank_encoder(spark, reference):
    got = {r["doc_id"]: r for r in bpe.byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = reference.encode_ordinary(d["text"] or "")
        r = got[d["doc_id"]]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()

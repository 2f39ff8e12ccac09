import hashlib
import base64

import pytest
from pyspark.sql import functions as F

from tagloom.llm import warc
from tagloom.session import new_stage_path


def archive(spark, rows, schema="page_id bigint, url string, html string"):
    raw, out = new_stage_path(spark, "t-raw"), new_stage_path(spark, "t-out")
    warc.archive_pages(spark.createDataFrame(rows, schema), raw)
    warc.resolve_revisits(spark, raw, out)
    return raw, out


def test_revisits_point_at_the_smallest_page(spark):
    rows = [(5, "u5", "same"), (2, "u2", "same"), (9, None, None), (7, "a\r\nb", ""), (8, "u8", "WARC/1.1\r\n\r\nline\r\n\r\nßñ"), (2, "u2", "same")]
    raw, out = archive(spark, rows)
    assert warc.read_archives(spark, raw).filter("record_type = 'response'").count() == 6
    got = warc.read_archives(spark, out, payloads=True).collect()
    by_id = {r["record_id"]: r for r in got}
    assert len(by_id) == 6
    kinds = sorted((r["page_id"], r["record_type"], by_id[r["refers_to_record"]]["page_id"] if r["refers_to_record"] else None) for r in got)
    assert kinds == [(2, "response", None), (2, "revisit", 2), (5, "revisit", 2), (7, "response", None), (8, "response", None), (9, "revisit", 7)]
    eight = next(r for r in got if r["page_id"] == 8)
    assert bytes(eight["payload"]).decode() == rows[4][2]
    assert eight["payload_digest"] == base64.b32encode(hashlib.sha1(rows[4][2].encode()).digest()).decode()
    assert next(r["url"] for r in got if r["page_id"] == 7) == "a%0D%0Ab"


def test_resolving_again_keeps_revisits(spark):
    _, out = archive(spark, [(1, "a", "x"), (2, "b", "x"), (3, "c", "y")])
    again = new_stage_path(spark, "t-again")
    warc.resolve_revisits(spark, out, again)
    first = {tuple(r) for r in warc.read_archives(spark, out).collect()}
    assert {tuple(r) for r in warc.read_archives(spark, again).collect()} == first


def test_small_payloads_stay_responses(spark):
    raw, out = new_stage_path(spark, "t-raw"), new_stage_path(spark, "t-out")
    warc.archive_pages(spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "long one"), (4, "d", "long one")], "page_id bigint, url string, html string"), raw)
    warc.resolve_revisits(spark, raw, out, min_bytes=4)
    assert sorted((r["page_id"], r["record_type"]) for r in warc.read_archives(spark, out).collect()) == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]


def test_empty_and_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "a", "x", "c", b"r")], "page_id bigint, url string, html string, key string, record binary")
    raw = new_stage_path(spark, "t-raw")
    warc.archive_pages(pages, raw)
    assert warc.read_archives(spark, raw).count() == 1
    none, out = new_stage_path(spark, "t-raw"), new_stage_path(spark, "t-out")
    warc.archive_pages(pages.filter(F.lit(False)), none)
    warc.resolve_revisits(spark, none, out)
    assert warc.read_archives(spark, out).count() == 0

from tagloom.catalog import QUERIES
from tagloom.catalog import retrieve_queries as R


def test_plain_search_builds_no_graph(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("a plain search needs no graph")

    monkeypatch.setattr(R, "transport", refused)
    monkeypatch.setattr(R, "tag_vector_table", refused)
    rows = QUERIES["retrieve_plain"](spark, "/root/testdata/sf0.001").collect()
    assert rows and {r["role"] for r in rows} == {"unranked"}

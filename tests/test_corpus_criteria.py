from tagloom.catalog import QUERIES


def test_criteria_read_the_edges_once(spark, capsys):
    df = QUERIES["corpus_criteria"](spark, "/root/testdata/sf0.001")
    df.explain()
    assert "l_orderkey" not in capsys.readouterr().out
    assert {r["criterion"] for r in df.collect()} == {"components", "hub", "orphans", "bodies", "report"}

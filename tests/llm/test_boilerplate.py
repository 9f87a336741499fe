from schedulesmith.llm import boilerplate
from pyspark.sql import functions as F


def test_lines_above_the_ratio_go(spark):
    rows = [(i, "hot", ["menu", f"own {i}", "menu", "half" if i % 2 else "x"]) for i in range(40)] + [(100 + i, "b", ["menu", "y"]) for i in range(3)]
    rows += [(None, None, None), (7, "hot", []), (8, "hot", None)]
    pages = spark.createDataFrame(rows, "page_id long, host string, lines array<string>").selectExpr("*", "1 as kept", "2 as code", "3 as h")
    got = boilerplate.drop_site_boilerplate(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.host == "hot" and r.kept:
            assert r.kept == [f"own {r.page_id}"] and len(r.removed) == 3 and r.host_pages == 42
        elif r.host == "b":
            assert r.kept == ["menu", "y"]
        else:
            assert r.kept == [] and r.removed == []
    assert boilerplate.drop_site_boilerplate(pages.limit(0)).count() == 0


def test_hosts_and_lines(spark):
    rows = [("HTTPS://u:p@Www.A.org:80/x", "<head>t</head><p>a  b<br>c &amp; <b>d</b>\n<!-- x --><script>if (a<b) 1</script></p>e"), (None, None), ("nohost", "")]
    got = spark.createDataFrame(rows, "u string, h string").select(boilerplate.host_of(F.col("u")), boilerplate.visible_lines(F.col("h"))).collect()
    assert [tuple(r) for r in got] == [("www.a.org", ["a b", "c &amp; d", "e"]), ("", []), ("", [])]

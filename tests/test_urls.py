"""Hosts and registrable domains (public-suffix rules)."""

from pyspark.sql import functions as F

from websift.functions import urls as U


def roots(spark, urls):
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    out = U.with_root(df, "url", U.suffix_rules(spark))
    return {r.url: (r.host, r.root) for r in out.collect()}


def test_suffix_rules(spark):
    got = roots(spark, ["http://a.b.co.uk/x", "https://x.y.ck/", "http://www.ck/", "http://localhost:8080/",
                        "http://10.0.0.1/a", "HTTP://User@WWW.Example.COM:80/p", "http://q.w.example.net/",
                        "/relative", "mailto:x@y", "http://a_b.example.org/"])
    assert got["http://a.b.co.uk/x"] == ("a.b.co.uk", "b.co.uk")
    assert got["https://x.y.ck/"] == ("x.y.ck", "x.y.ck")
    assert got["http://www.ck/"] == ("www.ck", "www.ck")
    assert got["http://localhost:8080/"] == ("localhost", None)
    assert got["http://10.0.0.1/a"] == ("10.0.0.1", None)
    assert got["HTTP://User@WWW.Example.COM:80/p"] == ("www.example.com", "www.example.com")
    assert got["http://q.w.example.net/"] == ("q.w.example.net", "w.example.net")
    assert got["/relative"] == (None, None)
    assert got["mailto:x@y"] == (None, None)
    assert got["http://a_b.example.org/"] == ("a_b.example.org", "a_b.example.org")


def test_path_parts(spark):
    df = spark.createDataFrame([("http://h.com/a/b/c?x=1",)], "u string")
    assert df.select(U.url_path_parts(F.col("u"))).first()[0] == ["a", "b", "c"]

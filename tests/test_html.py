"""Inline HTML edge cases for the extraction expressions."""

from pyspark.sql import functions as F

from websift.functions import html as H
from websift.operators import extract as X


def parse(spark, html):
    df = spark.createDataFrame([(1, "http://a.example.com/x", html)], "page_id long, url string, html string")
    return X.parse_pages(df).first()


def counts(spark, html):
    df = spark.createDataFrame([(html,)], "html string")
    cols = [H.closed_tag_count(F.col("html"), t).alias(t) for t in H.COUNTED_TAGS]
    return df.select(*cols, H.script_words(F.col("html")).alias("script_words")).first().asDict()


def test_first_title_trimmed_not_decoded(spark):
    r = parse(spark, "<html><head><title> A &amp; B </title><title>second</title></head><body>x</body></html>")
    assert r.title == "A &amp; B"


def test_missing_title_and_body(spark):
    r = parse(spark, "<html><head></head></html>")
    assert r.title is None and r.text == "" and r.parse_ok is False


def test_body_text_nodes_joined_decoded(spark):
    r = parse(spark, "<title>t</title><body><p> one &amp; two </p>\n<b>three<!-- c -->four</b></body>")
    assert r.text == "one & two, three, four"


def test_script_text_in_body_counts_as_text(spark):
    r = parse(spark, "<title>t</title><body><script>var a=1;</script>end</body>")
    assert r.text == "var a=1;, end"


def test_unclosed_body_reads_to_end(spark):
    r = parse(spark, "<title>t</title><body><p>a<p>b")
    assert r.text == "a, b"


def test_meta_values_in_order(spark):
    r = parse(spark, '<title>t</title><meta name="description" content="d1"><meta property=\'og:description\' content=d2><body></body>')
    assert list(r.meta) == ["description", "d1", "og:description", "d2"]


def test_hrefs(spark):
    r = parse(spark, '<title>t</title><body><a class="x" href="https://b.example.org/p">b</a><a href=/rel>r</a></body>')
    assert list(r.hrefs) == ["https://b.example.org/p", "/rel"]


def test_tag_counter_sample(spark):
    html = ("<body><ul><li>one <a href=/1>first</a></li><li>two <a href=/2>second</ul><iframe src=x></iframe>"
            "<script>let total = 3 + 4</script><script src=y></script></body>")
    c = counts(spark, html)
    # the second item and its link are never closed
    assert c == {"a": 1, "li": 1, "script": 2, "iframe": 1, "input": 0, "script_words": 6}


def test_input_self_closing_counts(spark):
    c = counts(spark, "<input/><input><li>x</li><li>y")
    assert c["input"] == 1 and c["li"] == 1


def test_end_tag_without_open_does_not_count(spark):
    c = counts(spark, "</a><a>x</a></a>")
    assert c["a"] == 1


def test_display_title_fallback(spark):
    df = spark.createDataFrame([(None, "x" * 30), ("", "short"), ("T", "text")], "title string, text string")
    got = [r[0] for r in df.select(X.display_title(F.col("title"), F.col("text"))).collect()]
    assert got == ["x" * 24 + "...", "short", "T"]

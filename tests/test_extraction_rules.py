"""Literal expectations for extraction, URL, word-part, id and upsert rules, in Spark and in the oracle's SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from websift.functions import html as H
from websift.functions import text as TX
from websift.functions import urls as U
from websift.operators import analysis as AN
from websift.operators import store as ST
from websift.plans import sqlkit as S

PAGE = ("<html><head><meta name=description content=\"it's a test\"><meta name='q' content='say \"hi\"'></head><body>"
        "<a href=\"/wiki/Moore's_law\">x</a><a href='/s?x=1&amp;y=2'>caf&eacute; &#8217; &#x263A; &amp;lt; &nosuch; AT&T</a>"
        "<a href=/plain>z</a></body></html>")
META = ["description", "it's a test", "q", 'say "hi"']
HREFS = ["/wiki/Moore's_law", "/s?x=1&y=2", "/plain"]
TEXT = "x, café ’ ☺ &lt; &nosuch; AT&T, z"


def test_attributes_and_entities(spark):
    r = spark.createDataFrame([(PAGE,)], "html string").select(
        H.meta_values(F.col("html")).alias("m"), H.hrefs(F.col("html")).alias("h"), H.body_text(F.col("html")).alias("t")).first()
    assert (r.m, r.h, r.t) == (META, HREFS, TEXT)


def test_attributes_and_entities_in_the_oracle():
    con = duckdb.connect()
    con.execute("CREATE TABLE p AS SELECT ? AS html", [PAGE])
    r = con.execute(f"SELECT {S.meta_values('html')}, {S.hrefs('html')}, {S.body_text('html')} FROM p").fetchone()
    assert r == (META, HREFS, TEXT)


@pytest.mark.parametrize("word,parts", [("XMLParser", ["XMLParser"]), ("fooBar12", ["foo", "Bar", "12"]), ("WiFi", ["Wi", "Fi"]),
                                        ("élanVital", ["élan", "Vital"]), ("ABC-9x", ["ABC", "9", "x"])])
def test_word_parts(spark, word, parts):
    assert spark.createDataFrame([(word,)], "w string").select(TX.word_delimiter_parts(F.col("w")).alias("p")).first().p == parts
    sql = f"SELECT regexp_extract_all({S.lit(word)}, {S.lit(TX.WORD_PART_PATTERN)})"
    assert duckdb.connect().execute(sql).fetchone()[0] == parts


def test_hosts_of_any_length_have_a_root(spark):
    rules = U.suffix_rules(spark)
    long = ".".join(["a"] * 17) + ".shop.example.com"
    hosts = {long: "shop.example.com", "x.y.co.uk": "y.co.uk", "a.b.ck": "a.b.ck", "z.www.ck": "www.ck", "co.uk": None, "10.0.0.1": None}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    assert {r.host: r.root for r in U.registrable_domains(df, rules).collect()} == hosts


def test_ids_follow_the_order_over_many_files(spark):
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        urls = sorted(f"u{i:05d}" + "x" * (i // 20) for i in range(2000))  # later files are larger
        got = ST.assign_ids(spark.createDataFrame([(u,) for u in reversed(urls)], "url string"), 5, ["url"]).orderBy("id").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert [r.id for r in got] == list(range(6, 2006)) and [r.url for r in got] == urls


def test_last_version_of_a_url_counts(spark):
    cols = "id long, title string, text string, url string, base_url string, rank double, type_of_website string"
    have = spark.createDataFrame([(1, "old", "t", "u", "b", 3.0, "d")], cols)
    new = spark.createDataFrame([("u", "first", "t", "b", "d"), ("u", "last", "t", "b", "d"), ("v", "one", "t", "b", "d"), ("v", "two", "t", "b", "d")],
                                "url string, title string, text string, base_url string, type_of_website string").coalesce(1)
    got = {r.url: (r.id, r.title, r.rank) for r in ST.upsert_by_url(have, new).collect()}
    assert got == {"u": (1, "last", 3.0), "v": (2, "two", 0.0)}


def test_spelling_finds_another_first_letter(spark):
    vocab = spark.createDataFrame([("thing", 5), ("think", 9), ("a", 1)], "term string, df long")
    words = spark.createDataFrame([("xhing",), ("thing",), ("zzzzzz",), ("b",)], "word string")
    got = {r.word: (r.suggestion, r.distance) for r in AN.spelling(words, vocab, AN.spelling_index(vocab)).collect()}
    assert got == {"xhing": ("thing", 1), "b": ("a", 1)}


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("most", [1, 2, 3])
def test_spelling_equals_brute_force(spark, most):
    import random
    rng = random.Random(most)
    word = lambda lo, hi: "".join(rng.choice("abcé") for _ in range(rng.randrange(lo, hi)))
    terms = {word(1, 12): rng.randrange(1, 9) for _ in range(250)}
    words = [word(1, 13) for _ in range(120)] + ["", "a" * 40, next(iter(terms)), next(iter(terms)) + "b"]
    want = {}
    for w in set(words) - set(terms):
        close = [(_edits(w, t), -n, t) for t, n in terms.items() if _edits(w, t) <= most]
        if close:
            d, n, t = min(close)
            want[w] = (t, d, -n)
    vocab = spark.createDataFrame(list(terms.items()), "term string, df long")
    asked = spark.createDataFrame([(w,) for w in [*words, *words[:5], None]], "word string")
    got = AN.spelling(asked, vocab, AN.spelling_index(vocab, most), most).collect()
    assert {r.word: (r.suggestion, r.distance, r.hits) for r in got} == want and len(got) == len(want) > 20

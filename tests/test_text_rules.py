"""Inline cases for suggestions, snippet windows/highlighting and genre rules (FIXTURES §4)."""

from pyspark.sql import functions as F

from websift.operators import genre as G
from websift.operators import snippets as SN
from websift.operators import suggest as SG


def suggestions(spark, texts, queries):
    dic = SG.dictionary(spark.createDataFrame([(t,) for t in texts], "text string"))
    q = spark.createDataFrame(list(enumerate(queries)), "query_id long, q string")
    out = SG.suggest(q, dic).collect()
    res = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.pos)):
        res.setdefault(r.query_id, []).append((r.suggestion, r.completion))
    return res


def test_suggest_reference_cases(spark):
    texts = ["these things are thinner things", "thinking about things", "random words here"]
    got = suggestions(spark, texts, ["a", "random string word asdfsdfjkn 0", "thin", "things"])
    assert 0 not in got and 1 not in got          # too short / last word too short: nothing
    assert ("things", "gs") in got[2]             # "thin" completes to "things"
    assert got[2][0] == ("thin", "")               # typed query first, it is not among the terms
    assert got[3][0] == ("things", "")             # query equal to a term: the term list itself


def snip(spark, text, words):
    df = spark.createDataFrame([(text, words)], "text string, w array<string>")
    return df.select(SN.highlight(SN.snippet("text", "w"), F.col("w"))).first()[0]


def test_snippet_windows(spark):
    long = "a" * 40 + " target " + "word " * 100
    assert snip(spark, "Target at start", ["target"]) == "<b>Target</b> at start"
    s = snip(spark, "x " * 30 + "hit " + "y " * 10, ["hit"])
    assert s.startswith("&hellip; ") and "<b>hit</b>" in s
    s2 = snip(spark, long, ["target"])
    assert s2.endswith(" &hellip;") and not s2.startswith("&hellip;")
    assert snip(spark, "nothing here", ["zzz"]) == "nothing here"
    assert snip(spark, "Alpha beta", ["alpha", "beta"]) == "<b>Alpha</b> <b>beta</b>"
    assert snip(spark, "no words at all", []) == "no words at all"


def genre(spark, body, meta):
    df = spark.createDataFrame([(body, meta)], "b string, m array<string>")
    return df.select(G.rule_genre(F.col("b"), F.col("m"))).first()[0]


def test_genre_rules(spark):
    assert genre(spark, "", ["OG:Article"]) == "article"
    assert genre(spark, "", ["og:book"]) == "product"
    assert genre(spark, "", ["x", "og:website", "og:article"]) == "website"   # first matching meta wins
    assert genre(spark, "", ["og:profile"]) == "social"
    assert genre(spark, "Install it. Version 2", []) == "product"
    assert genre(spark, "get started, see version", None) == "product"
    assert genre(spark, "maintained and developed", []) == "product"
    assert genre(spark, "install only", []) == "default"
    assert genre(spark, "the author wrote this article", []) == "article"
    assert genre(spark, "Written by someone", []) == "article"
    assert genre(spark, "see further reading", []) == "article"
    assert genre(spark, "author only", []) == "default"


def test_description_pick(spark):
    df = spark.createDataFrame([(["description", "d1", "og:description", "d2"],), (["og:description", "d2"],),
                                (["charset", "utf-8"],), ([],)], "m array<string>")
    got = [r[0] for r in df.select(SN.description(F.col("m"))).collect()]
    assert got == ["d1", "d2", None, None]


def test_snippet_very_long_word(spark):
    word = "x" * 150
    text = "start " + "y" * 100 + " " + word + " " + "z " * 300
    s = snip(spark, text, [word])
    assert "<b>" + word + "</b>" in s and s.startswith("&hellip; ")

import random
from collections import Counter

from websift.operators import dictionary as DI
from websift.operators import phrases as PH
from websift.operators import search as SR

TERMS = ["a", "ab", "abc", "abd", "b", "ba", "é", "éa", "zz", "a\U0010ffffb", "a￿", "\U0001f600x"]


def some_terms():
    rng = random.Random(5)
    return TERMS + ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9))) for _ in range(800)]


def index(spark, terms):
    return spark.createDataFrame([(t,) for t in terms], "term string")


def found(spark, terms, words, backwards):
    entries = DI.dictionary(index(spark, terms), backwards)
    return sorted((r.w, r.term) for r in DI.matches(spark.createDataFrame([(w,) for w in words], "w string"), entries, backwards).collect())


def test_prefixes_and_suffixes_equal_brute_force(spark):
    terms = some_terms()
    words = TERMS + ["abcd", "e", "edc", "x", "nothing", "", None, "a", "cé"]
    real = {w for w in words if w}
    for backwards, test in ((False, str.startswith), (True, str.endswith)):
        want = sorted((w, t) for w in real for t in set(terms) if test(t, w))
        assert found(spark, [*terms, None], words, backwards) == want and len(want) > 300


def test_entries_are_in_key_order_over_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = DI.dictionary(index(spark, some_terms()), True).orderBy("at").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [r.key for r in rows] == sorted({t[::-1] for t in some_terms()})
    assert len({r.at >> DI.PART_BITS for r in rows}) > 1


def test_a_prefix_over_several_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        terms = [f"p{k:05d}" for k in range(3000)]
        got = found(spark, terms, ["p", "p0", "p02999", "q"], False)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert Counter(w for w, _ in got) == {"p": 3000, "p0": 3000, "p02999": 1}


def test_documents_of_a_prefix(spark):
    docs = spark.createDataFrame([(1, "http://aa.ab/b", ["ab.c", "ab.c"]), (2, "b", None), (3, None, ["a"] * 50)],
                                 "id long, url string, external_links array<string>")
    post = PH.positional_index(PH.field_values(docs, ["url", "external_links"]))
    words = spark.createDataFrame([(7, "a"), (7, "a"), (8, "ab"), (8, "c"), (9, "zzz")], "query_id long, w string")
    got = {(r.query_id, r.field, r.doc_id): r.tf for r in DI.matching_docs(words, DI.dictionary(post), post).collect()}
    assert got == {(7, "url", 1): 4, (7, "external_links", 1): 4, (7, "external_links", 3): 100,
                   (8, "url", 1): 1, (8, "external_links", 1): 4}


def test_empty(spark):
    assert found(spark, [], ["a"], False) == [] and found(spark, ["a"], [], True) == []


def test_search_order_follows_the_votes(spark):
    docs = spark.createDataFrame([(k, f"http://h{k}/", None, 0.0, f"word {k}", None) for k in (1, 2, 3)],
                                 "id long, url string, title string, rank double, text string, base_url string")
    ranks = spark.createDataFrame([(2, 3.0), (3, -1.0)], "id long, rank double")
    from pyspark.sql import functions as F
    from websift.operators import index as IX
    post = IX.postings(docs, F.col("text"))
    aq = SR.analyse_queries(spark.createDataFrame([(1, "word")], "query_id long, q string"))
    got = SR.ranked(aq, SR.with_ranks(docs, ranks), IX.vocab_grams(IX.vocab(post)), post).orderBy("pos").collect()
    assert [(r.doc_id, r["rank"]) for r in got] == [(2, 3.0), (1, 0.0), (3, -1.0)]

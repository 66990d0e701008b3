import random
from collections import Counter

from websift.operators import phrases as PH

SCHEMA = "id long, text string, url string, external_links array<string>"
FIELDS = ["text", "url", "external_links"]


def rows(spark):
    rng = random.Random(2)
    w = ["a", "b", "c", "and", "dd"]
    out = [(k, " ".join(rng.choice(w) for _ in range(rng.randrange(0, 40))), f"http://{rng.choice(w)}.{rng.choice(w)}/{rng.choice(w)}",
            [f"{rng.choice(w)}-x.{rng.choice(w)}" for _ in range(rng.randrange(0, 5))]) for k in range(60)]
    return out + [(100, None, None, None), (101, "", "", []), (102, "a b c " * 3000, "a/b", ["a", None, "b", "b.a", "a.b"])]


def words(field, value):
    import re
    return re.findall(r"[A-Za-z0-9_-]+" if field != "text" else r"[^\W]+", value.lower())


def brute(table, phrases):
    out = Counter()
    for pid, field, phrase in phrases:
        p = [(i, x) for i, x in enumerate(words(field, phrase)) if field != "text" or x != "and"]
        for r in table:
            value = r[1 + FIELDS.index(field)]
            for v in ([value] if isinstance(value, str) else value or []):
                d = dict(enumerate(x for x in words(field, v))) if v is not None else {}
                d = {i: x for i, x in d.items() if field != "text" or x != "and"}
                if p:
                    out[pid, field, r[0]] += sum(all(d.get(s + i) == x for i, x in p) for s in {k - p[0][0] for k, x in d.items() if x == p[0][1]})
    return {k: n for k, n in out.items() if n}


def test_whole_phrases_equal_brute_force(spark):
    table = rows(spark)
    phrases = [(1, "text", "a b"), (2, "text", "A and c"), (3, "text", "and b"), (4, "text", "a b c a b c a b c"), (5, "text", "and"), (6, "text", "zz a"),
               (7, "text", "a"), (8, "text", "dd dd"), (9, "text", ""), (10, "text", "a a and a"), (11, "url", "a.b"), (12, "url", "http a and c"),
               (13, "external_links", "a b"), (14, "external_links", "a-x b"), (15, "external_links", "b"), (16, "text", "b c and a and")]
    df = spark.createDataFrame(table, SCHEMA)
    ph = spark.createDataFrame(phrases, "phrase_id long, field string, phrase string")
    got = PH.phrase_hits(PH.phrase_words(ph), PH.positional_index(PH.field_values(df, FIELDS))).collect()
    assert {(r.phrase_id, r.field, r.doc_id): r.n for r in got} == brute(table, phrases) and len(got) > 100


def test_no_phrase_spans_two_values(spark):
    df = spark.createDataFrame([(1, None, None, ["x a", "b y", "a b"])], SCHEMA)
    index = PH.positional_index(PH.field_values(df, FIELDS)).collect()
    assert {(r.term, tuple(r.positions)) for r in index} == {("x", (0,)), ("a", (1, 204)), ("b", (102, 205)), ("y", (103,))}
    ph = spark.createDataFrame([(1, "external_links", "a b"), (2, "external_links", "a b y")], "phrase_id long, field string, phrase string")
    got = PH.phrase_hits(PH.phrase_words(ph), PH.positional_index(PH.field_values(df, FIELDS))).collect()
    assert [(r.phrase_id, r.n) for r in got] == [(1, 1)]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    ph = spark.createDataFrame([], "phrase_id long, field string, phrase string")
    assert PH.phrase_hits(PH.phrase_words(ph), PH.positional_index(PH.field_values(df, FIELDS))).count() == 0

import random

from websift.functions import text as TX
from websift.operators import index as IX
from websift.operators import phrases as PH
from websift.operators import synonyms as SY

LINES = ["a b, c => d e, f", "a b c => long", "x, y z", "b c => never", "a, the d", "the q and r => s"]


def brute_graph(words, lines):
    rules = {}
    for line in lines:
        left, arrow, right = line.partition("=>")
        for s in left.split(","):
            rules.setdefault(tuple(s.split()), set()).update(" ".join(a.split()) for a in (right if arrow else left).split(","))
    at, out, longest = 0, [], max(map(len, rules))
    while at < len(words):
        m = max((n for n in range(1, min(longest, len(words) - at) + 1) if tuple(words[at:at + n]) in rules), default=0)
        out.append((at, max(m, 1), sorted(rules[tuple(words[at:at + m])]) if m else [words[at]]))
        at += max(m, 1)
    return out


def test_graph_equals_walk(spark):
    rng = random.Random(3)
    texts = [(k, " ".join(rng.choice("abcdqxyz") if rng.random() < .8 else rng.choice(["the", "and", "r"]) for _ in range(rng.randrange(0, 40))))
             for k in range(80)] + [(90, None), (91, ""), (92, "A b C " * 2000), (93, "a b")]
    df = spark.createDataFrame(texts, "qid long, text string")
    rules = SY.rule_table(spark, LINES)
    for first in (True, False):
        got = {}
        for r in SY.token_graph(df, rules, "qid", ["the", "and"], first).collect():
            got.setdefault(r.qid, []).append((r.at, r.n, r.alternatives))
        want = {}
        for k, t in texts:
            w = (t or "").lower().split()
            if first:
                slots = brute_graph([x for x in w if x not in ("the", "and")], LINES)
            else:
                slots = [(a, n, sorted({" ".join(x for x in alt.split() if x not in ("the", "and")) for alt in alts} - {""}))
                         for a, n, alts in brute_graph(w, LINES)]
            slots = [s for s in slots if s[2]]
            if slots:
                want[k] = slots
        assert {k: sorted(v) for k, v in got.items()} == want


def test_stop_order_decides(spark):
    df = spark.createDataFrame([(1, "the q and r")], "qid long, text string")
    rules = SY.rule_table(spark, LINES)
    first = SY.token_graph(df, rules, "qid", ["the", "and"], True).collect()
    last = SY.token_graph(df, rules, "qid", ["the", "and"], False).collect()
    assert [r.alternatives for r in sorted(first, key=lambda r: r.at)] == [["q"], ["r"]] and [r.alternatives for r in last] == [["s"]]


def test_alternatives_are_phrases_of_prefixes(spark):
    docs = spark.createDataFrame([(1, ["united states of america"]), (2, ["states united"]), (3, ["usa today"]), (4, ["united", "states"]),
                                  (5, ["uniteds statesman"]), (6, ["united the states"]), (7, None), (8, ["unit states united states"])],
                                 "id long, text_all array<string>")
    index = PH.positional_index(PH.field_values(docs, ["text_all"]))
    joined = docs.select("id", "text_all")
    from pyspark.sql import functions as F
    post = IX.postings(joined, F.array_join("text_all", " "))
    voc = IX.vocab(post)
    q = spark.createDataFrame([(1, "USA"), (2, "states"), (3, "usa usa"), (4, "none at all"), (5, None)], "query_id long, text string")
    graph = SY.token_graph(q, SY.rule_table(spark, ["usa, united states", "none at => zz united, zz"]), "query_id", TX.GENERAL_STOPWORDS, True)
    hits = SY.graph_hits(graph, IX.vocab_grams(voc), voc, post, index).collect()
    got = {k: sorted(r.doc_id for r in hits if r.query_id == k) for k in (1, 2, 3, 4, 5)}
    assert got == {1: [1, 3, 5, 8], 2: [1, 2, 4, 5, 6, 8], 3: [1, 3, 5, 8], 4: [], 5: []}


def test_empty(spark):
    df = spark.createDataFrame([], "qid long, text string")
    assert SY.token_graph(df, SY.rule_table(spark, LINES), "qid", [], True).count() == 0
    some = spark.createDataFrame([(1, "a b")], "qid long, text string")
    assert SY.token_graph(some, SY.rule_table(spark, LINES).where("false"), "qid", [], True).count() == 2

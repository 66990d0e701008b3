"""Brute-force checks for the queries without SQL oracle (on the smallest tables)."""

import re
from collections import defaultdict

import duckdb

import __spark_entry__ as E
from websift.functions.stem import porter

SF = "/root/testdata/sf0.001"
Q = E.queries()


def soundex(word: str) -> str:
    """American Soundex (first letter kept; h/w do not separate equal codes)."""
    codes = {**{c: "1" for c in "bfpv"}, **{c: "2" for c in "cgjkqsxz"}, **{c: "3" for c in "dt"},
             "l": "4", **{c: "5" for c in "mn"}, "r": "6"}
    w = word.lower()
    if not w or not w[0].isalpha():
        return word
    out, prev = [w[0].upper()], codes.get(w[0], "")
    for ch in w[1:]:
        code = codes.get(ch, "")
        if code and code != prev:
            out.append(code)
        if ch not in "hw":
            prev = code
    return ("".join(out) + "000")[:4]


def test_phonetic_groups_match_python_soundex(spark):
    names = [r[0] for r in duckdb.sql(f"SELECT p_name FROM '{SF}/part.parquet'").fetchall()]
    want = defaultdict(set)
    for n in names:
        for w in n.split(" "):
            if w:
                want[soundex(w)].add(w)
    got = {r.code: set(r.words.split(" ")) for r in Q["phonetic_match"](spark, SF).collect()}
    assert got == dict(want)


def test_stems_match_python_porter(spark):
    got = {r.term: r.stem for r in Q["stem_vocab"](spark, SF).collect()}
    assert got and all(porter(t) == s for t, s in got.items())


def test_clusters_cover_all_documents(spark):
    n_docs = duckdb.sql(f"SELECT count(*) FROM '{SF}/documents.parquet'").fetchall()[0][0]
    rows = Q["cluster_docs"](spark, SF).collect()
    assert sum(r.size for r in rows) == n_docs
    assert all(r.label for r in rows)


def test_model_report(spark):
    rows = Q["genre_models_accuracy"](spark, SF).collect()
    assert {r.model for r in rows} == {"naive_bayes", "gaussian_nb", "svm", "random_forest", "neural_network"}
    assert all(0.0 <= r.accuracy <= 100.0 and r.n_test > 0 for r in rows)


def test_page_predictions_one_per_page(spark):
    n_pages = duckdb.sql(f"SELECT count(*) FROM '{SF}/pages.parquet'").fetchall()[0][0]
    rows = Q["page_quality_predict"](spark, SF).collect()
    assert len(rows) == n_pages and len({r.page_id for r in rows}) == n_pages
    assert {r.predicted_label for r in rows} <= {"0", "1"}


def test_more_like_this_uses_the_whole_vocabulary(spark):
    from websift.operators import features as FE
    from websift.operators import relevance as RV
    # 30 documents share common words; two share one rare word, which a cut to the commonest terms would drop
    docs = [(i, "common words everywhere " * 3 + f"own{i}") for i in range(30)] + [(100, "common rareword"), (101, "words rareword")]
    w = FE.tfidf(FE.feature_postings(spark.createDataFrame(docs, "doc_id long, text string")), len(docs), vocab_size=None).persist()
    weights = {}
    for r in w.collect():
        weights.setdefault(r.doc_id, {})[r.term] = r.weight
    got = [(r.doc_id, r.score) for r in RV.more_like_this(spark.createDataFrame([(100,)], "doc_id long"), w, n=3).orderBy("pos").collect()]
    want = sorted(((d, round(sum(x * weights[100].get(t, 0) for t, x in v.items()), 9)) for d, v in weights.items() if d != 100),
                  key=lambda r: (-r[1], r[0]))[:3]
    assert got[0][0] == 101 and [d for d, _ in got] == [d for d, _ in want]
    assert all(abs(a[1] - b[1]) < 1e-8 for a, b in zip(got, want))


def test_more_like_this_in_blocks_shuffles_no_pairs(spark):
    from websift.operators import relevance as RV
    rows = [(d, f"t{t}", 0.1 + ((d * 7 + t * 3) % 11) / 10) for d in range(60) for t in range(12) if (d + t * t) % 3 == 0]
    rows += [(1000 + d, t, w) for d, t, w in rows] + [(None, "t0", 1.0)]  # copies: equal scores, ordered by doc_id
    w = spark.createDataFrame(rows, "doc_id long, term string, weight double").persist()
    of = {}
    for d, t, x in rows[:-1]:
        of.setdefault(d, {})[t] = x
    want = []
    for s in range(0, 60, 2):
        top = dict(sorted(of.get(s, {}).items(), key=lambda x: (-x[1], x[0]))[:3])
        near = sorted((-round(sum(x * of[d][t] for t, x in top.items() if t in of[d]), 9), d) for d in of if d != s and set(top) & set(of[d]))
        want += [(s, i, d, -x) for i, (x, d) in enumerate(near[:4], 1)]
    seeds = spark.createDataFrame([(s,) for s in range(0, 60, 2)] + [(None,)], "doc_id long")
    df = RV.more_like_this(seeds, w, top_terms=3, n=4, doc_block=16, seed_block=8)
    assert sorted((r.seed_id, r.pos, r.doc_id, r.score) for r in df.collect()) == sorted(want)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(seed_id#\d+L?, doc_id", plan)


def test_raw_tfidf_shuffles_no_row_of_a_frequent_term(spark):
    """Weights and norms equal ``tfidf``, also with repeated and null ids; the nearest documents are the same."""
    from pyspark.sql import functions as F
    from websift.operators import features as FE
    from websift.operators import relevance as RV
    from websift.session import materialize
    docs = [(i, f"common words w{i % 7} v{i % 3} " * (1 + i % 4) + f"own{i}") for i in range(40)] + [(3, "common again"), (None, "words own3"), (90, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    post, n = materialize(FE.feature_postings(df)), len(docs)
    want = {(r.doc_id, r.term): r.weight for r in FE.tfidf(post, n, vocab_size=None).collect()}
    seeds = spark.createDataFrame([(3,), (3,), (8,), (None,), (77,)], "doc_id long")
    near = sorted(RV.more_like_this(seeds, FE.tfidf(post, n, vocab_size=None).persist(), top_terms=4, n=3).collect())
    for common in (0, 6, 1 << 18):
        w, norms = FE.raw_tfidf(post, n, common)
        got = {(r.doc_id, r.term): r.weight / r.norm for r in w.join(norms, w.doc_id.eqNullSafe(norms.doc_id)).select(w.doc_id, "term", "weight", "norm").collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
        assert w.where("common").select("term").distinct().count() <= common
        plan = w.where(F.col("common"))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan.replace("BroadcastExchange", "")
        assert sorted(RV.more_like_this(seeds, w, top_terms=4, n=3, doc_block=16, norms=norms).collect()) == near

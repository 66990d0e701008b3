"""Plans and results of counts, matches and spatial pairs that move documents instead of their terms."""

from collections import Counter

from websift.operators import analysis as AN
from websift.operators import dictionary as DI
from websift.operators import features as FE
from websift.operators import geo_money as GM
from websift.operators import index as IX
from pyspark.sql import functions as F


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _exchanges(df) -> list[str]:
    return [x for x in _plan(df).splitlines() if "Exchange hashpartitioning" in x]


ROWS = [(1, "cat dog cat", "en", None), (1, "dog", None, "Web"), (None, "cat", "EN", "web"), (2, None, "de", "web"), (3, "", None, None)]


def _docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")


def test_postings_shuffle_no_terms(spark):
    want = [(None, "cat", 1), (1, "cat", 2), (1, "dog", 2)]
    for df in (IX.postings(_docs(spark), F.col("text"), id_col="doc_id"), FE.feature_postings(_docs(spark))):
        assert sorted((tuple(r) for r in df.select("doc_id", "term", "tf").collect()), key=repr) == sorted(want, key=repr)
        assert _exchanges(df) and not any("term" in x for x in _exchanges(df))


def test_field_postings_shuffle_no_terms(spark):
    df = AN._postings(AN.field_tokens(_docs(spark)))
    want = {("text", None, "cat"): 1, ("text", 1, "cat"): 2, ("text", 1, "dog"): 2, ("lang", 1, "en"): 1, ("lang", None, "en"): 1, ("lang", 2, "de"): 1,
            ("source", 1, "web"): 1, ("source", None, "web"): 1, ("source", 2, "web"): 1}
    assert {(r.field, r.doc_id, r.term): r.tf for r in df.collect()} == want
    assert _exchanges(df) and not any("term" in x for x in _exchanges(df))


def test_matching_docs_in_blocks(spark):
    index = [(t, f, d, list(range(n))) for d in [None, *range(30)] for f in ("a", "b") for t, n in (("nation", 2), ("station", 1), ("ion", (d or 0) % 4 + 1))]
    words = [(q, w) for q in [None, *range(8)] for w in ("ion", "n", "ion", "tation", "zebra", "", None)[:(q or 0) + 1]]
    ix = spark.createDataFrame(index, "term string, field string, doc_id long, positions array<int>")
    df = DI.matching_docs(spark.createDataFrame(words, "query_id long, w string"), DI.dictionary(ix, backwards=True), ix, backwards=True, doc_block=8, query_block=3)
    want = Counter()
    for q, w in words:
        for t, f, d, p in index:
            if w and t.endswith(w):
                want[q, f, d] += len(p)
    rows = df.collect()
    assert len(rows) == len(want) and {(r.query_id, r.field, r.doc_id): r.tf for r in rows} == want


def test_spatial_pairs_keep_their_tasks(spark):
    rows = spark.createDataFrame([(i, 10.0, 20.0) for i in range(40)] + [(99, -40.0, 20.0)], "id long, lat double, lon double")
    points = spark.createDataFrame([(1, 10.1, 20.1, 50.0), (2, 80.0, 0.0, 10.0)], "point_id long, lat double, lon double, km double")
    df = GM.near_points(rows, points)
    assert sorted((r.point_id, r.id) for r in df.collect()) == [(1, i) for i in range(40)]
    assert _plan(df).count("REPARTITION_BY_NUM") >= 2 and "BroadcastHashJoin" not in _plan(df)

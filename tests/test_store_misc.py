"""Corpus source, feature cache, reset, ids, upsert, stemming, search on inline rows."""

import os
import tempfile

from websift.functions.stem import porter
from websift.operators import search as SR
from websift.operators import index as IX
from websift.operators import store as ST
from websift.sources import corpus as C
from websift.sources.tables import STORE_SCHEMAS, empty_store


def test_corpus_labels_from_folders(spark):
    root = tempfile.mkdtemp(prefix="websift-corpus-")
    for g, n in (("shop", 2), ("help", 1), ("unknown", 1)):
        os.makedirs(os.path.join(root, g))
        for i in range(n):
            with open(os.path.join(root, g, f"p{i}.html"), "w") as f:
                f.write(f"<html><title>{g}{i}</title>\n<body>x</body></html>")
    df = C.read_corpus(spark, root)
    got = sorted((r.label, "\n" in r.html) for r in df.collect())
    assert got == [("help", True), ("shop", True), ("shop", True)]


def test_feature_cache_builds_once(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="websift-cache-"), "f")
    calls = []

    def build():
        calls.append(1)
        return spark.range(3).withColumnRenamed("id", "x")
    assert C.cached(build, path, spark).count() == 3
    assert C.cached(build, path, spark).count() == 3
    assert len(calls) == 1


def test_reset_gives_empty_tables_with_schemas(spark):
    store = empty_store(spark)
    for name, df in store.items():
        assert df.count() == 0 and df.schema == STORE_SCHEMAS[name]


def test_assign_ids_dense_in_order(spark):
    df = spark.createDataFrame([(u,) for u in ["d", "a", "c", "b", "e"]], "url string").repartition(3)
    got = sorted((r.id, r.url) for r in ST.assign_ids(df, 10, ["url"]).collect())
    assert got == [(11, "a"), (12, "b"), (13, "c"), (14, "d"), (15, "e")]


def test_upsert_keeps_id_and_rank_and_is_idempotent(spark):
    old = spark.createDataFrame([(1, "t", "x", "u1", "b", 5.0, "default"), (2, "t", "x", "u2", "b", -1.0, "default")],
                                STORE_SCHEMAS["websites"])
    inc = spark.createDataFrame([("u2", "T2", "y", "b", "default"), ("u3", "T3", "z", "b", "default")],
                                "url string, title string, text string, base_url string, type_of_website string")
    s1 = ST.upsert_by_url(old, inc)
    rows = {r.url: (r.id, r.rank, r.title) for r in s1.collect()}
    assert rows == {"u1": (1, 5.0, "t"), "u2": (2, -1.0, "T2"), "u3": (3, 0.0, "T3")}
    s2 = ST.upsert_by_url(s1.drop("is_new"), inc)
    assert {r.url: (r.id, r.rank) for r in s2.collect()} == {k: v[:2] for k, v in rows.items()}


def test_porter_published_examples():
    ex = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "motoring": "motor", "hopping": "hop",
          "filing": "file", "happy": "happi", "relational": "relat", "generalizations": "gener",
          "oscillators": "oscil", "dontstems": "dontstems"}
    assert {k: porter(k) for k in ex} == ex


def test_search_order_on_inline_docs(spark):
    docs = spark.createDataFrame([
        (1, "Thin things", "thin thin thing", "http://a.example.com/thin", "a.example.com", 0.0, "default", None, None),
        (2, "Other", "thing", "http://b.example.com/x", "b.example.com", 5.0, "default", None, None),
        (3, "None", "nothing here", "http://c.example.com/y", "c.example.com", 9.0, "default", None, None),
    ], "id long, title string, text string, url string, base_url string, rank double, type_of_website string, "
       "metadata array<string>, external_links array<string>")
    post = IX.postings(docs, IX.text_all_source())
    grams = IX.vocab_grams(IX.vocab(post))
    q = spark.createDataFrame([(1, "thin"), (2, "a"), (3, "x")], "query_id long, q string")
    r = SR.ranked(SR.analyse_queries(q), docs, grams, post, rows=10)
    got = sorted((x.query_id, x.pos, x.doc_id) for x in r.collect())
    # url tf first (doc 1), then rank (doc 2 before doc 3 is not a hit: 'nothing' does not start with 'thin')
    assert got == [(1, 1, 1), (1, 2, 2)]


def test_model_store_round_trip(spark):
    from websift.operators import models as MD
    rows = [(i, ("good clean text about science " if i % 2 else "spam buy cheap pills now ") * 3, i % 2)
            for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    data = MD.prepare(docs, "doc_id", "text", "quality")
    store = tempfile.mkdtemp(prefix="websift-models-")
    m1 = MD.train_or_load("naive_bayes", data, 2, store)
    m2 = MD.train_or_load("naive_bayes", data, 2, store)  # loaded, not refitted
    p1 = [r.prediction for r in MD.predict(m1, data.drop("label")).orderBy("id").collect()]
    p2 = [r.prediction for r in MD.predict(m2, data.drop("label")).orderBy("id").collect()]
    assert p1 == p2
    acc = dict(MD.evaluate({"naive_bayes": m2}, data))
    assert acc["naive_bayes"] == 100.0


def test_models_follow_their_training_rows(spark):
    from websift.operators import models as MD
    store = tempfile.mkdtemp(prefix="websift-models-")

    def data(shift):
        rows = [(i, ("clean text science " if i % 2 else "spam cheap pills ") * 3, (i + shift) % 2) for i in range(40)]
        return MD.prepare(spark.createDataFrame(rows, "doc_id long, text string, quality int"), "doc_id", "text", "quality")
    one, other = data(0), data(1)  # the same texts with the labels exchanged
    a = MD.train_or_load("neural_network", one, 2, store)  # six terms: the network's input follows the vocabulary
    b = MD.train_or_load("neural_network", other, 2, store)
    assert MD.fingerprint(one) == MD.fingerprint(data(0)) != MD.fingerprint(other)
    assert dict(MD.evaluate({"neural_network": a}, one)) == dict(MD.evaluate({"neural_network": b}, other)) == {"neural_network": 100.0}


def test_snapshot_versions_and_reset(spark):
    from websift.sources.snapshots import SnapshotStore
    store = SnapshotStore(spark, tempfile.mkdtemp(prefix="websift-store-"), keep=2)
    assert store.read("websites").count() == 0
    for n in (1, 2, 3):
        store.write("t", spark.range(n))
    assert store.read("t").count() == 3
    assert len(store._versions("t")) == 2
    store.write("websites", spark.createDataFrame([(1, "t", "x", "u", "b", 0.0, "default")], STORE_SCHEMAS["websites"]))
    assert store.read("websites").count() == 1
    store.reset(["websites"])
    assert store.read("websites").count() == 0

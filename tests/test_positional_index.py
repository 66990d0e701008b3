"""The positional index moves documents instead of their terms."""

from websift.operators import phrases as PH


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_positional_index_shuffles_no_terms(spark):
    docs = spark.createDataFrame([(1, "a b a", ["a c", "b"]), (1, "a", None), (None, "b", ["a"]), (2, None, [])], "id long, text string, external_links array<string>")
    for fields in (["text"], ["text", "external_links"]):
        index = PH.positional_index(PH.field_values(docs, fields))
        moved = [x for x in _plan(index).splitlines() if "Exchange " in x]
        assert len(moved) == 1 and "doc_id" in moved[0] and "term" not in moved[0]
    got = sorted(((r.term, r.field, r.doc_id, tuple(r.positions)) for r in index.collect()), key=repr)
    assert got == sorted([("a", "text", 1, (0, 0, 2)), ("b", "text", 1, (1,)), ("b", "text", None, (0,)), ("a", "external_links", 1, (0,)),
                          ("c", "external_links", 1, (1,)), ("b", "external_links", 1, (102,)), ("a", "external_links", None, (0,))], key=repr)

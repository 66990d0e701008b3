"""Rows of the incremental index: one for a document, not one for each of its terms."""

from websift.operators import delta_index as DX


def test_a_document_is_one_row_of_the_delta_index(spark, tmp_path):
    rows = [(k, 1, f"w{k} x x y", False) for k in range(40)] + [(3, 2, "z", False), (4, 2, None, True)]
    DX.write_run(spark.createDataFrame(rows, "doc_id long, version long, text string, deleted boolean"), str(tmp_path), 0)
    assert spark.read.parquet(str(tmp_path / "postings" / "run=0-0")).count() == 39
    got = {(r.doc_id, r.term): r.tf for r in DX.read(spark, str(tmp_path)).collect()}
    assert got[0, "x"] == 2 and got[3, "z"] == 1 and len(got) == 38 * 3 + 1

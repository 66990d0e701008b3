import random
import re
from collections import Counter

from websift.operators import delta_index as DX

SCHEMA = "doc_id long, version long, text string, deleted boolean"


def rebuild(changes):
    """Postings of the newest versions, from scratch."""
    newest = {}
    for d, v, text, deleted in changes:
        if d is not None:
            key = (v, bool(deleted), text or "")
            newest[d] = max(newest.get(d, key), key)
    out = {}
    for d, (_, deleted, text) in newest.items():
        if not deleted:
            for t, n in Counter(w for w in re.findall(r"\w+", text.lower()) if w != "and").items():
                out[d, t] = n
    return out


def feed(seed=3, batches=22):
    rng = random.Random(seed)
    out = [[(rng.randrange(25), 100 * k + i if rng.random() < .8 else rng.randrange(100 * batches), rng.choice([None, "", "a b b", "c and d", "e f a a"]),
             rng.choice([None, False, False, True])) for i in range(rng.randrange(1, 12))] for k in range(batches)]
    out[4] += [(None, 1, "no id", False), (90, 500, "x y", False), (90, 500, "x y", False)]
    out[9] += [(90, 500, "x y", False)]  # the same change in two batches
    out[1] += [(91, 7, "p q", False), (92, 7, "r", False)]
    out[2] += [(91, 7, None, True)]  # a deletion of the same version
    return out


def test_index_equals_a_rebuild_after_every_batch(spark, tmp_path):
    root, done = str(tmp_path), []
    for k, rows in enumerate(feed()):
        done += rows
        DX.write_run(spark.createDataFrame(rows, SCHEMA), root, k)
        DX.merge_levels(spark, root, 3)
        if k % 4 == 3 or k in (8, 9):
            assert {(r.doc_id, r.term): r.tf for r in DX.read(spark, root).collect()} == rebuild(done)
    assert DX.runs(spark, root) == [(0, 8), (9, 17), (18, 20), (21, 21)]


def test_a_repeated_batch_replaces_its_run(spark, tmp_path):
    rows = [(1, 1, "a b", False), (2, 1, "c", False)]
    for _ in range(2):
        DX.write_run(spark.createDataFrame(rows, SCHEMA), str(tmp_path), 0)
    assert {(r.doc_id, r.term): r.tf for r in DX.read(spark, str(tmp_path)).collect()} == rebuild(rows)


def test_a_batch_writes_no_more_than_its_own_rows(spark, tmp_path):
    root = str(tmp_path)
    DX.write_run(spark.createDataFrame([(k, 1, f"w{k} x y", False) for k in range(500)], SCHEMA), root, 0)
    DX.write_run(spark.createDataFrame([(7, 2, "new", False), (8, 2, None, True)], SCHEMA), root, 1)
    assert spark.read.parquet(f"{root}/postings/run=1-1").count() == 1 and spark.read.parquet(f"{root}/docs/run=1-1").count() == 2
    got = {(r.doc_id, r.term) for r in DX.read(spark, root).collect()}
    assert (7, "new") in got and (7, "w7") not in got and not any(d == 8 for d, _ in got) and len(got) == 498 * 3 + 1


def test_an_unfinished_run_does_not_count(spark, tmp_path):
    root = str(tmp_path)
    DX.write_run(spark.createDataFrame([(1, 1, "a", False)], SCHEMA), root, 0)
    (tmp_path / "docs" / "run=0-3").mkdir()
    assert DX.runs(spark, root) == [(0, 0)]


def test_equal_versions_with_two_texts_leave_one(spark, tmp_path):
    for k, order in enumerate(([0, 1], [1, 0])):
        for batch, i in enumerate(order):
            DX.write_run(spark.createDataFrame([(1, 5, ["a b", "c d e"][i], False)], SCHEMA), str(tmp_path / str(k)), batch)
    a, b = (sorted(r.term for r in DX.read(spark, str(tmp_path / k)).collect()) for k in "01")
    assert a == b and a in (["a", "b"], ["c", "d", "e"])


def test_empty(spark, tmp_path):
    assert DX.read(spark, str(tmp_path)).count() == 0
    DX.write_run(spark.createDataFrame([], SCHEMA), str(tmp_path), 0)
    assert DX.read(spark, str(tmp_path)).count() == 0

import numpy as np
import pytest

from websift.operators import knn as KN

SCHEMA = "id long, vec array<double>, label int"


def table(spark, x, start=0, labels=None):
    rows = [(start + i, [float(c) for c in v], int(i % 3 if labels is None else labels[i])) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, SCHEMA)


def brute(test, train, start, k):
    out = {}
    for i, v in enumerate(test):
        d = ((train - v) ** 2).sum(axis=1)
        out[i] = [start + int(j) for j in np.argsort(d, kind="stable")[:k]]
    return out


def clusters(n, seed, dims=8, centres=12):
    rng = np.random.default_rng(seed)
    c = np.random.default_rng(1).normal(size=(centres, dims)) * 5
    return c[rng.integers(0, centres, n)] + rng.normal(size=(n, dims)) * 0.3


@pytest.mark.parametrize("block_rows,max_pivots", [(4096, 1024), (16, 5), (7, 1)])
def test_equals_all_pairs(spark, block_rows, max_pivots):
    train, test = clusters(400, 2), clusters(60, 3)
    train[100:230] = train[100]  # a third of all rows are copies of one
    test[:20] = train[100]
    got = KN.neighbours(table(spark, test), table(spark, train, 1000), 9, block_rows, max_pivots).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.id, r["rank"])):
        by.setdefault(r.id, []).append(r.nb_id)
    assert by == brute(test, train, 1000, 9)


def test_far_cells_are_not_visited(spark):
    share = []
    for n in (300, 3000):
        report = {}
        got = KN.neighbours(table(spark, clusters(50, 5)), table(spark, clusters(n, 4), 10 ** 6), 5, report=report)
        assert got.count() == 250
        share.append(report["compared"] / report["pairs"])
    assert share[1] < share[0] < 0.2


def test_fewer_rows_than_k_nulls_and_empty_tables(spark):
    test = spark.createDataFrame([(1, [0.0, 0.0], 0), (2, None, 0)], SCHEMA)
    train = spark.createDataFrame([(5, [1.0, 0.0], 1), (6, None, 1), (7, [0.5, 0.0], None)], SCHEMA)
    got = KN.neighbours(test, train, 9).orderBy("rank").collect()
    assert [(r.id, r.nb_id, r.nb_label, r["rank"]) for r in got] == [(1, 7, None, 1), (1, 5, 1, 2)]
    assert KN.neighbours(test, train.where("false"), 9).count() == 0
    assert KN.neighbours(test.where("false"), train, 9).count() == 0


def test_only_rows_that_may_be_among_the_k_leave_a_block(spark):
    """A block's candidates are bounded by the k-th distance so far, and equal the exact distances' order with copies."""
    rng = np.random.default_rng(9)
    x, m = rng.normal(size=(40, 8)) + 1000, rng.normal(size=(600, 8)) + 1000
    m[50:300], x[:9] = m[3], m[3]
    d = ((x[:, None] - m[None]) ** 2).sum(axis=2)
    idx = np.argsort(d, axis=1, kind="stable")[:, :20]
    q, c, dist = KN._closest(x, m, np.full(40, np.inf), 20)
    assert c.reshape(40, 20).tolist() == idx.tolist() and dist.tolist() == np.take_along_axis(d, idx, axis=1).ravel().tolist()
    most = np.sort(d, axis=1)[:, 4]
    q, c, dist = KN._closest(x, m, most, 20)
    assert [sorted(c[q == i].tolist()) for i in range(9, 40)] == [sorted(idx[i, :5].tolist()) for i in range(9, 40)]


def test_a_test_row_is_sent_once_to_a_block_of_rings(spark):
    """Where no ring can be left out, copies of the test rows grow with the blocks of training rows, not with the cells."""
    from pyspark.sql import functions as F
    rng = np.random.default_rng(11)
    train = table(spark, rng.normal(size=(400, 16)))
    test = table(spark, rng.normal(size=(30, 16))).select("id", "vec", F.lit(1e9).alias("most"))
    piv = KN.pivots(train)
    for block_rows in (4096, 100):
        rows, rings = KN.cells(train, piv, block_rows)
        late = KN._visits(test, piv, rings, 5)
        assert len(rings) >= len(piv) - 1 and rows.groupBy("block").count().agg(F.max("count")).first()[0] <= block_rows
        assert late.count() <= 30 * rings["block"].nunique() <= 30 * 2 * 400 / block_rows + 30
        assert late.agg(F.sum("pairs")).first()[0] > 30 * 350

import numpy as np

from websift.llm import embeddings


def vectors():
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 64))
    rows = []
    for k in range(160):
        v = base[k % 40] + rng.standard_normal(64) * rng.choice([0.02, 0.2, 0.3, 0.4])
        rows.append((k, v.astype(np.float32).tolist(), k % 40 % 3, "z"))
    rows += [(200, rows[5][1], 2, "z"), (201, rows[5][1], 2, "z"), (202, rows[5][1], 1, "z"), (203, rows[5][1], None, "z"),
             (204, [0.0] * 64, 2, "z"), (205, None, 2, "z"), (206, [float("nan")] + [1.0] * 63, 2, "z"), (207, [None] + [1.0] * 63, 2, "z"),
             (208, [float("inf")] + [1.0] * 63, 2, "z"), (209, [], 2, "z"), (210, [2 * x for x in rows[5][1]], 2, "z"), (5, rows[5][1], 2, "z"),
             (None, rows[8][1], 2, "z"), (211, rows[5][1][:32], 2, "z")]
    return rows


def brute(rows):
    ok = [i for i, (_, v, label, _) in enumerate(rows) if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for n, a in enumerate(ok):
        for b in ok[n + 1:]:
            x, y = np.array(rows[a][1], dtype=np.float64), np.array(rows[b][1], dtype=np.float64)
            if rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93:
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    low = {}
    for i in range(len(rows)):
        if rows[i][0] is not None:
            low[find(i)] = min(low.get(find(i), 1 << 60), rows[i][0])
    return sorted(((rows[i][0] is None, rows[i][0] or 0), links[i], low.get(find(i))) for i in range(len(rows)))


def test_links_and_components_equal_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, key string")
    want = brute(rows)
    assert sum(r[1] for r in want) > 100
    for cell in (embeddings.CELL_VECTORS, 5):
        got = embeddings.join(df, cell_vectors=cell).collect()
        assert sorted(((r.vec_id is None, r.vec_id or 0), r.n_links, r.component_id) for r in got) == want
        assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)


def test_pigeonhole_budgets_cover_the_threshold():
    for dims in (1, 3, 8, 64, 100):
        assert embeddings.budgets(dims, 0.93).sum() >= 2 - 2 * 0.93
        q = embeddings.rotation(dims)
        assert np.allclose(q @ q.T, np.eye(dims))


def test_empty(spark):
    assert embeddings.join(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0

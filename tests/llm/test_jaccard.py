import itertools

import numpy as np

from websift.llm import jaccard, shingles


def sets_of(texts):
    out = []
    for t in texts:
        w = (t or "").encode().split()
        out.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    return out


def brute(rows):
    """(n_links, class) of each row by comparing all pairs."""
    sets = sets_of([t for _, t in rows])
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    groups = {}
    for a in range(len(rows)):
        groups.setdefault(find(a), []).append(rows[a][0])
    low = {k: min((i for i in v if i is not None), default=None) for k, v in groups.items()}
    return [(rows[a][0], links[a], low[find(a)]) for a in range(len(rows))]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x or 0) for x in r))


def test_links_and_classes_equal_brute_force(docs, rows):
    want = order(brute([r[:2] for r in rows]))
    got = order((r.doc_id, r.n_links, r.class_id) for r in jaccard.join(docs).collect())
    assert got == want


def test_blocks_give_the_same_links(spark):
    rng = np.random.default_rng(2)
    base = [f"v{i}" for i in rng.integers(0, 1000, 80)]
    rows = []
    for k in range(40):  # a large group of near copies, split into many small blocks
        w = list(base)
        w[int(rng.integers(0, 80))] = f"x{k}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = order((r.doc_id, r.n_links, r.class_id) for r in jaccard.join(df, block_classes=7).collect())
    assert got == order(brute(rows))


def test_keep_one_keeps_one_of_each_group(docs, rows):
    out = jaccard.keep_one(docs)
    assert out.columns == docs.columns
    kept = [r.doc_id for r in out.collect()]
    groups = brute([r[:2] for r in rows])
    linked = {c for _, n, c in groups if n}
    assert sorted(i for i in kept if i in linked) == sorted(linked)
    alone = {i for i, n, _ in groups if not n and i is not None}
    assert alone <= set(kept)


def test_groups_without_ids_or_with_a_shared_id_stay_apart(spark):
    """Two groups whose doc_ids are all null, and one doc_id on two texts that have a copy each."""
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcd")
    near = c.replace("c29", "other")
    rows = [(None, a), (None, a), (None, b), (None, b), (1, c), (2, c), (4, near), (1, d), (3, d)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    links = jaccard.join(df).collect()
    assert order((r.doc_id, r.n_links, r.class_id) for r in links) == order(brute(rows))
    assert len({r.group_id for r in links}) == 4
    kept = jaccard.keep_one(df).collect()
    assert sorted(((r.doc_id or 0), r.text) for r in kept) == sorted([(0, a), (0, b), (1, c), (1, d)])


def test_pruning_table_follows_the_posterior():
    least = jaccard.least_matches()
    assert len(least) == shingles.HASHES // jaccard.STEP and least == sorted(least)
    rng = np.random.default_rng(1)
    for n, m in zip(range(20, 200, 20), least):  # pairs at the threshold stay
        assert (rng.binomial(n, 0.8, 200_000) >= m).all()
    assert least[-1] > 0.5 * shingles.HASHES


def test_minhash_estimates_similarity():
    words = [f"a{i}" for i in range(400)]
    h, o = shingles.shingles([" ".join(words), " ".join(words[:350] + ["q"] * 50)])
    s = shingles.signatures(h, o)
    a, b = (set(h[o[i]:o[i + 1]].tolist()) for i in (0, 1))
    assert abs((s[0] == s[1]).mean() - len(a & b) / len(a | b)) < 0.15


def test_empty(empty):
    assert jaccard.join(empty).count() == 0 and jaccard.keep_one(empty).count() == 0

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from websift.llm import oracles, trie

SCHEMA = "conv_id long, turn int, role string, text string, depth long, owner string, hi string, _tie string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def table(n=260, seed=4):
    rng = random.Random(seed)
    rows = []
    for c in list(range(n)) + [405, 409, 999]:  # 405 and 409 have no conversation 400
        for t in range(rng.choice([0, 1, 2, 3, 4, 7, 9]) if c != 100 else 3):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "b", "é🙂", "", "long " * 40])))
    rows += [(500 + k, t, "user", "deep") for k in (1, 2) for t in range(150)]  # deep, mostly unary
    rows += [(700 + k, t, "user", f"x{t}" if t < 40 + k else f"y{k}") for k in range(1, 30) for t in range(45 + k)]
    rows += [(3, None, None, None), (3, 0, None, "n"), (6, 1, "user", "same"), (6, 1, "user", "same"), (None, 0, "user", "no id"), (900, 0, "user", "")]
    return [(*r, 1, "o", "h", "t") for r in rows]


def rebuilt(rows, max_shared=5, family=100):
    own = defaultdict(list)
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own[r[0]].append((r[2] or "", r[3] or ""))
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % (max_shared + 1)
        out[c] = own.get(c - c % family, [])[:h] + turns[h:]
    return out


def brute(rows, **kw):
    convs, members = rebuilt(rows, **kw), defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in m if len(convs[c]) == len(p)).encode()).hexdigest()) for p, m in members.items())


def got(df, **kw):
    return sorted(tuple(r[c] for c in COLUMNS) for r in trie.trie(df, **kw).collect())


def test_nodes_equal_brute_force(spark):
    rows = table()
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute([r[:4] for r in rows])


def test_rounds_in_spark_give_the_same(spark):
    """Small limits make Spark split the components down to a few nodes, and strings of a few ids."""
    rows = [r for r in table(120, 9) if r[0] is None or r[0] < 600]
    assert got(spark.createDataFrame(rows, SCHEMA), in_task=40, chunk=3) == brute([r[:4] for r in rows])


def test_plain_trie(spark):
    rows = table(60, 11)
    assert got(spark.createDataFrame(rows, SCHEMA), max_shared=0) == brute([r[:4] for r in rows], max_shared=0)


def test_prefixes_do_not_depend_on_the_ranges(spark):
    rows = [(c, t, "user", f"{t % 3}") for c, n in ((1, 3), (2, 400), (3, 1), (4, 400)) for t in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        many = trie.prefixes(df).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by = defaultdict(dict)
    for r in many:
        by[r.conv_id][r.pos] = tuple(r[f"s{k}"] for k in trie.LANES)
        assert r.pos == 1 or by[r.conv_id].get(r.pos - 1, None) in (None, tuple(r[f"b{k}"] for k in trie.LANES))
    assert by[2] == by[4] and by[1] == {p: by[2][p] for p in (1, 2, 3)} and sorted(by[2]) == list(range(1, 401))
    assert len(set(by[2].values())) == 400


def test_decompose_equals_sums_from_the_leaves():
    rng = np.random.default_rng(7)
    for shape in range(30):
        n = int(rng.integers(1, 300))
        parent = np.array([-1 if i == 0 or rng.random() < 0.03 else (i - 1 if shape % 3 == 0 else int(rng.integers(0 if shape % 3 == 1 else max(0, i - 4), i)))
                           for i in range(n)])
        values = rng.integers(0, 1000, (2, n))
        size, want = np.ones(n, dtype=np.int64), values.copy()
        for v in range(n - 1, 0, -1):
            if parent[v] >= 0:
                size[parent[v]] += size[v]
                want[:, parent[v]] += want[:, v]
        assert (trie.decompose(parent, size, values) == want).all()


def test_empty_table(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert got(spark.createDataFrame([(None, 0, "user", "x", 1, "", "", "")], SCHEMA)) == []


def test_sql_agrees(spark):
    rows = [r[:4] for r in table(150, 3)]
    con = duckdb.connect()
    con.register("conversations", spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").toPandas()
                 .astype({"turn": "Int64", "conv_id": "Int64"}))
    con.execute("CREATE TABLE c AS SELECT conv_id, turn, role, text FROM conversations")
    r = con.sql(oracles.TRIE.replace("FROM conversations", "FROM c")).fetchall()
    names = con.sql(oracles.TRIE.replace("FROM conversations", "FROM c")).columns
    assert sorted((tuple(x[names.index(c)] for c in COLUMNS) for x in r)) == brute(rows)

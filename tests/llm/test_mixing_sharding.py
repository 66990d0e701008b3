import zlib

import pytest

from websift.llm import mixing, quality, sharding


def targets(sizes, weights=(5, 2, 1)):
    """Shared by weight, stopped at three times the size, shared again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, open_ = {s: 0.0 for s in names}, set(names)
    left = float(sum(sizes.values()))
    while True:
        total = sum(w[s] for s in open_)
        goal = {s: left * w[s] / total for s in open_} if total else {}
        over = {s for s in open_ if goal[s] > 3 * sizes[s]}
        if not over:
            out.update(goal)
            return out
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        open_ -= over


def test_mix_reaches_targets_and_agrees_between_runs(docs, rows):
    got = mixing.mix(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    assert len(got) == len(rows)
    words = quality.word_array
    assert words is not None
    sizes = {}
    for r in rows:
        n = len((r[1] or "").encode().split())
        sizes[r[3]] = sizes.get(r[3], 0) + n
    want = targets(sizes)
    by_target = {round(v, 6): s for s, v in want.items()}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = by_target[round(r.target, 6)]
        assert r.source_size == sizes[s] and 0 <= r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        taken[s] += r.taken
    longest = {s: max([0, *(r.size for r in got if by_target[round(r.target, 6)] == s)]) for s in sizes}
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s] / 2 + 1


def test_mix_rows_repeat_as_planned(docs):
    plan = mixing.mix(docs).where("size > 0 and doc_id is not null").groupBy("doc_id").agg({"taken": "sum"}).collect()
    rows = mixing.mix_rows(docs)
    assert rows.columns == docs.columns
    sized = rows.where("doc_id is not null").select("doc_id", (quality.F.size(quality.word_array(quality.F.col("text")))).alias("n"))
    found = {r[0]: r[1] for r in sized.groupBy("doc_id").sum("n").collect()}
    assert {r[0]: r[1] for r in plan if r[1]} == {k: v for k, v in found.items() if v}


def test_mix_empty(empty):
    assert mixing.mix(empty).count() == 0 and mixing.mix_rows(empty).count() == 0


def smallest_capacity(sizes, n):
    def need(c):
        shards, at = 1, 0
        for v in sizes:
            if at + v > c:
                shards, at = shards + 1, 0
            at += v
        return shards
    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if need(mid) <= n else (mid + 1, hi)
    return lo


@pytest.mark.parametrize("blocks,split,n", [(32_768, 64, 7), (8, 4, 7), (3, 2, 3), (16, 2, 40)])
def test_shards_have_the_smallest_capacity(docs, rows, monkeypatch, blocks, split, n):
    monkeypatch.setattr(sharding, "BLOCKS", blocks)
    monkeypatch.setattr(sharding, "SPLIT", split)
    got = sharding.shard(docs, n).collect()
    groups = {}
    for r in rows:
        first, size = groups.get(r[1], (None, 0))
        first = r[0] if first is None or (r[0] is not None and r[0] < first) else first
        groups[r[1]] = (first, size + len((r[1] or "").encode()) + 16)
    ordered = [s for _, s in sorted(groups.values(), key=lambda x: (x[0] is not None, x[0] or 0))]
    load, slots = {}, {}
    for r in got:
        load[r.shard] = load.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert max(load.values()) == smallest_capacity(ordered, n)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and max(load) < n
    text = {}
    for r in got:
        text.setdefault(r.text_crc32, set()).add(r.shard)
    crcs = {zlib.crc32((r[1] or "").encode()) for r in rows}
    assert set(text) == crcs
    assert all(len(v) == 1 for c, v in text.items() if c)  # null and empty texts are two groups with checksum 0


def test_shard_empty(empty):
    assert sharding.shard(empty, 4).count() == 0

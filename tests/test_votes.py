"""Vote cooldown and bounded rank fold against a plain sequential loop."""

import datetime as dt
import random

from websift.operators import votes as V

T0 = dt.datetime(2024, 1, 1)


def sequential(votes, sites, cd):
    """The reference's order of checks, one vote at a time."""
    last, rank, out = None, dict(), {}
    counts = {}
    for sid, r in sites:
        counts[sid] = counts.get(sid, 0) + 1
        rank.setdefault(sid, r)
    for eid, ts, wid, reaction in sorted(votes, key=lambda v: (v[1], v[0])):
        t = ts.timestamp()
        if last is not None and last + cd >= t:
            out[eid] = ("too_many_requests", None)
            continue
        last = t
        if wid not in counts:
            out[eid] = ("no_website", None)
        elif counts[wid] > 1:
            out[eid] = ("ambiguous_website", None)
        elif (reaction == "up" and rank[wid] <= 9) or (reaction == "down" and rank[wid] >= -9):
            rank[wid] += 1 if reaction == "up" else -1
            out[eid] = ("accepted", rank[wid])
        else:
            out[eid] = ("out_of_bounds", None)
    return out


def run(spark, votes, sites, cd, chunk=86400):
    vdf = spark.createDataFrame(votes, "event_id long, ts timestamp, website_id long, reaction string")
    sdf = spark.createDataFrame(sites, "id long, rank double")
    got = V.rank_fold(vdf, sdf, cd, chunk_seconds=chunk).collect()
    return {r.event_id: (r.outcome, r.rank_after) for r in got}


def test_exact_gap_is_rejected(spark):
    votes = [(1, T0, 1, "up"), (2, T0 + dt.timedelta(seconds=10), 1, "up"),
             (3, T0 + dt.timedelta(seconds=20, microseconds=1), 1, "up")]
    got = run(spark, votes, [(1, 0.0)], 10.0)
    assert got[1][0] == "accepted" and got[2][0] == "too_many_requests" and got[3][0] == "accepted"


def test_bounds_and_fractional_start(spark):
    sites = [(1, 9.0), (2, 9.5), (3, 10.0), (4, -9.0), (5, -10.0), (6, 0.0), (6, 1.0)]
    votes = [(i, T0 + dt.timedelta(minutes=i), w, r) for i, (w, r) in enumerate(
        [(1, "up"), (1, "up"), (2, "up"), (2, "down"), (3, "up"), (4, "down"), (4, "down"), (5, "down"),
         (5, "up"), (6, "up"), (7, "up")])]
    got = run(spark, votes, sites, 10.0)
    want = sequential(votes, sites, 10.0)
    assert got == want
    assert got[0] == ("accepted", 10.0) and got[1][0] == "out_of_bounds"
    assert got[2][0] == "out_of_bounds" and got[3] == ("accepted", 8.5)
    assert got[9][0] == "ambiguous_website" and got[10][0] == "no_website"


def test_random_streams_match_sequential(spark):
    rnd = random.Random(7)
    sites = [(i, float(rnd.choice([0, 3, -4, 9, -9, 8.5]))) for i in range(6)]
    votes, t = [], T0
    for eid in range(600):
        t = t + dt.timedelta(seconds=rnd.choice([1, 5, 10, 11, 30, 3600]))
        votes.append((eid, t, rnd.randrange(8), rnd.choice(["up", "up", "down"])))
    for cd in (10.0, 60.0):
        assert run(spark, votes, sites, cd, chunk=3600) == sequential(votes, sites, cd)


def sequential_slots(votes, cd):
    last, out = None, {}
    for eid, ts, _, _ in sorted(votes, key=lambda v: (v[1], v[0])):
        t = ts.timestamp()
        ok = last is None or t - last > cd
        if ok:
            last = t
        out[eid] = ok
    return out


def test_dense_sessions_by_pointer_doubling(spark):
    rnd = random.Random(11)
    votes, t = [], T0
    for eid in range(700):
        t = t + dt.timedelta(seconds=rnd.choice([0, 1, 2, 3, 5, 7, 9, 10, 11]),
                             microseconds=rnd.choice([0, 1, 500000]))
        votes.append((eid, t, rnd.randrange(5), rnd.choice(["up", "down"])))
    votes.append((900, t + dt.timedelta(seconds=60), 1, "up"))      # a second session
    vdf = spark.createDataFrame(votes, "event_id long, ts timestamp, website_id long, reaction string")
    want = sequential_slots(votes, 10.0)
    for hot in (0, 10 ** 9):   # every session doubled / every session scanned
        got = {r.event_id: r.slot_ok for r in V.cooldown(vdf, 10.0, hot_rows=hot).collect()}
        assert got == want


def test_unknown_site_uses_up_the_slot(spark):
    votes = [(1, T0, 99, "up"), (2, T0 + dt.timedelta(seconds=5), 1, "up"),
             (3, T0 + dt.timedelta(seconds=11), 1, "up")]
    got = run(spark, votes, [(1, 0.0)], 10.0)
    assert got[1][0] == "no_website" and got[2][0] == "too_many_requests" and got[3] == ("accepted", 1.0)


def test_long_sessions_take_no_more_jobs(spark, monkeypatch):
    """A session of any length is solved in the same number of steps, over chunk borders, ties and copies of a vote time."""
    rnd = random.Random(5)
    steps = []
    for n in (40, 1500):
        votes, t = [], T0
        for eid in range(n):
            t = t + dt.timedelta(seconds=rnd.choice([0, 0, 1, 2, 9]) if eid % 400 else 5000)
            votes.append((eid, t, 1, "up"))
        vdf = spark.createDataFrame(votes, "event_id long, ts timestamp, website_id long, reaction string")
        cut, real = [], V.materialize
        monkeypatch.setattr(V, "materialize", lambda df, *keys: cut.append(1) or real(df, *keys))
        got = {r.event_id: r.slot_ok for r in V.cooldown(vdf, 10.0, hot_rows=0).collect()}
        monkeypatch.undo()
        assert got == sequential_slots(votes, 10.0)
        steps.append(len(cut))
    assert steps[0] == steps[1]

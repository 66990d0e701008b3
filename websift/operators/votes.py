"""Votes: global cooldown (W6), bounded rank fold per website (W3, F13), outcomes (Q12).

Order of checks per vote, in (ts, event_id) order: cooldown (the slot is used
up by every vote that passes it) → website exists (exactly once) → bound.

Cooldown at scale.  A vote is accepted when more than ``cooldown`` seconds
passed since the last accepted vote.  If the gap to the *previous vote* is
larger than that, the vote is accepted whatever came before, so the stream
splits into independent gap-sessions.  The previous timestamp and the session
key come from a two-level scan: a window inside time buckets plus a carry over
the (small) per-bucket summary table, never a single global window over the
votes.  Inside a session the greedy chain is followed with ``searchsorted``
(next accepted = first vote later than last + cooldown).

Rank fold at scale.  In offset space n = rank - start_rank an upvote is
``min(n+1, H)`` and a downvote ``max(n-1, L)``; compositions of such steps
stay of the form ``min(max(n+a, lo), hi)``.  Each (website, time chunk)
folds to one (a, lo, hi) on the JVM; chunks are composed per website in
order (one row per chunk); then each chunk replays its votes from its entry
offset to give per-vote outcomes.  A website with a third of all votes is
spread over its chunks.  Start ranks are within [-10, 10] (store invariant).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

COOLDOWN_SECONDS = 10.0
UPPER, LOWER = 9.0, -9.0          # an upvote needs rank <= 9, a downvote rank >= -9
STEP = 1.0
BUCKET_SECONDS = 60               # cooldown scan bucket (window partitions; summary table has one row per bucket)
CHUNK_SECONDS = 86400             # rank-fold chunk
BIG = 1 << 40
HOT_SESSION_ROWS = 2_000_000      # sessions above this size are split into chunks of time
CHAIN_COOLDOWNS = 16              # cooldowns in such a chunk


def _ordered(votes: DataFrame) -> DataFrame:
    return votes.withColumn("t_us", F.unix_micros(F.col("ts").cast("timestamp")))


def cooldown(votes: DataFrame, seconds: float = COOLDOWN_SECONDS,
             bucket_seconds: int = BUCKET_SECONDS, hot_rows: int | None = None) -> DataFrame:
    """Add ``slot_ok``: the vote passes the global cooldown.

    Sessions with more than ``hot_rows`` votes (a dense stream without a gap
    longer than the cooldown) are cut into chunks of time instead of one
    sequential scan."""
    hot_rows = HOT_SESSION_ROWS if hot_rows is None else hot_rows
    cd = int(round(seconds * 1_000_000))
    v = _ordered(votes).withColumn("b", F.floor(F.col("t_us") / F.lit(bucket_seconds * 1_000_000)))
    in_b = Window.partitionBy("b").orderBy("t_us", "event_id")
    v = v.withColumn("prev_in_b", F.lag("t_us").over(in_b))
    # per-bucket summary: last timestamp; carried to the next non-empty bucket
    bsum = v.groupBy("b").agg(F.max("t_us").alias("b_last"))
    carry = Window.orderBy("b")  # one row per bucket: small
    bsum = bsum.withColumn("prev_b_last", F.lag("b_last").over(carry)).select("b", "prev_b_last")
    v = v.join(bsum, "b").withColumn("prev_t", F.coalesce("prev_in_b", "prev_b_last"))
    v = v.withColumn("start", F.col("prev_t").isNull() | (F.col("t_us") - F.col("prev_t") > F.lit(cd)))
    # session key = (t_us, event_id) of the last start at or before the vote
    skey = F.when(F.col("start"), F.struct("t_us", "event_id"))
    run = in_b.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    v = v.withColumn("sk_in_b", F.last(skey, ignorenulls=True).over(run))
    blast = v.groupBy("b").agg(F.max(skey).alias("b_last_start"))
    blast = blast.withColumn("carry_start", F.last("b_last_start", ignorenulls=True)
                             .over(carry.rowsBetween(Window.unboundedPreceding, -1))).select("b", "carry_start")
    v = v.join(blast, "b").withColumn("session", F.coalesce("sk_in_b", "carry_start"))
    v = v.select(F.col("session.t_us").alias("s_t"), F.col("session.event_id").alias("s_id"), "t_us", "event_id")
    v = materialize(v)
    sizes = v.groupBy("s_t", "s_id").agg(F.count(F.lit(1)).alias("n"))
    hot = sizes.where(F.col("n") > hot_rows)
    chunked = None
    if hot.count():
        hv = v.join(hot.select("s_t", "s_id"), ["s_t", "s_id"], "left_semi")
        v = v.join(hot.select("s_t", "s_id"), ["s_t", "s_id"], "left_anti")
        chunked = _chain_by_chunks(hv.select("t_us", "event_id"), cd)
    # whole sessions are routed by the bucket of their start; within a partition
    # rows are in time order, so the greedy chain runs over Arrow batches
    grp = F.floor(F.col("s_t") / F.lit(bucket_seconds * 1_000_000))
    sess = (v.select(grp.alias("g"), "t_us", "event_id")
            .repartition("g").sortWithinPartitions("g", "t_us", "event_id"))

    def chain(batches):
        last = None
        for pdf in batches:
            t = pdf["t_us"].to_numpy()
            ok = np.zeros(len(t), dtype=bool)
            nxt = np.searchsorted(t, t + cd, side="right")
            i = 0 if last is None else int(np.searchsorted(t, last + cd, side="right"))
            while i < len(t):
                ok[i] = True
                last = int(t[i])
                i = nxt[i]
            yield pd.DataFrame({"event_id": pdf["event_id"].to_numpy(), "slot_ok": ok})

    flags = sess.mapInPandas(chain, "event_id long, slot_ok boolean")
    if chunked is not None:
        flags = flags.unionByName(chunked)
    return votes.join(flags, "event_id")


def _chain_by_chunks(ev: DataFrame, cd: int, chunk: int | None = None) -> DataFrame:
    """Greedy cooldown chain of large sessions without one scan over all votes.

    ``ev`` (t_us, event_id).  Time is cut into chunks of some cooldowns.  What a chunk does depends only on the last
    accepted time L before it: its first accepted vote is the first one later than L + cd, among those of its first
    cooldown or the next one, and the chain from there gives the chunk's last accepted time.  Neighbouring entries mostly
    end alike, so a chunk is summed up in a few rows (up_to, exit): an L with L + cd < up_to ends at ``exit``.  The sums
    are composed in time order, and then every chunk follows its chain from its own L.  Sessions are more than a
    cooldown apart, so one after another they need no key of their own."""
    chunk = chunk or CHAIN_COOLDOWNS * cd
    ev = ev.select(F.floor(F.col("t_us") / F.lit(chunk)).alias("c"), "t_us", "event_id")

    def sums(key, pdf):
        t = np.sort(pdf["t_us"].to_numpy())
        end = np.searchsorted(t, t + cd, side="right")
        at = np.arange(min(len(t), np.searchsorted(t, key[0] * chunk + cd, side="right") + 1))
        while (end[at] < len(t)).any():  # a jump passes a cooldown, and a chunk has CHAIN_COOLDOWNS of them
            at = np.where(end[at] < len(t), end[at], at)
        last = np.append(np.flatnonzero(np.diff(at)), len(at) - 1)
        return pd.DataFrame({"c": key[0], "up_to": t[last], "exit": t[at[last]]})

    def entries(batches):
        c, entry, done = None, None, False
        for pdf in batches:
            out = []
            for k, up_to, leave in zip(pdf["c"].tolist(), pdf["up_to"].tolist(), pdf["exit"].tolist()):
                if k != c:
                    c, done = k, False
                    out.append((c, entry))
                if not done and (entry is None or entry + cd < up_to):
                    entry, done = leave, True
            yield pd.DataFrame({"c": [k for k, _ in out], "entry": pd.array([e for _, e in out], dtype="Int64")})

    def chain(batches):
        c, last = None, None
        for pdf in batches:
            ks, t = pdf["c"].to_numpy(), pdf["t_us"].to_numpy()
            entry = pdf["entry"].astype("Int64")
            ok = np.zeros(len(t), dtype=bool)
            first = np.flatnonzero(np.append(True, ks[1:] != ks[:-1])) if len(t) else []
            for a, b in zip(first, [*first[1:], len(t)]):
                if ks[a] != c:
                    c, last = ks[a], None if pd.isna(entry.iloc[a]) else int(entry.iloc[a])
                i = a if last is None else a + int(np.searchsorted(t[a:b], last + cd, side="right"))
                while i < b:
                    ok[i], last = True, int(t[i])
                    i = a + int(np.searchsorted(t[a:b], last + cd, side="right"))
            yield pd.DataFrame({"event_id": pdf["event_id"].astype("Int64"), "slot_ok": ok})

    parts = ev.select("c", "t_us").distinct().groupBy("c").applyInPandas(sums, "c long, up_to long, exit long")
    entry = materialize(parts.repartition(1).sortWithinPartitions("c", "up_to").mapInPandas(entries, "c long, entry long"))
    return (ev.join(entry, "c").repartition("c").sortWithinPartitions("c", "t_us", "event_id")
            .mapInPandas(chain, "event_id long, slot_ok boolean"))


def _bounds(start_rank):
    hi = F.floor(F.lit(UPPER) - start_rank).cast("long") + 1
    lo = F.ceil(F.lit(LOWER) - start_rank).cast("long") - 1
    return hi, lo


ENTRY_EVENT = -(1 << 62)  # synthetic vote standing for the last accepted one of an earlier batch


def with_entry(votes: DataFrame, last_accept_us: int | None) -> DataFrame:
    """Prepend the previous batch's last accepted vote so the cooldown continues from it."""
    if last_accept_us is None:
        return votes
    spark = votes.sparkSession
    e = spark.createDataFrame([(ENTRY_EVENT, last_accept_us)], "event_id long, t long") \
        .select("event_id", F.timestamp_micros("t").alias("ts"), F.lit(None).cast("long").alias("website_id"),
                F.lit("entry").alias("reaction"))
    return votes.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "website_id", "reaction").unionByName(e)


def rank_fold(votes: DataFrame, websites: DataFrame, seconds: float = COOLDOWN_SECONDS,
              chunk_seconds: int = CHUNK_SECONDS, last_accept_us: int | None = None) -> DataFrame:
    """Per-vote outcome and rank after the vote.

    ``votes`` (event_id, ts, website_id, reaction 'up'/'down'),
    ``websites`` (id, rank).  Returns (event_id, website_id, reaction, outcome,
    rank_after) where rank_after is NULL unless the vote was accepted.
    """
    v = cooldown(with_entry(votes, last_accept_us), seconds)
    if last_accept_us is not None:
        v = v.where(F.col("event_id") != ENTRY_EVENT)
    site_n = websites.groupBy("id").agg(F.count(F.lit(1)).alias("n_sites"), F.first("rank").alias("start_rank"))
    v = v.join(site_n, v.website_id == site_n.id, "left").drop("id")
    outcome0 = (F.when(~F.col("slot_ok"), "too_many_requests")
                .when(F.col("n_sites").isNull(), "no_website")
                .when(F.col("n_sites") > 1, "ambiguous_website"))
    v = materialize(v.withColumn("outcome0", outcome0), "event_id")
    live = _ordered(v.where(F.col("outcome0").isNull())) \
        .withColumn("chunk", F.floor(F.col("t_us") / F.lit(chunk_seconds * 1_000_000)))
    hi_b, lo_b = _bounds(F.col("start_rank"))
    live = live.withColumn("H", hi_b).withColumn("L", lo_b).withColumn("d", F.when(F.col("reaction") == "up", 1).otherwise(-1))

    # level 1: each (website, chunk) folds to min(max(n + a, lo), hi)
    steps = F.array_sort(F.collect_list(F.struct("t_us", "event_id", "d")))
    init = F.struct(F.lit(0).cast("long").alias("a"), F.lit(-BIG).cast("long").alias("lo"),
                    F.lit(BIG).cast("long").alias("hi"))

    def step(f, e, H, L):
        up = F.struct((f.a + 1).alias("a"), (f.lo + 1).alias("lo"), F.least(f.hi + 1, H).alias("hi"))
        dn = F.struct((f.a - 1).alias("a"), F.greatest(f.lo - 1, L).alias("lo"), F.greatest(f.hi - 1, L).alias("hi"))
        return F.when(e.d == 1, up).otherwise(dn)

    chunks = live.groupBy("website_id", "chunk", "H", "L").agg(steps.alias("steps")) \
        .select("website_id", "chunk", F.aggregate("steps", init, lambda f, e: step(f, e, F.col("H"), F.col("L"))).alias("f"))
    chunks = chunks.select("website_id", "chunk", "f.a", "f.lo", "f.hi")

    # level 2: entry offset of every chunk, composing chunks in time order per website
    def entries(batches):
        site, n = None, 0
        for pdf in batches:
            out = np.empty(len(pdf), dtype=np.int64)
            for k, (w, a, lo, hi) in enumerate(zip(pdf["website_id"].to_numpy(), pdf["a"].to_numpy(),
                                                    pdf["lo"].to_numpy(), pdf["hi"].to_numpy())):
                if w != site:
                    site, n = w, 0
                out[k] = n
                n = min(max(n + int(a), int(lo)), int(hi))
            yield pd.DataFrame({"website_id": pdf["website_id"].to_numpy(), "chunk": pdf["chunk"].to_numpy(),
                                "entry": out})

    ent = (chunks.repartition("website_id").sortWithinPartitions("website_id", "chunk")
           .mapInPandas(entries, "website_id long, chunk long, entry long"))

    # level 3: replay each chunk from its entry offset
    def replay(batches):
        key, n = None, 0
        for pdf in batches:
            m = len(pdf)
            ok = np.zeros(m, dtype=bool)
            after = np.full(m, np.nan)
            cols = [pdf[c].to_numpy() for c in ("website_id", "chunk", "entry", "H", "L", "start_rank", "d")]
            for k, (w, ch, e, H, L, r0, d) in enumerate(zip(*cols)):
                if (w, ch) != key:
                    key, n = (w, ch), int(e)
                if (d == 1 and n < H) or (d == -1 and n > L):
                    n += int(d)
                    ok[k] = True
                    after[k] = r0 + n * STEP
            yield pd.DataFrame({"event_id": pdf["event_id"].to_numpy(), "accepted": ok, "rank_after": after})

    played = (live.join(ent, ["website_id", "chunk"])
              .select("website_id", "chunk", "t_us", "event_id", "entry", "H", "L", "start_rank", "d")
              .repartition("website_id", "chunk").sortWithinPartitions("website_id", "chunk", "t_us", "event_id")
              .mapInPandas(replay, "event_id long, accepted boolean, rank_after double"))
    res = v.join(played, "event_id", "left")
    outcome = F.coalesce(F.col("outcome0"), F.when(F.col("accepted"), "accepted").otherwise("out_of_bounds"))
    return res.select("event_id", "ts", "website_id", "reaction", outcome.alias("outcome"),
                      F.when(F.col("accepted"), F.col("rank_after")).alias("rank_after"))


def final_ranks(votes: DataFrame, websites: DataFrame, seconds: float = COOLDOWN_SECONDS) -> DataFrame:
    """(website_id, rank, n_accepted) for every website (rank unchanged without votes)."""
    out = rank_fold(votes, websites, seconds)
    acc = out.where(F.col("outcome") == "accepted")
    last = acc.groupBy("website_id").agg(
        F.max_by("rank_after", F.struct("ts", "event_id")).alias("last_rank"), F.count(F.lit(1)).alias("n_accepted"))
    return (websites.select(F.col("id").alias("website_id"), F.col("rank").alias("start_rank"))
            .join(last, "website_id", "left")
            .select("website_id", F.coalesce("last_rank", "start_rank").alias("rank"),
                    F.coalesce("n_accepted", F.lit(0)).cast("long").alias("n_accepted")))

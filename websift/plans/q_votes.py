"""Vote queries: cooldown, per-vote outcomes, ranks, link score, site rank."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import links as L
from ..operators import votes as V
from . import sqlkit as S
from .context import ctx
from .registry import register

# Cooldown used to exercise rejections (the reference's is 10 s).
STRICT_COOLDOWN = 600.0


def _sql_outcomes(cd_seconds: float) -> str:
    cd = int(cd_seconds * 1_000_000)
    return f"""{S.cte_votes()},
srt AS (SELECT list({{'eid': event_id, 't': epoch_us(ts)}} ORDER BY ts, event_id) AS l FROM votes),
cd AS (SELECT unnest(list_reduce(l,
          lambda acc, e: CASE WHEN acc.last IS NULL OR e.t - acc.last > {cd}
                              THEN {{'last': e.t, 'ids': list_append(acc.ids, e.eid)}} ELSE acc END,
          {{'last': CAST(NULL AS BIGINT), 'ids': CAST([] AS BIGINT[])}}).ids) AS eid FROM srt),
sites AS (SELECT page_id AS id, count(*) AS n_sites, 0.0 AS start_rank FROM pages GROUP BY page_id),
v2 AS (SELECT v.*, v.event_id IN (SELECT eid FROM cd) AS slot_ok, s.n_sites, s.start_rank
       FROM votes v LEFT JOIN sites s ON s.id = v.website_id),
folded AS (
  SELECT website_id, unnest(list_reduce(
           list({{'eid': event_id, 'd': CASE WHEN reaction = 'up' THEN 1 ELSE -1 END}} ORDER BY ts, event_id),
           lambda acc, e: CASE WHEN (e.d = 1 AND acc.r <= 9) OR (e.d = -1 AND acc.r >= -9)
                               THEN {{'r': acc.r + e.d, 'outs': list_append(acc.outs, {{'eid': e.eid, 'ok': true, 'r': acc.r + e.d}})}}
                               ELSE {{'r': acc.r, 'outs': list_append(acc.outs, {{'eid': e.eid, 'ok': false, 'r': CAST(NULL AS DOUBLE)}})}} END,
           {{'r': CAST(0.0 AS DOUBLE), 'outs': CAST([] AS STRUCT(eid BIGINT, ok BOOLEAN, r DOUBLE)[])}}).outs) AS o
  FROM v2 WHERE slot_ok AND n_sites = 1 GROUP BY website_id),
outcomes AS (
  SELECT v.event_id, v.ts, v.website_id, v.reaction,
         CASE WHEN NOT v.slot_ok THEN 'too_many_requests' WHEN v.n_sites IS NULL THEN 'no_website'
              WHEN v.n_sites > 1 THEN 'ambiguous_website' WHEN f.o.ok THEN 'accepted' ELSE 'out_of_bounds' END AS outcome,
         f.o.r AS rank_after
  FROM v2 v LEFT JOIN folded f ON f.o.eid = v.event_id)"""


def _sql_ranks(cd_seconds: float) -> str:
    return f"""{_sql_outcomes(cd_seconds)},
ranks AS (
  SELECT p.page_id AS website_id,
         coalesce(arg_max(o.rank_after, o.ts) FILTER (WHERE o.outcome = 'accepted'), 0.0) AS rank,
         CAST(count(o.event_id) FILTER (WHERE o.outcome = 'accepted') AS BIGINT) AS n_accepted
  FROM pages p LEFT JOIN outcomes o ON o.website_id = p.page_id GROUP BY p.page_id)"""


@register("vote_outcomes", ops=("W3", "W6", "F13", "Q12", "T5"), sql=f"""
WITH {_sql_outcomes(STRICT_COOLDOWN)}
SELECT event_id, website_id, reaction, outcome, round(rank_after, 6) AS rank_after FROM outcomes
""")
def vote_outcomes(spark, sf_dir):
    c = ctx(spark, sf_dir)
    out = V.rank_fold(c.votes, c.websites.select("id", "rank"), STRICT_COOLDOWN)
    return out.select("event_id", "website_id", "reaction", "outcome", F.round("rank_after", 6).alias("rank_after"))


@register("vote_cooldown", ops=("W6",), sql=f"""
WITH {_sql_outcomes(10.0)}
SELECT event_id, CAST(slot_ok AS BIGINT) AS slot_ok FROM v2
""")
def vote_cooldown(spark, sf_dir):
    c = ctx(spark, sf_dir)
    return V.cooldown(c.votes, 10.0).select("event_id", F.col("slot_ok").cast("long").alias("slot_ok"))


@register("vote_rank", ops=("W3", "F13", "W5"), sql=f"""
WITH {_sql_ranks(V.COOLDOWN_SECONDS)}
SELECT website_id, round(rank, 6) AS rank, n_accepted FROM ranks
""")
def vote_rank(spark, sf_dir):
    c = ctx(spark, sf_dir)
    r = V.final_ranks(c.votes, c.websites.select("id", "rank"))
    return r.select("website_id", F.round("rank", 6).alias("rank"), "n_accepted")


def _ranks_df(c):
    return c.ranks


@register("inbound_link_score", ops=("J7", "G4", "F6"), sql=f"""
WITH {S.cte_links()},
{_sql_ranks(V.COOLDOWN_SECONDS)}
SELECT e.domain, CAST(count(DISTINCT e.page_id) AS BIGINT) AS inbound_sites,
       round(least(greatest(coalesce(sum(CASE WHEN r.rank > 0 THEN r.rank * {L.LINK_WEIGHT} END), 0.0), -{L.LINK_SCORE_BOUND}), {L.LINK_SCORE_BOUND}), 6) AS link_score
FROM edges e JOIN ranks r ON r.website_id = e.page_id
WHERE r.rank >= 0
GROUP BY e.domain
""")
def inbound_link_score(spark, sf_dir):
    c = ctx(spark, sf_dir)
    return L.inbound_link_scores(c.edges, _ranks_df(c))


@register("site_rank", ops=("G5", "G4", "W3"), sql=f"""
WITH {S.cte_links()},
{_sql_ranks(V.COOLDOWN_SECONDS)},
ls AS (
  SELECT e.domain, round(least(greatest(coalesce(sum(CASE WHEN r.rank > 0 THEN r.rank * {L.LINK_WEIGHT} END), 0.0), -{L.LINK_SCORE_BOUND}), {L.LINK_SCORE_BOUND}), 6) AS link_score
  FROM edges e JOIN ranks r ON r.website_id = e.page_id WHERE r.rank >= 0 GROUP BY e.domain)
SELECT s.page_id AS website_id, s.root AS base_url, round(r.rank, 6) AS vote_rank,
       coalesce(ls.link_score, 0.0) AS link_score, round(r.rank + coalesce(ls.link_score, 0.0), 6) AS site_rank
FROM site s JOIN ranks r ON r.website_id = s.page_id LEFT JOIN ls ON ls.domain = s.root
""")
def site_rank(spark, sf_dir):
    """Vote rank of the website + link score of its registrable domain."""
    c = ctx(spark, sf_dir)
    ranks = _ranks_df(c)
    ls = L.inbound_link_scores(c.edges, ranks).select(F.col("domain").alias("base_url"), "link_score")
    return (c.site.select(F.col("page_id").alias("website_id"), F.col("root").alias("base_url"))
            .join(ranks.withColumnRenamed("id", "website_id"), "website_id")
            .join(ls, "base_url", "left")
            .select("website_id", "base_url", F.round("rank", 6).alias("vote_rank"),
                    F.coalesce("link_score", F.lit(0.0)).alias("link_score"),
                    F.round(F.col("rank") + F.coalesce("link_score", F.lit(0.0)), 6).alias("site_rank")))

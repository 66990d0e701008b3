"""Link graph operators: frontier (J4), inbound links (J7, G4), site rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINK_WEIGHT = 0.0001
LINK_SCORE_BOUND = 20.0


def frontier_candidates(candidates: DataFrame, websites: DataFrame,
                        queue: DataFrame | None = None) -> DataFrame:
    """Distinct candidate URLs that are neither a known website nor queued.

    Both exclusions are left-anti joins on the URL key; Spark shuffles (or, for
    a small side measured at run time, broadcasts) by URL.
    """
    out = candidates.select("url").where(F.col("url").isNotNull()).distinct()
    out = out.join(websites.select("url"), "url", "left_anti")
    if queue is not None:
        out = out.join(queue.select("url"), "url", "left_anti")
    return out


def inbound_link_scores(edges: DataFrame, ranks: DataFrame, weight: float = LINK_WEIGHT,
                        bound: float = LINK_SCORE_BOUND) -> DataFrame:
    """Per linked domain, the linking sites with rank >= 0 and their score.

    ``edges`` (page_id, domain), ``ranks`` (id, rank).  One shuffle for the
    edge ⋈ rank join on page id, one partial+final aggregation on domain.
    """
    e = edges.join(ranks.select(F.col("id").alias("page_id"), "rank"), "page_id", "inner") \
        .where(F.col("rank") >= 0)
    agg = e.groupBy("domain").agg(
        F.countDistinct("page_id").alias("inbound_sites"),
        F.coalesce(F.sum(F.when(F.col("rank") > 0, F.col("rank") * weight)), F.lit(0.0)).alias("raw"))
    return agg.select("domain", F.col("inbound_sites").cast("long").alias("inbound_sites"),
                      F.round(F.least(F.greatest("raw", F.lit(-bound)), F.lit(bound)), 6).alias("link_score"))

"""Inputs derived from the given tables (FIXTURES.md §3).

The given ``pages`` carry only relative links and one meta value, so the link
graph, votes and query batches are derived from the tables by fixed formulas
that the SQL oracle repeats.  Their size grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from .tables import table, table_count

# The search batch used by the tests (query_id, q).
QUERY_BATCH = [
    (1, "thin the"),
    (2, "ble"),
    (3, "re-the"),
    (4, "x"),
    (5, ""),
    (6, "abcdefghijklmnop"),
    (7, "c++ (the)"),
    (8, "the the"),
]

# Synonym rules of the test batch, beside the shipped ones.
QUERY_SYNONYMS = ["thin the, thou re", "re the => ble on, er", "the => the th, of the", "in the re, in, inth", "of, of the and in => with"]

# Hrefs added to every 50th page so that relative, mail and
# IP links reach the link extractor.
NOISE_HREFS = ["/relative/page.html", "mailto:x@y", "http://10.0.0.1/index.html"]
EDGE_FANOUT = (1, 2, 3)


def queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUERY_BATCH, "query_id long, q string")


def site(spark: SparkSession, sf_dir: str, rules: DataFrame | None = None) -> DataFrame:
    """(page_id, url, host, root) for every page."""
    rules = rules if rules is not None else U.suffix_rules(spark)
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return U.with_root(pages, "url", rules).select("page_id", "url", "host", "root")


def outlinks(spark: SparkSession, sf_dir: str, site_df: DataFrame | None = None) -> DataFrame:
    """(page_id, href): for k in 1,2,3 a link to page ``(page_id*7 + k*13) % n``.

    k=1 links the target page's full URL, k=2,3 the target site's root URL;
    every 50th page gets the noise hrefs.  The target lookup is an equi-join.
    """
    s = site_df if site_df is not None else site(spark, sf_dir)
    n = table_count(spark, sf_dir, "pages")  # scalar from parquet footers
    src = table(spark, sf_dir, "pages").select("page_id")
    tgt = s.select(F.col("page_id").alias("t_id"), F.col("url").alias("t_url"), F.col("root").alias("t_root"))
    fan = src.select("page_id", F.explode(F.array(*[F.lit(k) for k in EDGE_FANOUT])).alias("k")) \
        .withColumn("t_id", F.pmod(F.col("page_id") * 7 + F.col("k") * 13, F.lit(n)))
    linked = fan.join(tgt, "t_id").select(
        "page_id",
        F.when(F.col("k") == 1, F.col("t_url"))
        .otherwise(F.concat(F.lit("https://"), F.col("t_root"), F.lit("/"))).alias("href"))
    noise = src.where(F.pmod("page_id", F.lit(50)) == 0).select(
        "page_id", F.explode(F.array(*[F.lit(h) for h in NOISE_HREFS])).alias("href"))
    return linked.where(F.col("href").isNotNull()).unionByName(noise)


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ts, website_id, reaction): click → up, error → down."""
    ev = table(spark, sf_dir, "events")
    return (ev.where(F.col("event_type").isin("click", "error"))
            .select("event_id", F.col("ts").cast("timestamp").alias("ts"),
                    (F.col("user_id") * 2).alias("website_id"),
                    F.when(F.col("event_type") == "click", "up").otherwise("down").alias("reaction")))

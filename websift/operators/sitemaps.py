"""Sitemaps: derive, parse (A9), follow nested maps to closure with a visited set.

The closure is a level-by-level loop on the driver (bounded by the nesting
depth, not by the data): each level is one anti-join against the visited set
and one join with the sitemap table, and each level is materialised so the
lineage does not grow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..session import materialize

MAX_URLS_PER_MAP = 50000   # protocol limit per sitemap file
NESTED_PATTERN = r"<sitemap>\s*<loc>\s*([^<\s]+)\s*</loc>"
URL_PATTERN = r"<url>\s*<loc>\s*([^<\s]+)\s*</loc>"


def derive(site: DataFrame) -> DataFrame:
    """(sitemap_url, xml): per site an index listing one urlset per path group.

    ``site`` (page_id, url, root).  A group is (root, first path segment,
    page_id / MAX_URLS_PER_MAP), so no file lists more than the protocol limit.
    The first site's index also lists itself (a cycle for the visited set)."""
    seg = F.coalesce(F.element_at(F.concat(U.url_path_parts(F.col("url")), F.array(F.lit("root"))), 1), F.lit("root"))
    p = site.where(F.col("root").isNotNull()).select(
        "root", "url", "page_id",
        F.concat(F.lit("https://"), F.col("root"), F.lit("/sitemap-"), seg, F.lit("-"),
                 F.floor(F.col("page_id") / MAX_URLS_PER_MAP).cast("string"), F.lit(".xml")).alias("map_url"))
    urlsets = p.groupBy("root", "map_url").agg(
        F.array_sort(F.collect_list(F.struct("page_id", "url"))).alias("u")) \
        .select("root", "map_url", F.concat(F.lit("<urlset>"), F.array_join(F.transform(
            "u", lambda x: F.concat(F.lit("<url><loc>"), x.url, F.lit("</loc></url>"))), ""), F.lit("</urlset>")).alias("xml"))
    first_root = site.where(F.col("root").isNotNull()).agg(F.min("root").alias("r0"))
    idx = urlsets.groupBy("root").agg(F.array_sort(F.collect_list("map_url")).alias("maps")) \
        .join(first_root, F.col("root") == F.col("r0"), "left") \
        .select(F.concat(F.lit("https://"), F.col("root"), F.lit("/sitemap.xml")).alias("sitemap_url"),
                F.concat(F.lit("<sitemapindex>"), F.array_join(F.transform(
                    F.when(F.col("r0").isNotNull(),
                           F.concat("maps", F.array(F.concat(F.lit("https://"), F.col("root"), F.lit("/sitemap.xml")))))
                    .otherwise(F.col("maps")),
                    lambda m: F.concat(F.lit("<sitemap><loc>"), m, F.lit("</loc></sitemap>"))), ""),
                    F.lit("</sitemapindex>")).alias("xml"))
    return idx.unionByName(urlsets.select(F.col("map_url").alias("sitemap_url"), "xml"))


def parse(maps: DataFrame) -> DataFrame:
    """(sitemap_url, kind, loc) with kind 'sitemap' (nested) or 'url'; empty locs skipped."""
    nested = maps.select("sitemap_url", F.lit("sitemap").alias("kind"),
                         F.explode(F.regexp_extract_all("xml", F.lit(NESTED_PATTERN), 1)).alias("loc"))
    urls = maps.select("sitemap_url", F.lit("url").alias("kind"),
                       F.explode(F.regexp_extract_all("xml", F.lit(URL_PATTERN), 1)).alias("loc"))
    return nested.unionByName(urls).where(F.col("loc") != "")


def closure(start: DataFrame, entries: DataFrame) -> DataFrame:
    """(url, depth) of every page URL reachable from the start sitemaps.

    ``start`` (sitemap_url); ``entries`` from ``parse`` (the fetched maps)."""
    ent = materialize(entries, "sitemap_url")
    frontier = materialize(start.select("sitemap_url").distinct().withColumn("depth", F.lit(0)))
    visited = frontier.select("sitemap_url")
    found = None
    while True:  # ends with the deepest map: visited maps are not followed again
        hit = frontier.join(ent, "sitemap_url")
        urls = hit.where(F.col("kind") == "url").select(F.col("loc").alias("url"), "depth")
        found = urls if found is None else found.unionByName(urls)
        nxt = (hit.where(F.col("kind") == "sitemap").select(F.col("loc").alias("sitemap_url"), (F.col("depth") + 1).alias("depth"))
               .dropDuplicates(["sitemap_url"]).join(visited, "sitemap_url", "left_anti"))
        nxt = materialize(nxt)
        if nxt.isEmpty():
            break
        visited = materialize(visited.unionByName(nxt.select("sitemap_url")).distinct())
        frontier = nxt
        found = materialize(found)
    return found.groupBy("url").agg(F.min("depth").alias("depth"))

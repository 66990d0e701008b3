"""Page extraction: pages → website rows, metadata rows, external links.

One projection over the page scan computes every field; the HTML string is
dropped right after, so later stages shuffle only the small extracted columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import urls as U

DEFAULT_RANK = 0.0
DEFAULT_TYPE = "default"


def parse_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, text, meta ARRAY, hrefs ARRAY, parse_ok)."""
    html = F.col("html")
    return pages.select(
        "page_id", "url",
        H.title(html).alias("title"),
        F.when(H.has_body(html), H.body_text(html)).otherwise(F.lit("")).alias("text"),
        H.meta_values(html).alias("meta"),
        H.hrefs(html).alias("hrefs"),
        (H.title(html).isNotNull() & H.has_body(html)).alias("parse_ok"),
    )


def display_title(title, text):
    """Empty title → first 24 characters of the text, with '...' when longer than 25."""
    fallback = F.when(F.length(text) > 25, F.concat(F.substring(text, 1, 24), F.lit("..."))).otherwise(text)
    return F.when(F.coalesce(title, F.lit("")) == "", fallback).otherwise(title)


def websites(parsed: DataFrame, roots: DataFrame) -> DataFrame:
    """Website rows with defaults (rank 0, type 'default'); base_url = registrable domain.

    ``roots`` is (page_id, root)."""
    return (parsed.join(roots.select("page_id", "root"), "page_id", "left")
            .select(F.col("page_id").alias("id"), "title", "text", "url",
                    F.col("root").alias("base_url"),
                    F.lit(DEFAULT_RANK).alias("rank"), F.lit(DEFAULT_TYPE).alias("type_of_website")))


def metadata_rows(parsed: DataFrame) -> DataFrame:
    """(website_id, position, metadata_text), duplicates kept, document order."""
    return parsed.select(F.col("page_id").alias("website_id"),
                         F.posexplode("meta").alias("position", "metadata_text"))


def page_links(parsed: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """All (page_id, href) of the pages, plus extra link rows."""
    links = parsed.select("page_id", F.explode("hrefs").alias("href"))
    if extra is not None:
        links = links.unionByName(extra.select("page_id", "href"))
    return links


def external_links(links: DataFrame, page_roots: DataFrame, rules: DataFrame) -> DataFrame:
    """P5/G1: (page_id, href, domain) for links to another registrable domain.

    Relative, host-less and IP links have no domain and are dropped."""
    l = U.with_root(links, "href", rules, prefix="l_")
    own = page_roots.select("page_id", F.col("root").alias("own_root"))
    return (l.join(own, "page_id", "left")
            .where(F.col("l_root").isNotNull() & (F.col("own_root").isNull() | (F.col("l_root") != F.col("own_root"))))
            .select("page_id", "href", F.col("l_root").alias("domain")))


def link_edges(ext: DataFrame) -> DataFrame:
    """G1: distinct (page_id, domain)."""
    return ext.select("page_id", "domain").distinct()


def restamp(rows: DataFrame, website_id_col: str = "website_id", new_id=None) -> DataFrame:
    """Put rows on a website id and clear their own ids."""
    out = rows
    if new_id is not None:
        out = out.withColumn(website_id_col, new_id)
    return out.withColumn("id", F.lit(None).cast("long"))

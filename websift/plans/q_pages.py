"""Queries over pages: extraction, tag counts, domains, link graph, frontier."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..operators import extract as X
from ..operators import links as L
from . import sqlkit as S
from .context import ctx
from .registry import register


@register("page_extract", ops=("A1", "A4", "P1", "P2", "P3", "P4", "S23"), sql=f"""
WITH {S.cte_parsed()}
SELECT page_id, title, {S.display_title('title', 'text')} AS display_title, text,
       CAST(len(meta) AS BIGINT) AS n_meta, array_to_string(meta, '|') AS meta_values,
       CAST(title IS NOT NULL AND {S.has_body('p.html')} AS BIGINT) AS parse_ok
FROM parsed JOIN pages p USING (page_id)
""")
def page_extract(spark, sf_dir):
    c = ctx(spark, sf_dir)
    p = c.parsed
    return p.select("page_id", "title", X.display_title(F.col("title"), F.col("text")).alias("display_title"),
                    "text", F.size("meta").cast("long").alias("n_meta"),
                    F.array_join("meta", "|").alias("meta_values"),
                    F.col("parse_ok").cast("long").alias("parse_ok"))


_TAGS_SQL = ",\n       ".join(
    f"""CAST((list_reduce(list_transform(regexp_extract_all(regexp_replace(html, '(?is)(<script\\b[^>]*>).*?(</script>)', '\\1\\2', 'g'), {S.lit(f'(?i)</?{t}' + chr(92) + 'b[^>]*>')}),
          lambda x: CASE WHEN starts_with(x, '</') THEN -1 WHEN ends_with(x, '/>') THEN 0 ELSE 1 END),
          lambda s, e: CASE WHEN e = 1 THEN {{'open': s.open + 1, 'n': s.n}}
                         WHEN e = 0 THEN {{'open': s.open, 'n': s.n + 1}}
                         WHEN s.open > 0 THEN {{'open': s.open - 1, 'n': s.n + 1}}
                         ELSE s END,
          {{'open': 0, 'n': 0}})).n AS BIGINT) AS n_{t}"""
    for t in H.COUNTED_TAGS)


@register("page_tag_counts", ops=("P7", "P8"), sql=f"""
SELECT page_id,
       {_TAGS_SQL},
       CAST(coalesce(list_sum(list_transform(regexp_extract_all(html, {S.lit(H.SCRIPT_BLOCK)}, 1),
            lambda b: len(regexp_extract_all(b, '\\S+')))), 0) AS BIGINT) AS script_words
FROM pages
""")
def page_tag_counts(spark, sf_dir):
    p = ctx(spark, sf_dir).t("pages")
    html = F.col("html")
    cols = [H.closed_tag_count(html, t).cast("long").alias(f"n_{t}") for t in H.COUNTED_TAGS]
    return p.select("page_id", *cols, H.script_words(html).cast("long").alias("script_words"))


@register("registrable_domain", ops=("S5", "S6", "J8"), sql=f"""
WITH {S.cte_site()}
SELECT page_id, host, root FROM site
""")
def registrable_domain(spark, sf_dir):
    return ctx(spark, sf_dir).site.select("page_id", "host", "root")


@register("link_edges", ops=("P5", "G1", "S7"), sql=f"""
WITH {S.cte_links()}
SELECT page_id, domain FROM edges
""")
def link_edges(spark, sf_dir):
    return ctx(spark, sf_dir).edges


@register("outlink_urls", ops=("P6", "S7"), sql=f"""
WITH {S.cte_links()}
SELECT page_id, href, domain FROM ext_links
""")
def outlink_urls(spark, sf_dir):
    return ctx(spark, sf_dir).ext_links


@register("frontier_new_urls", ops=("J4", "P6", "Q11", "U3"), sql=f"""
WITH {S.cte_links()}
SELECT DISTINCT e.href AS url FROM ext_links e
WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE p.url = e.href)
""")
def frontier_new_urls(spark, sf_dir):
    c = ctx(spark, sf_dir)
    return L.frontier_candidates(c.ext_links.select(F.col("href").alias("url")), c.websites)


@register("visible_text", ops=("P9",), sql=f"""
SELECT page_id,
  lower({S.strip_ws("regexp_replace(array_to_string(" + S.text_nodes("regexp_replace(html, " + S.lit(H.HIDDEN_BLOCK) + ", ' ', 'g')") + ", ' '), '\\s+', ' ', 'g')")}) AS visible_text
FROM pages
""")
def visible_text(spark, sf_dir):
    p = ctx(spark, sf_dir).t("pages")
    return p.select("page_id", H.visible_text(F.col("html")).alias("visible_text"))


@register("meta_lists", ops=("P10", "P4"), sql=f"""
WITH {S.cte_parsed()}
SELECT page_id, CAST(generate_subscripts(meta, 1) - 1 AS BIGINT) AS position, unnest(meta) AS metadata_text
FROM parsed
""")
def meta_lists(spark, sf_dir):
    m = ctx(spark, sf_dir).metadata
    return m.select(F.col("website_id").alias("page_id"), F.col("position").cast("long").alias("position"),
                    "metadata_text")


_PATH_RE = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)"


@register("sitemap_closure", ops=("A9", "U1", "U3", "G2", "S8"), sql=f"""
WITH RECURSIVE {S.cte_site()},
p AS (SELECT root, url, 'https://' || root || '/sitemap-'
        || coalesce(list_filter(string_split(regexp_extract(url, {S.lit(_PATH_RE)}, 1), '/'), lambda x: x <> '')[1], 'root')
        || '-' || CAST(CAST(floor(page_id / 50000) AS BIGINT) AS VARCHAR) || '.xml' AS map_url
      FROM site WHERE root IS NOT NULL),
roots AS (SELECT DISTINCT root FROM site WHERE root IS NOT NULL),
nested AS (SELECT DISTINCT 'https://' || root || '/sitemap.xml' AS sitemap_url, map_url AS loc FROM p
           UNION ALL SELECT 'https://' || root || '/sitemap.xml', 'https://' || root || '/sitemap.xml' FROM roots
           WHERE root = (SELECT min(root) FROM roots)),
start AS (SELECT 'https://' || root || '/sitemap.xml' AS u FROM roots UNION SELECT 'http://' || root || '/sitemap.xml' FROM roots),
walk(sitemap_url, depth) AS (SELECT u, 0 FROM start
                             UNION SELECT n.loc, w.depth + 1 FROM walk w JOIN nested n USING (sitemap_url) WHERE w.depth < 10)
SELECT p.url, CAST(min(w.depth) AS BIGINT) AS depth FROM walk w JOIN p ON p.map_url = w.sitemap_url GROUP BY p.url
""")
def sitemap_closure(spark, sf_dir):
    """Page URLs reachable from every site's candidate sitemaps, nested maps followed once."""
    from ..functions import urls as U
    from ..operators import sitemaps as SM
    c = ctx(spark, sf_dir)
    maps = SM.derive(c.site)
    start = c.site.where(F.col("root").isNotNull()).select("root").distinct() \
        .select(F.explode(U.sitemap_candidates(F.col("root"))).alias("sitemap_url"))
    out = SM.closure(start, SM.parse(maps))
    return out.select("url", F.col("depth").cast("long").alias("depth"))


@register("url_lookup", ops=("F1", "Q7", "J3"), sql=f"""
WITH {S.cte_links()}
SELECT p.page_id, p.url FROM pages p WHERE p.url IN (SELECT href FROM outlinks)
""")
def url_lookup(spark, sf_dir):
    """Exact URL lookups (equality, not the n-gram link match) of every linked full page URL."""
    c = ctx(spark, sf_dir)
    wanted = c.outlinks.select(F.col("href").alias("url")).distinct()
    return c.t("pages").select("page_id", "url").join(wanted, "url", "left_semi")

"""Store queries: upsert, child replacement, deletes, integrity, document build, queue."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import extract as X
from ..operators import links as L
from ..operators import store as ST
from ..sources.snapshots import SnapshotStore
from . import sqlkit as S
from .context import ctx
from .q_votes import _sql_ranks
from .registry import register

DELTA_SINCE = "2001-01-01 00:00:00"


def _voted_sites(c):
    """Websites touched by a vote (re-analysed after it, T5)."""
    return c.votes.select(F.col("website_id").alias("id")).distinct() \
        .join(c.websites.select("id"), "id", "left_semi")


@register("upsert_sites", ops=("J5", "J6", "W1", "U5", "U6", "A7"), sql=f"""
WITH {S.cte_links()},
{_sql_ranks(10.0)},
existing AS (SELECT s.page_id AS id, s.url, r.rank FROM site s JOIN ranks r ON r.website_id = s.page_id),
new_urls AS (SELECT DISTINCT e.href AS url FROM ext_links e WHERE NOT EXISTS (SELECT 1 FROM existing x WHERE x.url = e.href))
SELECT id, url, round(rank, 6) AS rank, CAST(0 AS BIGINT) AS is_new FROM existing
UNION ALL
SELECT (SELECT max(id) FROM existing) + row_number() OVER (ORDER BY url) AS id, url, 0.0 AS rank, CAST(1 AS BIGINT) AS is_new
FROM new_urls
""")
def upsert_sites(spark, sf_dir):
    """Re-crawl of every page plus the new frontier URLs, upserted by URL."""
    c = ctx(spark, sf_dir)
    existing = c.websites.drop("rank").join(c.ranks, "id")
    recrawl = c.websites.select("url", "title", "text", "base_url", "type_of_website")
    fresh = L.frontier_candidates(c.ext_links.select(F.col("href").alias("url")), c.websites)
    fresh = U.with_root(fresh, "url", c.rules).select(
        "url", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("text"),
        F.col("root").alias("base_url"), F.lit("default").alias("type_of_website"))
    snap = ST.upsert_by_url(existing, recrawl.unionByName(fresh))
    # The new website table becomes visible at once as the store's current version
    store = SnapshotStore(spark)
    store.write("websites_upserted", snap)
    snap = store.read("websites_upserted")
    return snap.select("id", "url", F.round("rank", 6).alias("rank"), F.col("is_new").cast("long").alias("is_new"))


_FRESH_META = [("og:website", 0), ("og:title", 1)]


@register("replace_children", ops=("U2", "P11", "U7", "J1"), sql=f"""
WITH {S.cte_parsed()}, {S.cte_votes()},
touched AS (SELECT DISTINCT v.website_id FROM votes v JOIN pages p ON p.page_id = v.website_id),
meta AS (SELECT page_id AS website_id, CAST(generate_subscripts(meta, 1) - 1 AS BIGINT) AS position, unnest(meta) AS metadata_text FROM parsed)
SELECT website_id, position, metadata_text FROM meta WHERE website_id NOT IN (SELECT website_id FROM touched)
UNION ALL
SELECT touched.website_id, CAST(t.position AS BIGINT), t.metadata_text FROM touched, {S.values_table([(v, p) for v, p in _FRESH_META], ["metadata_text", "position"])}
""")
def replace_children(spark, sf_dir):
    """Voted websites get new metadata rows; their old ones are replaced."""
    c = ctx(spark, sf_dir)
    touched = _voted_sites(c).withColumnRenamed("id", "website_id")
    fresh = touched.select("website_id", F.explode(F.array(*[F.struct(F.lit(v).alias("metadata_text"),
                                                                  F.lit(p).alias("position"))
                                                         for v, p in _FRESH_META])).alias("m")) \
        .select("website_id", F.col("m.position").alias("position"), F.col("m.metadata_text").alias("metadata_text"))
    # The new rows are stamped on their website and get no row id until stored
    fresh = X.restamp(fresh.select("website_id", "metadata_text", "position"))
    old = c.metadata.withColumn("id", F.lit(None).cast("long"))
    out = ST.replace_children(old, fresh, "website_id")
    return out.select("website_id", F.col("position").cast("long").alias("position"), "metadata_text")


@register("delete_counts", ops=("U4", "J9", "J12", "G7", "J3"), sql=f"""
WITH {S.cte_links()}, {S.cte_votes()},
touched AS (SELECT DISTINCT v.website_id FROM votes v JOIN pages p ON p.page_id = v.website_id),
meta AS (SELECT page_id AS website_id, unnest(meta) AS metadata_text FROM parsed)
SELECT 'metadata' AS tbl,
       CAST(count(*) FILTER (WHERE website_id IN (SELECT website_id FROM touched)) AS BIGINT) AS deleted,
       CAST(count(*) FILTER (WHERE website_id NOT IN (SELECT website_id FROM touched)) AS BIGINT) AS remaining
FROM meta
UNION ALL
SELECT 'website_ref_ext_links',
       CAST(count(*) FILTER (WHERE page_id IN (SELECT website_id FROM touched)) AS BIGINT),
       CAST(count(*) FILTER (WHERE page_id NOT IN (SELECT website_id FROM touched)) AS BIGINT)
FROM edges
UNION ALL
SELECT 'websites',
       CAST(count(*) FILTER (WHERE page_id IN (SELECT website_id FROM touched)) AS BIGINT),
       CAST(count(*) FILTER (WHERE page_id NOT IN (SELECT website_id FROM touched)) AS BIGINT)
FROM pages
UNION ALL
SELECT 'external_links',
       CAST(count(*) FILTER (WHERE page_id IN (SELECT website_id FROM touched)) AS BIGINT),
       CAST(count(*) FILTER (WHERE page_id NOT IN (SELECT website_id FROM touched)) AS BIGINT)
FROM edges
""")
def delete_counts(spark, sf_dir):
    """Cascade delete of the voted websites; affected-row counts per table."""
    c = ctx(spark, sf_dir)
    victims = _voted_sites(c)
    bridge = c.edges.withColumnRenamed("page_id", "website_id")
    websites = c.websites.withColumnRenamed("id", "website_id")
    out = ST.cascade_delete(websites, {"metadata": (c.metadata, "website_id"),
                                       "website_ref_ext_links": (bridge, "website_id")},
                            victims.withColumnRenamed("id", "website_id"), key="website_id")
    gone = victims.withColumnRenamed("id", "website_id")
    parts = []
    for name, before, after in (("metadata", c.metadata, out["metadata"]),
                                ("website_ref_ext_links", bridge, out["website_ref_ext_links"]),
                                ("websites", websites, out["parents"])):
        parts.append(before.join(gone, "website_id", "left_semi").select(F.lit(name).alias("tbl"), F.lit(1).alias("d")))
        parts.append(after.select(F.lit(name).alias("tbl"), F.lit(0).alias("d")))
    rows = parts[0]
    for p_ in parts[1:]:
        rows = rows.unionByName(p_)
    res = rows.groupBy("tbl").agg(F.sum("d").cast("long").alias("deleted"),
                                  F.sum(1 - F.col("d")).cast("long").alias("remaining"))
    # Link rows (one per stored link of a website) referenced by the victims' bridge rows
    links = ST.assign_ids(c.edges.select("page_id", "domain"), 0, ["page_id", "domain"])
    link_rows = links.select("id", F.col("domain").alias("url"))
    bridge_rows = links.select(F.col("id").alias("id"), F.col("page_id").alias("website_id"), F.col("id").alias("ext_link_id"))
    kept, gone, _ = ST.delete_links_of_sites(link_rows, bridge_rows, victims)
    d_cnt = gone.select(F.lit(1).alias("k"), F.lit(1).alias("d")).unionByName(kept.select(F.lit(1).alias("k"), F.lit(0).alias("d")))
    j9 = d_cnt.agg(F.sum("d").cast("long").alias("deleted"), F.sum(1 - F.col("d")).cast("long").alias("remaining")) \
        .select(F.lit("external_links").alias("tbl"), "deleted", "remaining")
    return res.unionByName(j9)


@register("integrity_report", ops=("J10", "J11"), sql="""
SELECT 'lineitem_orphans' AS check_name, CAST(count(*) AS BIGINT) AS n FROM lineitem l
  WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey)
UNION ALL SELECT 'orders_without_lines', CAST(count(*) AS BIGINT) FROM orders o
  WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)
UNION ALL SELECT 'orders_bad_customer', CAST(count(*) AS BIGINT) FROM orders o
  WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)
UNION ALL SELECT 'dup_order_keys', CAST(count(*) AS BIGINT) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'dup_customer_names', CAST(count(*) AS BIGINT) FROM (SELECT c_name FROM customer GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'dup_page_urls', CAST(count(*) AS BIGINT) FROM (SELECT url FROM pages GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'long_customer_names', CAST(count(*) AS BIGINT) FROM customer WHERE length(c_name) > 18
UNION ALL SELECT 'long_page_urls', CAST(count(*) AS BIGINT) FROM pages WHERE length(url) > 2200
""")
def integrity_report(spark, sf_dir):
    """Referential, unique and length checks as counts (0 = clean)."""
    c = ctx(spark, sf_dir)
    o, l, cu, p = c.t("orders"), c.t("lineitem"), c.t("customer"), c.t("pages")
    checks = [
        ("lineitem_orphans", ST.orphans(l, o, "l_orderkey", "o_orderkey")),
        ("orders_without_lines", ST.orphans(o, l, "o_orderkey", "l_orderkey")),
        ("orders_bad_customer", ST.orphans(o, cu, "o_custkey", "c_custkey")),
        ("dup_order_keys", ST.duplicate_keys(o, "o_orderkey")),
        ("dup_customer_names", ST.duplicate_keys(cu, "c_name")),
        ("dup_page_urls", ST.duplicate_keys(p, "url")),
        ("long_customer_names", ST.too_long(cu, "c_name", 18)),
        ("long_page_urls", ST.too_long(p, "url", 2200)),
    ]
    res = None
    for name, df in checks:
        r = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check_name"), F.col("n").cast("long"))
        res = r if res is None else res.unionByName(r)
    return res


def _docs_sql(where: str = "") -> str:
    return f"""
WITH lines AS (
  SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber) AS nums, sum(l_quantity) AS qty,
         max(l_shipdate) AS last_ship, count(*) AS n
  FROM lineitem GROUP BY l_orderkey)
SELECT o.o_orderkey AS doc_id, o.o_custkey AS customer, CAST(coalesce(l.n, 0) AS BIGINT) AS n_lines,
       array_to_string(l.nums, ',') AS line_numbers, round(l.qty, 6) AS quantity,
       epoch_us(greatest(o.o_orderdate, coalesce(l.last_ship, o.o_orderdate))) AS last_modified_us
FROM orders o LEFT JOIN lines l ON l.l_orderkey = o.o_orderkey
{where}"""


def _docs(c, parents=None):
    o = c.t("orders").select("o_orderkey", "o_custkey", "o_orderdate")
    if parents is not None:
        o = o.join(parents, "o_orderkey", "left_semi")
    l = c.t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    if parents is not None:
        l = l.join(parents.withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey", "left_semi")
    agg = l.groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list("l_linenumber")).alias("nums"), F.sum("l_quantity").alias("qty"),
        F.max("l_shipdate").alias("last_ship"), F.count(F.lit(1)).alias("n"))
    d = o.join(agg, o.o_orderkey == agg.l_orderkey, "left")
    lm = F.greatest(F.col("o_orderdate"), F.coalesce("last_ship", "o_orderdate")).cast("timestamp")
    return d.select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("customer"),
                    F.coalesce("n", F.lit(0)).cast("long").alias("n_lines"),
                    F.array_join(F.transform("nums", lambda x: x.cast("string")), ",").alias("line_numbers"),
                    F.round("qty", 6).alias("quantity"), F.unix_micros(lm).alias("last_modified_us"))


@register("build_docs", ops=("A5", "J1", "J2", "G9"), sql=_docs_sql())
def build_docs(spark, sf_dir):
    """Full import: parent rows with their children collected in order, replacing the old snapshot."""
    store = SnapshotStore(spark)
    store.write("order_docs", _docs(ctx(spark, sf_dir)))
    return store.read("order_docs")


@register("delta_docs", ops=("A6", "Q14", "U3"), sql=_docs_sql(f"""
WHERE o.o_orderdate > TIMESTAMP '{DELTA_SINCE}'
   OR o.o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate > TIMESTAMP '{DELTA_SINCE}')"""))
def delta_docs(spark, sf_dir):
    """Delta import: only documents whose parent or a child changed since the last run."""
    c = ctx(spark, sf_dir)
    since = F.lit(dt.datetime.fromisoformat(DELTA_SINCE)).cast("timestamp_ntz")
    changed = ST.changed_parents(c.t("orders"), c.t("lineitem"), "o_orderkey", "l_orderkey",
                                 "o_orderdate", "l_shipdate", since)
    return _docs(c, changed)


@register("queue_ops", ops=("O5", "W1", "U4", "J4"), sql=f"""
WITH {S.cte_links()},
q AS (SELECT row_number() OVER (ORDER BY url) AS id, url
      FROM (SELECT DISTINCT e.href AS url FROM ext_links e WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE p.url = e.href)))
SELECT CAST(id AS BIGINT) AS id, url,
       CAST(id = (SELECT min(id) FROM q) AS BIGINT) AS is_head,
       CAST(id = (SELECT max(id) FROM q) AS BIGINT) AS is_tail
FROM q
""")
def queue_ops(spark, sf_dir):
    """Frontier queue with ids (in URL order), its head and its tail."""
    c = ctx(spark, sf_dir)
    cand = L.frontier_candidates(c.ext_links.select(F.col("href").alias("url")), c.websites)
    q = ST.assign_ids(cand, 0, ["url"])
    n = q.count()  # ids are dense 1..n
    return q.select("id", "url", (F.col("id") == 1).cast("long").alias("is_head"),
                    (F.col("id") == F.lit(n)).cast("long").alias("is_tail"))


@register("lookup_filters", ops=("F1", "F2", "F6", "A4", "J3"), sql=f"""
WITH {S.cte_site()},
{_sql_ranks(10.0)}
SELECT s.page_id AS id, s.url, round(r.rank, 6) AS rank
FROM site s JOIN ranks r ON r.website_id = s.page_id
WHERE s.page_id IN (SELECT user_id * 2 FROM events WHERE event_type = 'click') AND r.rank >= 0
""")
def lookup_filters(spark, sf_dir):
    """Websites named by an upvote (in-list as a semi-join) with rank >= 0."""
    c = ctx(spark, sf_dir)
    ids = c.votes.where(F.col("reaction") == "up").select(F.col("website_id").alias("id"))
    w = c.site.select(F.col("page_id").alias("id"), "url").join(ids, "id", "left_semi").join(c.ranks, "id")
    return w.where(F.col("rank") >= 0).select("id", "url", F.round("rank", 6).alias("rank"))

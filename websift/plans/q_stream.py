"""Streaming queries: each runs its stream to the end (availableNow) and returns the result."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..sources.tables import table_count
from ..streaming import frontier as FR
from ..streaming import reanalysis as RA
from ..streaming import streams as ST
from . import q_votes  # noqa: F401 - register the oracle text reused below
from . import sqlkit as S
from .context import ctx
from .registry import ORACLE, register

PIECES = 4


@register("stream_votes", ops=("T2", "T3", "T5"), sql=ORACLE["vote_outcomes"])
def stream_votes(spark, sf_dir):
    """Votes arriving in files (time order): outcomes equal the batch fold."""
    c = ctx(spark, sf_dir)
    root = ST.workspace(spark, "votes")
    src = os.path.join(root, "in")
    votes = c.votes
    ST.stage_files(votes, src, "ts", PIECES)
    out = ST.run_votes(spark, src, votes.schema, c.websites, root, q_votes.STRICT_COOLDOWN)
    return out.select("event_id", "website_id", "reaction", "outcome", F.round("rank_after", 6).alias("rank_after"))


@register("stream_crawl", ops=("T1", "J5", "J6"), sql=f"""
WITH {S.cte_parsed()}
SELECT page_id, title, CAST(0.0 AS DOUBLE) AS rank, url FROM parsed
""")
def stream_crawl(spark, sf_dir):
    """Pages arriving in files, upserted into the website table batch by batch."""
    c = ctx(spark, sf_dir)
    root = ST.workspace(spark, "crawl")
    src = os.path.join(root, "in")
    pages = c.t("pages")
    ST.stage_files(pages, src, "page_id", PIECES)
    snap = ST.run_crawl(spark, src, pages.schema, c.rules, root)
    return snap.select(F.col("id").alias("page_id"), "title", "rank", "url")


INDEX_FILES, INDEX_BATCHES = 24, 6


def _changes(docs):
    """Stand-in for a change feed: every document once, some sent again with other words, some deleted, some of these
    brought back; (doc_id, version, text, deleted)."""
    def some(mod: int, k: int, version: int, text, deleted: bool):
        return docs.where(F.col("doc_id") % mod == k).select("doc_id", F.lit(version).cast("long").alias("version"), text.alias("text"),
                                                             F.lit(deleted).alias("deleted"))
    text = F.col("text")
    return some(1, 0, 1, text, False).unionByName(some(3, 0, 2, F.concat_ws(" revised ", text, text), False)) \
        .unionByName(some(7, 1, 3, F.lit(None).cast("string"), True)).unionByName(some(21, 1, 4, F.lit("back again, back"), False))


@register("stream_index", ops=("T4", "G3", "U2"), sql=f"""
WITH changes AS (
  SELECT doc_id, 1 AS version, text, false AS deleted FROM documents
  UNION ALL SELECT doc_id, 2, concat_ws(' revised ', text, text), false FROM documents WHERE doc_id % 3 = 0
  UNION ALL SELECT doc_id, 3, NULL, true FROM documents WHERE doc_id % 7 = 1
  UNION ALL SELECT doc_id, 4, 'back again, back', false FROM documents WHERE doc_id % 21 = 1),
newest AS (SELECT * FROM changes QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY version DESC) = 1),
tok AS (SELECT doc_id, unnest({S.general_tokens('text')}) AS term FROM newest WHERE NOT deleted)
SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM tok GROUP BY ALL
""")
def stream_index(spark, sf_dir):
    """A feed of new, changed and deleted documents in files of any order: the index equals that of the newest versions."""
    c = ctx(spark, sf_dir)
    root = ST.workspace(spark, "index")
    src = os.path.join(root, "in")
    feed = _changes(c.t("documents").select("doc_id", "text"))
    feed.repartition(INDEX_FILES, "doc_id", "version").write.parquet(src)
    return ST.run_index(spark, src, feed.schema, root, -(-INDEX_FILES // INDEX_BATCHES))


#: Seconds between two visits of the stand-in feed, and before a URL may be visited again (never a visit's own second).
VISIT_SECONDS, RECRAWL_SECONDS = 60, 1801


def _visits(c):
    """Stand-in for a fetcher's output: every page once, a minute apart, with the test tables' link graph as links in
    its html; every fifth page a second time after all others; (url, html, fetched_at, visit)."""
    anchors = c.outlinks.groupBy("page_id").agg(F.concat_ws("", F.array_sort(F.collect_list(F.concat(F.lit('<a href="'), "href", F.lit('">link</a>'))))).alias("a"))
    pages = c.t("pages").join(anchors, "page_id", "left").withColumn("html", F.concat("html", F.coalesce("a", F.lit(""))))
    n = table_count(c.spark, c.sf_dir, "pages")
    visits = pages.withColumn("visit", F.col("page_id")).unionByName(pages.where("page_id % 5 = 0").withColumn("visit", F.col("page_id") + n))
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("visit") * VISIT_SECONDS)
    return visits.select("url", "html", at.alias("fetched_at"), "visit"), n


@register("stream_frontier", ops=("T1", "J4", "U4", "F18", "P6"), sql=f"""
WITH RECURSIVE {S.cte_links()},
visit AS (
  SELECT page_id, url, page_id AS v FROM pages
  UNION ALL SELECT page_id, url, page_id + n.n FROM pages, n_pages n WHERE page_id % 5 = 0),
own_link AS (SELECT page_id, unnest(hrefs) AS href FROM parsed UNION ALL SELECT page_id, href FROM outlinks),
found AS (
  SELECT l.page_id, l.href FROM own_link l JOIN pages p USING (page_id)
  WHERE regexp_matches(l.href, '(?i)^https?://') AND {S.host('l.href')} IS NOT NULL AND {S.host('l.href')} IS DISTINCT FROM {S.host('p.url')}),
ev0 AS (
  SELECT url, 1700000000000 + v * {VISIT_SECONDS * 1000} AS ms, 0 AS kind FROM visit
  UNION SELECT f.href, 1700000000000 + v * {VISIT_SECONDS * 1000}, 1 FROM visit JOIN found f USING (page_id)),
ev AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ms, kind) AS k FROM ev0),
st AS (
  SELECT DISTINCT url, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS q, CAST(NULL AS BIGINT) AS visited, CAST(NULL AS BIGINT) AS due,
         CAST(0 AS BIGINT) AS n_enq, CAST(0 AS BIGINT) AS n_drop, CAST(NULL AS BIGINT) AS last_enq FROM ev0
  UNION ALL
  SELECT url, k, CASE WHEN kind = 0 THEN NULL WHEN q1 IS NOT NULL THEN q1 WHEN free THEN ms END,
         CASE WHEN kind = 0 THEN ms ELSE visited END,
         CASE WHEN kind = 0 THEN NULL WHEN q1 IS NOT NULL THEN due1 WHEN NOT free THEN visited + {RECRAWL_SECONDS * 1000} END,
         n1 + CASE WHEN kind = 1 AND q1 IS NULL AND free THEN 1 ELSE 0 END,
         n_drop + CASE WHEN kind = 0 AND q1 IS NOT NULL THEN 1 ELSE 0 END,
         CASE WHEN kind = 1 AND q1 IS NULL AND free THEN ms WHEN fired THEN due ELSE last_enq END
  FROM (SELECT s.*, fired, e.ms, e.kind, CASE WHEN fired THEN s.due ELSE s.q END AS q1, CASE WHEN fired THEN NULL ELSE s.due END AS due1,
               s.n_enq + CASE WHEN fired THEN 1 ELSE 0 END AS n1, (s.visited IS NULL OR e.ms >= s.visited + {RECRAWL_SECONDS * 1000}) AS free
        FROM (SELECT st.url, st.k + 1 AS k, st.q, st.visited, st.due, st.n_enq, st.n_drop, st.last_enq FROM st) s
        JOIN ev e ON e.url = s.url AND e.k = s.k, LATERAL (SELECT coalesce(s.due <= e.ms, false) AS fired))),
last AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY url ORDER BY k DESC) = 1),
done AS (SELECT *, coalesce(due <= (SELECT max(ms) FROM ev0), false) AS late FROM last)
SELECT url, n_enq + CASE WHEN late THEN 1 ELSE 0 END AS n_enqueued, n_drop AS n_dropped,
       CASE WHEN late THEN due ELSE last_enq END AS last_enqueued_ms, n_enq + CASE WHEN late THEN 1 ELSE 0 END > n_drop AS queued
FROM done WHERE n_enq > 0 OR late
""")
def stream_frontier(spark, sf_dir):
    """Fetched pages in three deliveries: which URLs were queued, dropped, throttled and queued again."""
    c = ctx(spark, sf_dir)
    root = ST.workspace(spark, "frontier")
    src = os.path.join(root, "in")
    visits, n = _visits(c)
    edges = [None, n // 2, n, None]
    for low, high in zip(edges, edges[1:]):
        part = visits if low is None else visits.where(F.col("visit") >= low)
        part = part if high is None else part.where(F.col("visit") < high)
        part.drop("visit").write.mode("append").parquet(src)
        actions = FR.run_frontier(spark, src, visits.drop("visit").schema, root, RECRAWL_SECONDS)
    return FR.urls(actions)


def _snapshots(c):
    """Stand-in for the page archive: the given pages as version 1 and, for every other page, a version 2 with another
    title, without meta tags and with one more link; (page_id, version, url, html)."""
    one = c.t("pages").select("page_id", F.lit(1).cast("long").alias("version"), "url", "html")
    html = F.regexp_replace(F.regexp_replace("html", "<meta[^>]*>", ""), "<title>", "<title>Revised ")
    two = one.where("page_id % 4 = 0").withColumns({"version": F.lit(2).cast("long"), "html": F.concat(html, F.lit('<a href="https://new.example/">new</a>'))})
    return one.unionByName(two)


@register("reanalysed", ops=("T5", "U2", "U7", "T4"), sql=f"""
WITH outcome AS ({ORACLE["vote_outcomes"]}),
voted AS (SELECT DISTINCT website_id AS page_id FROM outcome WHERE outcome = 'accepted'),
page AS (
  SELECT p.page_id, url, CASE WHEN two THEN 2 ELSE 1 END AS version,
         CASE WHEN two THEN replace(regexp_replace(html, '<meta[^>]*>', '', 'g'), '<title>', '<title>Revised ') || '<a href="https://new.example/">new</a>'
              ELSE html END AS html
  FROM (SELECT pages.*, page_id % 4 = 0 AND page_id IN (SELECT page_id FROM voted) AS two FROM pages) p),
parsed AS (SELECT page_id, version, {S.title('html')} AS title, {S.body_text('html')} AS text, {S.meta_values('html')} AS meta, {S.hrefs('html')} AS hrefs FROM page)
SELECT page_id, CAST(version AS BIGINT) AS version, title, CAST(coalesce(len(meta), 0) AS BIGINT) AS n_metadata, CAST(coalesce(len(hrefs), 0) AS BIGINT) AS n_links,
       CAST(len(list_distinct({S.general_tokens("concat_ws(' ', title, text)")})) AS BIGINT) AS n_terms
FROM parsed
""")
def reanalysed(spark, sf_dir):
    """Votes as a stream; accepted ones re-extract their page's newest snapshot: websites, children and index terms."""
    c = ctx(spark, sf_dir)
    root = ST.workspace(spark, "reanalysis")
    src = os.path.join(root, "in")
    ST.stage_files(c.votes, src, "ts", PIECES)
    snapshots = _snapshots(c)
    store = RA.Store(spark, os.path.join(root, "store"))
    store.write(RA.extract(snapshots.where("version = 1")))
    ST.run_votes(spark, src, c.votes.schema, c.websites, root, q_votes.STRICT_COOLDOWN)
    RA.run_reanalysis(spark, os.path.join(root, "ranked"), ST.RANKED_SCHEMA, snapshots, store)

    def number(table: str, name: str):
        return store.read(table).groupBy(F.col("website_id").alias("page_id")).agg(F.count("*").alias(name))
    terms = store.index().groupBy(F.col("doc_id").alias("page_id")).agg(F.count("*").alias("n_terms"))
    out = store.read("websites").withColumnRenamed("id", "page_id").select("page_id", "version", "title")
    for part in (number("metadata", "n_metadata"), number("links", "n_links"), terms):
        out = out.join(part, "page_id", "left")
    return out.fillna(0, ["n_metadata", "n_links", "n_terms"])

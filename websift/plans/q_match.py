"""Prefix and suffix match over the term dictionaries, and search in the order of the votes' ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import dictionary as DI
from ..operators import search as SR
from ..operators import votes as V
from ..sources import derived as D
from . import sqlkit as S
from .context import ctx
from .q_search import _result_cols
from .q_votes import _sql_ranks
from .registry import register


@register("prefix_links", ops=("F4", "F5", "S15"), sql=f"""
WITH {S.cte_links()}, {S.cte_docs()},
w AS (SELECT item_id AS query_id, unnest({S.link_tokens('text')}) AS w FROM benchmark),
tok AS (
  SELECT id AS doc_id, 'url' AS field, unnest({S.link_tokens('url')}) AS t FROM docs
  UNION ALL SELECT id, 'base_url', unnest({S.link_tokens('base_url')}) FROM docs WHERE base_url IS NOT NULL
  UNION ALL SELECT id, 'external_links', unnest({S.link_tokens('l')}) FROM (SELECT id, unnest(external_links) AS l FROM docs)),
m AS (SELECT w.w, t.t FROM (SELECT DISTINCT w FROM w WHERE length(w) >= 2) w JOIN (SELECT DISTINCT t FROM tok) t ON starts_with(t.t, w.w)),
hit AS (SELECT w.query_id, m.t, count(*) AS times FROM w JOIN m USING (w) GROUP BY ALL),
c AS (SELECT doc_id, field, t, count(*) AS n FROM tok GROUP BY ALL)
SELECT CAST(query_id AS BIGINT) AS query_id, field, doc_id, CAST(sum(times * n) AS BIGINT) AS tf
FROM hit JOIN c USING (t) GROUP BY ALL
""")
def prefix_links(spark, sf_dir):
    """The words of every benchmark text, of two letters or more, as prefixes of link parts of url, base_url and
    external_links of all websites."""
    c = ctx(spark, sf_dir)
    words = c.t("benchmark").select(F.col("item_id").cast("long").alias("query_id"), F.explode(TX.link_tokens(F.col("text"))).alias("w"))
    words = words.where(F.length("w") >= TX.LINK_GRAM_MIN)
    return DI.matching_docs(words, c.link_dictionary, c.link_positions)


@register("suffix_docs", ops=("F10",), sql=f"""
WITH w AS (SELECT item_id AS query_id, unnest({S.general_tokens('text')}) AS w FROM benchmark),
tok AS (SELECT doc_id, unnest({S.general_tokens('text')}) AS t FROM documents),
m AS (SELECT w.w, t.t FROM (SELECT DISTINCT w FROM w) w JOIN (SELECT DISTINCT t FROM tok) t ON ends_with(t.t, w.w)),
hit AS (SELECT w.query_id, m.t, count(*) AS times FROM w JOIN m USING (w) GROUP BY ALL),
c AS (SELECT doc_id, t, count(*) AS n FROM tok GROUP BY ALL)
SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, CAST(sum(times * n) AS BIGINT) AS tf
FROM hit JOIN c USING (t) GROUP BY ALL
""")
def suffix_docs(spark, sf_dir):
    """Leading-wildcard match: documents with words that end with a word of each benchmark text."""
    c = ctx(spark, sf_dir)
    words = c.t("benchmark").select(F.col("item_id").cast("long").alias("query_id"), F.explode(TX.general_tokens(F.col("text"))).alias("w"))
    return DI.matching_docs(words, c.text_dictionary_reversed, c.text_positions, backwards=True).drop("field")


@register("search_voted", ops=("O1", "O3", "F3", "W3"), sql=f"""
WITH {S.cte_search(D.QUERY_BATCH)},
{_sql_ranks(V.COOLDOWN_SECONDS)},
voted AS (
  SELECT r.*, k.rank AS vote_rank,
         row_number() OVER (PARTITION BY r.query_id ORDER BY r.tf_url DESC, k.rank DESC, r.tf_all DESC, r.id ASC) AS place
  FROM ranked r JOIN ranks k ON k.website_id = r.id)
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(place AS BIGINT) AS pos, id AS page_id, url, round(vote_rank, 6) AS rank,
       {S.display_title('title', 'text')} AS title,
       array_to_string(tf_url, ',') AS tf_url, array_to_string(tf_all, ',') AS tf_all,
       CAST(num_found AS BIGINT) AS num_found
FROM voted WHERE place <= 10
""")
def search_voted(spark, sf_dir):
    """Top 10 per query with the rank that the votes gave each website as the second sort key."""
    c = ctx(spark, sf_dir)
    aq = SR.analyse_queries(c.queries)
    r = SR.ranked(aq, SR.with_ranks(c.search_docs, c.ranks), c.grams, c.postings, rows=10)
    return _result_cols(r).join(r.select("query_id", F.col("doc_id").alias("page_id"), F.round("rank", 6).alias("rank")), ["query_id", "page_id"])

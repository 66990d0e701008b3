"""Search queries: batch top-10, paging, term frequencies, index statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extract as X
from ..operators import search as SR
from ..sources import derived as D
from . import sqlkit as S
from .context import ctx
from .registry import register


def _result_cols(df):
    return df.select(F.col("query_id").cast("long").alias("query_id"), F.col("pos").cast("long").alias("pos"),
                     F.col("doc_id").alias("page_id"), "url",
                     X.display_title(F.col("title"), F.col("text")).alias("title"),
                     F.array_join(F.transform("tf_url", lambda x: x.cast("string")), ",").alias("tf_url"),
                     F.array_join(F.transform("tf_all", lambda x: x.cast("string")), ",").alias("tf_all"),
                     F.col("num_found").cast("long").alias("num_found"))


_RESULT_SQL = f"""SELECT CAST(query_id AS BIGINT) AS query_id, CAST(pos AS BIGINT) AS pos, id AS page_id, url,
       {S.display_title('title', 'text')} AS title,
       array_to_string(tf_url, ',') AS tf_url, array_to_string(tf_all, ',') AS tf_all,
       CAST(num_found AS BIGINT) AS num_found
FROM ranked"""


@register("search_top10", ops=("F3", "F4", "O1", "O3", "G6", "S1", "S3", "S4", "S15", "P13", "A5"), sql=f"""
WITH {S.cte_search(D.QUERY_BATCH)}
{_RESULT_SQL} WHERE pos <= 10
""")
def search_top10(spark, sf_dir):
    c = ctx(spark, sf_dir)
    aq = SR.analyse_queries(c.queries)
    return _result_cols(SR.ranked(aq, c.search_docs, c.grams, c.postings, rows=10))


@register("search_paged", ops=("O6", "O3", "G6"), sql=f"""
WITH {S.cte_search(D.QUERY_BATCH)}
SELECT query_id, pos, page_id, num_found, CAST(ceil(num_found / 5.0) AS BIGINT) AS pages
FROM ({_RESULT_SQL} WHERE pos > 5 AND pos <= 10) r
""")
def search_paged(spark, sf_dir):
    """Second page of 5 results, with the page count."""
    c = ctx(spark, sf_dir)
    aq = SR.analyse_queries(c.queries)
    r = _result_cols(SR.ranked(aq, c.search_docs, c.grams, c.postings, rows=5, start=5))
    return r.select("query_id", "pos", "page_id", "num_found",
                    F.ceil(F.col("num_found") / F.lit(5.0)).cast("long").alias("pages"))


@register("search_batch", ops=("F3", "F4", "O1", "G6"), sql=f"""
WITH {S.cte_search(D.QUERY_BATCH)}
{_RESULT_SQL}
""")
def search_batch(spark, sf_dir):
    """Every hit of every query with its position (no cut)."""
    c = ctx(spark, sf_dir)
    aq = SR.analyse_queries(c.queries)
    return _result_cols(SR.ranked(aq, c.search_docs, c.grams, c.postings, rows=None))


@register("query_escape", ops=("S1", "S2", "S3", "S4"), sql=f"""
SELECT CAST(item_id AS BIGINT) AS item_id,
       regexp_replace(text, {S.lit(r'''([\\+\-!():^\[\]"{}~*?|&;/])''')}, '\\\\\\1', 'g') AS escaped,
       CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS BIGINT) AS n_match_words,
       array_to_string(list_transform(regexp_extract_all(text, '[a-zA-Z0-9]+'), lambda w: lower(w)), ' ') AS sort_words,
       url_encode(text) AS encoded,
       CAST(url_decode(url_encode(text)) = text AS BIGINT) AS round_trip
FROM benchmark
""")
def query_escape(spark, sf_dir):
    """S1/S3/S4 over the benchmark texts used as queries."""
    from ..functions import text as TX
    b = ctx(spark, sf_dir).t("benchmark")
    t = F.col("text")
    return b.select(F.col("item_id").cast("long").alias("item_id"), TX.escape_query(t).alias("escaped"),
                    F.size(TX.match_words(t)).cast("long").alias("n_match_words"),
                    F.array_join(TX.sort_words(t), " ").alias("sort_words"),
                    TX.encode_component(t).alias("encoded"),
                    (TX.decode_component(TX.encode_component(t)) == t).cast("long").alias("round_trip"))


@register("json_result", ops=("A8", "P13"), sql=f"""
WITH {S.cte_search(D.QUERY_BATCH)}
SELECT CAST(query_id AS BIGINT) AS query_id,
       to_json(list({{'page_id': id, 'url': url}} ORDER BY pos)) AS json
FROM ranked WHERE pos <= 10 GROUP BY query_id
""")
def json_result(spark, sf_dir):
    """Each query's top 10 as one JSON array."""
    from ..operators import export as EX
    c = ctx(spark, sf_dir)
    aq = SR.analyse_queries(c.queries)
    r = SR.ranked(aq, c.search_docs, c.grams, c.postings, rows=10).withColumnRenamed("doc_id", "page_id")
    return EX.json_results(r, "query_id", "pos", ["page_id", "url"]).select(F.col("query_id").cast("long"), "json")

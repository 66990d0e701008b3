"""Batch search: term/prefix match, the reference's sort order, top-N.

A batch of queries is a table; every step is an equi-join or an aggregation:

1. match terms (analysed query words, 2..15 chars) ⋈ vocab_grams on the prefix
   → matched index terms ⋈ postings on term → distinct (query_id, doc_id) hits;
2. sort words ⋈ vocab_grams ⋈ postings → tf(text_all, w) per hit;
   tf(url, w) is a column expression on the hit's URL tokens;
3. ``row_number`` per query over (tf_url[] desc, rank desc, tf_all[] desc, id)
   with ``rn <= n``: Spark plans a partial per-partition group limit before
   the shuffle, so a query with many hits ships at most n rows per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as TX
from . import index as IX

DEFAULT_ROWS = 10


def analyse_queries(queries: DataFrame) -> DataFrame:
    """(query_id, q, escaped, terms[], sort_words[])."""
    q = F.coalesce(F.col("q"), F.lit(""))
    terms = F.array_distinct(F.filter(TX.general_tokens(q), lambda t: F.length(t).between(TX.TEXT_GRAM_MIN, TX.TEXT_GRAM_MAX)))
    return queries.select("query_id", "q", TX.escape_query(q).alias("escaped"),
                          terms.alias("terms"), TX.sort_words(q).alias("sort_words"))


def hits(aq: DataFrame, grams: DataFrame, post: DataFrame) -> DataFrame:
    """Distinct (query_id, doc_id) whose text_all has a term the query word is a prefix of.

    The prefix table and the postings are bucketed by their keys, so only the
    query words and the matched terms move; the planner broadcasts them when
    they are small."""
    qt = aq.select("query_id", F.explode("terms").alias("w"))
    terms = qt.join(grams, qt.w == grams.gram).select("query_id", "term").distinct()
    return terms.join(post, "term").select("query_id", "doc_id").distinct()


def with_ranks(docs: DataFrame, ranks: DataFrame) -> DataFrame:
    """Search documents with the rank of (id, rank) rows; a document without one keeps its own.

    Ranks change with every accepted vote, so they are joined when a batch is searched and not part of the index."""
    now = ranks.select("id", F.col("rank").alias("_rank"))
    return docs.join(now, "id", "left").withColumn("rank", F.coalesce("_rank", "rank")).drop("_rank")


def ranked(aq: DataFrame, docs: DataFrame, grams: DataFrame, post: DataFrame,
           rows: int | None = DEFAULT_ROWS, start: int = 0, found: DataFrame | None = None) -> DataFrame:
    """One row per (query_id, hit) with sort keys and ``pos``; ``rows=None`` keeps all.

    ``found``: the hits (query_id, doc_id) to order, by default those of the query words."""
    h = hits(aq, grams, post) if found is None else found
    sw = aq.select("query_id", F.posexplode("sort_words").alias("idx", "w"))
    tf_all = IX.prefix_tf(sw, grams, post)
    d = docs.select(F.col("id").alias("doc_id"), "url", "rank")
    keyed = (h.join(sw, "query_id", "left")
             .join(tf_all, ["query_id", "idx", "doc_id"], "left")
             .join(d, "doc_id"))
    url_tf = F.when(F.length("w") >= TX.LINK_GRAM_MIN,
                    F.size(F.filter(TX.link_tokens(F.col("url")), lambda t: t.startswith(F.col("w"))))) \
        .otherwise(F.lit(0))
    keyed = keyed.withColumn("tf_url", url_tf).withColumn("tf", F.coalesce("tf", F.lit(0)))
    per_doc = keyed.groupBy("query_id", "doc_id", "url", "rank").agg(
        F.array_sort(F.collect_list(F.when(F.col("idx").isNotNull(),
                                           F.struct("idx", "tf_url", F.col("tf").alias("tf_all"))))).alias("k"))
    per_doc = per_doc.select("query_id", "doc_id", "url", "rank",
                             F.transform("k", lambda x: x.tf_url.cast("long")).alias("tf_url"),
                             F.transform("k", lambda x: x.tf_all.cast("long")).alias("tf_all"))
    w = Window.partitionBy("query_id").orderBy(F.col("tf_url").desc(), F.col("rank").desc(),
                                                 F.col("tf_all").desc(), F.col("doc_id").asc())
    out = per_doc.withColumn("pos", F.row_number().over(w))
    if rows is not None:
        out = out.where((F.col("pos") > start) & (F.col("pos") <= start + rows))
    num_found = h.groupBy("query_id").agg(F.count(F.lit(1)).alias("num_found"))
    out = out.join(num_found, "query_id")
    # display fields only for the rows that survived the cut
    shown = docs.select(F.col("id").alias("doc_id"), "title", "text")
    return out.join(shown, "doc_id")

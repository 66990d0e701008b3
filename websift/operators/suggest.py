"""Prefix suggestions.

The dictionary is the unstemmed vocabulary of the indexed text (suggest
chain: non-alphanumerics to blanks, lower case, length 2..255, stop words
out) with its total count as weight.  The query's last word is the prefix.

Prefix lookup is an equi-join: the vocabulary is keyed by its prefix of
each length that occurs among the batch's prefixes (a small set of
integers), so a term contributes one row per distinct prefix length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as TX

MIN_PREFIX, MAX_TERM = 2, 255
LIST_SIZE = 7


def dictionary(texts: DataFrame, col: str = "text") -> DataFrame:
    """(term, weight)."""
    return (texts.select(F.explode(TX.suggest_tokens(F.col(col))).alias("term"))
            .groupBy("term").agg(F.count(F.lit(1)).alias("weight")))


def last_word(q):
    parts = F.split(F.trim(F.lower(F.regexp_replace(q, r"[^a-zA-Z0-9]", " "))), " +")
    return F.element_at(parts, -1)


def suggest(queries: DataFrame, dic: DataFrame, n: int = LIST_SIZE) -> DataFrame:
    """(query_id, pos, suggestion, completion): the list shown under the search box."""
    q = queries.select("query_id", "q", last_word(F.col("q")).alias("prefix")) \
        .where(F.length("prefix").between(MIN_PREFIX, MAX_TERM))
    lengths = sorted({r[0] for r in q.select(F.length("prefix")).distinct().collect()})
    if not lengths:
        return queries.sparkSession.createDataFrame([], "query_id long, pos long, suggestion string, completion string")
    keyed = dic.select("term", "weight", F.explode(F.array(*[F.lit(x) for x in lengths])).alias("plen")) \
        .where(F.length("term") >= F.col("plen")) \
        .withColumn("key", F.expr("substring(term, 1, plen)"))
    m = q.join(keyed, (q.prefix == keyed.key) & (F.length(q.prefix) == keyed.plen))
    w = Window.partitionBy("query_id").orderBy(F.col("weight").desc(), F.col("term").asc())
    top = m.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
    lists = top.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rn", "term"))).alias("t")) \
        .select("query_id", F.transform("t", lambda x: x.term).alias("terms"))
    full = q.join(lists, "query_id", "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))
    shown = F.when(F.array_contains("terms", F.col("prefix")), F.col("terms")) \
        .otherwise(F.slice(F.concat(F.array(F.col("q")), F.col("terms")), 1, n))
    out = full.select("query_id", "q", "prefix", F.posexplode(shown).alias("pos", "suggestion"))
    is_typed = (F.col("suggestion") == F.col("q")) & (F.col("pos") == 0) & \
        ~F.col("suggestion").startswith(F.col("prefix"))
    completion = F.when(is_typed, F.lit("")).otherwise(F.expr("substring(suggestion, length(prefix) + 1)"))
    return out.select(F.col("query_id").cast("long"), (F.col("pos") + 1).cast("long").alias("pos"),
                      "suggestion", completion.alias("completion"))

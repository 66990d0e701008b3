"""Inverted index: postings, vocabulary and vocabulary prefixes.

Edge n-grams are never materialised per posting.  Prefix search goes through
``vocab_grams`` (at most ``hi - lo + 1`` rows per *distinct* term), then an
equi-join to ``postings`` on the full term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as TX
from ..session import by_document


def text_all_source(prefix: str = "") -> Column:
    """Q26: the catch-all field reads the raw values of the 8 copied fields."""
    c = lambda n: F.col(prefix + n)
    return F.concat_ws(" ", c("title"), F.array_join(F.coalesce(c("metadata"), F.array()), " "), c("text"),
                       c("url"), c("base_url"), F.array_join(F.coalesce(c("external_links"), F.array()), " "),
                       c("rank").cast("string"), c("type_of_website"))


def text_all_values() -> Column:
    """Q26: the values of the 8 copied fields, for positions that no phrase crosses from one value to the next."""
    one = lambda *names: F.array(*[F.col(n).cast("string") for n in names])
    many = lambda n: F.coalesce(F.col(n), F.array().cast("array<string>"))
    return F.concat(one("title"), many("metadata"), one("text", "url", "base_url"), many("external_links"), one("rank", "type_of_website"))


def postings(docs: DataFrame, source: Column, tokenizer=TX.general_tokens, id_col: str = "id") -> DataFrame:
    """(doc_id, term, tf): one row per distinct term of a document.

    The source texts are shuffled by document and counted where they lie; no (doc, term) row is shuffled."""
    return (by_document(docs.select(F.col(id_col).alias("doc_id"), source.alias("source")), "doc_id")
            .select("doc_id", F.explode(tokenizer(F.col("source"))).alias("term"))
            .groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf")))


def vocab(post: DataFrame) -> DataFrame:
    """(term, df, cf)."""
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def vocab_grams(voc: DataFrame, lo: int = TX.TEXT_GRAM_MIN, hi: int = TX.TEXT_GRAM_MAX) -> DataFrame:
    """(gram, term) for every prefix of length lo..min(len, hi) of each term."""
    v = voc.select("term").where(F.length("term") >= lo)
    return v.select(F.explode(TX.edge_grams(F.col("term"), lo, hi)).alias("gram"), "term")


def prefix_tf(words: DataFrame, grams: DataFrame, post: DataFrame, lo: int = TX.TEXT_GRAM_MIN,
              hi: int = TX.TEXT_GRAM_MAX, keys: tuple[str, ...] = ("query_id", "idx")) -> DataFrame:
    """Sum of tf over the terms each word is a prefix of (the tf of an edge-gram).

    ``words`` has ``keys`` + ``w``; returns ``keys`` + (doc_id, tf)."""
    w = words.where(F.length("w").between(lo, hi))
    terms = w.join(grams, w.w == grams.gram).select(*keys, "term")
    return (terms.join(post, "term").groupBy(*keys, "doc_id").agg(F.sum("tf").alias("tf")))

"""Phrase match over a positional index (F17): whole phrases, on text and on link fields, single and multi-valued.

The index has a row per (term, field, document) with the sorted positions.  Texts are shuffled by document and indexed
where they lie, so each file has all terms of its documents, sorted by (term, doc_id): the postings of a hot term lie in
all files and a batch's terms read few row groups, and no (term, document) row is shuffled.
Positions count before stop removal (a stop word leaves a gap, which any word fills), and the values of a multi-valued
field are ``VALUE_GAP`` positions apart, so no phrase spans two values.

A batch of phrases is matched from its rarest words on: the rarest word's positions give the possible starts, the
second rarest thins them out, and only what is left is compared with the postings of all other words, by (term,
document).  The work follows the rarest words, not the common ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as TX
from ..session import by_document, materialize

VALUE_GAP = 100
#: Fields analysed by the link chain (parts of letters, digits, "-" and "_"); all others by the word chain.
LINK_FIELDS = ("url", "base_url", "external_links")


def tokens(field: Column, value: Column) -> Column:
    return F.when(field.isin(*LINK_FIELDS), TX.link_tokens(value)).otherwise(TX.words(value))


def stopped(field: Column, term: Column) -> Column:
    """Whether a term is a stop word of its field's chain (the link chain has none)."""
    return ~field.isin(*LINK_FIELDS) & term.isin(*TX.GENERAL_STOPWORDS)


def field_values(docs: DataFrame, fields: list[str], id_col: str = "id") -> DataFrame:
    """(doc_id, field, ordinal, value): a row for every value of the fields, single (string) or multi-valued (array)."""
    out = None
    for f in fields:
        if dict(docs.dtypes)[f].startswith("array"):
            v = docs.select(F.col(id_col).alias("doc_id"), F.lit(f).alias("field"), F.posexplode(f).alias("ordinal", "value"))
        else:
            v = docs.select(F.col(id_col).alias("doc_id"), F.lit(f).alias("field"), F.lit(0).alias("ordinal"), F.col(f).alias("value"))
        out = v if out is None else out.unionByName(v)
    return out.where("value is not null")


def positional_index(values: DataFrame, gap: int = VALUE_GAP) -> DataFrame:
    """(term, field, doc_id, positions) of ``field_values`` rows, a document's in one partition, sorted by (term, doc_id) there."""
    v = by_document(values, "doc_id").withColumn("tokens", tokens(F.col("field"), F.col("value"))).drop("value")
    earlier = Window.partitionBy("doc_id", "field").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    multi = {r["field"] for r in values.where("ordinal > 0").select("field").distinct().collect()}  # the fields' names
    base = F.lit(0).cast("long")
    if multi:  # only the values of multi-valued fields have others before them
        base = F.when(F.col("field").isin(*multi), F.coalesce(F.sum(F.size("tokens") + gap).over(earlier), F.lit(0))).otherwise(base)
    placed = v.withColumn("base", base)
    rows = placed.select("doc_id", "field", "base", F.posexplode("tokens").alias("i", "term")).where(~stopped(F.col("field"), F.col("term")))
    index = rows.groupBy("term", "field", "doc_id").agg(F.sort_array(F.collect_list((F.col("base") + F.col("i")).cast("int"))).alias("positions"))
    return index.sortWithinPartitions("term", "doc_id", "field")


def phrase_words(phrases: DataFrame) -> DataFrame:
    """(phrase_id, field, i, w): the words of (phrase_id, field, phrase) rows with their places, without stop words."""
    w = phrases.select("phrase_id", "field", F.posexplode(tokens(F.col("field"), F.col("phrase"))).alias("i", "w"))
    return w.where(~stopped(F.col("field"), F.col("w")))


def phrase_hits(words: DataFrame, index: DataFrame) -> DataFrame:
    """(phrase_id, field, doc_id, n): the occurrences of every whole phrase of ``phrase_words`` in every document.

    A phrase without words, or with a word that the field nowhere has, occurs nowhere."""
    post = index.withColumnRenamed("term", "w")
    df = post.join(words.select("w", "field").distinct(), ["w", "field"], "left_semi").groupBy("w", "field").agg(F.count("*").alias("df"))
    by_df = Window.partitionBy("phrase_id", "field").orderBy("df", "i")
    whole = Window.partitionBy("phrase_id", "field")
    ranked = materialize(words.join(df, ["w", "field"], "left").withColumns({
        "k": F.row_number().over(by_df), "n_words": F.count("*").over(whole), "found": F.count("df").over(whole)})
        .where("found = n_words").select("phrase_id", "field", "i", "w", "k", "n_words"))

    def starts(positions: str = "positions") -> Column:
        return F.transform(positions, lambda p: p - F.col("i"))
    # written, so that its size is known and the index needs no shuffle to meet few possible starts
    rarest = materialize(ranked.where("k = 1").join(post, ["w", "field"]).select("phrase_id", "field", "doc_id", "n_words", starts().alias("starts")))
    alone = rarest.where("n_words = 1").select("phrase_id", "field", "doc_id", F.size("starts").cast("long").alias("n"))
    # one text's words and one phrase's words meet at (word, document), which no hot word can overload
    second = rarest.where("n_words > 1").join(ranked.where("k = 2").select("phrase_id", "field", "i", "w"), ["phrase_id", "field"]) \
        .join(post, ["w", "field", "doc_id"]).withColumn("both", F.array_intersect("starts", starts())) \
        .where(F.size("both") > 0).select("phrase_id", "field", "doc_id", "n_words", F.col("both").alias("starts"))
    second = materialize(second)
    pair = second.where("n_words = 2").select("phrase_id", "field", "doc_id", F.size("starts").cast("long").alias("n"))
    more = second.where("n_words > 2").join(ranked.where("k > 2").select("phrase_id", "field", "i", "w"), ["phrase_id", "field"]) \
        .join(post, ["w", "field", "doc_id"]).select("phrase_id", "field", "doc_id", "n_words", F.explode(F.array_intersect("starts", starts())).alias("start"))
    full = more.groupBy("phrase_id", "field", "doc_id", "start").agg(F.count("*").alias("m"), F.first("n_words").alias("n_words")) \
        .where("m = n_words - 2").groupBy("phrase_id", "field", "doc_id").agg(F.count("*").alias("n"))
    return alone.unionByName(pair).unionByName(full)

"""Text-analysis operators over token columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as TX
from ..session import by_document

ALNUM = r"^[\p{L}\p{N}]+$"
MAX_DIST = 2  # edits between a misspelt word and its suggestion


def field_tokens(docs: DataFrame) -> DataFrame:
    """(field, doc_id, term): analysed text, plus whole lower-cased values of lang and source."""
    d = by_document(docs.select("doc_id", "text", "lang", "source"), "doc_id")
    none = F.array().cast("array<string>")

    def terms(field, values):
        return F.transform(F.coalesce(values, none), lambda t: F.struct(F.lit(field).alias("field"), t.alias("term")))
    whole = [terms(f, F.when(F.col(f).isNotNull(), F.array(F.lower(f)))) for f in ("lang", "source")]
    return d.select("doc_id", F.explode(F.concat(terms("text", TX.general_tokens(F.col("text"))), *whole)).alias("t")) \
        .select("t.field", "doc_id", "t.term")


def _postings(toks: DataFrame) -> DataFrame:
    """(field, doc_id, term, tf): tokens are counted once, in the partition of their document; statistics read the counts."""
    return toks.groupBy("field", "doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def field_stats(toks: DataFrame) -> DataFrame:
    """Per field, documents, distinct terms, tokens and the top term by document frequency."""
    post = _postings(toks)
    df = post.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    per = df.groupBy("field").agg(F.count(F.lit(1)).alias("terms"), F.sum("cf").alias("tokens")).join(
        post.select("field", "doc_id").distinct().groupBy("field").agg(F.count(F.lit(1)).alias("docs")), "field")
    top = df.withColumn("rn", F.row_number().over(Window.partitionBy("field").orderBy(F.col("df").desc(), "term"))) \
        .where(F.col("rn") == 1)
    return per.join(top, "field").select("field", F.col("docs").cast("long"), F.col("terms").cast("long"),
                                         F.col("tokens").cast("long"), F.col("term").alias("top_term"),
                                         F.col("df").cast("long").alias("top_df"))


def df_histogram(toks: DataFrame) -> DataFrame:
    """Number of terms per power-of-two document-frequency bucket."""
    df = _postings(toks).groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    bucket = (F.length(F.bin("df")) - 1).cast("long")
    return df.groupBy("field", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n_terms"))


def expand_synonyms(texts: DataFrame, id_col: str, synonyms: DataFrame) -> DataFrame:
    """Each query token with all its replacements (itself when it has none).

    The synonym table is fixed configuration of bounded size: broadcast."""
    toks = texts.select(id_col, F.posexplode(TX.general_tokens(F.col("text"))).alias("pos", "term"))
    j = toks.join(F.broadcast(synonyms), "term", "left")
    g = j.groupBy(id_col, "pos", "term").agg(F.array_sort(F.collect_set("replacement")).alias("r"))
    return g.select(F.col(id_col).cast("long").alias(id_col), (F.col("pos") + 1).cast("long").alias("pos"), "term",
                    F.when(F.size("r") > 0, F.array_join("r", " ")).otherwise(F.col("term")).alias("expanded"))


def language_counts(docs: DataFrame, stops: DataFrame) -> DataFrame:
    """Per document, tokens and tokens kept after the language's chain.

    The stop table (lang, word) is fixed and small: broadcast; the token side is
    never shuffled for it."""
    toks = docs.select("doc_id", "lang", F.explode(
        F.transform(TX.words(F.col("text")),
                    lambda t: F.when(F.col("lang") == "fr", TX.strip_elision(t)).otherwise(t))).alias("term"))
    j = toks.join(F.broadcast(stops.withColumnRenamed("word", "term").withColumn("_stop", F.lit(1))),
                  ["lang", "term"], "left")
    kept = F.col("_stop").isNull() & (F.col("term") != "") & F.col("term").rlike(ALNUM)
    agg = j.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.count(F.when(kept, F.lit(1))).alias("n_kept"))
    return docs.select("doc_id", "lang").join(agg, "doc_id", "left").select(
        "doc_id", "lang", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"),
        F.coalesce("n_kept", F.lit(0)).cast("long").alias("n_kept"))


def token_chains(part: DataFrame) -> DataFrame:
    """S11/S14/S19/S20/S22/S32 on part names, brands and types."""
    parts = TX.word_delimiter_parts(F.col("p_brand"))
    payload = TX.payload_token(F.concat(F.split_part(F.col("p_name"), F.lit(" "), F.lit(1)), F.lit("|"),
                                        F.col("p_size").cast("string"), F.lit(".5")))
    return part.select(
        "p_partkey",
        F.array_join(TX.english_tokens(F.col("p_name")), " ").alias("english"),
        F.array_join(parts, " ").alias("parts"), F.array_join(parts, "").alias("catenated"),
        F.array_join(TX.whitespace_tokens(F.col("p_name")), "|").alias("ws_tokens"),
        F.lower("p_type").alias("whole_value"),
        F.array_join(TX.cjk_bigrams(F.col("p_type")), " ").alias("bigrams"),
        payload.term.alias("payload_term"), F.round(payload.weight.cast("double"), 3).alias("payload_weight"))


def suffix_terms(vocab: DataFrame, suffix: str) -> DataFrame:
    """vocabulary terms ending with ``suffix`` (reversed-prefix test)."""
    return vocab.where(F.reverse("term").startswith(suffix[::-1]))


def _pieces(length, n: int):
    """(i, start, size) of the ``n`` even pieces of a word of ``length`` letters."""
    at = lambda i: F.floor(length * i / n).cast("int")
    return F.array(*[F.struct(F.lit(i).alias("i"), at(i).alias("start"), (at(i + 1) - at(i)).alias("size")) for i in range(n)])


def spelling_index(vocab: DataFrame, max_dist: int = MAX_DIST) -> DataFrame:
    """(piece, i, len, term, df): every term of (term, df) rows in ``max_dist`` + 1 even pieces, one row for each."""
    v = vocab.where(F.length("term") > 0).select("term", "df", F.length("term").alias("len"))
    v = v.select("*", F.explode(_pieces(F.col("len"), max_dist + 1)).alias("p"))
    return v.select(F.substr("term", F.col("p.start") + 1, F.col("p.size")).alias("piece"), F.col("p.i").alias("i"), "len", "term", "df")


def spelling(words: DataFrame, vocab: DataFrame, index: DataFrame, max_dist: int = MAX_DIST) -> DataFrame:
    """For words not in the vocabulary, the closest term (distance, then frequency).

    ``max_dist`` edits leave one of a term's ``max_dist`` + 1 pieces untouched, and move it by ``max_dist`` places at
    most.  So a word asks, for each length a close term can have, for each piece in each place it can have moved to: an
    equi-join of some dozens of rows per word with ``spelling_index``, built once for a vocabulary with the same
    ``max_dist``; the distance decides."""
    miss = words.select("word").where("word is not null").distinct() \
        .join(vocab.select(F.col("term").alias("word")), "word", "left_anti").withColumn("n", F.length("word"))
    asked = miss.select("*", F.explode(F.sequence(F.greatest(F.col("n") - max_dist, F.lit(1)), F.col("n") + max_dist)).alias("len")) \
        .select("*", F.explode(_pieces(F.col("len"), max_dist + 1)).alias("p")) \
        .select("*", F.explode(F.sequence(F.col("p.start") - max_dist, F.col("p.start") + max_dist)).alias("at")) \
        .where((F.col("at") >= 0) & (F.col("at") + F.col("p.size") <= F.col("n"))) \
        .select("word", "len", F.col("p.i").alias("i"), F.substr("word", F.col("at") + 1, F.col("p.size")).alias("piece")).distinct()
    cand = asked.join(index, ["piece", "i", "len"]).select("word", "term", "df").distinct() \
        .withColumn("distance", F.levenshtein("word", "term")).where(F.col("distance") <= max_dist)
    w = Window.partitionBy("word").orderBy("distance", F.col("df").desc(), "term")
    best = cand.withColumn("rn", F.row_number().over(w)).where(F.col("rn") == 1)
    return best.select("word", F.col("term").alias("suggestion"), F.col("distance").cast("long"),
                       F.col("df").cast("long").alias("hits"))

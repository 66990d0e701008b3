"""Multi-word synonyms inside search (J13, Q9): longest match over a query's words, a token graph, phrases.

A rule's left side is a phrase of one or more words.  From each place of a query's word sequence the longest left side
that begins there is taken, and matching goes on behind it; the words it covers become one slot of the graph, whose
alternatives are the rule's right sides.  Every other word is a slot with itself as its only alternative.  A document
is found when any alternative of any slot occurs in it: a single word as a prefix of an indexed word, several words as
a phrase of such prefixes within one value of one field.

Rules are configuration, queries a batch: windows of the queries' words meet the rules by equi-join, and only matched
terms reach the index.  Null and empty texts have no slots; equal left sides of several rules share their alternatives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as TX
from ..session import materialize
from . import search as SR

SEP = " "


def rule_table(spark: SparkSession, lines: list[str]) -> DataFrame:
    """(source, m, alternatives) of rule lines: ``a b, c => d e, f`` replaces each left side by all right sides,
    ``a b, c`` each member by all members, itself included.  Case is ignored."""
    pairs = []
    for line in lines:
        left, arrow, right = line.partition("=>")
        sources = left.split(",")
        pairs += [(s, a) for s in sources for a in (right.split(",") if arrow else sources)]
    r = spark.createDataFrame(pairs, "left string, right string")
    r = r.select(TX.words(F.col("left")).alias("s"), F.array_join(TX.words(F.col("right")), SEP).alias("a")).where("size(s) > 0 and a <> ''")
    return r.groupBy(F.array_join("s", SEP).alias("source"), F.size("s").alias("m")).agg(F.array_sort(F.collect_set("a")).alias("alternatives"))


def _matches(seqs: DataFrame, rules: DataFrame, id_col: str) -> DataFrame:
    """(id, at, m, alternatives): leftmost, then longest matches that do not overlap."""
    longest = rules.agg(F.max("m")).first()[0] or 0  # one number of the configuration
    size = F.size("seq")
    windows = F.flatten(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(max(longest, 1)), size - i)),
        lambda m: F.struct(i.alias("at"), F.array_join(F.slice("seq", i + 1, m), SEP).alias("source")))))
    found = seqs.where(size > 0).select(id_col, F.explode(windows).alias("w")).select(id_col, "w.at", "w.source").join(rules, "source")
    found = found.groupBy(id_col, "at").agg(F.max_by(F.struct("m", "alternatives"), "m").alias("x")).select(id_col, "at", "x.*")
    # a match that begins behind all earlier ones is taken whatever they were: chains of overlaps are folded one by one
    earlier = Window.partitionBy(id_col).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    chain = found.withColumn("fresh", F.coalesce(F.col("at") >= F.max(F.col("at") + F.col("m")).over(earlier), F.lit(True)).cast("int"))
    chain = chain.withColumn("chain", F.sum("fresh").over(Window.partitionBy(id_col).orderBy("at")))
    spans = chain.groupBy(id_col, "chain").agg(F.array_sort(F.collect_list(F.struct("at", "m"))).alias("spans"))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("taken"))
    kept = F.aggregate("spans", start, lambda acc, x: F.when(x.at < acc.end, acc).otherwise(
        F.struct((x.at + x.m).alias("end"), F.array_append(acc.taken, x.at).alias("taken")))).taken
    return found.join(spans.select(id_col, F.explode(kept).alias("at")), [id_col, "at"])


def token_graph(texts: DataFrame, rules: DataFrame, id_col: str, stopwords: list[str], stops_first: bool) -> DataFrame:
    """(id, at, n, alternatives): the slots of each text of (id, text), ``at`` the slot's first word, ``n`` its words.

    ``stops_first``: stop words go before the match, so a rule may match over them; otherwise rules see all words, and
    stop words go from the alternatives afterwards (an alternative without words goes, a slot without alternatives too)."""
    words = TX.words(F.coalesce(F.col("text"), F.lit("")))
    seqs = texts.select(id_col, (TX.drop_stopwords(words, stopwords) if stops_first else words).alias("seq"))
    spans = materialize(_matches(seqs, rules, id_col))
    inside = spans.select(id_col, "m", "alternatives", F.explode(F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda k: F.struct(
        (F.col("at") + k).alias("at"), k.alias("k")))).alias("x")).select(id_col, "x.*", "m", "alternatives")
    slots = seqs.select(id_col, F.posexplode("seq").alias("at", "term")).join(inside, [id_col, "at"], "left").where("k is null or k = 0")
    alts = F.coalesce("alternatives", F.array("term"))
    if not stops_first:
        alts = F.transform(alts, lambda a: F.array_join(TX.drop_stopwords(F.split(a, SEP), stopwords), SEP))
        alts = F.array_sort(F.array_distinct(F.filter(alts, lambda a: a != "")))
    return slots.select(id_col, "at", F.coalesce("m", F.lit(1)).alias("n"), alts.alias("alternatives")).where(F.size("alternatives") > 0)


def prefix_phrases(phrases: DataFrame, grams: DataFrame, vocab: DataFrame, index: DataFrame) -> DataFrame:
    """(phrase, doc_id): documents in which words that begin with a phrase's words follow one another.

    ``phrases``: (phrase), words joined by a blank, two or more.  The words with the fewest postings give the possible
    starts; the postings of the others meet them by (phrase, document)."""
    w = phrases.distinct().select("phrase", F.size(F.split("phrase", SEP)).alias("n_words"), F.posexplode(F.split("phrase", SEP)).alias("i", "w"))
    terms = w.join(grams, w.w == grams.gram).join(vocab.select("term", "df"), "term")
    cost = terms.groupBy("phrase", "i", "n_words").agg(F.sum("df").alias("cost"))
    order = cost.withColumns({"k": F.row_number().over(Window.partitionBy("phrase").orderBy("cost", "i")),
                              "found": F.count("*").over(Window.partitionBy("phrase"))}).where("found = n_words")
    terms = materialize(terms.select("phrase", "i", "term").join(order.select("phrase", "i", "k", "n_words"), ["phrase", "i"]))
    at = terms.join(index.select("term", "doc_id", "positions"), "term") \
        .withColumn("starts", F.transform("positions", lambda p: p - F.col("i")))
    first = at.where("k = 1").groupBy("phrase", "doc_id").agg(F.flatten(F.collect_list("starts")).alias("possible"))
    rest = at.where("k > 1").join(first, ["phrase", "doc_id"]) \
        .select("phrase", "doc_id", "n_words", F.explode(F.array_intersect("possible", "starts")).alias("start"))
    # a place holds one word, so each of the other words counts once for a start
    full = rest.groupBy("phrase", "doc_id", "start", "n_words").agg(F.count("*").alias("c")).where("c = n_words - 1")
    return full.select("phrase", "doc_id").distinct()


def graph_hits(graph: DataFrame, grams: DataFrame, vocab: DataFrame, post: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, doc_id): documents with any alternative of any slot of a query's graph."""
    alts = materialize(graph.select("query_id", F.explode("alternatives").alias("phrase")).distinct())
    several = F.contains("phrase", F.lit(SEP))
    fits = F.length("phrase").between(TX.TEXT_GRAM_MIN, TX.TEXT_GRAM_MAX)
    single = SR.hits(alts.where(~several & fits).select("query_id", F.array("phrase").alias("terms")), grams, post)
    multi = alts.where(several)
    docs = prefix_phrases(multi.select("phrase"), grams, vocab, index)
    return single.unionByName(multi.join(docs, "phrase").select("query_id", "doc_id")).distinct()

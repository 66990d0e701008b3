"""Sorted term dictionary and its reversed twin: prefix and suffix match without a table of prefixes.

The distinct terms of an index are range partitioned and sorted by a key: the term itself or, in the reversed twin,
its letters from the last to the first.  ``at`` numbers the entries in key order (range partition in the high bits), so
the terms with a prefix of any length are one range of ``at`` in each partition that it touches; a suffix is a prefix
in the twin.  A batch of words visits only the partitions whose key range can hold them, finds its two ends there by
binary search, and reads the terms between by an equi-join on ``at``.

What one task holds is one range partition of distinct terms; the driver sees the two end keys of each partition.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: ``monotonically_increasing_id`` keeps the partition above these bits.
PART_BITS = 33
#: Values of a field and queries that one task of ``matching_docs`` compares, and values in one of its matrices.
DOC_BLOCK, QUERY_BLOCK, CHUNK = 4096, 1024, 256


def _key(term: Column, backwards: bool) -> Column:
    return F.reverse(term) if backwards else term


def dictionary(index: DataFrame, backwards: bool = False) -> DataFrame:
    """(at, key, term): the distinct terms of ``index`` (any table with a column term) in key order; null is no term."""
    terms = index.select("term").where("term is not null").distinct().withColumn("key", _key(F.col("term"), backwards))
    ordered = terms.repartitionByRange("key").sortWithinPartitions("key")
    return materialize(ordered.select(F.monotonically_increasing_id().alias("at"), "key", "term"))


def _parts(prefixes: DataFrame, ends: list[tuple]) -> DataFrame:
    """(prefix, part): the range partitions that can hold keys with the prefix; ``ends``: (part, first key, last key)."""
    low, high = [e[1] for e in ends], [e[2] for e in ends]

    @F.pandas_udf("array<long>")
    def touched(prefix: pd.Series) -> pd.Series:
        return pd.Series([[e[0] for e in ends[bisect_left(high, p):bisect_right(low, p, key=lambda k: k[:len(p)])]] for p in prefix])
    return prefixes.select("prefix", F.explode(touched("prefix")).alias("part"))


def matches(words: DataFrame, entries: DataFrame, backwards: bool = False) -> DataFrame:
    """(w, term): every dictionary term that begins (in the reversed twin: ends) with a word ``w`` of ``words``.

    Each distinct word is looked up once; null and empty words match nothing, and so does an empty dictionary."""
    part = F.shiftright("at", PART_BITS)
    ends = entries.groupBy(part.alias("part")).agg(F.min("key").alias("low"), F.max("key").alias("high")).collect()  # one per partition
    prefixes = words.where("w is not null and w != ''").select(_key(F.col("w"), backwards).alias("prefix")).distinct()
    dealt = _parts(prefixes, sorted((r["part"], r["low"], r["high"]) for r in ends))

    def search(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame({"prefix": [], "first": [], "last": []})
        held = held.sort_values("at")
        keys, at = held["key"].tolist(), held["at"].tolist()
        rows = []
        for p in asked["prefix"]:
            i = bisect_left(keys, p)
            j = bisect_right(keys, p, lo=i, key=lambda k: k[:len(p)])
            if j > i:
                rows.append((p, at[i], at[j - 1]))
        return pd.DataFrame(rows, columns=["prefix", "first", "last"])
    keyed = entries.select("at", "key", part.alias("part"))
    spans = dealt.groupBy("part").cogroup(keyed.join(dealt.select("part").distinct(), "part", "left_semi").groupBy("part")) \
        .applyInPandas(search, "prefix string, first long, last long")
    places = spans.select(_key(F.col("prefix"), backwards).alias("w"), F.explode(F.sequence("first", "last")).alias("at"))
    return places.join(entries.select("at", "term"), "at").select("w", "term")


def matching_docs(words: DataFrame, entries: DataFrame, index: DataFrame, backwards: bool = False,
                  doc_block: int = DOC_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, field, doc_id, tf): occurrences in each field of terms that match the words of (query_id, w) rows.

    ``index`` is a positional index; a word given twice counts twice.  Short words match thousands of terms and many
    queries share them, so terms and queries never meet row by row: each index row goes to the words that its term
    matches (few), and blocks of documents meet blocks of queries as two matrices, documents by words and words by
    queries.  A task holds the words of about ``doc_block`` values of a field and of about ``query_block`` queries."""
    asked = materialize(words.where("w is not null and w != ''").groupBy("query_id", "w").agg(F.count("*").alias("times")))
    # small numbers instead of words and queries in the blocks
    numbers = materialize(asked.select("w").distinct().select("w", F.monotonically_increasing_id().alias("word")))
    queries = materialize(asked.select(F.col("query_id").alias("_id")).distinct().select("_id", F.monotonically_increasing_id().alias("q")))
    # written before the join with the postings: Spark splits a hot term only where both sides are bare shuffles
    pairs = materialize(matches(asked, entries, backwards).join(numbers, "w").select("term", "word"))
    n_docs = max(1, math.ceil(index.agg(F.approx_count_distinct(F.struct("doc_id", "field"))).first()[0] / doc_block))
    n_queries = max(1, math.ceil(queries.count() / query_block))

    def block(of: int, *cols: str) -> Column:
        return F.pmod(F.xxhash64(*cols), F.lit(of)).cast("int")

    def every(of: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    batch = asked.join(numbers, "w").join(queries, F.col("query_id").eqNullSafe(F.col("_id"))) \
        .select(block(n_queries, "q").alias("qb"), every(n_docs).alias("db"), "q", F.col("word").alias("asked"), "times")
    held = index.join(pairs, "term").select(block(n_docs, "doc_id", "field").alias("db"), every(n_queries).alias("qb"),
                                            F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), F.col("doc_id").isNull().alias("no_doc"),
                                            "field", "word", F.size("positions").alias("n"))

    def tally(a: pd.DataFrame, h: pd.DataFrame) -> pd.DataFrame:
        terms, row = np.unique(a["asked"].to_numpy(), return_inverse=True)
        ids, column = np.unique(a["q"].to_numpy(), return_inverse=True)
        times = np.zeros((len(terms), len(ids)))
        times[row, column] = a["times"].to_numpy()
        h = h[h["word"].isin(terms)]
        key = ["doc_id", "no_doc", "field"]
        docs = h[key].drop_duplicates()
        doc, word = h.groupby(key, sort=False).ngroup().to_numpy(), np.searchsorted(terms, h["word"].to_numpy())
        order = np.argsort(doc, kind="stable")
        doc, word, n = doc[order], word[order], h["n"].to_numpy()[order]
        q, tf = [], []
        for first in range(0, len(docs), CHUNK):
            some = min(CHUNK, len(docs) - first)
            part = slice(*np.searchsorted(doc, [first, first + some]))
            held_words = np.bincount((doc[part] - first) * len(terms) + word[part], n[part], some * len(terms))
            for found in held_words.reshape(some, len(terms)) @ times:
                hit = np.flatnonzero(found)
                q.append(ids[hit])
                tf.append(found[hit].astype(np.int64))
        return docs.assign(q=q, tf=tf)
    found = batch.groupBy("db", "qb").cogroup(held.groupBy("db", "qb")) \
        .applyInPandas(tally, "doc_id long, no_doc boolean, field string, q array<long>, tf array<long>")
    found = found.select(F.when(~F.col("no_doc"), F.col("doc_id")).alias("doc_id"), "field", F.explode(F.arrays_zip("q", "tf")).alias("hit"))
    return found.select("doc_id", "field", "hit.q", "hit.tf").join(queries, "q") \
        .select(F.col("_id").alias("query_id"), "field", "doc_id", "tf")

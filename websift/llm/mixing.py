"""Mixing sources to target weights with hash-threshold histograms. DataFrame functions only.

Each source gets a weight; targets share 100 % of all sizes by weight, stop at ``MAX_COPIES`` times their source's
size, and what stops there is shared again by weight.  A source takes floor(target / size) whole copies and, for the
rest of its target, the rows whose hash lies under a threshold.  Thresholds nest: a larger target keeps every row
that a smaller one takes.  The threshold is found without a sort: sizes are summed by source and hash bucket, the
bucket in which the running sum passes the budget is refined by the next bits of the hash, and so on until one hash
value is left, which is taken if that comes nearer to the target.

What one task gathers is bounded: a source's histogram has at most 2**BITS sums however many rows it has; the table
of sources has one row per source.

Defined results: a null text has size 0; a null source is a source of its own, after all others; sources without
any word have target 0; rows with equal doc_id and text share a hash and are taken together; an empty table gives
an empty result.  Reruns agree, as the hash depends on doc_id and text alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .quality import word_array

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
BITS = 12
HASH_BITS = 60


def row_hash(doc_id: str, text: str) -> Column:
    """0 to 2**HASH_BITS - 1, the same on every run."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("mix"), F.col(doc_id), F.col(text)), 64 - HASH_BITS)


def targets(sizes: DataFrame, source: str = "source", size: str = "size", weights=WEIGHTS) -> DataFrame:
    """(source, source_size, target): weights are given in code-point order of the sources, null last, repeating.

    Targets are min(cap, rate * weight); the rate is the largest of the rates that hold when the sources with the
    smallest cap per weight are at their caps.
    """
    s = sizes.groupBy(source).agg(F.sum(size).alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last()))
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(rank - 1, F.lit(len(weights))))
    s = s.withColumn("_weight", weight).withColumn("_cap", (F.col("source_size") * MAX_COPIES).cast("double"))
    by = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col(source).asc_nulls_last())
    before = F.coalesce(F.sum("_cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    beyond = F.sum("_weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    s = s.withColumn("_rate", (F.sum("source_size").over(everything) - before) / beyond)
    s = s.withColumn("_rate", F.max("_rate").over(everything))
    return s.select(source, "source_size", F.least("_cap", F.col("_rate") * F.col("_weight")).alias("target"))


def thresholds(sizes: DataFrame, goals: DataFrame, source: str = "source", size: str = "size") -> DataFrame:
    """``goals`` with ``copies`` (whole copies of the source) and ``threshold`` (rows with a smaller hash get one more)."""
    g = goals.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                         .otherwise(0).cast("int"))
    g = cut(g.withColumn("_rest", F.greatest(F.lit(0.0), F.col("target") - F.col("copies") * F.col("source_size"))), "goals")
    edge = g.select(F.col(source).alias("_s"), F.col("_rest"), F.lit(0).cast("long").alias("_prefix"))
    last = None
    for shift in range(HASH_BITS - BITS, -1, -BITS):
        inside = sizes.join(edge.select("_s", "_prefix"), sizes[source].eqNullSafe(F.col("_s"))
                            & (F.shiftrightunsigned("_h", shift + BITS) == F.col("_prefix")))
        sums = inside.groupBy("_s", F.shiftrightunsigned("_h", shift).alias("_bucket")).agg(F.sum(size).alias("_sum"))
        w = Window.partitionBy("_s").orderBy("_bucket")
        sums = sums.withColumn("_end", F.sum("_sum").over(w)).select(F.col("_s").alias("_s2"), "_bucket", "_sum", "_end")
        hit = sums.join(edge.select("_s", "_rest"), F.col("_s").eqNullSafe(F.col("_s2")) & (F.col("_end") > F.col("_rest")))
        # the first bucket whose running sum passes the budget
        first = hit.groupBy("_s", "_rest").agg(F.min(F.struct("_bucket", "_sum", "_end")).alias("_b"))
        edge = cut(first.select("_s", (F.col("_rest") - F.col("_b._end") + F.col("_b._sum")).alias("_rest"),
                                F.col("_b._bucket").alias("_prefix"), F.col("_b._sum").alias("_size")), "edge")
        last = edge
    end = last.select("_s", (F.col("_prefix") + F.when(F.col("_rest") * 2 > F.col("_size"), 1).otherwise(0)).alias("threshold"))
    out = g.join(end, g[source].eqNullSafe(F.col("_s")), "left")
    # a table of one row per source: written, so that Spark knows its size when it plans the join with all rows
    return cut(out.select(source, "source_size", "target", "copies", F.coalesce("threshold", F.lit(0)).alias("threshold")), "thresholds")


def plan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS):
    """(sizes, table): one narrow row (doc_id, source, size, _h) per row, and the thresholds of each source."""
    sizes = cut(df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
                          F.size(word_array(F.col(text))).cast("long").alias("size"), row_hash(doc_id, text).alias("_h")), "sizes")
    return sizes, thresholds(sizes, targets(sizes, weights=weights))


def copies_of(h: Column) -> Column:
    return F.col("copies") + F.when(h < F.col("threshold"), 1).otherwise(0)


def mix(df: DataFrame, **columns) -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes of the row, repeats counted)."""
    sizes, table = plan(df, **columns)
    t = table.withColumnRenamed("source", "_s")
    return sizes.join(t, sizes["source"].eqNullSafe(F.col("_s"))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * copies_of(F.col("_h"))).cast("long").alias("taken"))


def mix_rows(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS) -> DataFrame:
    """The rows of ``df`` as often as the mix takes them (0 to 3 times), with the columns of ``df``."""
    table = plan(df, doc_id, text, source, weights)[1]
    columns = df.columns
    names = [f"_in{i}" for i in range(len(columns))]
    d = df.toDF(*names)
    name = dict(zip(columns, names))
    d = d.withColumn("_h", row_hash(name[doc_id], name[text]))
    t = table.withColumnRenamed("source", "_s")
    d = d.join(t, d[name[source]].eqNullSafe(F.col("_s"))).withColumn("_n", copies_of(F.col("_h"))).where("_n > 0")
    return d.select(F.explode(F.array_repeat(F.struct(*names), F.col("_n"))).alias("_row")) \
        .select(*[F.col(f"_row.{n}").alias(c) for n, c in zip(names, columns)])

"""Facets and grouping (G12–G16, W4): partial + final aggregations, no collect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def field_facet(df: DataFrame, field: str) -> DataFrame:
    """(field, value, count); NULL is its own ("missing") bucket."""
    return df.groupBy(field).agg(F.count(F.lit(1)).alias("count")) \
        .select(F.lit(field).alias("field"), F.col(field).cast("string").alias("value"), "count")


def query_facet(df: DataFrame, facets: list[tuple[str, str]]) -> DataFrame:
    """One count per named predicate (one pass), zero counts hidden."""
    agg = df.agg(*[F.count_if(F.expr(p)).alias(f"q{i}") for i, (_, p) in enumerate(facets)])
    stacked = agg.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"q{i}").alias("count"))
                                             for i, (n, _) in enumerate(facets)])).alias("s"))
    return stacked.select("s.name", F.col("s.count").cast("long").alias("count")).where(F.col("count") > 0)


def range_facet(df: DataFrame, col: str, start: int, end: int, gap: int) -> DataFrame:
    """Counts per [start + k*gap, start + (k+1)*gap) plus 'before' and 'after'."""
    x = F.col(col)
    bucket = (F.when(x < start, F.lit("before")).when(x >= end, F.lit("after"))
              .otherwise((F.lit(start) + F.floor((x - start) / gap) * gap).cast("long").cast("string")))
    return df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("count"))


def pivot_facet(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts by a, then by b inside a; ``level`` tells rollup rows from NULL values."""
    return df.rollup(a, b).agg(F.grouping_id(a, b).cast("long").alias("level"),
                               F.count(F.lit(1)).alias("count"))


def group_top(df: DataFrame, group: str, order: Column, tie: str, n: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Group size and the first n rows per group.

    ``row_number <= n`` lets Spark cut each partition to n rows per group
    before the shuffle; the group size is a separate partial aggregation."""
    w = Window.partitionBy(group).orderBy(order, F.col(tie).asc())
    top = df.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n)
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("group_count"))
    return top.join(sizes, group, "inner").select(
        group, F.col("group_count").cast("long").alias("group_count"), F.col("pos").cast("long").alias("pos"),
        tie, *keep)

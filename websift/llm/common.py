"""Helpers shared by the training-data operators: tables in the shared folder, connected components."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: Rows of one Arrow batch for columns that hold whole texts; the default (10,000) is too many for long texts.
TEXT_BATCH_ROWS = 512


def prepare(spark: SparkSession) -> None:
    """Settings of the session that the operators need: small Arrow batches, as a row may hold a long text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH_ROWS))


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh path in the shared folder named by ``spark.checkpoint.dir``."""
    return os.path.join(checkpoint_dir(spark), "llm", f"{kind}-{uuid.uuid4().hex}")


def cut(df: DataFrame, kind: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, no lineage, safe when executors are lost."""
    spark = df.sparkSession
    path = new_folder(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Connected components as (node, component = smallest node), one row for each node that has an edge.

    Alternating large-star and small-star steps: each shortens paths until every
    node points at the smallest node of its component; no step gathers a
    component in one task (minimum per node with map-side combine, then a join
    whose skewed keys Spark can split).  Rows with a null end or equal ends are
    ignored; an empty input gives an empty result.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")) \
        .where("u is not null and v is not null and u != v").distinct()
    e = cut(e, "edges")
    state = _state(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        # large star: every larger neighbour of u goes to the smallest node around u
        big = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        # small star: the smaller neighbours of u (and u) go to the smallest of them
        small = big.groupBy("u").agg(F.min("v").alias("m"))
        nxt = big.join(small, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        e = cut(nxt, "edges")
        now = _state(e)
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")) \
        .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(e: DataFrame) -> tuple:
    """Count and order-free checksum of an edge list (two numbers)."""
    r = e.select(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)).alias("h")).agg(F.count("*").alias("n"), F.sum("h").alias("s")).first()
    return r["n"], r["s"]


def runs(batches, keys: list[str]):
    """Consecutive rows with equal ``keys`` of sorted pandas batches, one frame per run."""
    import pandas as pd
    parts, current = [], None
    for b in batches:
        here = list(zip(*[b[k] for k in keys]))
        begin = 0
        for i, key in enumerate(here):
            if key != current:
                if i > begin:
                    parts.append(b.iloc[begin:i])
                if parts:
                    yield pd.concat(parts, ignore_index=True)
                parts, current, begin = [], key, i
        if len(here) > begin:
            parts.append(b.iloc[begin:])
    if parts:
        yield pd.concat(parts, ignore_index=True)


def smallest_roots(n: int, x, y):
    """Smallest position that each of ``n`` positions reaches over the pairs (x, y)."""
    import numpy as np
    root = np.arange(n)
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new

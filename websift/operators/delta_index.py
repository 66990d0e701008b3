"""Incremental term index (T4): runs of postings with versions, read by newest version, merged in levels.

A batch of changes (doc_id, version, text, deleted) becomes one run: ``docs`` with the newest change of each of its
documents (a deletion is a row without postings, a tombstone) and ``postings`` with the terms of those that are not
deleted, all terms of a document in one row.  A batch's texts are shuffled once, by document, and versions are chosen by
their numbers, so merging and reading move the row of a document and not one for each of its terms.  Nothing older is rewritten, so what a batch writes grows with the batch and not with the index.  Reading
takes the newest version of each document over all runs, whatever order the changes arrived in, so a document that is
sent again replaces its postings and one that is deleted loses them, until a newer change brings it back.

Every ``FAN`` runs of a level are merged into one of the next level: older versions go, the newest stay, and a row is
rewritten once a level, that is a logarithmic number of times.  A run's folder is named by the first and last batch
that it covers and counts once its write has succeeded; a merged run hides the runs that it covers.  A repeated batch
writes the same folder again.

Defined results: of changes with equal document and version a deletion wins, then the text with the largest hash,
whatever batches they came in; a null text has no terms; changes without doc_id are left out.
"""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as TX
from ..session import by_document, materialize

FAN = 4
VERSION = ["doc_id", "version", "digest"]
DOCS = "doc_id long, version long, deleted boolean, digest long"
POSTINGS = "doc_id long, version long, digest long, terms array<string>, tfs array<int>"


def runs(spark: SparkSession, root: str) -> list[tuple[int, int]]:
    """(first, last) batch of every finished run that no larger finished run covers, oldest first."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(root, "docs")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for st in (fs.listStatus(p) if fs.exists(p) else []):
        name = st.getPath().getName()
        # the docs of a run are written after its postings
        if name.startswith("run=") and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            a, b = name[4:].split("-")
            found.append((int(a), int(b)))
    return sorted(x for x in found if not any(y != x and y[0] <= x[0] and x[1] <= y[1] for y in found))


def _path(root: str, kind: str, run: tuple[int, int]) -> str:
    return os.path.join(root, kind, f"run={run[0]}-{run[1]}")


def _read(spark: SparkSession, root: str, kind: str, which: list[tuple[int, int]]) -> DataFrame:
    """The rows of runs with ``run``, the first batch of their run."""
    schema = DOCS if kind == "docs" else POSTINGS
    if not which:
        return spark.createDataFrame([], schema + ", run int")
    parts = [spark.read.schema(schema).parquet(_path(root, kind, r)).withColumn("run", F.lit(r[0])) for r in which]
    return reduce(DataFrame.unionByName, parts)


def write_run(changes: DataFrame, root: str, batch: int) -> None:
    """The newest change of each document of a batch, as one run."""
    rows = changes.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("version").cast("long").alias("version"),
                                                      F.coalesce("deleted", F.lit(False)).alias("deleted"), F.xxhash64("text").alias("digest"), "text")
    # a document's rows lie in one partition from here on: its newest text, its counts and its postings need no other shuffle
    last = by_document(rows, "doc_id").groupBy("doc_id").agg(F.max(F.struct("version", "deleted", "digest", "text")).alias("c")).select("doc_id", "c.*")
    words = last.where("not deleted").select(*VERSION, F.explode(TX.general_tokens(F.col("text"))).alias("term"))
    tf = words.groupBy(*VERSION, "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    post = tf.groupBy(*VERSION).agg(F.collect_list(F.struct("term", "tf")).alias("p")).select(*VERSION, F.col("p.term").alias("terms"), F.col("p.tf").alias("tfs"))
    post.write.mode("overwrite").parquet(_path(root, "postings", (batch, batch)))
    newest(rows, "version", "deleted", "digest").write.mode("overwrite").parquet(_path(root, "docs", (batch, batch)))


def newest(docs: DataFrame, *numbers: str) -> DataFrame:
    """The newest version of each document (numbers only, combined before the shuffle)."""
    return docs.groupBy("doc_id").agg(F.max(F.struct(*numbers)).alias("c")).select("doc_id", "c.*")


def _current(spark: SparkSession, root: str, which: list[tuple[int, int]]) -> tuple[DataFrame, DataFrame]:
    # a change that was sent in two batches counts in one of the runs
    docs = materialize(newest(_read(spark, root, "docs", which), "version", "deleted", "digest", "run"))
    key = [*VERSION, "run"]
    post = _read(spark, root, "postings", which).join(docs.where("not deleted").select(*key), key, "left_semi")
    return docs.drop("run"), post.drop("run")


def read(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, term, tf) of the newest version of every document that is not deleted."""
    post = _current(spark, root, runs(spark, root))[1]
    return post.select("doc_id", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("doc_id", F.col("p.terms").alias("term"), F.col("p.tfs").cast("long").alias("tf"))


def merge(spark: SparkSession, root: str, which: list[tuple[int, int]]) -> None:
    docs, post = _current(spark, root, which)
    whole = (which[0][0], which[-1][1])
    post.write.mode("overwrite").parquet(_path(root, "postings", whole))
    docs.write.mode("overwrite").parquet(_path(root, "docs", whole))


def merge_levels(spark: SparkSession, root: str, fan: int = FAN) -> None:
    """Merge the newest ``fan`` runs while they are of one level (cover equally many batches)."""
    while True:
        last = runs(spark, root)[-fan:]
        if len(last) < fan or len({b - a for a, b in last}) > 1:
            return
        merge(spark, root, last)

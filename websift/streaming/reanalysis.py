"""Re-analysis after votes (T5): accepted votes drive a new extraction of the voted page from its newest snapshot.

The vote stream's sink of folded votes is the source of a second stream.  Each of its micro-batches takes the websites
with an accepted vote, finds the newest snapshot of each page (versions are compared as numbers, only the chosen
snapshots' html is read on), extracts website, metadata and links once, and writes them as rows of the batch's epoch,
together with a run of the incremental index.  Nothing older is rewritten: ``Store`` reads, for each website, the rows
of the newest epoch that touched it, and the base rows of all others, so child rows that a new snapshot no longer has
are gone.  A repeated micro-batch overwrites its own epoch.

Defined results: rejected votes and votes for websites without snapshot change nothing; several votes in a micro-batch
cause one extraction; of snapshots with equal version the one with the largest hash of its html is taken.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import delta_index as DX
from ..operators import extract as X
from ..session import materialize

TABLES = {"websites": "id long, title string, text string, url string, version long",
          "metadata": "website_id long, position int, metadata_text string",
          "links": "website_id long, href string"}


def newest_snapshots(snapshots: DataFrame, ids: DataFrame) -> DataFrame:
    """The newest snapshot (page_id, version, url, html) of every page in ``ids`` (page_id)."""
    s = snapshots.join(ids, "page_id", "left_semi").withColumn("digest", F.xxhash64("html"))
    key = s.groupBy("page_id").agg(F.max(F.struct("version", "digest")).alias("k")).select("page_id", "k.*")
    return s.join(key, ["page_id", "version", "digest"]).dropDuplicates(["page_id"]).drop("digest")


def extract(pages: DataFrame) -> dict[str, DataFrame]:
    """Rows of ``TABLES`` of (page_id, version, url, html) pages."""
    p = materialize(X.parse_pages(pages).join(pages.select("page_id", "version"), "page_id"))
    return {"websites": p.select(F.col("page_id").alias("id"), "title", "text", "url", "version"),
            "metadata": X.metadata_rows(p).select("website_id", "position", "metadata_text"),
            "links": p.select(F.col("page_id").alias("website_id"), F.explode("hrefs").alias("href"))}


class Store:
    """Base rows and the epochs written over them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def path(self, table: str, epoch: int | None = None) -> str:
        return os.path.join(self.root, "base" if epoch is None else "epochs", table, *([] if epoch is None else [f"epoch={epoch}"]))

    def write(self, rows: dict[str, DataFrame], epoch: int | None = None) -> None:
        """The base (no epoch) or an epoch's rows; the websites, which mark what the epoch touched, come last."""
        for table in ("metadata", "links", "websites"):
            rows[table].write.mode("overwrite").parquet(self.path(table, epoch))
        docs = rows["websites"].select(F.col("id").alias("doc_id"), F.lit(0 if epoch is None else epoch + 1).cast("long").alias("version"),
                                       F.concat_ws(" ", "title", "text").alias("text"), F.lit(False).alias("deleted"))
        DX.write_run(docs, os.path.join(self.root, "index"), 0 if epoch is None else epoch + 1)

    def _epochs(self, table: str) -> DataFrame:
        folder = os.path.join(self.root, "epochs", table)
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        if not hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], TABLES[table] + ", epoch long")
        return self.spark.read.schema(TABLES[table] + ", epoch long").parquet(folder)

    def read(self, table: str) -> DataFrame:
        key = "id" if table == "websites" else "website_id"
        touched = self._epochs("websites").groupBy("id").agg(F.max("epoch").alias("epoch")).withColumnRenamed("id", key)
        base = self.spark.read.schema(TABLES[table]).parquet(self.path(table))
        now = self._epochs(table).join(touched, [key, "epoch"], "left_semi").drop("epoch")
        return base.join(touched, key, "left_anti").unionByName(now)

    def index(self) -> DataFrame:
        return DX.read(self.spark, os.path.join(self.root, "index"))


def run_reanalysis(spark: SparkSession, source: str, schema: str, snapshots: DataFrame, store: Store) -> None:
    """Fold the votes in ``source`` (website_id, accepted) that have arrived into ``store``."""
    def batch(df: DataFrame, epoch: int) -> None:
        voted = df.where("accepted").select(F.col("website_id").alias("page_id")).distinct()
        store.write(extract(materialize(newest_snapshots(snapshots, voted))), epoch)
        DX.merge_levels(spark, os.path.join(store.root, "index"))

    q = (spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(source)
         .writeStream.foreachBatch(batch).option("checkpointLocation", os.path.join(store.root, "ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination()

"""Labelled page corpus (A2) and a feature cache (A3).

A corpus is a folder tree ``<genre>/<file>``; the label is the parent folder
name and only the known genres are kept.  Files are read whole, one row each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The genres of the page corpus.
GENRES = ["articles", "discussion", "download", "help", "linklists", "portrait-non_priv", "portrait-priv", "shop"]


def read_corpus(spark: SparkSession, folder: str, genres: list[str] = GENRES) -> DataFrame:
    """(path, label, html) for every file under a known genre folder."""
    df = (spark.read.text(folder, wholetext=True, recursiveFileLookup=True)
          .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html")))
    return df.withColumn("label", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)) \
        .where(F.col("label").isin(*genres)).select("path", "label", "html")


def cached(df_builder, path: str, spark: SparkSession) -> DataFrame:
    """A3: read the features stored at ``path``; compute and store them when absent."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        df_builder().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)

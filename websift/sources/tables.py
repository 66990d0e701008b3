"""Given tables (parquet) and the fixed-schema tables of the engine.

Reads never infer schemas and never pull more columns than a caller selects:
Catalyst prunes the scan to the projected columns and pushes filters into
the parquet reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


# Text tables whose per-row work (regex parsing, tokenising) is CPU heavy.
TEXT_TABLES = {"pages": "page_id", "documents": "doc_id", "benchmark": "item_id", "conversations": "conv_id"}
# Below this size a text table is spread over all cores once after the scan:
# a small file is often a single row group, i.e. a single scan task.  Large
# inputs already arrive in many splits and are never reshuffled.
REBALANCE_BYTES = 256 << 20


def _input_bytes(spark: SparkSession, path: str) -> int:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(p).getLength())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    df = spark.read.parquet(path)
    if name in TEXT_TABLES and _input_bytes(spark, path) < REBALANCE_BYTES:
        # hash on the id: deterministic, no pre-sort of the wide text rows
        df = df.repartition(spark.sparkContext.defaultParallelism, TEXT_TABLES[name])
    return df


def table_count(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Row count of a given table (answered from the Parquet footers, no shuffle)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").count()


# Fixed schemas of the relational store (website, metadata, links, bridge,
# frontier, users).  Ids are nullable before they are assigned.
WEBSITES = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("base_url", T.StringType()),
    T.StructField("rank", T.DoubleType()),
    T.StructField("type_of_website", T.StringType()),
])
METADATA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("metadata_text", T.StringType()),
    T.StructField("website_id", T.LongType()),
    T.StructField("position", T.IntegerType()),
])
EXTERNAL_LINKS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("url", T.StringType()),
])
WEBSITE_REF_EXT_LINKS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("website_id", T.LongType()),
    T.StructField("ext_link_id", T.LongType()),
])
NEXT_URLS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("url", T.StringType()),
])
USERS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("username", T.StringType()),
    T.StructField("rank", T.DoubleType()),
    T.StructField("country_iso_a2", T.StringType()),
])

STORE_SCHEMAS = {
    "websites": WEBSITES,
    "metadata": METADATA,
    "external_links": EXTERNAL_LINKS,
    "website_ref_ext_links": WEBSITE_REF_EXT_LINKS,
    "next_urls": NEXT_URLS,
    "users": USERS,
}

# Column length limits of the store (VARCHAR(n)); checked by the integrity operator.
LENGTH_LIMITS = {
    ("websites", "url"): 2200,
    ("users", "username"): 50,
    ("users", "country_iso_a2"): 2,
    ("external_links", "url"): 2200,
    ("next_urls", "url"): 2200,
}


def empty_store(spark: SparkSession) -> dict[str, DataFrame]:
    """Reset: every store table empty, with its fixed schema."""
    return {name: spark.createDataFrame([], schema) for name, schema in STORE_SCHEMAS.items()}

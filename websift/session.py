"""Spark session helpers.

The session settings here are for local runs and tests.  On a cluster the
caller's session is used as is; only settings that are unset get a default.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  driver_memory: str = "8g", app: str = "websift") -> SparkSession:
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", driver_memory)
               # catalog folder for the bucketed lineage tables' metadata: scratch, not the working directory
               .config("spark.sql.warehouse.dir", os.path.join(os.environ.get("WEBSIFT_SCRATCH", "/tmp"),
                                                               "websift-warehouse")))
    for k, v in LOCAL_DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings the library's results depend on (UTC timestamps)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts.

    Reads ``spark.checkpoint.dir`` from the session (a cluster names a shared
    folder there).  Only when it is unset on a local master, as in tests, a
    scratch folder is created; a cluster without the setting is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = tempfile.mkdtemp(prefix="websift-ckpt-", dir=os.environ.get("WEBSIFT_SCRATCH", "/tmp"))
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def by_document(docs, key: str):
    """``docs`` with all rows of a key in one partition: counts per key and term then need no shuffle of their own, so
    the texts move once instead of a row for each of their terms."""
    return docs.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def materialize(df, *partition_cols: str, row_group_bytes: int | None = None):
    """Cut lineage: write ``df`` once as a Parquet table in a new folder under the
    shared checkpoint folder and read it back.

    One job (a reliable ``checkpoint()`` computes its plan twice), durable when
    executors are lost, and the read-back relation carries its real size, so
    the planner's broadcast decisions see measured bytes.  With
    ``partition_cols`` the rows are clustered by those keys in the files.
    ``row_group_bytes`` is what a writing task holds before it goes to its file.
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), "tables", uuid.uuid4().hex)
    if partition_cols:
        df = df.repartition(*partition_cols)
    (df.write.option("parquet.block.size", row_group_bytes) if row_group_bytes else df.write).parquet(path)
    return spark.read.parquet(path)


#: Most buckets of a bucketed table: each writing task makes a file for every bucket, so with a bucket for each shuffle
#: partition the files would grow with the square of these (600 by 600 at 6 GB).
BUCKETS = 64


def materialize_bucketed(df, key: str, buckets: int | None = None):
    """Lineage cut as a bucketed Parquet table (by ``key``) under the checkpoint folder.

    Reading it back gives a scan already hash-partitioned by ``key``, so a join
    on ``key`` shuffles only the other side, whatever its size."""
    spark = df.sparkSession
    if spark.conf.get("spark.sql.catalogImplementation", "in-memory") != "in-memory":
        return materialize(df, key)  # never register scratch tables in a shared metastore
    n = buckets or min(int(spark.conf.get("spark.sql.shuffle.partitions")), BUCKETS)
    name = f"websift_{uuid.uuid4().hex[:12]}"
    path = os.path.join(checkpoint_dir(spark), "tables", name)
    df.write.bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(name)
    return spark.table(name)

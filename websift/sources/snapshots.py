"""Versioned table snapshots (A5 full import, A7 upsert sink, A11 reset).

Parquet tables have no MERGE or DELETE, so every change writes a new version
folder ``<root>/<table>/v=<sequence>``.  The current version is the newest one
whose Spark job committed (``_SUCCESS`` present): the switch is atomic for
readers, a reader keeps the version it resolved, and a failed write never
becomes current.  Old versions beyond ``keep`` are removed.
"""

from __future__ import annotations

import os
import time

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir
from .tables import STORE_SCHEMAS


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str | None = None, keep: int = 3):
        self.spark = spark
        self.root = root or os.path.join(checkpoint_dir(spark), "store")
        self.keep = keep
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self, name: str) -> list[str]:
        p = self._Path(os.path.join(self.root, name))
        if not self._fs.exists(p):
            return []
        out = []
        for st in self._fs.listStatus(p):
            n = st.getPath().getName()
            if n.startswith("v=") and self._fs.exists(self._Path(st.getPath(), "_SUCCESS")):
                out.append(n)
        return sorted(out)

    def current(self, name: str) -> str | None:
        v = self._versions(name)
        return os.path.join(self.root, name, v[-1]) if v else None

    def write(self, name: str, df: DataFrame) -> str:
        """Write a new version; it becomes current when the job commits."""
        seq = f"v={time.time_ns():020d}"
        path = os.path.join(self.root, name, seq)
        df.write.parquet(path)
        for old in self._versions(name)[:-self.keep]:
            self._fs.delete(self._Path(os.path.join(self.root, name, old)), True)
        return path

    def read(self, name: str) -> DataFrame:
        path = self.current(name)
        if path is None:
            if name in STORE_SCHEMAS:
                return self.spark.createDataFrame([], STORE_SCHEMAS[name])
            raise FileNotFoundError(name)
        return self.spark.read.parquet(path)

    def reset(self, names=tuple(STORE_SCHEMAS)) -> None:
        """Every table empty (a new, empty version with its fixed schema)."""
        for n in names:
            self.write(n, self.spark.createDataFrame([], STORE_SCHEMAS[n]))

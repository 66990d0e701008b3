"""Continuous crawl frontier (T1, J4, U4, F18) as keyed state: which URLs wait to be fetched, which have been, and when.

One streaming query reads fetched pages.  Each page yields an event ``fetched`` for its own URL and ``found`` for every
link to another host; the state of a URL folds its events in time order:

* a found URL that was never fetched is queued, once, however often it is found;
* a fetched URL leaves the queue;
* a URL found again before ``interval`` has passed since its last fetch is not queued then; a timer queues it when
  the interval ends, unless it has been fetched meanwhile.  After the interval it is queued at once.

The actions (``enqueue``, ``drop``) are appended by Spark's file sink, so a repeated micro-batch adds nothing.  Event
time drives the timers: pages arrive in the order of their fetch times (later than all of earlier deliveries), a timer
fires when the watermark, the largest fetch time so far, has reached it, and an event at or after a timer's time sees
it as fired.  So the actions do not depend on how the pages are dealt to micro-batches.  A task holds the event times
of one URL and one micro-batch at a time.

Defined results: pages without URL or fetch time are left out; links without host, to the own host or with another
scheme than http(s) are not found; a page fetched without being queued (a seed) is only marked as fetched; of events
at one time the fetch comes first.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import html as H
from ..functions import urls as U

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ACTIONS = "url string, action string, at_ms long"
FETCHED, FOUND = 0, 1


class Visit:
    """State of one URL: when it was queued (None: it isn't), last fetched, and when a timer will queue it."""

    def __init__(self, queued: int | None = None, visited: int | None = None, due: int | None = None):
        self.queued, self.visited, self.due = queued, visited, due

    def fire(self, now: int) -> list[tuple[str, int]]:
        """The timer's action, if it has one by ``now``."""
        if self.due is None or self.due > now:
            return []
        self.queued, self.due = self.due, None
        return [("enqueue", self.queued)]

    def event(self, at: int, kind: int, interval_ms: int) -> list[tuple[str, int]]:
        out = self.fire(at)
        if kind == FETCHED:
            if self.queued is not None:
                out.append(("drop", at))
            self.queued, self.visited, self.due = None, at, None
        elif self.queued is None:
            if self.visited is None or at >= self.visited + interval_ms:
                self.queued, self.due = at, None
                out.append(("enqueue", at))
            else:
                self.due = self.visited + interval_ms
        return out


class FrontierProcessor(StatefulProcessor):
    def __init__(self, interval_ms: int):
        self.interval_ms = interval_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("visit", T.StructType([T.StructField(n, T.LongType()) for n in ("queued", "visited", "due")]))

    def _load(self) -> Visit:
        self.held = self.state.get() if self.state.exists() else None
        return Visit(*(None if x is None else int(x) for x in self.held)) if self.held is not None else Visit()

    def _save(self, v: Visit) -> None:
        now = (v.queued, v.visited, v.due)  # each call of the state is a message to the JVM, so none if it stays as it was
        if self.held is None or now != tuple(self.held):
            self.state.update(now)

    @staticmethod
    def _rows(url: str, actions: list[tuple[str, int]]) -> pd.DataFrame:
        return pd.DataFrame({"url": np.array([url] * len(actions), dtype=object), "action": np.array([a for a, _ in actions], dtype=object),
                             "at_ms": np.array([t for _, t in actions], dtype=np.int64)})

    def handleInputRows(self, key, rows, timerValues):
        seen = [f[["at_ms", "kind"]].to_numpy() for f in rows]
        events = np.unique(np.concatenate(seen), axis=0)  # by time, the fetch first
        v, actions = self._load(), []
        old = v.due
        for at, kind in events.tolist():
            actions += v.event(at, kind, self.interval_ms)
        if v.due != old:
            if old is not None:
                self.handle.deleteTimer(old)
            if v.due is not None:
                self.handle.registerTimer(v.due)
        self._save(v)
        if actions:
            yield self._rows(key[0], actions)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        v = self._load()
        actions = v.fire(expiredTimerInfo.getExpiryTimeInMs())
        self._save(v)
        if actions:
            yield self._rows(key[0], actions)

    def close(self) -> None:
        pass


def events(pages: DataFrame) -> DataFrame:
    """(url, ts, at_ms, kind) of fetched pages (url, html, fetched_at); no shuffle."""
    own = F.array(F.struct(F.col("url").alias("url"), F.lit(FETCHED).alias("kind")))
    links = F.filter(H.hrefs(F.col("html")), lambda h: h.rlike(r"(?i)^https?://") & U.host(h).isNotNull() & ~U.host(h).eqNullSafe(U.host(F.col("url"))))
    found = F.transform(links, lambda h: F.struct(h.alias("url"), F.lit(FOUND).alias("kind")))
    e = pages.where("url is not null and fetched_at is not null").select(
        F.col("fetched_at").alias("ts"), F.explode(F.concat(own, F.coalesce(found, F.slice(own, 1, 0)))).alias("e"))
    return e.select("e.url", "ts", F.unix_millis("ts").alias("at_ms"), F.col("e.kind").cast("long").alias("kind"))


def run_frontier(spark: SparkSession, source: str, schema, root: str, interval_seconds: float) -> DataFrame:
    """Fold all pages that have arrived in ``source`` into the frontier under ``root``; returns all actions so far.

    Call it again after further deliveries: the stream goes on from its checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    pages = spark.readStream.schema(schema).parquet(source)
    actions = events(pages).withWatermark("ts", "0 seconds").groupBy("url").transformWithStateInPandas(
        statefulProcessor=FrontierProcessor(int(interval_seconds * 1000)), outputStructType=ACTIONS, outputMode="Append", timeMode="EventTime")
    out = os.path.join(root, "actions")
    q = (actions.writeStream.format("parquet").option("path", out).option("checkpointLocation", os.path.join(root, "ckpt"))
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(ACTIONS).parquet(out)


def urls(actions: DataFrame) -> DataFrame:
    """(url, n_enqueued, n_dropped, last_enqueued_ms, queued) from the actions; queued: it waits to be fetched now."""
    def count(a: str):
        return F.count(F.when(F.col("action") == a, 1))
    return actions.groupBy("url").agg(count("enqueue").alias("n_enqueued"), count("drop").alias("n_dropped"),
                                      F.max(F.when(F.col("action") == "enqueue", F.col("at_ms"))).alias("last_enqueued_ms")) \
        .withColumn("queued", F.col("n_enqueued") > F.col("n_dropped"))

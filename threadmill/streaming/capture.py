"""Capture events as a stream: hook payloads from a spool folder, debounced per session, handed to an upsert.

A file-stream source reads each payload once (its checkpoint replaces the spool's deletes); a micro-batch keeps one event per
session; keyed state with a time to live drops what comes while a session has been handled a moment ago.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from threadmill.functions import patterns as P
from threadmill.sources.logs import get


def payloads(raw: DataFrame, text: str = "value") -> DataFrame:
    """session_id, path, event and trigger of hook payloads; what is no JSON object has nulls and the default event."""
    d = raw.withColumn("v", F.try_parse_json(text))
    names = F.create_map(*(F.lit(x) for kv in P.HOOK_EVENTS.items() for x in kv))
    event = F.coalesce(F.try_element_at(names, F.coalesce(get("v", "$.hook_event_name"), F.lit(""))), F.lit("change"))
    some = lambda p: F.when(F.trim(get("v", p)) != "", F.trim(get("v", p)))
    kept = [c for c in raw.columns if c != text]
    return d.select(*kept, get("v", "$.session_id").alias("session_id"), get("v", "$.transcript_path").alias("path"), event.alias("event"), F.coalesce(some("$.trigger"), some("$.reason"), some("$.source")).alias("trigger"))


def spool(spark: SparkSession, folder: str, max_age: str = "24h", clean: str = "delete") -> DataFrame:
    """The stream of payload files of a folder. Files that a finished batch has read are deleted by the source, those older than ``max_age``
    are never read."""
    reader = spark.readStream.format("text").option("wholetext", "true").option("cleanSource", clean).option("maxFileAge", max_age)
    return reader.load(folder)


def reap(spark: SparkSession, folder: str, hours: int = 24) -> int:
    """Delete payload files that have lain in the spool for so long, read or not; returns their number."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    before, gone = time.time() * 1000 - hours * 3_600_000, 0
    for f in fs.listStatus(path) if fs.exists(path) else []:
        if f.isFile() and f.getModificationTime() < before:
            gone += bool(fs.delete(f.getPath(), False))
    return gone


def debounce(events: DataFrame, key: str, ts: str, quiet_seconds: int = 600) -> DataFrame:
    """(key, ts) of events that come after ``quiet_seconds`` without one of their key; state of a silent key expires.

    ``events`` must have a watermark on ``ts``.
    """
    def step(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ts = pd.concat([p["ts"] for p in parts]).sort_values()
        known = pd.Timestamp(state.get[0], unit="us") if state.exists else pd.NaT
        # the latest event before each one, that of earlier batches included
        before = ts.shift(1).fillna(known).where(lambda x: ~(x < known), known)
        out = ts[before.isna() | ((ts - before).dt.total_seconds() > quiet_seconds)].tolist()
        last = max(x for x in (ts.iloc[-1], known) if x is not pd.NaT)
        state.update((int(last.value // 1000),))
        state.setTimeoutTimestamp(int(last.value // 1_000_000) + quiet_seconds * 1000 + 1)
        yield pd.DataFrame({"key": [k[0]] * len(out), "ts": out})

    kind = events.schema[key].dataType.simpleString()
    rows = events.select(F.col(key).alias("key"), F.col(ts).alias("ts"))
    return rows.groupBy("key").applyInPandasWithState(step, f"key {kind}, ts timestamp", "last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def run(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, sweep: Callable[[int], None] | None = None):
    """Start the capture query: each batch's sessions once to ``handle``; payloads without a path call ``sweep``. Stops when the spool is read."""

    def batch(df: DataFrame, n: int) -> None:
        p = payloads(df)
        one = p.where("path is not null").dropDuplicates(["session_id"])
        handle(one, n)
        if sweep and p.where("path is null").limit(1).count():
            sweep(n)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

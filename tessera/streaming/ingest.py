"""Structured Streaming: event facts into a store, windowed aggregation with late data, custom state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..model import FACTS

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "events*").parquet(folder)


def event_facts(events: DataFrame, topic: int = 3) -> DataFrame:
    """Two facts an event: who did what, and its value."""
    null = F.lit(None)
    fact = lambda s, p, kind, text, num: F.struct(F.lit(topic).alias("topic_id"), s.alias("subject"), F.lit(p).alias("predicate"), F.lit(kind).alias("o_kind"), text.alias("o_text"), num.alias("o_num"))
    user, event = F.concat(F.lit("user:"), F.col("user_id").cast("string")), F.concat(F.lit("event:"), F.col("event_id").cast("string"))
    both = F.array(fact(user, "did", "str", F.col("event_type"), null.cast("double")), fact(event, "value", "f64", F.col("value").cast("string"), F.col("value")))
    out = events.select("event_id", F.explode(both).alias("f")).where("f.o_text is not null")
    types = {f.name: f.dataType for f in FACTS.fields}
    return out.select("f.*", *[F.lit(0).cast(types[c]).alias(c) for c in ("entity_type", "semantic_hash", "flags")], F.col("event_id").alias("ingest_seq"))


def into_store(facts: DataFrame, store, checkpoint: str):
    """Every micro-batch is one commit of the store.  A batch replayed after a failure writes the same facts, a set."""

    def commit(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.refresh()
            store.update(lambda tx: tx.add_frame(batch, count=False))

    return facts.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, window: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums per window and type; events later than ``late`` behind the newest are dropped."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    agg = events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return agg.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    agg = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return agg.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def _running(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, total = state.get if state.exists else (0, 0.0)
    for f in frames:
        n, total = n + len(f), total + float(f["value"].sum())
    state.update((n, total))
    yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})


def running_totals(events: DataFrame, fn: Callable = _running) -> DataFrame:
    """Each user's count and sum so far, emitted whenever they change (state kept across batches)."""
    return events.groupBy("user_id").applyInPandasWithState(fn, "user_id bigint, n bigint, total double", "n bigint, total double", "update", GroupStateTimeout.NoTimeout)

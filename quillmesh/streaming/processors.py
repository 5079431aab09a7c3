"""Event-time processing: sessions, debounce and last-writer registers as stateful streams.

Nothing is dropped as late: no watermark closes a key. Replaying a merged ledger in batch gives the truth, a
stream is its accelerator, and the two agree on ordered input.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillmesh.sources.sinks import has_files
from quillmesh.operators.ledger import DEBOUNCE, SESSION_GAP


def infer_sessions(events: DataFrame, actor: str, gap: int = SESSION_GAP) -> DataFrame:
    """(actor, ordinal, session) of (actor, ordinal, seconds): a session goes on while gaps are at most ``gap``."""
    kind = events.schema[actor].dataType.simpleString()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, number = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["seconds", "ordinal"])
        out = []
        for ordinal, t in zip(rows["ordinal"], rows["seconds"]):
            if last is None or t - last > gap:
                number += 1
            last = t if last is None else max(last, t)
            out.append((key[0], int(ordinal), number))
        state.update((last, number))
        yield pd.DataFrame(out, columns=[actor, "ordinal", "session"])

    return events.select(actor, "ordinal", "seconds").groupBy(actor).applyInPandasWithState(step, f"{actor} {kind}, ordinal long, session long", "last double, number long", "append", GroupStateTimeout.NoTimeout)


def debounce(events: DataFrame, key: str, quiet: int = DEBOUNCE) -> DataFrame:
    """(key, ordinal, seconds) of the events that are ``quiet`` seconds after the last kept one of their key."""
    kind = events.schema[key].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["seconds", "ordinal"])
        out = []
        for ordinal, t in zip(rows["ordinal"], rows["seconds"]):
            if last is None or t - last >= quiet:
                last = float(t)
                out.append((k[0], int(ordinal), last))
        state.update((last,))
        yield pd.DataFrame(out, columns=[key, "ordinal", "seconds"])

    return events.select(key, "ordinal", "seconds").groupBy(key).applyInPandasWithState(step, f"{key} {kind}, ordinal long, seconds double", "last double", "append", GroupStateTimeout.NoTimeout)


def usage_counts(events: DataFrame) -> DataFrame:
    """Running (note, recurrence, recalls): built-in state, complete at any time."""
    return events.groupBy("note").agg(F.count_if(F.col("kind").isin("touch", "encode")).alias("recurrence"), F.count_if(F.col("kind") == "recall").alias("recalls"))


def idempotent_append(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Appends each identified event once, whatever is delivered again: batches are anti-joined with the ledger."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(["sync_id"])
        if has_files(spark, path):
            fresh = fresh.join(spark.read.parquet(path).select("sync_id"), "sync_id", "left_anti")
        fresh.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)

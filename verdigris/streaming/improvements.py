"""Scores against the one before them, as a stream: the latest score of each tag is state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "tag string, timestamp string, position long, score double, passed boolean, previous double, improvement double, push boolean"
STATE = "timestamp string, position long, score double"


def improvements(scores: DataFrame, threshold: float = 0.0) -> DataFrame:
    """``baselines.improvements`` of a stream (tag, timestamp, position, score, passed), tag by tag.

    A score is held against the latest one before it that has come: within a batch in the order of (timestamp, position),
    and in later batches against the state.  One that comes after a later one changes nothing and gives no row.  What is
    kept is three values for each tag; a batch of one tag is taken in parts, so no task holds more than a part.  A part
    need not be in order with others of its batch: batches bring each tag's scores in order, as an append-only history
    does, or rows that are late are left out.
    """

    def run(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, previous = (state.get[:2], state.get[2]) if state.exists else (None, None)
        for part in parts:
            rows = []
            for r in part.sort_values(["timestamp", "position"]).itertuples(index=False):
                if at is not None and (r.timestamp, r.position) <= tuple(at):
                    continue
                gain = None if previous is None else r.score - previous
                rows.append((key[0], r.timestamp, r.position, r.score, r.passed, previous, gain, bool(r.passed) if gain is None else gain > threshold))
                at, previous = (r.timestamp, r.position), r.score
            yield pd.DataFrame(rows, columns=["tag", "timestamp", "position", "score", "passed", "previous", "improvement", "push"]).astype({"previous": float, "improvement": float})
        if at is not None:
            state.update((*at, previous))

    rows = scores.where("score is not null and tag is not null and timestamp is not null").select("tag", "timestamp", "position", "score", "passed")
    return rows.groupBy("tag").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def run_improvements(scores: DataFrame, path: str, checkpoint: str, threshold: float = 0.0):
    """Starts the query into Parquet files, which hold each batch once, also after a restart."""
    return improvements(scores, threshold).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

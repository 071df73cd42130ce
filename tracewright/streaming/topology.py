"""The log as a stream: context by case, then clustering by activity, on one shared fold.

Rows wait in state until the watermark passes their time, and are then taken in
the order of (time, event), as a batch takes them; rows behind the watermark are
let go here, and kept by sinks.save_late(), which reads the same source.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import Params
from ..operators.clustering import RESULT, Clusters
from ..sources.logs import LOG, LogSchema, valid


def arrivals(stream: DataFrame, delay: str = "1 hour", s: LogSchema = LOG) -> DataFrame:
    """Valid events, each id once within the watermark."""
    return valid(stream, s).withWatermark(s.time, delay).dropDuplicatesWithinWatermark([s.event])


def _due(rows: list, state: GroupState, new: Iterator[pd.DataFrame], time: str, event: str) -> tuple[list[dict], list[dict]]:
    """Rows whose time the watermark has passed, in order, and those that wait."""
    for pdf in new:
        pdf = pdf.assign(**{time: pdf[time].astype("datetime64[us]").astype("int64")})
        rows = rows + json.loads(pdf.to_json(orient="records"))
    mark = state.getCurrentWatermarkMs() * 1000
    rows.sort(key=lambda r: (r[time], r[event]))
    return [r for r in rows if r[time] <= mark], [r for r in rows if r[time] > mark]


def _waits(state: GroupState, rows: list[dict], time: str) -> None:
    if rows:
        state.setTimeoutTimestamp(max(min(r[time] for r in rows) // 1000 + 1, state.getCurrentWatermarkMs() + 1))


def context_stream(events: DataFrame, s: LogSchema = LOG, size: int = 3, unknown: str = "UNKNOWN") -> DataFrame:
    """event, case, activity, time and p1 to p3; events: what arrivals() returns."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    out = f"{s.event} {kinds[s.event]}, {s.case} {kinds[s.case]}, {s.activity} string, {s.time} timestamp, p1 string, p2 string, p3 string"

    def run(key, new, state: GroupState):
        held = json.loads(state.get[0]) if state.exists else {"rows": [], "last": [unknown] * size}
        due, wait = _due(held["rows"], state, new, s.time, s.event)
        last, done = held["last"], []
        for r in due:
            done.append((r[s.event], key[0], r[s.activity], pd.Timestamp(r[s.time], unit="us"), *last))
            last = [*last[1:], r[s.activity]]
        state.update((json.dumps({"rows": wait, "last": last}),))
        _waits(state, wait, s.time)
        yield pd.DataFrame(done, columns=[s.event, s.case, s.activity, s.time, "p1", "p2", "p3"])

    slim = events.select(s.event, s.case, s.activity, s.time)
    return slim.groupBy(s.case).applyInPandasWithState(run, out, "held string", "append", GroupStateTimeout.EventTimeTimeout)


def refined_stream(events: DataFrame, params: Params = Params(), s: LogSchema = LOG) -> DataFrame:
    """event, activity, time and the fold's result; events: arrivals with vector."""
    kind = {f.name: f.dataType.simpleString() for f in events.schema}[s.event]
    out = f"{s.event} {kind}, {s.activity} string, {s.time} timestamp, {RESULT}"
    names = [x.split()[0] for x in out.split(", ")]

    def run(key, new, state: GroupState):
        held = json.loads(state.get[0]) if state.exists else {"rows": [], "state": None}
        if held["state"]:
            held["state"]["clusters"] = {int(k): v for k, v in held["state"]["clusters"].items()}
            held["state"]["ordinal"] = {int(k): v for k, v in held["state"]["ordinal"].items()}
        clusters = Clusters(params, held["state"])
        due, wait = _due(held["rows"], state, new, s.time, s.event)
        done = [(r[s.event], key[0], pd.Timestamp(r[s.time], unit="us"), *clusters.add(r["vector"], key[0])) for r in due]
        state.update((json.dumps({"rows": wait, "state": clusters.state()}),))
        _waits(state, wait, s.time)
        yield pd.DataFrame(done, columns=names)

    slim = events.select(s.event, s.activity, s.time, "vector")
    return slim.groupBy(s.activity).applyInPandasWithState(run, out, "held string", "append", GroupStateTimeout.EventTimeTimeout)


def drained(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over all that its source has now, into Parquet files."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()

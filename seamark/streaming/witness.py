"""The last time each statement was seen in a stream of logs, and the statements that weren't seen again for too long."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from seamark.operators import log_recovery

SCHEMA = "unit string, line long, event string, first_seen timestamp, last_seen timestamp, n long"
STATE = "first_seen timestamp, last_seen timestamp, n long"


def last_seen(log: DataFrame, shapes: DataFrame, late: str = "10 minutes", quiet: str = "1 day") -> DataFrame:
    """log(ts, action, sql_text), a stream, and shapes(unit, line, shape) -> a row for each change: event is seen or quiet.

    State is one row for each (unit, line) seen within `quiet`, whatever the length of the stream; when the watermark passes that,
    a quiet row is told and the state goes. Rows that come after a batch whose start the watermark had already let pass them are dropped; others count, in any order.
    """
    seen = log_recovery.sighted(log.withWatermark("ts", late), shapes).select("unit", F.col("line").cast("long").alias("line"), "ts")
    wait = int(pd.Timedelta(quiet).total_seconds() * 1000)

    def told(key: tuple, event: str, state: tuple) -> pd.DataFrame:
        return pd.DataFrame([(*key, event, *state)], columns=["unit", "line", "event", "first_seen", "last_seen", "n"])

    def each(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            yield told(key, "quiet", state.get)
            state.remove()
            return
        times = pd.concat([r["ts"] for r in rows])
        first, last, n = state.get if state.exists else (times.min(), times.max(), 0)
        new = (min(pd.Timestamp(first), times.min()), max(pd.Timestamp(last), times.max()), int(n) + len(times))
        state.update(new)
        # A time-out has to lie ahead of the watermark, which has passed rows that come late.
        state.setTimeoutTimestamp(max(int(new[1].timestamp() * 1000) + wait, state.getCurrentWatermarkMs() + 1))
        yield told(key, "seen", new)

    return seen.groupBy("unit", "line").applyInPandasWithState(each, SCHEMA, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def last_seen_batch(log: DataFrame, shapes: DataFrame) -> DataFrame:
    """What the stream's last seen row of each (unit, line) says when no row is too late and none goes quiet: unit, line, first_seen, last_seen, n."""
    seen = log_recovery.sighted(log, shapes)
    return seen.groupBy("unit", F.col("line").cast("long").alias("line")).agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("n"))

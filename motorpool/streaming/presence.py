"""The last reading of every vehicle, kept as stream state: changes between readings, and vehicles gone silent."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

READING, SILENT = "reading", "silent"
_STATE = "times array<long>, ids array<string>, miles array<long>, last_time long, last_miles long, told boolean"
_OUT = "vehicle_id {kind}, what string, event_id string, at long, miles long, previous_miles long"


def _step(silence: int):
    """Takes over the readings of one vehicle, and puts out those the watermark has passed, in the order of time."""

    def run(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, ids, miles, last_time, last_miles, told = state.get if state.exists else ([], [], [], None, None, False)
        pending = list(zip(times, ids, miles))
        for frame in () if state.hasTimedOut else frames:
            values = frame["_miles"].astype("Int64")
            pending += [(int(t), i, None if pd.isna(m) else int(m)) for t, i, m in zip(frame["_time"], frame["_id"], values)]
        pending.sort(key=lambda p: (p[0], p[1]))
        passed = state.getCurrentWatermarkMs() * 1000
        found: list[tuple] = []

        def tell_silence(until: int) -> None:
            nonlocal told
            if last_time is not None and not told and until - last_time > silence:
                found.append((SILENT, None, last_time + silence, last_miles, None))
                told = True

        done = 0
        while done < len(pending) and pending[done][0] <= passed:
            time, event, value = pending[done]
            tell_silence(time)
            found.append((READING, event, time, value, last_miles))
            last_time, last_miles, told = time, value, False
            done += 1
        tell_silence(passed)
        pending = pending[done:]
        columns = [list(c) for c in zip(*pending)] if pending else [[], [], []]
        state.update((*columns, last_time, last_miles, told))
        # Woken up when the watermark passes the next reading, or the moment from which the vehicle is silent.
        wake = [pending[0][0]] if pending else []
        if last_time is not None and not told:
            wake.append(last_time + silence)
        if wake:
            state.setTimeoutTimestamp(max(min(wake), passed) // 1000 + 1)
        if found:
            frame = pd.DataFrame(found, columns=["what", "event_id", "at", "miles", "previous_miles"])
            frame = frame.astype({c: "Int64" for c in ("at", "miles", "previous_miles")})
            frame.insert(0, "vehicle_id", key[0])
            yield frame

    return run


def presence(events: DataFrame, silence_minutes: int = 240, delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Per vehicle: every reading with the odometer of the one before, and a row when it has been silent for so long.

    ``what`` is "reading" or "silent", ``at`` the time of the reading or the moment silence is noticed. Readings come
    out once the watermark (``delay`` behind the newest event) has passed them, in order, so neither the split into
    micro-batches nor a restart changes them; readings of equal time go by event id. State per vehicle is its last
    reading and those the watermark has not passed. Readings without a vehicle or time are left out, and so are events
    later than ``delay``.
    """
    kind = events.schema["vehicle_id"].dataType.simpleString()
    zoned = events.schema[ts].dataType
    rows = events.where(F.col("vehicle_id").isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, delay)
    narrow = rows.select(
        "vehicle_id", ts, F.unix_micros(F.col(ts).cast("timestamp")).alias("_time"),
        F.col("event_id").cast("string").alias("_id"), F.col("odometer_miles").cast("long").alias("_miles"),
    )
    out = narrow.groupBy("vehicle_id").applyInPandasWithState(
        _step(silence_minutes * 60_000_000), _OUT.format(kind=kind), _STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
    return out.select(
        "vehicle_id", "what", "event_id", F.timestamp_micros("at").cast(zoned).alias("at"), "miles", "previous_miles",
        (F.col("miles") - F.col("previous_miles")).alias("miles_change"),
    )

"""Streams: k least values so far, windows around grid times, and state carried from step to step."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import ship

#: A row that waits in the state, 24 bytes, and how many rows are handed on at once.
ROW, PIECE = np.dtype([("time", "<i8"), ("tie", "<i8"), ("value", "<f8")]), 100_000


def k_least(stream: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """(key, least): after each batch, the k least values that each key has had. The state is k numbers a key."""
    ship(stream.sparkSession)
    kind = stream.schema[key].dataType.simpleString()

    def update(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        for f in frames:
            kept = sorted(kept + f[value].dropna().tolist())[:k]
        state.update((kept,))
        yield pd.DataFrame({"key": [keys[0]], "least": [kept]})

    return stream.select(F.col(key), F.col(value).cast("double")).groupBy(key).applyInPandasWithState(update, f"key {kind}, least array<double>", "kept array<double>", "update", GroupStateTimeout.NoTimeout)


def around_grid(stream: DataFrame, time: str, value: str, step: str, half: str, late: str, least: int = 1) -> DataFrame:
    """Count and mean of values within half a window of each grid time; windows overlap. Rows later than `late` are dropped,
    and windows of fewer than `least` rows are left out."""
    t = F.window(time, f"{2 * int(half.split()[0])} {half.split()[1]}", step)
    return stream.withWatermark(time, late).groupBy(t.alias("w")).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).where(F.col("n") >= least).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean")


def sessions(stream: DataFrame, time: str, key: str, gap: str, late: str) -> DataFrame:
    return stream.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def carried(stream: DataFrame, key: str, value: str, decay: float, order: list[str]) -> DataFrame:
    """(key, level): a recurrence level = decay * level + value over a key's rows, in the order of columns `order` within each batch.

    A batch's rows of a key are sorted in one task; rows that come in a later batch than they should follow those before. Null values are left out."""
    ship(stream.sparkSession)
    kind = stream.schema[key].dataType.simpleString()

    def update(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level = state.get[0] if state.exists else 0.0
        parts = [f[[*order, "_value"]].dropna(subset="_value") for f in frames]  # without the key, whose text is the most of a row
        rows = pd.concat(parts, ignore_index=True)
        del parts
        plain = all(rows[c].dtype.kind in "iufM" for c in order)
        values = rows["_value"].to_numpy()[np.lexsort([rows[c].to_numpy() for c in reversed(order)])] if plain else rows.sort_values(order)["_value"].to_numpy()
        del rows
        for at in range(0, len(values), PIECE):
            for v in values[at : at + PIECE].tolist():
                level = decay * level + v
        state.update((level,))
        yield pd.DataFrame({"key": [keys[0]], "level": [level]})

    rows = stream.select(F.col(key), F.col(value).cast("double").alias("_value"), *order)
    return rows.groupBy(key).applyInPandasWithState(update, f"key {kind}, level double", "level double", "update", GroupStateTimeout.NoTimeout)


def in_time_order(stream: DataFrame, key: str, time: str, value: str, decay: float, late: str, tie: str) -> DataFrame:
    """(key, time, level, n): a recurrence level = decay * level + value over a key's rows in the order of `time`, then `tie` (a whole number), whatever the order in
    which they come; one row for each, and n counts them from 1.

    Rows wait in the key's state until the watermark, `late` behind the latest time seen, is past them, and are then carried in order; an event-time timer wakes a
    key that has no new rows. What a key holds is its rows of the time `late`, 24 bytes each. Rows that come later than that are dropped, as are those with a null time or value.
    Rows newer than the last watermark wait for more of the stream.
    """
    ship(stream.sparkSession)
    kind = stream.schema[key].dataType.simpleString()

    def update(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, level, n = state.get if state.exists else (b"", 0.0, 0)
        parts = [np.frombuffer(held, dtype=ROW)]
        for f in frames:
            f = f.dropna(subset=["_time", "_value"])
            part = np.empty(len(f), dtype=ROW)
            part["time"], part["tie"], part["value"] = f["_time"].to_numpy("datetime64[us]").astype("int64"), f["_tie"].to_numpy(), f["_value"].to_numpy()
            parts.append(part)
        rows = np.concatenate(parts)
        del parts
        rows = rows[np.lexsort((rows["value"], rows["tie"], rows["time"]))]
        mark = state.getCurrentWatermarkMs()
        past = int(np.searchsorted(rows["time"], mark * 1000))
        ready, rows = rows[:past], rows[past:]
        levels = []
        for at in range(0, past, PIECE):
            found = []
            for v in ready["value"][at : at + PIECE].tolist():
                level = decay * level + v
                found.append(level)
            levels.append(np.array(found))
        state.update((rows.tobytes(), level, n + past))
        if len(rows):
            state.setTimeoutTimestamp(max(int(rows["time"][0]) // 1000, mark + 1))
        for k, found in enumerate(levels):
            at = k * PIECE
            yield pd.DataFrame({"key": [keys[0]] * len(found), "time": ready["time"][at : at + len(found)].astype("datetime64[us]"), "level": found, "n": n + 1 + at + np.arange(len(found))})

    rows = stream.withWatermark(time, late).select(F.col(key), F.col(time).alias("_time"), F.col(tie).cast("long").alias("_tie"), F.col(value).cast("double").alias("_value"))
    return rows.groupBy(key).applyInPandasWithState(update, f"key {kind}, time timestamp, level double, n long", "held binary, level double, n long", "append", GroupStateTimeout.EventTimeTimeout)

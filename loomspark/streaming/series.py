"""Lags and rolling windows over streams, as a table of the same rows would have them.

Each series keeps its last values and the rows that may still be preceded by others: a row is given out once the watermark has passed it, in the order
of time and id, so rows may come in any order within the delay. Rows behind the watermark are dropped. What a series keeps is bounded by its
widest window and the rows of one delay; it is forgotten when nothing came for `expire`.
"""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..shipping import ship


def _statistics(seen: list, lags, windows) -> list:
    """The row's lags and its rolling mean, deviation, least and greatest value, nulls left out; seen ends in the row's own value."""
    out = [seen[-1 - k] if len(seen) > k else None for k in lags]
    for n in windows:
        x = [v for v in seen[-n:] if v is not None]
        mean = math.fsum(x) / len(x) if x else None
        std = math.sqrt(math.fsum((v - mean) ** 2 for v in x) / (len(x) - 1)) if len(x) > 1 else 0.0
        out += [mean, std, min(x, default=None), max(x, default=None)]
    return out


def series_features(stream: DataFrame, key: str, time: str, id_col: str, value: str, delay: str = "10 minutes", lags=(1, 2, 3), windows=(3, 7), expire: int = 86_400_000) -> DataFrame:
    """(key, id, {x}_lag_{k}, {x}_rolling_{mean,std,min,max}_{w}) of each row of a stream; expire: milliseconds of event time. Keys and ids are whole numbers or texts."""
    ship(stream.sparkSession)
    kinds = dict(stream.dtypes)
    names = [f"{value}_lag_{k}" for k in lags] + [f"{value}_rolling_{s}_{n}" for n in windows for s in ("mean", "std", "min", "max")]
    out = f"`{key}` {kinds[key]}, `{id_col}` {kinds[id_col]}, " + ", ".join(f"`{n}` double" for n in names)
    width = max([1, *(k + 1 for k in lags), *windows])

    def run(group, frames, state: GroupState):
        seen, waiting = json.loads(state.get[0]) if state.exists else ([], [])
        for pdf in frames:
            known = pdf["_value"].notna()
            waiting += [[int(t), i, float(v) if k else None] for t, i, v, k in zip(pdf["_us"], pdf["_id"].tolist(), pdf["_value"], known, strict=True)]
        passed, rows = state.getCurrentWatermarkMs(), []
        waiting.sort(key=lambda r: (r[0], r[1]))
        ready = [r for r in waiting if r[0] // 1000 <= passed]
        for _, i, v in ready:
            seen = [*seen, v][-width:]
            rows.append([group[0], i, *_statistics(seen, lags, windows)])
        waiting = waiting[len(ready) :]
        if waiting:
            state.update((json.dumps([seen, waiting]),))
            state.setTimeoutTimestamp(max(passed, waiting[0][0] // 1000) + 1)
        elif state.hasTimedOut and not ready:
            state.remove()
        else:
            state.update((json.dumps([seen, waiting]),))
            state.setTimeoutTimestamp(max(passed, 0) + expire)
        if rows:
            yield pd.DataFrame(rows, columns=[key, id_col, *names]).astype(dict.fromkeys(names, "float64"))

    own = stream.select(F.col(key), F.col(time).cast("timestamp").alias("_time"), F.col(id_col).alias("_id"), F.col(value).cast("double").alias("_value")).where("_time is not null")
    marked = own.withWatermark("_time", delay).withColumn("_us", F.unix_micros("_time"))
    done = marked.groupBy(key).applyInPandasWithState(run, out, "kept string", "append", GroupStateTimeout.EventTimeTimeout)
    return done.select(key, id_col, *[F.when(~F.isnan(n), F.col(n)).alias(n) for n in names])

"""The rate meter on a stream of events: five numbers of state for each job."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.progress import Meter

STATE = "last_at long, last_bytes long, rate double, seen long, moved_at long"
OUT = "job string, seq long, bytes long, elapsed_ns long, rate double, stalled_ns long"


def metered(events: DataFrame) -> DataFrame:
    """events (job, seq, bytes, elapsed_ns) with rate and stalled_ns. Events of a job that come in one trigger are taken by seq."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        meter = Meter(*state.get) if state.exists else Meter()
        rows = pd.concat(list(batches)).sort_values("seq")
        got = [meter.observe(int(b), int(e)) for b, e in zip(rows["bytes"], rows["elapsed_ns"], strict=True)]
        state.update(meter.state)
        yield pd.DataFrame({"job": key[0], "seq": rows["seq"].to_numpy(), "bytes": rows["bytes"].to_numpy(), "elapsed_ns": rows["elapsed_ns"].to_numpy(), "rate": [g[0] for g in got], "stalled_ns": [g[1] for g in got]})

    return events.select("job", "seq", "bytes", "elapsed_ns").groupBy("job").applyInPandasWithState(fold, OUT, STATE, "append", GroupStateTimeout.NoTimeout)

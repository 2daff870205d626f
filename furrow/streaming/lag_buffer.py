"""Lag correction on a stream: a value meets the place that was logged `steps` rows earlier by the same machine.

State is the rows of a machine that still wait for their value, `steps` at most, so it is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "machine string, seq long, x double, y double, v double"
STATE = "seq array<long>, x array<double>, y array<double>"


def aligned(stream: DataFrame, steps: int) -> DataFrame:
    """stream (machine, seq, x, y, v), in order within a machine: rows (machine, seq, x, y, v) with v taken from `steps` rows later."""
    if steps < 0:
        raise ValueError("a stream can't wait for the past: steps must not be negative")

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("seq")
        seq, xs, ys = (list(a) for a in state.get) if state.exists else ([], [], [])
        out = []
        for r in rows.itertuples(index=False):
            seq.append(int(r.seq))
            xs.append(float(r.x))
            ys.append(float(r.y))
            if len(seq) > steps:
                out.append((key[0], seq.pop(0), xs.pop(0), ys.pop(0), float(r.v)))
        state.update((seq, xs, ys))
        yield pd.DataFrame(out, columns=["machine", "seq", "x", "y", "v"])

    return stream.groupBy("machine").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)

"""Extension: an online rolling minimum-variance portfolio over a stream of daily return vectors.

Days arrive as rows (stream string, t long, r array<double>), in order within a stream. State is the last ``lookback`` vectors
and the current weights; a day's output is its return at the weights set before it. The batch study has no
streaming counterpart: this restates one backtest for arriving data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions import kernels

STATE = "seen long, window array<double>, n int, w array<double>"
OUTPUT = "stream string, t long, port_ret double"


def online_backtest(days: DataFrame, lookback: int = 63, every: int = 21, estimator: str = "sample") -> DataFrame:
    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen, window, n, w = state.get if state.exists else (0, [], 0, [])
        rows = pd.concat(list(batches)).sort_values("t")
        held = [np.array(window[i * n : (i + 1) * n]) for i in range(len(window) // n)] if n else []
        out = []
        for t, r in zip(rows["t"], rows["r"]):
            r = np.asarray(r, float)
            n = len(r)
            if seen >= lookback:
                if (seen - lookback) % every == 0:
                    w = kernels.min_variance(kernels.ESTIMATORS[estimator](np.stack(held)[None]))[0]
                out.append((key[0], int(t), float(np.asarray(w) @ (np.exp(r) - 1))))
            held = [*held, r][-lookback:]
            seen += 1
        state.update((seen, np.concatenate(held).tolist() if held else [], n, list(map(float, w))))
        yield pd.DataFrame(out, columns=["stream", "t", "port_ret"])

    return days.groupBy("stream").applyInPandasWithState(step, OUTPUT, STATE, "append", "NoTimeout")

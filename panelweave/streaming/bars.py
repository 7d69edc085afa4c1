"""Streams: bars of trades by event time, and rolling means of an instrument's latest bars.

Batch results come from the compiler; this is for feeds. Late rows beyond the watermark are dropped
by Spark, as for any windowed aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_bars(trades: DataFrame, *, time: str, key: str, price: str, size: str, width: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """date, inst, open, high, low, close, vwap, volume of each window of event time; final once the watermark has passed it."""
    p, order = F.col(price), F.struct(F.col(time), F.col(price))
    rows = trades.withWatermark(time, lateness).groupBy(F.window(time, width).alias("w"), F.col(key).cast("string").alias("inst"))
    bars = rows.agg(
        F.min_by(p, order).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, order).alias("close"),
        F.try_divide(F.sum(p * F.col(size)), F.sum(size)).alias("vwap"), F.sum(size).alias("volume"),
    )
    return bars.select(F.col("w.start").alias("date"), "inst", "open", "high", "low", "close", "vwap", "volume")


def stream_rolling_mean(bars: DataFrame, d: int, value: str = "close") -> DataFrame:
    """inst, date, mean of the last d bars in order of arrival, for windows with ceil(0.8 d) present values.

    The state of an instrument is its last d values, whatever the length of the stream.
    """
    least = -(-8 * d // 10)

    def step(key: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        last = list(state.get[0]) if state.exists else []
        out = []
        for pdf in batches:
            for row in pdf.sort_values("date").itertuples(index=False):
                v = getattr(row, value)
                last = [*last, None if pd.isna(v) else float(v)][-d:]
                present = [x for x in last if x is not None]
                if len(last) == d and len(present) >= least:
                    out.append((key[0], row.date, sum(present) / len(present)))
        state.update((last,))
        yield pd.DataFrame(out, columns=["inst", "date", "mean"])

    rows = bars.select("inst", "date", F.col(value).cast("double").alias(value))
    return rows.groupBy("inst").applyInPandasWithState(step, "inst string, date timestamp, mean double", "last array<double>", "append", GroupStateTimeout.NoTimeout)

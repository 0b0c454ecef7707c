"""Candles and signals from a stream of ticks, with watermarks and keyed state."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.atc import KINDS, Config
from ..operators.trend_state import TrendState


def ticks(spark: SparkSession, path: str, schema, per_trigger: int = 1) -> DataFrame:
    """A file stream, so many files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def candle_stream(t: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling candles from (symbol, ts, price, id); ticks later than the watermark are dropped, replayed ids too."""
    t = t.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])
    at = F.struct("ts", "id")
    g = t.groupBy(F.window("ts", every), "symbol").agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
    return g.select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def sliding_volatility(t: DataFrame, width: str = "4 hours", step: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    g = t.withWatermark("ts", late).groupBy(F.window("ts", width, step), "symbol").agg(F.stddev_samp("price").alias("volatility"), F.count(F.lit(1)).alias("n"))
    return g.select("symbol", F.col("window.start").alias("ts"), "volatility", "n")


def sessions(t: DataFrame, gap: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """Spans of activity that end with a gap."""
    g = t.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "symbol").agg(F.count(F.lit(1)).alias("n"))
    return g.select("symbol", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def ema_cross(closes: DataFrame, fast: int = 12, slow: int = 26) -> DataFrame:
    """(symbol, ts, close, fast, slow, signal) bar by bar, with a symbol's two means as keyed state.

    The recursion is that of the batch fold with the first close as start, so a stream and a batch over the same bars agree.
    """

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        a, b = state.get if state.exists else (None, None)
        bars = pd.concat(list(frames)).sort_values("ts")
        rows = []
        for ts, close in zip(bars["ts"], bars["close"], strict=True):
            a = close if a is None else a + 2 / (fast + 1) * (close - a)
            b = close if b is None else b + 2 / (slow + 1) * (close - b)
            rows.append((key[0], ts, close, a, b, 1 if a > b else -1 if a < b else 0))
        state.update((a, b))
        yield pd.DataFrame(rows, columns=["symbol", "ts", "close", "fast", "slow", "signal"])

    out = "symbol string, ts timestamp, close double, fast double, slow double, signal int"
    return closes.groupBy("symbol").applyInPandasWithState(step, out, "a double, b double", "append", "NoTimeout")


def trend_state(bars: DataFrame, cfg: Config | None = None) -> DataFrame:
    """(symbol, ts, close, <kind> ..., average): the trend classification of a stream of bars, with keyed state a symbol.

    ``bars`` has symbol, ts, close and command: null or "bar" for a bar; "reset" forgets a symbol, which starts anew with its next
    bar; "remove" makes its bars be left out until "add". The rows of a symbol in one batch are taken by time, commands before
    bars of the same time. A stream and the batch classification of the same bars agree.
    """
    cfg = cfg or Config()

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        active, numbers = state.get if state.exists else (True, [])
        trend = TrendState.unpack(numbers, cfg) if numbers else TrendState(cfg)
        rows = pd.concat(list(frames))
        rows["command"] = rows["command"].fillna("bar")
        rows = rows.assign(late=rows["command"] == "bar").sort_values(["ts", "late"], kind="stable")
        out = []
        for ts, close, command in zip(rows["ts"], rows["close"], rows["command"], strict=True):
            if command != "bar":
                active = command != "remove" if command in ("add", "remove") else active
                trend = TrendState(cfg)
            elif active:
                layers, final = trend.update(float(close))
                out.append((key[0], ts, close, *(None if math.isnan(x) else float(x) for x in layers), final))
        state.update((active, trend.pack()))
        yield pd.DataFrame(out, columns=["symbol", "ts", "close", *KINDS, "average"])

    schema = "symbol string, ts timestamp, close double, " + ", ".join(f"{k} double" for k in KINDS) + ", average double"
    return bars.groupBy("symbol").applyInPandasWithState(step, schema, "active boolean, numbers array<double>", "append", "NoTimeout")


def streaming_centers(values: DataFrame, lookback: int = 100, low: float = 5, high: float = 95, adaptive: bool = False) -> DataFrame:
    """(symbol, ts, low, mid, high): the clustering centres of a stream of (symbol, ts, value), with the window as keyed state.

    Unknown and infinite values repeat the last centres (null before the first). ``adaptive`` moves the percentiles outwards by twice what
    the window's variation is over its slow running mean, within 1 to 20 and 80 to 99.
    """

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        window, usual = state.get if state.exists else ([], 0.0)
        window, out = list(window), []
        for r in pd.concat(list(frames)).sort_values("ts").itertuples():
            if r.value is not None and math.isfinite(r.value):
                window = [*window, float(r.value)][-lookback:]
                usual, centers = _centers(window, usual, low, high, adaptive)
            else:
                centers = _centers(window, usual, low, high, adaptive)[1] if window else (None, None, None)
            out.append((key[0], r.ts, *centers))
        state.update((window, usual))
        yield pd.DataFrame(out, columns=["symbol", "ts", "low", "mid", "high"])

    return values.groupBy("symbol").applyInPandasWithState(step, "symbol string, ts timestamp, low double, mid double, high double", "window array<double>, usual double", "append", "NoTimeout")


def _centers(window: list[float], usual: float, low: float, high: float, adaptive: bool) -> tuple[float, tuple[float, float, float]]:
    """(running variation, centres) of a window."""
    ordered, n = sorted(window), len(window)
    mid = sum(window) / n
    if adaptive and n > 1 and abs(mid) > 1e-9:
        now = (sum((v - mid) ** 2 for v in window) / n) ** 0.5 / abs(mid)
        usual = now if usual == 0 else 0.01 * now + 0.99 * usual
        low, high = max(1.0, min(20.0, low - 2 * (now - usual))), max(80.0, min(99.0, high + 2 * (now - usual)))
    at = lambda p: ordered[int((n - 1) * p / 100)]
    return usual, ((at(low) + mid) / 2, mid, (at(high) + mid) / 2)


def with_higher(bars: DataFrame, hours: int = 24) -> DataFrame:
    """(symbol, ts, close, higher_close, higher_ts): each bar of a stream with the last complete candle of a longer timeframe.

    The state holds the candle in the making and the last complete one; a bar of a new period completes the one before.
    """
    width = hours * 3600

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        period, close, done, done_close = state.get if state.exists else (None, None, None, None)
        out = []
        for r in pd.concat(list(frames)).sort_values("ts").itertuples():
            now = int(r.ts.timestamp()) // width
            if period is not None and now > period:
                done, done_close = period, close
            period, close = now, float(r.close)
            out.append((key[0], r.ts, close, done_close, None if done is None else pd.Timestamp(done * width, unit="s")))
        state.update((period, close, done, done_close))
        yield pd.DataFrame(out, columns=["symbol", "ts", "close", "higher_close", "higher_ts"])

    return bars.groupBy("symbol").applyInPandasWithState(step, "symbol string, ts timestamp, close double, higher_close double, higher_ts timestamp", "period long, close double, done long, done_close double", "append", "NoTimeout")


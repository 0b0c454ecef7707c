"""Back-tests: one position at a time, as a fold over a symbol's bars; and the sizes that follow."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.windows import W, fold

_D, _I = "cast(null AS double)", "cast(null AS int)"


def trades(df: DataFrame, side: str = "LONG", stop: float = 0.02, target: float = 0.04, trailing: float = 0.015, max_hold: int = 20) -> DataFrame:
    """Closed trades from candles with ``signal``: exits first (stop, target, trailing, age), then the entry at the close.

    A bar with an exit has no entry. The trailing stop exists only after a better close than any since the entry.
    What is open at the end is closed at the last price.
    """
    d = 1 if side == "LONG" else -1
    long = d == 1
    stop_px, target_px = f"s.px * {1 - d * stop!r}D", f"s.px * {1 + d * target!r}D"
    hit_stop = f"x.low <= {stop_px}" if long else f"x.high >= {stop_px}"
    hit_target = f"x.high >= {target_px}" if long else f"x.low <= {target_px}"
    hit_trail = "s.trail IS NOT NULL AND x.close <= s.trail" if long else "s.trail IS NOT NULL AND x.close >= s.trail"
    reason = f"CASE WHEN s.i0 IS NULL THEN null WHEN {hit_stop} THEN 'STOP_LOSS' WHEN {hit_target} THEN 'TAKE_PROFIT' WHEN {hit_trail} THEN 'TRAILING_STOP' WHEN x.i - s.i0 >= {max_hold} THEN 'MAX_HOLD' WHEN x.final THEN 'END_OF_DATA' END"
    price = f"CASE WHEN s.i0 IS NULL THEN null WHEN {hit_stop} THEN {stop_px} WHEN {hit_target} THEN {target_px} WHEN {hit_trail} THEN s.trail ELSE x.close END"
    better = "x.close > s.best" if long else "x.close < s.best"
    enters = f"s.i0 IS NULL AND coalesce(x.signal, 0) {'>' if long else '<'} 0"
    # the state after a bar that closes a trade is flat; the closed trade is shown by that bar's state
    step = f"""CASE WHEN ({reason}) IS NOT NULL THEN struct({_I} AS i0, {_D} AS px, {_D} AS best, {_D} AS trail, s.i0 AS e0, s.px AS epx, {reason} AS why, {price} AS out)
        WHEN {enters} AND x.final THEN struct({_I} AS i0, {_D} AS px, {_D} AS best, {_D} AS trail, x.i AS e0, x.close AS epx, 'END_OF_DATA' AS why, x.close AS out)
        WHEN {enters} THEN struct(x.i AS i0, x.close AS px, x.close AS best, {_D} AS trail, {_I} AS e0, {_D} AS epx, cast(null AS string) AS why, {_D} AS out)
        WHEN s.i0 IS NOT NULL AND {better} THEN struct(s.i0 AS i0, s.px AS px, x.close AS best, x.close * {1 - d * trailing!r}D AS trail, {_I} AS e0, {_D} AS epx, cast(null AS string) AS why, {_D} AS out)
        ELSE struct(s.i0 AS i0, s.px AS px, s.best AS best, s.trail AS trail, {_I} AS e0, {_D} AS epx, cast(null AS string) AS why, {_D} AS out) END"""
    init = f"struct({_I} AS i0, {_D} AS px, {_D} AS best, {_D} AS trail, {_I} AS e0, {_D} AS epx, cast(null AS string) AS why, {_D} AS out)"
    t = df.withColumns({"final": F.lead("ts").over(W()).isNull(), "i": F.row_number().over(W()) - 1})
    t = fold(t, ["high", "low", "close", "signal", "final"], init, step, {"e0": "s.e0", "epx": "s.epx", "why": "s.why", "out": "s.out"}, ["ts", "i", "high", "low", "close", "signal", "final"])
    pnl = d * F.try_divide(F.col("out") - F.col("epx"), F.col("epx"))
    return t.where("why IS NOT NULL").select("symbol", F.col("e0").alias("entry_index"), F.col("i").alias("exit_index"), F.col("epx").alias("entry_price"), F.col("out").alias("exit_price"), F.col("ts").alias("exit_time"), F.lit(side).alias("signal_type"), F.col("why").alias("exit_reason"), pnl.alias("pnl"), (F.col("i") - F.col("e0")).alias("hold_periods"))


def equity(df: DataFrame, closed: DataFrame, capital: float = 10_000.0, risk: float = 0.01) -> DataFrame:
    """(symbol, ts, equity): the capital after the trades closed up to each bar, each moving it by risk times its profit.

    A running product, as a sum of logarithms.
    """
    factors = closed.groupBy("symbol", F.col("exit_time").alias("ts")).agg(F.sum(F.log1p(risk * F.col("pnl"))).alias("g"))
    t = df.select("symbol", "ts").join(factors, ["symbol", "ts"], "left")
    return t.select("symbol", "ts", (capital * F.exp(F.sum(F.coalesce("g", F.lit(0.0))).over(W().rowsBetween(Window.unboundedPreceding, 0)))).alias("equity"))


def metrics(closed: DataFrame, curve: DataFrame, per_year: int = 8760) -> DataFrame:
    """Per symbol: trades, win rate, mean win and loss, profit factor, total return, Sharpe, drawdown in percent of the highest peak.

    Symbols without trades have zeros.
    """
    win, loss = F.col("pnl") > 0, F.col("pnl") < 0
    g = closed.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("num_trades"), (F.count_if(win) / F.count(F.lit(1))).alias("win_rate"), F.coalesce(F.avg(F.when(win, F.col("pnl"))), F.lit(0.0)).alias("avg_win"), F.coalesce(-F.avg(F.when(loss, F.col("pnl"))), F.lit(0.0)).alias("avg_loss"),
        F.coalesce(F.sum(F.when(win, F.col("pnl"))), F.lit(0.0)).alias("gain"), F.coalesce(-F.sum(F.when(loss, F.col("pnl"))), F.lit(0.0)).alias("lost"),
    )
    c = curve.withColumns({"peak": F.max("equity").over(W().rowsBetween(Window.unboundedPreceding, 0)), "r": F.try_divide(F.col("equity"), F.lag("equity").over(W())) - 1})
    e = c.groupBy("symbol").agg(
        (F.try_divide(F.max_by("equity", "ts"), F.min_by("equity", "ts")) - 1).alias("total_return"), F.coalesce(F.try_divide(F.avg("r"), F.stddev_samp("r")) * per_year**0.5, F.lit(0.0)).alias("sharpe"), (F.try_divide(F.min(F.col("equity") - F.col("peak")), F.max("equity")) * 100).alias("max_drawdown"),
    )
    j = e.join(g, "symbol", "left")
    none = F.col("num_trades").isNull()
    zero = lambda c: F.when(none, 0.0).otherwise(F.col(c)).alias(c)
    factor = F.when(none, 0.0).when(F.col("lost") > 0, F.col("gain") / F.col("lost")).otherwise(F.col("gain"))
    return j.select("symbol", F.coalesce("num_trades", F.lit(0)).alias("num_trades"), *map(zero, ("win_rate", "avg_win", "avg_loss", "total_return", "sharpe", "max_drawdown")), factor.alias("profit_factor"))


def beta_quantile(a: np.ndarray, b: np.ndarray, p: float) -> np.ndarray:
    """The p quantile of Beta(a, b) by bisection on the regularised incomplete beta function (continued fraction)."""
    from math import exp, lgamma, log

    def cdf(x: float, a: float, b: float) -> float:
        if x <= 0 or x >= 1:
            return float(x >= 1)
        if x > (a + 1) / (a + b + 2):
            return 1 - cdf(1 - x, b, a)
        front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
        c, d, h = 1.0, 1 / (1 - (a + b) * x / (a + 1)), 1 / (1 - (a + b) * x / (a + 1))
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 / (1 + num * d), 1 + num / c
                h *= c * d
            if abs(c * d - 1) < 1e-14:
                break
        return front * h

    out = []
    for x, y in zip(a, b, strict=True):
        lo, hi = 0.0, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if cdf(mid, x, y) < p else (lo, mid)
        out.append((lo + hi) / 2)
    return np.array(out)


def kelly(stats: DataFrame, confidence: float = 0.95, fraction: float = 0.25, prior: float = 2.0, min_trades: int = 10, min_win_rate: float = 0.4) -> DataFrame:
    """Adds kelly: a quarter of the Kelly share at a careful win rate, between 0 and 0.3.

    The careful rate is the lower end of the posterior Beta interval, or nine tenths of its mean where the
    interval says too little. The Beta quantile has no SQL function: a vectorised one over a row a symbol.
    """

    @F.pandas_udf("double")
    def lower(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(beta_quantile(a.to_numpy(), b.to_numpy(), (1 - confidence) / 2))

    wins = F.floor(F.col("win_rate") * F.col("num_trades"))
    t = stats.withColumns({"pa": prior + wins, "pb": prior + F.col("num_trades") - wins}).withColumn("lb", lower(F.col("pa").cast("double"), F.col("pb").cast("double")))
    mean = F.col("pa") / (F.col("pa") + F.col("pb"))
    p = F.when((F.col("lb") < 0.1) | ((F.col("num_trades") < 20) & (F.col("lb") < mean * 0.7)), mean * 0.9).otherwise(F.col("lb"))
    b = F.try_divide(F.col("avg_win"), F.col("avg_loss"))
    t = t.withColumns({"p": p, "b": b})
    full = F.try_divide(F.col("p") * F.col("b") - (1 - F.col("p")), F.col("b"))
    fit = (F.col("num_trades") >= min_trades) & (F.col("win_rate") >= min_win_rate) & (F.col("avg_win") > 0) & (F.col("avg_loss") > 0)
    return t.withColumn("kelly", F.when(fit, F.greatest(F.lit(0.0), F.least(F.lit(0.3), full * fraction))).otherwise(0.0)).drop("pa", "pb", "lb", "p", "b")


def allocate(sizes: DataFrame, account: float = 10_000.0, most: float = 0.8, least_size: float = 0.1) -> DataFrame:
    """(symbol, share, size): Kelly shares, a positive one at least a tenth, scaled down if together over ``most``."""
    t = sizes.withColumn("share", F.when(F.col("kelly") > 0, F.greatest(F.col("kelly"), F.lit(least_size))).otherwise(0.0))
    total = F.sum("share").over(Window.partitionBy(F.lit(1)))
    t = t.withColumn("share", F.when(total > most, F.col("share") / total * most).otherwise(F.col("share")))
    return t.select("symbol", "share", (F.col("share") * account).alias("size"))


def position_size(stats: DataFrame, account: float = 10_000.0, risk: float = 0.02, least: float = 0.1, most: float = 0.3) -> DataFrame:
    """(symbol, share, size): the Kelly share blended with a plain risk share.

    The more trades there are, the more the Kelly share counts: by a sigmoid centred on thirty trades. A
    positive share is kept between ``least`` and ``most``.
    """
    trust = 1 / (1 + F.exp(-(F.col("num_trades") - 30) / 10))
    raw = trust * F.col("kelly") + (1 - trust) * F.when(F.col("kelly") > 0, F.lit(risk)).otherwise(0.0)
    share = F.when(raw > 0, F.least(F.lit(most), F.greatest(F.lit(least), raw))).otherwise(0.0)
    return stats.select("symbol", share.alias("share"), (share * account).alias("size"))


def posterior(stats: DataFrame, prior: float = 2.0) -> DataFrame:
    """(symbol, alpha, beta, mean, mode) of the Beta posterior of the win rate."""
    wins = F.floor(F.col("win_rate") * F.col("num_trades"))
    t = stats.select("symbol", (prior + wins).alias("alpha"), (prior + F.col("num_trades") - wins).alias("beta"))
    return t.withColumns({"mean": F.col("alpha") / (F.col("alpha") + F.col("beta")), "mode": (F.col("alpha") - 1) / (F.col("alpha") + F.col("beta") - 2)})


def incremental_signals(df: DataFrame, closed: DataFrame) -> DataFrame:
    """(symbol, ts, signal) of candles with ``signal``, 0 while a trade of ``closed`` (from the same signals) is open: its exit bar included, its entry bar not."""
    t = df.withColumn("__i", F.row_number().over(W()) - 1).select("symbol", "ts", "signal", "__i")
    marks = closed.select("symbol", F.explode(F.array(F.struct((F.col("entry_index") + 1).alias("__i"), F.lit(1).alias("d")), F.struct((F.col("exit_index") + 1).alias("__i"), F.lit(-1).alias("d")))).alias("m")).where("exit_index > entry_index")
    marks = marks.groupBy("symbol", "m.__i").agg(F.sum("m.d").alias("d"))
    j = t.join(marks, ["symbol", "__i"], "left")
    open_ = F.sum(F.coalesce("d", F.lit(0))).over(Window.partitionBy("symbol").orderBy("__i").rowsBetween(Window.unboundedPreceding, 0))
    return j.withColumn("__open", open_).select("symbol", "ts", F.when(F.col("__open") > 0, 0).otherwise(F.coalesce("signal", F.lit(0))).alias("signal"))


def walk_forward(df: DataFrame, signal_fn, min_periods: int = 1, columns: tuple[str, ...] = ("open", "high", "low", "close", "volume")) -> DataFrame:
    """(symbol, ts, signal, confidence): for each bar what ``signal_fn`` says of the history up to it.

    ``signal_fn`` takes a pandas frame of the bars so far and gives (signal, confidence) or None; bars before ``min_periods``,
    and those it gives None or an error for, have 0. The history is a view, so that a bar costs what the function costs.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", ignore_index=True)
        signal, sure = np.zeros(len(pdf), "int32"), np.zeros(len(pdf))
        for i in range(max(0, min_periods - 1), len(pdf)):
            try:
                got = signal_fn(pdf.iloc[: i + 1])
            except (ArithmeticError, LookupError, ValueError):
                got = None
            if got is not None:
                signal[i], sure[i] = got
        return pd.DataFrame({"symbol": pdf["symbol"], "ts": pdf["ts"], "signal": signal, "confidence": sure})

    stamp = dict(df.dtypes)["ts"]
    return df.select("symbol", "ts", *columns).groupBy("symbol").applyInPandas(one, f"symbol string, ts {stamp}, signal int, confidence double")

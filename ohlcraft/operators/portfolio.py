"""Portfolio: profit, beta, value at risk, correlations, hedges, targets and pivot levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.windows import change

_SIGN = lambda: F.when(F.col("direction") == "LONG", 1.0).otherwise(-1.0)


def returns(candles: DataFrame) -> DataFrame:
    return candles.select("symbol", "ts", "close", change("close").alias("r"))


def profit(positions: DataFrame, prices: DataFrame, betas: DataFrame | None = None) -> DataFrame:
    """(symbol, direction, pnl, delta, beta_delta) at the latest prices; a missing beta is 1."""
    p = positions.join(prices.groupBy("symbol").agg(F.max_by("close", "ts").alias("price")), "symbol")
    pnl = _SIGN() * F.try_divide(F.col("price") - F.col("entry_price"), F.col("entry_price")) * F.col("size_usdt")
    p = p.withColumns({"pnl": pnl, "delta": _SIGN() * F.col("size_usdt")})
    b = F.lit(1.0)
    if betas is not None:
        p, b = p.join(betas.select("symbol", "beta"), "symbol", "left"), F.coalesce("beta", F.lit(1.0))
    return p.select("symbol", "direction", "pnl", "delta", (F.col("delta") * b).alias("beta_delta"))


def beta(candles: DataFrame, market: str, least: int = 50) -> DataFrame:
    """(symbol, beta): covariance with the market's returns over their variance; the market's own is 1."""
    r = returns(candles)
    m = r.where(F.col("symbol") == market).select("ts", F.col("r").alias("m"))
    g = r.join(m, "ts").where("r IS NOT NULL AND m IS NOT NULL").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.covar_samp("r", "m"), F.var_samp("m")).alias("beta"))
    return g.where(F.col("n") >= least).select("symbol", F.when(F.col("symbol") == market, 1.0).otherwise(F.col("beta")).alias("beta"))


def value_at_risk(candles: DataFrame, positions: DataFrame, lookback: int = 60, confidence: float = 0.95) -> DataFrame:
    """(value_at_risk, n): the loss not passed on ``confidence`` of the last bars, 0 at least, by the linear percentile."""
    r = returns(candles).join(positions, "symbol").where("r IS NOT NULL")
    p = r.groupBy("ts").agg(F.sum(_SIGN() * F.col("size_usdt") * F.col("r")).alias("x"))
    last = p.orderBy(F.desc("ts")).limit(lookback)  # the look-back is the feature
    return last.agg(F.greatest(F.lit(0.0), -F.percentile("x", F.lit(1 - confidence))).alias("value_at_risk"), F.count(F.lit(1)).alias("n"))


def correlations(candles: DataFrame, least: int = 20) -> DataFrame:
    """(a, b, corr) of the returns of each two symbols at the times they share."""
    r = returns(candles).where("r IS NOT NULL")
    j = r.select(F.col("symbol").alias("a"), "ts", F.col("r").alias("ra")).join(r.select(F.col("symbol").alias("b"), "ts", F.col("r").alias("rb")), "ts").where("a < b")
    return j.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.corr("ra", "rb").alias("corr")).where(F.col("n") >= least)


def weighted_correlation(candles: DataFrame, positions: DataFrame) -> DataFrame:
    """(correlation, n_pairs): the mean pair correlation, signed by direction and weighted by size."""
    w = positions.select("symbol", F.col("size_usdt").alias("w"), _SIGN().alias("s"))
    c = correlations(candles).join(w.select(F.col("symbol").alias("a"), F.col("w").alias("wa"), F.col("s").alias("sa")), "a").join(w.select(F.col("symbol").alias("b"), F.col("w").alias("wb"), F.col("s").alias("sb")), "b")
    return c.agg(F.try_divide(F.sum(F.col("corr") * F.col("sa") * F.col("sb") * (F.col("wa") + F.col("wb"))), F.sum(F.col("wa") + F.col("wb"))).alias("correlation"), F.count(F.lit(1)).alias("n_pairs"))


def portfolio_returns(candles: DataFrame, positions: DataFrame) -> DataFrame:
    """(ts, r): the size-weighted mean of the known returns of a time."""
    j = returns(candles).join(positions, "symbol").where("r IS NOT NULL")
    return j.groupBy("ts").agg(F.try_divide(F.sum(_SIGN() * F.col("size_usdt") * F.col("r")), F.sum("size_usdt")).alias("r"))


def hedge_candidates(candles: DataFrame, positions: DataFrame, least: int = 20) -> DataFrame:
    """(symbol, weighted, joint, score): correlation of symbols outside the portfolio with it, by position and as a whole; the best first."""
    out = candles.join(positions.select("symbol"), "symbol", "left_anti")
    p = portfolio_returns(candles, positions).select("ts", F.col("r").alias("p"))
    joint = returns(out).join(p, "ts").where("r IS NOT NULL").groupBy("symbol").agg(F.corr("r", "p").alias("joint"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    c = correlations(candles, least)
    both = c.select(F.col("a").alias("symbol"), F.col("b").alias("other"), "corr").unionByName(c.select(F.col("b").alias("symbol"), F.col("a").alias("other"), "corr"))
    held = positions.select(F.col("symbol").alias("other"), "size_usdt", _SIGN().alias("s"))
    one = both.join(held, "other").groupBy("symbol").agg(F.try_divide(F.sum(F.col("corr") * F.col("s") * F.col("size_usdt")), F.sum("size_usdt")).alias("weighted"))
    return joint.join(one, "symbol").select("symbol", "weighted", "joint", ((F.abs("weighted") + F.abs("joint")) / 2).alias("score")).orderBy(F.desc("score"), "symbol")


def correlation_impact(candles: DataFrame, positions: DataFrame, addition: DataFrame) -> DataFrame:
    """(before, after): the weighted correlation without and with more positions."""
    a = weighted_correlation(candles, positions).select(F.col("correlation").alias("before"))
    return a.crossJoin(F.broadcast(weighted_correlation(candles, positions.unionByName(addition)).select(F.col("correlation").alias("after"))))  # one row each


def hedge_size(exposure: DataFrame, betas: DataFrame, hedge: str) -> DataFrame:
    """(hedge, direction, size): what brings the beta-weighted delta to zero, or the plain one without a beta."""
    b = betas.where(F.col("symbol") == hedge).agg(F.max("beta").alias("beta"))
    t = exposure.agg(F.sum("delta").alias("delta"), F.sum("beta_delta").alias("bd")).crossJoin(F.broadcast(b))  # one row each
    need = F.when(F.coalesce(F.abs("beta") > 1e-9, F.lit(False)), -F.col("bd") / F.col("beta")).otherwise(-F.col("delta"))
    return t.select(F.lit(hedge).alias("hedge"), F.when(need >= 0, "LONG").otherwise("SHORT").alias("direction"), F.abs(need).alias("size"))


def totals(positions: DataFrame) -> DataFrame:
    s = lambda d: F.sum(F.when(F.col("direction") == d, F.col("size_usdt")).otherwise(0.0))
    return positions.agg(s("LONG").alias("long_total"), s("SHORT").alias("short_total"), F.sum("size_usdt").alias("combined"), (s("LONG") - s("SHORT")).alias("net"))


def atr_targets(latest: DataFrame, price: str = "close", atr: str = "atr") -> DataFrame:
    """(symbol, side, k, target): price plus and minus one to three times the ATR."""
    k = F.explode(F.array(*[F.struct(F.lit(side).alias("side"), F.lit(n).alias("k")) for side in ("UP", "DOWN") for n in (1, 2, 3)])).alias("t")
    t = latest.select("symbol", F.col(price).alias("p"), F.col(atr).alias("a"), k)
    return t.select("symbol", "t.side", "t.k", (F.col("p") + F.when(F.col("t.side") == "UP", 1).otherwise(-1) * F.col("t.k") * F.col("a")).alias("target"))


def pivots(candles: DataFrame, n: int = 2) -> DataFrame:
    """(symbol, ts, kind, level): highs and lows passed by none of the n bars on either side."""
    w = Window.partitionBy("symbol").orderBy("ts")
    around = w.rowsBetween(-n, n)
    full = F.count(F.lit(1)).over(around) == 2 * n + 1
    t = candles.withColumns({"hi": full & (F.col("high") == F.max("high").over(around)), "lo": full & (F.col("low") == F.min("low").over(around))})
    return t.select("symbol", "ts", F.explode(F.array(F.struct(F.lit("HIGH").alias("kind"), F.col("high").alias("level"), F.col("hi").alias("ok")), F.struct(F.lit("LOW").alias("kind"), F.col("low").alias("level"), F.col("lo").alias("ok")))).alias("p")).where("p.ok").select("symbol", "ts", "p.kind", "p.level")


def pivot_view(levels: DataFrame, latest: DataFrame, near_percent: float = 5.0) -> DataFrame:
    """Each level against the latest price: distance, percent, above or below, near or not."""
    j = levels.join(latest.select("symbol", F.col("close").alias("price")), "symbol")
    d: Column = F.col("level") - F.col("price")
    return j.withColumns({"distance": d, "percent": F.try_divide(d * 100, F.col("price")), "side": F.when(d > 0, "ABOVE").otherwise("BELOW")}).withColumn("near", (F.abs("percent") <= near_percent).cast("int"))

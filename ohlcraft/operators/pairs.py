"""Pairs: rank symbols, pair the worst with the best, measure and score their spreads, select."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import quant


def performance(candles: DataFrame, least: int = 168) -> DataFrame:
    """(symbol, r1d, r3d, r1w, score): returns against the last close at or before a day, three days and a week ago."""
    now = candles.groupBy("symbol").agg(F.max("ts").alias("now"), F.max_by("close", "ts").alias("price"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    t = candles.join(now, "symbol")
    then = lambda days: F.max_by(F.when(F.col("ts") <= F.col("now") - F.expr(f"INTERVAL {days} DAYS"), F.col("close")), F.when(F.col("ts") <= F.col("now") - F.expr(f"INTERVAL {days} DAYS"), F.col("ts")))
    g = t.groupBy("symbol").agg(F.first("price").alias("price"), *[then(d).alias(f"p{d}") for d in (1, 3, 7)])
    ret = lambda d: F.coalesce(F.try_divide(F.col("price") - F.col(f"p{d}"), F.col(f"p{d}")), F.lit(0.0))
    g = g.select("symbol", ret(1).alias("r1d"), ret(3).alias("r3d"), ret(7).alias("r1w"))
    return g.withColumn("score", 0.5 * F.col("r1d") + 0.3 * F.col("r3d") + 0.2 * F.col("r1w"))


def ranked(perf: DataFrame) -> DataFrame:
    return perf.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "symbol")))


def candidates(perf: DataFrame, worst: int = 3, best: int = 3) -> DataFrame:
    """(long_symbol, short_symbol, spread): each of the worst against each of the best (stated numbers of symbols)."""
    lo = perf.orderBy("score", "symbol").limit(worst).select(F.col("symbol").alias("long_symbol"), F.col("score").alias("long_score"))
    hi = perf.orderBy(F.desc("score"), "symbol").limit(best).select(F.col("symbol").alias("short_symbol"), F.col("score").alias("short_score"))
    return lo.join(F.broadcast(hi), F.col("long_symbol") != F.col("short_symbol")).withColumn("spread", F.abs(F.col("short_score") - F.col("long_score")))


def aligned(candles: DataFrame, pairs: DataFrame) -> DataFrame:
    """(long_symbol, short_symbol, ts, y, x, ry, rx): both closes at the times they share, and their returns."""
    c = candles.select("symbol", "ts", "close")
    p = pairs.select("long_symbol", "short_symbol")
    a = p.join(c.withColumnsRenamed({"symbol": "long_symbol", "close": "y"}), "long_symbol")
    j = a.join(c.withColumnsRenamed({"symbol": "short_symbol", "close": "x"}), ["short_symbol", "ts"])
    w = Window.partitionBy("long_symbol", "short_symbol").orderBy("ts")
    return j.withColumns({"ry": F.try_divide(F.col("y"), F.lag("y").over(w)) - 1, "rx": F.try_divide(F.col("x"), F.lag("x").over(w)) - 1})


KEYS = ["long_symbol", "short_symbol"]


def pair_metrics(candles: DataFrame, pairs: DataFrame, least: int = 50) -> DataFrame:
    """All metrics of each pair: correlation, hedge ratios, the moments of both spreads, tests."""
    j = aligned(candles, pairs)
    base = j.groupBy(*KEYS).agg(F.count("ry").alias("points"), F.corr("ry", "rx").alias("correlation"), F.regr_slope("y", "x").alias("ols_beta"), F.regr_intercept("y", "x").alias("ols_alpha")).where(F.col("points") >= least)
    beta = quant.kalman_hedge(j, KEYS, "y", "x")
    out = base.join(beta, KEYS)
    s = j.join(out.select(*KEYS, "ols_beta", "ols_alpha", "kalman_beta"), KEYS)
    ols = s.withColumn("spread", F.col("y") - F.col("ols_beta") * F.col("x") - F.col("ols_alpha"))
    kal = s.withColumn("spread", F.col("y") - F.col("kalman_beta") * F.col("x"))
    for prefix, t in (("", ols), ("kalman_", kal)):
        m = quant.spread_metrics(t, KEYS)
        out = out.join(m.withColumnsRenamed({c: prefix + c for c in m.columns if c not in KEYS}), KEYS)
    out = out.join(quant.hurst(ols, KEYS, "spread"), KEYS, "left").join(quant.adf(ols, KEYS, "spread"), KEYS, "left").join(quant.johansen(j, KEYS, "y", "x"), KEYS, "left")
    z = ols.join(out.select(*KEYS, F.col("mean").alias("m"), F.col("std").alias("sd")), KEYS).withColumn("z", F.try_divide(F.col("spread") - F.col("m"), F.col("sd")))
    return out.join(quant.direction_metrics(z, KEYS, "z"), KEYS, "left")


def quantitative_score(df: DataFrame) -> DataFrame:
    """Adds quant_score, 0 to 100, from whichever metrics are known."""
    ladder = lambda good, better, a, b: F.coalesce(F.when(better, a).when(good, b), F.lit(0.0))
    c = F.col
    score = (
        F.when((c("adf_stationary") == 1) | (c("johansen_cointegrated") == 1), 30.0).otherwise(0.0)
        + ladder(c("half_life") < 50, c("half_life") < 20, 20.0, 10.0)
        + ladder(c("hurst") < 0.5, c("hurst") < 0.4, 15.0, 8.0)
        + ladder(c("sharpe") > 1, c("sharpe") > 2, 15.0, 8.0)
        + ladder(c("f1") > 0.6, c("f1") > 0.7, 10.0, 5.0)
        + ladder(F.abs("max_drawdown") < 0.3, F.abs("max_drawdown") < 0.2, 10.0, 5.0)
        + ladder(c("calmar") >= 0.5, c("calmar") >= 1, 5.0, 2.5)
    )
    return df.withColumn("quant_score", F.least(F.lit(100.0), score))


# Bonuses of the opportunity score.
BONUS = {
    "corr_good": 1.2, "corr_low": 0.8, "corr_high": 0.9, "cointegrated": 1.15, "half_life": 1.1, "hurst_good": 1.08, "hurst_ok": 1.02, "sharpe_good": 1.08, "sharpe_ok": 1.03,
    "drawdown": 1.05, "calmar": 1.05, "johansen": 1.08, "f1_high": 1.05, "f1_mid": 1.02, "z_divisor": 5.0, "z_cap": 0.2,
}


# The momentum strategy's factors and bounds.
MOMENTUM = {
    "negative": 1.10, "low": 1.05, "low_at": 0.30, "high": 0.90, "high_at": 0.75, "hurst": 1.08, "z_high": 1.15, "z_high_at": 2.0, "z_some": 1.08, "z_some_at": 1.0, "adx": 18.0, "adx_strong": 25.0,
    "adx_bonus": 1.03, "adx_strong_bonus": 1.08, "adx_none": 10.0, "adx_none_factor": 0.3, "adx_power": 2.0, "cointegrated": 0.95, "sharpe": 0.97, "sharpe_at": 0.5, "drawdown": 0.97, "drawdown_at": 0.45, "calmar": 0.98, "calmar_at": 0.5,
}


def picked(df: DataFrame, name: str, how: str = "best") -> Column:
    """A metric of the two spreads, by least squares and Kalman: ols, kalman, best (the lower half-life or drawdown, else the higher) or avg; the known one if one is."""
    finite = lambda c: F.when(F.abs(c) < float("inf"), F.col(c)) if c in df.columns else F.lit(None).cast("double")
    a, b = finite(name), finite(f"kalman_{name}")
    either = F.coalesce(b, a)
    if how == "ols":
        return a
    if how == "avg":
        return F.coalesce((a + b) / 2, either)
    if how == "best":
        return F.least(a, b) if name in ("half_life", "max_drawdown") else F.greatest(a, b)
    return either


def momentum_score(df: DataFrame, how: str = "best") -> DataFrame:
    """Adds opportunity for the momentum strategy: legs that trend (long_adx, short_adx) and part; metrics as :func:`picked`."""
    m, one = MOMENTUM, F.lit(1.0)
    pick = lambda *cases: F.coalesce(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(v)) for cond, v in cases], one)
    r, z = F.col("correlation"), F.abs(picked(df, "current_zscore", how))
    leg = lambda c: F.when(F.col(c) >= m["adx"], 1.0).when(F.col(c) < m["adx_none"], m["adx_none_factor"]).otherwise(F.pow(F.col(c) / m["adx"], F.lit(m["adx_power"])))
    both = lambda at: (F.col("long_adx") >= at) & (F.col("short_adx") >= at)
    known = F.col("long_adx").isNotNull() & F.col("short_adx").isNotNull()
    factors = (
        pick((r < 0, m["negative"]), (F.abs(r) < m["low_at"], m["low"]), (F.abs(r) > m["high_at"], m["high"])), pick((picked(df, "hurst", how) > 0.5, m["hurst"])),
        pick((z > m["z_high_at"], m["z_high"]), (z > m["z_some_at"], m["z_some"])), F.when(known, leg("long_adx") * leg("short_adx")).otherwise(one),
        F.when(known, pick((both(m["adx"]), m["adx_bonus"])) * pick((both(m["adx_strong"]), m["adx_strong_bonus"]))).otherwise(one),
        pick(((F.col("adf_stationary") == 1) | (F.col("johansen_cointegrated") == 1), m["cointegrated"])), pick((picked(df, "sharpe", how) < m["sharpe_at"], m["sharpe"])),
        pick((F.abs(picked(df, "max_drawdown", how)) > m["drawdown_at"], m["drawdown"])), pick((picked(df, "calmar", how) < m["calmar_at"], m["calmar"])),
    )
    score: Column = F.col("spread")
    for f in factors:
        score = score * f
    return df.withColumn("opportunity", F.greatest(score, F.lit(0.0)))


def opportunity_score(df: DataFrame, low: float = 0.3, high: float = 0.9) -> DataFrame:
    """Adds opportunity: the spread of the scores times a factor for each metric; reversion strategy."""
    c, b, one = F.col, BONUS, F.lit(1.0)
    pick = lambda *cases: F.coalesce(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(v)) for cond, v in cases], one)
    r = F.abs("correlation")
    factors = (
        pick((r.between(low, high), b["corr_good"]), (r < low, b["corr_low"]), (r > high, b["corr_high"])),
        pick((c("adf_stationary") == 1, b["cointegrated"])), pick((c("half_life") <= 50, b["half_life"])),
        F.coalesce(1 + F.least(F.abs("current_zscore") / b["z_divisor"], F.lit(b["z_cap"])), one),
        pick((c("hurst") <= 0.5, b["hurst_good"]), (c("hurst") < 0.6, b["hurst_ok"])), pick((c("sharpe") >= 1, b["sharpe_good"]), (c("sharpe") >= 0.5, b["sharpe_ok"])),
        pick((F.abs("max_drawdown") <= 0.3, b["drawdown"])), pick((c("calmar") >= 1, b["calmar"])), pick((c("johansen_cointegrated") == 1, b["johansen"])),
        pick((c("f1") >= 0.7, b["f1_high"]), (c("f1") >= 0.6, b["f1_mid"])),
    )
    score: Column = F.col("spread")
    for f in factors:
        score = score * f
    return df.withColumn("opportunity", F.greatest(score, F.lit(0.0)))


def valid(
    df: DataFrame,
    min_spread: float = 0.0,
    max_spread: float | None = None,
    min_correlation: float = 0.0,
    max_correlation: float = 1.0,
    require_cointegration: bool = False,
    max_half_life: float | None = 50.0,
    max_hurst: float | None = None,
    min_sharpe: float | None = None,
    max_drawdown: float | None = None,
    min_quant_score: float | None = None,
) -> DataFrame:
    """Pairs within all limits; None switches a limit off.

    A pair needs both symbols and a finite spread, and cointegration (the ADF verdict, Johansen's where that is unknown) if that is
    required; any other unknown or infinite metric passes. Correlations count by size; those outside -1 to 1 are errors.
    """
    known = lambda c: F.when(F.abs(c) < float("inf"), F.col(c))
    passes = lambda cond: F.coalesce(cond, F.lit(True))
    spread, r = known("spread"), F.abs(known("correlation"))
    ok = F.col("long_symbol").isNotNull() & F.col("short_symbol").isNotNull() & F.coalesce(spread >= min_spread, F.lit(False))
    ok = ok & passes(r <= 1) & passes(r.between(min_correlation, max_correlation))
    if max_spread is not None:
        ok = ok & (spread <= max_spread)
    if require_cointegration:
        ok = ok & (F.coalesce("adf_stationary", "johansen_cointegrated", F.lit(0)) == 1)
    if max_half_life is not None:
        ok = ok & passes(known("half_life") <= max_half_life)
    if max_hurst is not None:
        ok = ok & passes(known("hurst") < max_hurst)
    if min_sharpe is not None:
        ok = ok & passes(known("sharpe") >= min_sharpe)
    if max_drawdown is not None:
        ok = ok & passes(F.abs(known("max_drawdown")) <= max_drawdown)
    if min_quant_score is not None:
        ok = ok & passes(known("quant_score") >= min_quant_score)
    return df.where(ok)


def by_target(pairs: DataFrame, targets: DataFrame) -> DataFrame:
    """The best pair that holds each wanted symbol."""
    j = targets.select(F.col("symbol").alias("target")).join(pairs, (F.col("target") == F.col("long_symbol")) | (F.col("target") == F.col("short_symbol")))
    return j.withColumn("rn", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("score"), "long_symbol", "short_symbol"))).where("rn = 1").drop("rn")


def ensure_in_pool(pool: DataFrame, perf: DataFrame, wanted: DataFrame) -> DataFrame:
    """The pool with the wanted symbols that it lacks."""
    more = perf.join(wanted.select("symbol"), "symbol", "left_semi").join(pool.select("symbol"), "symbol", "left_anti")
    return pool.unionByName(more.select(*pool.columns))

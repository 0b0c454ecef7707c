"""Technical indicators: each takes candles and returns them with more columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clip
from ..functions.windows import ALL, UPTO, W, bfill, change, ffill, fold, last_n, persist_sign, prev, rolling, rolling_lower_quantile, rolling_quantile, rolling_skew, run_length, sma


def price_derived(df: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return df.withColumns(
        {
            "returns_1": zero(change("close", 1)),
            "returns_5": zero(change("close", 5)),
            "log_volume": F.log1p("volume"),
            "high_low_range": zero(F.try_divide(F.col("high") - F.col("low"), F.col("close"))),
            "close_open_diff": zero(F.try_divide(F.col("close") - F.col("open"), F.col("open"))),
        }
    )


def moving_averages(df: DataFrame, lengths: tuple[int, ...] = (20, 50, 200)) -> DataFrame:
    return df.withColumns({f"sma_{n}": sma("close", n) for n in lengths})


def bollinger(df: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    mid, sd = sma("close", n), rolling(F.stddev_pop, "close", n)
    out = df.withColumns({"bb_mid": mid, "bb_low": mid - k * sd, "bb_high": mid + k * sd})
    return out.withColumn("bb_percent", F.try_divide(F.col("close") - F.col("bb_low"), F.col("bb_high") - F.col("bb_low")))


def cci(df: DataFrame, n: int = 20) -> DataFrame:
    out = df.withColumn("tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    out = out.withColumns({"tp_m": sma("tp", n), "tp_w": F.collect_list("tp").over(last_n(n))})
    mad = F.expr(f"aggregate(tp_w, 0D, (a, v) -> a + abs(v - tp_m)) / {n}")
    return out.withColumn("cci", F.coalesce(F.try_divide(F.col("tp") - F.col("tp_m"), 0.015 * mad), F.lit(0.0))).drop("tp", "tp_m", "tp_w")


def delta_weighted_ma(df: DataFrame, n: int = 50) -> DataFrame:
    """Mean of closes weighted by their relative moves; the plain mean where nothing moves; null in the first n rows."""
    out = df.withColumn("dw", F.abs(change("close", 1)))
    num, den = F.sum(F.col("close") * F.col("dw")).over(last_n(n)), F.sum("dw").over(last_n(n))
    value = F.when(den > 0, num / den).otherwise(F.avg("close").over(last_n(n)))
    return out.withColumn("dwma", F.when(F.count("dw").over(last_n(n)) == n, value)).drop("dw")


def trend_direction(df: DataFrame, ma: str = "dwma") -> DataFrame:
    """1 above the average, -1 below, else as before; 0 at first."""
    return df.withColumn("trend", persist_sign(F.coalesce(F.signum(F.col("close") - F.col(ma)).cast("int"), F.lit(0))))


def on_balance_volume(df: DataFrame) -> DataFrame:
    signed = F.when(prev("close").isNull(), F.col("volume")).otherwise(F.signum(F.col("close") - prev("close")) * F.col("volume"))
    return df.withColumn("ov", signed).withColumn("obv", F.sum("ov").over(UPTO())).drop("ov")


def moving_average_ratio(df: DataFrame, n: int = 14) -> DataFrame:
    return df.withColumn("mar", F.try_divide(F.col("close"), sma("close", n)))


def z_score(df: DataFrame, n: int = 20, of: str = "close") -> DataFrame:
    sd = F.stddev_samp(of).over(last_n(n))
    return df.withColumn("zscore", F.try_divide(F.col(of) - F.avg(of).over(last_n(n)), sd))


def returns_volatility(df: DataFrame, n: int = 20) -> DataFrame:
    return df.withColumn("r", change("close")).withColumn("volatility", rolling(F.stddev_samp, "r", n)).drop("r")


def weighted_ma(x: str, n: int) -> Column:
    """Linear weights, the newest row the heaviest."""
    total = sum((n - k) * (F.col(x) if k == 0 else prev(x, k)) for k in range(n))
    return total / (n * (n + 1) // 2)


def wma(df: DataFrame, n: int = 14) -> DataFrame:
    return df.withColumn("wma", weighted_ma("close", n))


def hma(df: DataFrame, n: int = 14) -> DataFrame:
    """Weighted mean over sqrt(n) rows of twice the half-length one less the full one."""
    out = df.withColumns({"h1": weighted_ma("close", n // 2), "h2": weighted_ma("close", n)}).withColumn("h3", 2 * F.col("h1") - F.col("h2"))
    return out.withColumn("hma", weighted_ma("h3", int(n**0.5))).drop("h1", "h2", "h3")


def lsma(df: DataFrame, n: int = 14) -> DataFrame:
    """The end of the least-squares line over n rows."""
    x = [n - 1 - k for k in range(n)]
    mx, sxx = (n - 1) / 2, n * (n * n - 1) / 12
    slope = sum((xi - mx) * (F.col("close") if k == 0 else prev("close", k)) for k, xi in enumerate(x)) / sxx
    return df.withColumn("lsma", sma("close", n) + slope * ((n - 1) - mx))


def true_range(df: DataFrame) -> DataFrame:
    h, lo, p = F.col("high"), F.col("low"), prev("close")
    return df.withColumn("tr", F.greatest(h - lo, F.abs(h - p), F.abs(lo - p)))


def _ema(m: str, t: str, x: str, n: int, since: int = 0) -> tuple[str, str]:
    """(new mean, new running sum) of an exponential mean that starts with the plain mean of its first n values."""
    first = since + n - 1
    return f"CASE WHEN x.i < {first} THEN null WHEN x.i = {first} THEN (s.{t} + {x}) / {n}D ELSE s.{m} + ({2 / (n + 1)!r}D * ({x} - s.{m})) END", f"CASE WHEN x.i >= {since} AND x.i <= {first} THEN s.{t} + {x} ELSE s.{t} END"


_NULL = "cast(null AS double)"


def ema(df: DataFrame, n: int = 14, of: str = "close", name: str = "ema") -> DataFrame:
    m, t = _ema("m", "t", f"x.{of}", n)
    return fold(df, [of], f"struct({_NULL} AS m, 0D AS t)", f"struct({m} AS m, {t} AS t)", {name: "s.m"})


def dema(df: DataFrame, n: int = 14) -> DataFrame:
    m, t = _ema("m", "t", "x.close", n)
    m2, t2 = _ema("m2", "t2", f"({m})", n, n - 1)
    return fold(df, ["close"], f"struct({_NULL} AS m, 0D AS t, {_NULL} AS m2, 0D AS t2)", f"struct({m} AS m, {t} AS t, {m2} AS m2, {t2} AS t2)", {"dema": "2 * s.m - s.m2"})


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    a, ta = _ema("a", "ta", "x.close", fast)
    b, tb = _ema("b", "tb", "x.close", slow)
    c, tc = _ema("c", "tc", f"(({a}) - ({b}))", signal, slow - 1)
    names = ("a", "ta", "b", "tb", "c", "tc")
    init = ", ".join(f"{_NULL if len(n) == 1 else '0D'} AS {n}" for n in names)
    step = ", ".join(f"{e} AS {n}" for n, e in zip(names, (a, ta, b, tb, c, tc), strict=True))
    out = fold(df, ["close"], f"struct({init})", f"struct({step})", {"macd": "s.a - s.b", "macd_signal": "s.c"})
    out = out.withColumn("macd_hist", F.coalesce(F.col("macd") - F.col("macd_signal"), F.lit(0.0)))
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("macd", "macd_signal")})


def _wilder(m: str, x: str, n: int) -> str:
    return f"CASE WHEN {x} IS NULL THEN s.{m} WHEN s.{m} IS NULL THEN {x} ELSE s.{m} + ({x} - s.{m}) / {n}D END"


def rsi(df: DataFrame, n: int = 14, name: str = "rsi") -> DataFrame:
    """Wilder means of gains and losses; 50 before there are n moves or without any."""
    d = F.col("close") - prev("close")
    out = df.withColumns({"up": F.greatest(d, F.lit(0.0)), "down": F.greatest(-d, F.lit(0.0))})
    out = out.withColumns({"up": F.when(prev("close").isNotNull(), F.col("up")), "down": F.when(prev("close").isNotNull(), F.col("down"))})
    step = f"struct({_wilder('u', 'x.up', n)} AS u, {_wilder('d', 'x.down', n)} AS d, x.i AS i)"
    return fold(out, ["up", "down"], f"struct({_NULL} AS u, {_NULL} AS d, 0 AS i)", step, {name: f"CASE WHEN s.i < {n} OR s.u + s.d = 0 THEN 50D ELSE 100D * s.u / (s.u + s.d) END"}).drop("up", "down")


def atr(df: DataFrame, n: int = 14, name: str = "atr") -> DataFrame:
    """Wilder mean of the true range; a hundredth of the close where there is none."""
    out = fold(true_range(df), ["tr"], f"struct({_NULL} AS m)", f"struct({_wilder('m', 'x.tr', n)} AS m)", {name: "s.m"})
    return out.withColumn(name, F.coalesce(F.col(name), F.col("close") * 0.01)).drop("tr")


def directional(df: DataFrame) -> DataFrame:
    up, down = F.col("high") - prev("high"), prev("low") - F.col("low")
    return true_range(df).withColumns({"pdm": F.when((up > down) & (up > 0), up).otherwise(0.0), "mdm": F.when((down > up) & (down > 0), down).otherwise(0.0)})


def adx(df: DataFrame, n: int = 14) -> DataFrame:
    """Average directional index by four Wilder means; filled back, 0 without any, null for short series."""
    a, p, m = (_wilder(k, f"x.{c}", n) for k, c in (("a", "tr"), ("p", "pdm"), ("m", "mdm")))
    out = fold(directional(df), ["tr", "pdm", "mdm"], f"struct({_NULL} AS a, {_NULL} AS p, {_NULL} AS m)", f"struct({a} AS a, {p} AS p, {m} AS m)", {"dx": "100D * abs(try_divide(100D * s.p, s.a) - try_divide(100D * s.m, s.a)) / nullif(try_divide(100D * s.p, s.a) + try_divide(100D * s.m, s.a), 0D)"})
    out = fold(out, ["dx"], f"struct({_NULL} AS m)", f"struct({_wilder('m', 'x.dx', n)} AS m)", {"adx": "s.m"})
    n_rows = F.count(F.lit(1)).over(ALL())
    return out.withColumn("adx", F.when(n_rows >= 2 * n, F.coalesce(bfill("adx"), F.lit(0.0)))).drop("tr", "pdm", "mdm", "dx")


def dmi_difference(df: DataFrame, n: int = 9) -> DataFrame:
    a, p, m = (_wilder(k, f"x.{c}", n) for k, c in (("a", "tr"), ("p", "pdm"), ("m", "mdm")))
    out = fold(directional(df), ["tr", "pdm", "mdm"], f"struct({_NULL} AS a, {_NULL} AS p, {_NULL} AS m)", f"struct({a} AS a, {p} AS p, {m} AS m)", {"dmi": "coalesce(try_divide(100D * (s.p - s.m), s.a), 0D)"})
    return out.drop("tr", "pdm", "mdm")


def stochastic_rsi(df: DataFrame, n: int = 14, k: int = 3, d: int = 3) -> DataFrame:
    out = rsi(df, n)
    lo, hi = rolling(F.min, "rsi", n), rolling(F.max, "rsi", n)
    out = out.withColumn("st", F.try_divide(100 * (F.col("rsi") - lo), hi - lo)).withColumn("stoch_k", rolling(F.avg, "st", k))
    out = out.withColumn("stoch_d", rolling(F.avg, "stoch_k", d))
    return out.withColumns({c: F.coalesce(c, F.lit(50.0)) for c in ("stoch_k", "stoch_d")}).drop("st")


def _efficiency(n: int) -> Column:
    move = F.abs(F.col("close") - prev("close", n))
    path = F.sum(F.abs(F.col("dc"))).over(last_n(n))
    return F.coalesce(F.try_divide(move, path), F.lit(0.0))


def kama(df: DataFrame, n: int = 10, fast: int = 2, slow: int = 30) -> DataFrame:
    """Kaufman's adaptive mean; the first n rows have the first close."""
    f, sl = 2 / (fast + 1), 2 / (slow + 1)
    out = df.withColumn("dc", F.col("close") - prev("close")).withColumn("er", _efficiency(n))
    sc = F.pow(F.col("er") * (f - sl) + sl, F.lit(2.0))
    out = out.withColumn("sc", clip(sc, 1e-10, 1.0))
    step = f"struct(CASE WHEN x.i = 0 THEN x.close WHEN x.i < {n} THEN s.k ELSE s.k + x.sc * (x.close - s.k) END AS k)"
    return fold(out, ["close", "sc"], f"struct({_NULL} AS k)", step, {"kama": "s.k"}).drop("dc", "er", "sc")


def kama_atc(df: DataFrame, n: int = 28) -> DataFrame:
    """The adaptive mean of the trend classification: fixed smoothing limits, first price until row n."""
    out = df.withColumn("dc", F.col("close") - prev("close")).withColumn("er", _efficiency(n)).withColumn("sc", F.pow(F.col("er") * (0.666 - 0.064) + 0.064, F.lit(2.0)))
    step = f"struct(CASE WHEN x.i = 0 THEN x.close WHEN x.i < {n} THEN s.k ELSE s.k + x.sc * (x.close - s.k) END AS k)"
    return fold(out, ["close", "sc"], f"struct({_NULL} AS k)", step, {"kama_atc": "s.k"}).drop("dc", "er", "sc")


def fisher(df: DataFrame, n: int = 9) -> DataFrame:
    """Fisher transform of the place of the median price in its range."""
    out = df.withColumn("hl", (F.col("high") + F.col("low")) / 2)
    lo, hi = F.min("hl").over(last_n(n)), F.max("hl").over(last_n(n))
    out = out.withColumn("pos", F.coalesce(F.try_divide(F.col("hl") - lo, hi - lo), F.lit(0.5)) - 0.5)
    v = "(0.66D * x.pos + 0.67D * s.v)"
    v = f"CASE WHEN x.i = 0 THEN 0D WHEN {v} > 0.99D THEN 0.999D WHEN {v} < -0.99D THEN -0.999D ELSE {v} END"
    step = f"struct({v} AS v, CASE WHEN x.i = 0 THEN 0D ELSE 0.5D * ln((1D + ({v})) / (1D - ({v}))) + 0.5D * s.f END AS f)"
    return fold(out, ["pos"], "struct(0D AS v, 0D AS f)", step, {"fisher": "s.f"}).drop("hl", "pos")


def atr_ratio(df: DataFrame, a: int = 14, b: int = 50) -> DataFrame:
    out = atr(atr(df, a, "atr_a"), b, "atr_b")
    return out.withColumn("atr_ratio", F.coalesce(F.try_divide(F.col("atr_a"), F.col("atr_b")), F.lit(1.0)))


def kalman_smooth(df: DataFrame, q: float = 1e-5, r: float = 0.01) -> DataFrame:
    """A random-walk state seen through noise; starts at the first close."""
    p = f"(s.p + {q!r}D)"
    step = f"struct(CASE WHEN x.i = 0 THEN x.close ELSE s.x + {p} / ({p} + {r!r}D) * (x.close - s.x) END AS x, CASE WHEN x.i = 0 THEN 1D ELSE (1D - {p} / ({p} + {r!r}D)) * {p} END AS p)"
    return fold(df, ["close"], f"struct({_NULL} AS x, 1D AS p)", step, {"kalman": "s.x"})


def fractional_difference(df: DataFrame, d: float = 0.4, window: int = 10) -> DataFrame:
    """Weighted sum of the last rows, each weight (k - 1 - d) / k of the one before; null in the first rows."""
    weights = [1.0]
    for k in range(1, window + 1):
        weights.append(-weights[-1] * (d - k + 1) / k)
    return df.withColumn("fracdiff", sum(w * (F.col("close") if k == 0 else prev("close", k)) for k, w in enumerate(weights)))


def atr_band(df: DataFrame, mult: float = 2.0, lengths: tuple[int, ...] = (2000, 200, 14, 10, 5)) -> DataFrame:
    """Range band: mult times the ATR of the longest length the series can fill; a hundredth of the close if none."""
    out = true_range(df).withColumn("n_rows", F.count(F.lit(1)).over(ALL()))
    n = F.coalesce(*[F.when(F.col("n_rows") >= k, F.lit(k)) for k in lengths], F.lit(0))
    out = out.withColumn("band_n", n.cast("double"))
    step = "struct(CASE WHEN x.band_n = 0 OR x.tr IS NULL THEN s.m WHEN s.m IS NULL THEN x.tr ELSE s.m + (x.tr - s.m) / x.band_n END AS m, x.i AS i, x.band_n AS n)"
    out = fold(out, ["tr", "band_n"], f"struct({_NULL} AS m, 0 AS i, 0D AS n)", step, {"atr_long": "CASE WHEN s.i + 1 >= s.n THEN s.m END"})
    filled = F.coalesce(ffill("atr_long"), bfill("atr_long"))
    return out.withColumn("filled", filled).withColumn("range_atr", F.coalesce(mult * F.col("filled"), 0.01 * F.col("close"))).drop("tr", "n_rows", "band_n", "atr_long", "filled")


def window_kit(df: DataFrame) -> DataFrame:
    """The plain window primitives side by side."""
    out = df.withColumns(
        {
            "lag_1": prev("close"),
            "lead_2": F.lead("close", 2).over(W()),
            "diff_1": F.col("close") - prev("close"),
            "pct_3": change("close", 3),
            "roll_mean": rolling(F.avg, "close", 10),
            "roll_sum": rolling(F.sum, "close", 10, 3),
            "roll_std": rolling(F.stddev_samp, "close", 10),
            "roll_min": rolling(F.min, "close", 10),
            "roll_max": rolling(F.max, "close", 10),
            "roll_q25_lower": rolling_lower_quantile("close", 10, 0.25),
            "roll_median": rolling_quantile("close", 10, 0.5),
            "expanding_max": F.max("close").over(UPTO()),
            "cumsum": F.sum("close").over(UPTO()),
            "skew": rolling_skew("close", 10),
        }
    )
    return out


def run_lengths(df: DataFrame) -> DataFrame:
    """How long the close has been above or not above the one before."""
    return run_length(df, F.coalesce(F.col("close") > prev("close"), F.lit(False)), "run")


def gaps(df: DataFrame, every: int = 3) -> DataFrame:
    """Closes with holes, filled forwards, backwards, and by the straight line between neighbours."""
    out = df.withColumn("i", F.row_number().over(W()) - 1).withColumn("x", F.when(F.col("i") % every != 1, F.col("close")))
    known = F.when(F.col("x").isNotNull(), F.col("i"))
    out = out.withColumns({"ff": ffill("x"), "bf": bfill("x"), "i0": ffill(known), "i1": bfill(known)})
    line = F.coalesce(F.col("ff") + (F.col("bf") - F.col("ff")) * F.try_divide(F.col("i") - F.col("i0"), F.col("i1") - F.col("i0")), F.col("ff"), F.col("bf"))
    return out.withColumn("linear", line).drop("i", "i0", "i1")


#: Blocks of the indicator engine in order; a profile picks some of them.
BLOCKS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "price_derived": price_derived,
    "trend": lambda d: adx(moving_averages(d)),
    "momentum": lambda d: stochastic_rsi(macd(d)),
    "volatility": lambda d: atr(bollinger(d)),
    "volume": on_balance_volume,
}
PROFILES = {"core": tuple(BLOCKS), "boosting": (*BLOCKS, "candlestick"), "deep_learning": tuple(BLOCKS)}


def approximate_averages(df: DataFrame, n: int = 14) -> DataFrame:
    """Cheap stand-ins: the plain mean for the exponential one, the chord's end for the least-squares one, a fixed rate for the adaptive one."""
    out = df.withColumns({"ema_approx": sma("close", n), "lsma_approx": sma("close", n) + (F.col("close") - prev("close", n - 1)) / 2})
    step = "struct(CASE WHEN x.i = 0 THEN x.close ELSE s.k + 0.1D * (x.close - s.k) END AS k)"
    return fold(out, ["close"], f"struct({_NULL} AS k)", step, {"kama_approx": "s.k"})


def adaptive_tolerance(df: DataFrame, n: int = 20, base: float = 0.05, factor: float = 1.0) -> DataFrame:
    """How far an approximation may lie off: ``base``, more in volatile spells."""
    out = df.withColumn("r", change("close"))
    return out.withColumn("tolerance", base * (1 + factor * F.coalesce(F.stddev_samp("r").over(last_n(n)), F.lit(0.0)))).drop("r")

"""Queries of indicators and patterns over candles made from ``events``, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.windows import r6
from ..operators import candlesticks
from ..operators import indicators as ind
from ..sources import candles
from . import oracle_text as o

QUERIES, ORACLES = {}, {}


def add(name, fn, values, oracle, base="hourly"):
    """Register a query that gives symbol, ts and the named values, rounded, from ``fn`` over candles."""

    def run(spark, sf_dir):
        df = fn(getattr(candles, base)(spark, sf_dir))
        return df.select("symbol", "ts", *[r6(v).alias(v) if dict(df.dtypes)[v] == "double" else F.col(v) for v in values])

    QUERIES[name] = run
    ORACLES[name] = oracle


def plain(base, values, *ctes, source="c", recursive=False):
    text = o.HOURLY if base == "hourly" else o.DAILY
    return o.query(text, *ctes, select="SELECT symbol, ts, " + ", ".join(f"{e} AS {n}" for n, e in values.items()) + f" FROM {source}", recursive=recursive)


def folded(values, *ctes, rows="n", base=o.HOURLY):
    return o.query(base, *ctes, select=o.back(", ".join(f"{o.r6(e)} AS {n}" for n, e in values.items()), rows), recursive=True)


def guarded(agg, x, n):
    return f"CASE WHEN count({x}) {o.over(n)} = {n} THEN {agg} {o.over(n)} END"


_pct = lambda n: f"close / nullif({o.lag('close', n)}, 0) - 1"

add(
    "candles_hourly", lambda d: d, ["open", "high", "low", "close", "volume"], plain("hourly", {k: o.r6(k) for k in ("open", "high", "low", "close", "volume")})
)
add("candles_daily", lambda d: d, ["open", "high", "low", "close", "volume"], plain("daily", {k: o.r6(k) for k in ("open", "high", "low", "close", "volume")}), "daily")
add(
    "candles_resampled", lambda d: candles.resample(d, "day"), ["open", "high", "low", "close", "volume"],
    o.query(o.HOURLY, select=f"SELECT symbol, date_trunc('day', ts)::TIMESTAMP AS ts, {o.r6('arg_min(open, ts)')} AS open, {o.r6('max(high)')} AS high, {o.r6('min(low)')} AS low, {o.r6('arg_max(close, ts)')} AS close, {o.r6('sum(volume)')} AS volume FROM c GROUP BY symbol, date_trunc('day', ts)"),
)
add(
    "price_derived", ind.price_derived, ["returns_1", "returns_5", "log_volume", "high_low_range", "close_open_diff"],
    plain("hourly", {"returns_1": o.r6(f"coalesce({_pct(1)}, 0)"), "returns_5": o.r6(f"coalesce({_pct(5)}, 0)"), "log_volume": o.r6("ln(1 + volume)"), "high_low_range": o.r6("coalesce((high - low) / nullif(close, 0), 0)"), "close_open_diff": o.r6("coalesce((close - open) / nullif(open, 0), 0)")}),
)
add("moving_averages", ind.moving_averages, ["sma_20", "sma_50", "sma_200"], plain("hourly", {f"sma_{n}": o.r6(guarded("avg(close)", "close", n)) for n in (20, 50, 200)}))
add(
    "bollinger", ind.bollinger, ["bb_mid", "bb_low", "bb_high", "bb_percent"],
    plain("hourly", {"bb_mid": o.r6("m"), "bb_low": o.r6("m - 2 * s"), "bb_high": o.r6("m + 2 * s"), "bb_percent": o.r6("(close - (m - 2 * s)) / nullif((m + 2 * s) - (m - 2 * s), 0)")},
          f"b AS (SELECT *, {guarded('avg(close)', 'close', 20)} AS m, {guarded('stddev_pop(close)', 'close', 20)} AS s FROM c)", source="b"),
)
add(
    "cci", ind.cci, ["cci"],
    plain("hourly", {"cci": o.r6("coalesce((tp - m) / nullif(0.015 * list_sum(list_transform(w, lambda v: abs(v - m))) / 20, 0), 0)")},
          "a AS (SELECT *, (high + low + close) / 3 AS tp FROM c)", f"b AS (SELECT *, {guarded('avg(tp)', 'tp', 20)} AS m, list(tp) {o.over(20)} AS w FROM a)", source="b"),
)
_DW = f"a AS (SELECT *, abs({_pct(1)}) AS dw FROM c)"
_DWMA = f"b AS (SELECT *, CASE WHEN count(dw) {o.over(50)} = 50 THEN CASE WHEN sum(dw) {o.over(50)} > 0 THEN sum(close * dw) {o.over(50)} / sum(dw) {o.over(50)} ELSE avg(close) {o.over(50)} END END AS m FROM a)"
add("delta_weighted_ma", ind.delta_weighted_ma, ["dwma"], plain("hourly", {"dwma": o.r6("m")}, _DW, _DWMA, source="b"))
add(
    "trend_direction", lambda d: ind.trend_direction(ind.delta_weighted_ma(d)), ["trend"],
    plain("hourly", {"trend": f"CAST(coalesce(last_value(nullif(coalesce(sign(close - m), 0), 0) IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), 0) AS INTEGER)"}, _DW, _DWMA, source="b"),
)
add("on_balance_volume", ind.on_balance_volume, ["obv"], plain("hourly", {"obv": o.r6("sum(v) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)")}, f"a AS (SELECT *, coalesce(sign(close - {o.lag('close')}), 1) * volume AS v FROM c)", source="a"))
add("moving_average_ratio", ind.moving_average_ratio, ["mar"], plain("hourly", {"mar": o.r6(f"close / nullif({guarded('avg(close)', 'close', 14)}, 0)")}))
add("z_score", ind.z_score, ["zscore"], plain("hourly", {"zscore": o.r6(f"(close - avg(close) {o.over(20)}) / nullif(stddev_samp(close) {o.over(20)}, 0)")}))
add("returns_volatility", ind.returns_volatility, ["volatility"], plain("hourly", {"volatility": o.r6(guarded("stddev_samp(x)", "x", 20))}, f"a AS (SELECT *, {_pct(1)} AS x FROM c)", source="a"))


def _wma(x, n):
    return "(" + " + ".join(f"{n - k} * {x if k == 0 else o.lag(x, k)}" for k in range(n)) + f") / {n * (n + 1) // 2}"


add("wma", ind.wma, ["wma"], plain("hourly", {"wma": o.r6(_wma("close", 14))}))
add("hma", ind.hma, ["hma"], plain("hourly", {"hma": o.r6(_wma("h", 3))}, f"a AS (SELECT *, 2 * ({_wma('close', 7)}) - ({_wma('close', 14)}) AS h FROM c)", source="a"))
add(
    "lsma", ind.lsma, ["lsma"],
    plain("hourly", {"lsma": o.r6(f"CASE WHEN count(close) {o.over(14)} = 14 THEN regr_intercept(close, i) {o.over(14)} + i * regr_slope(close, i) {o.over(14)} END")}, f"a AS (SELECT *, row_number() OVER {o.W} AS i FROM c)", source="a"),
)
add("ema", ind.ema, ["ema"], folded({"ema": "r.m"}, o.recursion("c", {"m": "NULL", "t": "close"}, o.ema_step("m", "t", "n.close", 14))))
_d1 = o.ema_step("m", "t", "n.close", 14)
add(
    "dema", ind.dema, ["dema"],
    o.query(o.HOURLY, o.recursion("c", {"m": "NULL", "t": "close"}, _d1), "e AS (SELECT n.symbol, n.ts, r.m FROM n JOIN r ON r.symbol = n.symbol AND r.i = n.i)",
            "n2 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i FROM e WHERE m IS NOT NULL)",
            "r2(symbol, i, q, t) AS (SELECT symbol, i, CAST(NULL AS DOUBLE), m FROM n2 WHERE i = 0 UNION ALL SELECT n2.symbol, n2.i, CASE WHEN n2.i < 13 THEN NULL WHEN n2.i = 13 THEN (r2.t + n2.m) / 14 ELSE r2.q + 0.13333333333333333 * (n2.m - r2.q) END, CASE WHEN n2.i <= 13 THEN r2.t + n2.m ELSE r2.t END FROM r2 JOIN n2 ON n2.symbol = r2.symbol AND n2.i = r2.i + 1)",
            select=f"SELECT e.symbol, e.ts, {o.r6('2 * e.m - q')} AS dema FROM e LEFT JOIN n2 USING (symbol, ts) LEFT JOIN r2 ON r2.symbol = n2.symbol AND r2.i = n2.i", recursive=True),
)
_fast, _slow = o.ema_step("a", "ta", "n.close", 12), o.ema_step("b", "tb", "n.close", 26)
add(
    "macd", ind.macd, ["macd", "macd_signal", "macd_hist"],
    o.query(o.HOURLY, o.recursion("c", {"a": "NULL", "ta": "close", "b": "NULL", "tb": "close"}, _fast | _slow), "e AS (SELECT n.symbol, n.ts, r.a - r.b AS m FROM n JOIN r ON r.symbol = n.symbol AND r.i = n.i)",
            "n2 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i FROM e WHERE m IS NOT NULL)",
            "r2(symbol, i, q, t) AS (SELECT symbol, i, CAST(NULL AS DOUBLE), m FROM n2 WHERE i = 0 UNION ALL SELECT n2.symbol, n2.i, CASE WHEN n2.i < 8 THEN NULL WHEN n2.i = 8 THEN (r2.t + n2.m) / 9 ELSE r2.q + 0.2 * (n2.m - r2.q) END, CASE WHEN n2.i <= 8 THEN r2.t + n2.m ELSE r2.t END FROM r2 JOIN n2 ON n2.symbol = r2.symbol AND n2.i = r2.i + 1)",
            select=f"SELECT e.symbol, e.ts, {o.r6('coalesce(e.m, 0)')} AS macd, {o.r6('coalesce(q, 0)')} AS macd_signal, {o.r6('coalesce(e.m - q, 0)')} AS macd_hist FROM e LEFT JOIN n2 USING (symbol, ts) LEFT JOIN r2 ON r2.symbol = n2.symbol AND r2.i = n2.i", recursive=True),
)
_UD = f"d AS (SELECT *, greatest(close - {o.lag('close')}, 0) AS up0, greatest({o.lag('close')} - close, 0) AS down0, {o.lag('close')} IS NULL AS isfirst FROM c), d2 AS (SELECT *, CASE WHEN NOT isfirst THEN up0 END AS up, CASE WHEN NOT isfirst THEN down0 END AS down FROM d)"
_RSI = o.recursion("d2", {"u": "up", "d": "down"}, {"u": o.wilder("u", "n.up", 14), "d": o.wilder("d", "n.down", 14)})
_RSI_VALUE = "CASE WHEN n.i < 14 OR r.u + r.d = 0 THEN 50 ELSE 100 * r.u / (r.u + r.d) END"
add("rsi", ind.rsi, ["rsi"], folded({"rsi": _RSI_VALUE}, _UD, _RSI))
add(
    "stochastic_rsi", ind.stochastic_rsi, ["stoch_k", "stoch_d"],
    o.query(o.HOURLY, _UD, _RSI, f"v AS (SELECT n.symbol, n.ts, {_RSI_VALUE} AS rsi FROM n JOIN r ON r.symbol = n.symbol AND r.i = n.i)",
            f"s AS (SELECT *, {guarded('min(rsi)', 'rsi', 14)} AS lo, {guarded('max(rsi)', 'rsi', 14)} AS hi FROM v)", "s2 AS (SELECT *, 100 * (rsi - lo) / nullif(hi - lo, 0) AS st FROM s)",
            f"s3 AS (SELECT *, {guarded('avg(st)', 'st', 3)} AS k FROM s2)", f"s4 AS (SELECT *, {guarded('avg(k)', 'k', 3)} AS d FROM s3)",
            select=f"SELECT symbol, ts, {o.r6('coalesce(k, 50)')} AS stoch_k, {o.r6('coalesce(d, 50)')} AS stoch_d FROM s4", recursive=True),
)
_TR = f"t AS (SELECT *, greatest(high - low, abs(high - {o.lag('close')}), abs(low - {o.lag('close')})) AS tr FROM c)"
_atr = lambda n: o.recursion("t", {"m": "tr"}, {"m": o.wilder("m", "n.tr", n)})
add("atr", ind.atr, ["atr"], folded({"atr": "coalesce(r.m, n.close * 0.01)"}, _TR, _atr(14)))
add("atr_ratio", ind.atr_ratio, ["atr_ratio"], folded({"atr_ratio": "coalesce(coalesce(r.a, n.close * 0.01) / nullif(coalesce(r.b, n.close * 0.01), 0), 1)"}, _TR, o.recursion("t", {"a": "tr", "b": "tr"}, {"a": o.wilder("a", "n.tr", 14), "b": o.wilder("b", "n.tr", 50)})))
_DM = f"""dm0 AS (SELECT *, high - {o.lag('high')} AS up, {o.lag('low')} - low AS down FROM t),
dm AS (SELECT *, CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS pdm, CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS mdm FROM dm0)"""
_dmi = lambda n: o.recursion("dm", {"a": "tr", "p": "pdm", "m": "mdm"}, {"a": o.wilder("a", "n.tr", n), "p": o.wilder("p", "n.pdm", n), "m": o.wilder("m", "n.mdm", n)})
add("dmi_difference", ind.dmi_difference, ["dmi"], folded({"dmi": "coalesce(100 * (r.p - r.m) / nullif(r.a, 0), 0)"}, _TR, _DM, _dmi(9)))
add(
    "adx", ind.adx, ["adx"],
    o.query(o.HOURLY, _TR, _DM, _dmi(14), "x AS (SELECT n.symbol, n.ts, n.i, 100 * r.p / nullif(r.a, 0) AS pd, 100 * r.m / nullif(r.a, 0) AS md FROM n JOIN r ON r.symbol = n.symbol AND r.i = n.i)",
            "y AS (SELECT *, 100 * abs(pd - md) / nullif(pd + md, 0) AS dx FROM x)",
            "r2(symbol, i, m) AS (SELECT symbol, i, dx FROM y WHERE i = 0 UNION ALL SELECT y.symbol, y.i, CASE WHEN y.dx IS NULL THEN r2.m WHEN r2.m IS NULL THEN y.dx ELSE r2.m + (y.dx - r2.m) / 14 END FROM r2 JOIN y ON y.symbol = r2.symbol AND y.i = r2.i + 1)",
            "z AS (SELECT y.symbol, y.ts, r2.m, count(*) OVER (PARTITION BY y.symbol) AS k, first_value(r2.m IGNORE NULLS) OVER (PARTITION BY y.symbol ORDER BY y.ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM y JOIN r2 ON r2.symbol = y.symbol AND r2.i = y.i)",
            select=f"SELECT symbol, ts, {o.r6('CASE WHEN k >= 28 THEN coalesce(b, 0) END')} AS adx FROM z", recursive=True),
)


def _kama(n, sc):
    er = f"""k0 AS (SELECT *, close - {o.lag('close')} AS dc, abs(close - {o.lag('close', n)}) AS mv FROM c), k1 AS (SELECT *, coalesce(mv / nullif(sum(abs(dc)) {o.over(n)}, 0), 0) AS er FROM k0), k2 AS (SELECT *, {sc} AS sc FROM k1)"""
    return er, o.recursion("k2", {"k": "close"}, {"k": f"CASE WHEN n.i < {n} THEN r.k ELSE r.k + n.sc * (n.close - r.k) END"})


add("kama", ind.kama, ["kama"], folded({"kama": "r.k"}, *_kama(10, f"greatest(1e-10, least(1.0, (er * ({2 / 3!r} - {2 / 31!r}) + {2 / 31!r}) ** 2))")))
add("kama_atc", ind.kama_atc, ["kama_atc"], folded({"kama_atc": "r.k"}, *_kama(28, "(er * (0.666 - 0.064) + 0.064) ** 2")))
_V = "(0.66 * n.pos + 0.67 * r.v)"
_V = f"(CASE WHEN {_V} > 0.99 THEN 0.999 WHEN {_V} < -0.99 THEN -0.999 ELSE {_V} END)"
add(
    "fisher", ind.fisher, ["fisher"],
    folded({"fisher": "r.f"}, f"h AS (SELECT *, (high + low) / 2 AS hl FROM c), h2 AS (SELECT *, coalesce((hl - min(hl) {o.over(9)}) / nullif(max(hl) {o.over(9)} - min(hl) {o.over(9)}, 0), 0.5) - 0.5 AS pos FROM h)",
           o.recursion("h2", {"v": "0", "f": "0"}, {"v": _V, "f": f"0.5 * ln((1 + {_V}) / (1 - {_V})) + 0.5 * r.f"})),
)
add("kalman_smooth", ind.kalman_smooth, ["kalman"], folded({"kalman": "r.x"}, o.recursion("c", {"x": "close", "p": "1"}, {"x": "r.x + (r.p + 1e-5) / (r.p + 1e-5 + 0.01) * (n.close - r.x)", "p": "(1 - (r.p + 1e-5) / (r.p + 1e-5 + 0.01)) * (r.p + 1e-5)"})))


def _fracdiff(d=0.4, window=10):
    w = [1.0]
    for k in range(1, window + 1):
        w.append(-w[-1] * (d - k + 1) / k)
    return " + ".join(f"{x!r} * {'close' if k == 0 else o.lag('close', k)}" for k, x in enumerate(w))


add("fractional_difference", ind.fractional_difference, ["fracdiff"], plain("hourly", {"fracdiff": o.r6(_fracdiff())}))
_BAND = f"""t2 AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS k FROM t), t3 AS (SELECT *, CASE WHEN k >= 2000 THEN 2000 WHEN k >= 200 THEN 200 WHEN k >= 14 THEN 14 WHEN k >= 10 THEN 10 WHEN k >= 5 THEN 5 END AS bn FROM t2)"""
_BAND_R = o.recursion("t3", {"m": "tr"}, {"m": "CASE WHEN n.tr IS NULL OR n.bn IS NULL THEN r.m WHEN r.m IS NULL THEN n.tr ELSE r.m + (n.tr - r.m) / n.bn END"})
_BAND_V = "bv AS (SELECT n.*, CASE WHEN n.i + 1 >= coalesce(n.bn, 0) THEN r.m END AS al FROM n JOIN r ON r.symbol = n.symbol AND r.i = n.i), band AS (SELECT *, coalesce(2 * coalesce(last_value(al IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), first_value(al IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 0.01 * close) AS range_atr FROM bv)"
add("atr_band", ind.atr_band, ["range_atr"], o.query(o.HOURLY, _TR, _BAND, _BAND_R, _BAND_V, select=f"SELECT symbol, ts, {o.r6('range_atr')} AS range_atr FROM band", recursive=True))
_up = "OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)"
add(
    "window_kit", ind.window_kit, ["lag_1", "lead_2", "diff_1", "pct_3", "roll_mean", "roll_sum", "roll_std", "roll_min", "roll_max", "roll_q25_lower", "roll_median", "expanding_max", "cumsum", "skew"],
    plain("hourly", {
        "lag_1": o.r6(o.lag("close")), "lead_2": o.r6(f"lead(close, 2) OVER {o.W}"), "diff_1": o.r6(f"close - {o.lag('close')}"), "pct_3": o.r6(_pct(3)), "roll_mean": o.r6(guarded("avg(close)", "close", 10)),
        "roll_sum": o.r6(f"CASE WHEN count(close) {o.over(10)} >= 3 THEN sum(close) {o.over(10)} END"), "roll_std": o.r6(guarded("stddev_samp(close)", "close", 10)), "roll_min": o.r6(guarded("min(close)", "close", 10)), "roll_max": o.r6(guarded("max(close)", "close", 10)),
        "roll_q25_lower": o.r6(f"CASE WHEN count(close) {o.over(10)} = 10 THEN list_sort(list(close) {o.over(10)})[3] END"), "roll_median": o.r6(guarded("quantile_cont(close, 0.5)", "close", 10)),
        "expanding_max": o.r6(f"max(close) {_up}"), "cumsum": o.r6(f"sum(close) {_up}"), "skew": o.r6(guarded("skewness(close)", "close", 10)),
    }),
)
add(
    "run_lengths", ind.run_lengths, ["run"],
    plain("hourly", {"run": "CAST(row_number() OVER (PARTITION BY symbol, g ORDER BY ts) AS INTEGER)"}, f"a AS (SELECT *, coalesce(close > {o.lag('close')}, false) AS s FROM c), b AS (SELECT *, CASE WHEN s IS NOT DISTINCT FROM {o.lag('s')} THEN 0 ELSE 1 END AS f FROM a), g AS (SELECT *, sum(f) {_up} AS g FROM b)", source="g"),
)
_bk = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
add(
    "gap_filling", ind.gaps, ["ff", "bf", "linear"],
    plain("hourly", {"ff": o.r6("ff"), "bf": o.r6("bf"), "linear": o.r6("coalesce(ff + (bf - ff) * ((i - i0)::DOUBLE / nullif(i1 - i0, 0)), ff, bf)")},
          f"a AS (SELECT *, row_number() OVER {o.W} - 1 AS i FROM c), b AS (SELECT *, CASE WHEN i % 3 != 1 THEN close END AS x, CASE WHEN i % 3 != 1 THEN i END AS k FROM a), d AS (SELECT *, last_value(x IGNORE NULLS) {_up} AS ff, first_value(x IGNORE NULLS) {_bk} AS bf, last_value(k IGNORE NULLS) {_up} AS i0, first_value(k IGNORE NULLS) {_bk} AS i1 FROM b)", source="d"),
)

_SHAPES = "s AS (SELECT symbol, ts, open AS o, high AS h, low AS l, close AS c, abs(close - open) AS b, high - greatest(close, open) AS us, least(close, open) - low AS ls, CASE WHEN high = low THEN 1e-4 ELSE high - low END AS r FROM c), s2 AS (SELECT *, b / r AS br FROM s)"
_LAGS = "s3 AS (SELECT *, " + ", ".join(f"{o.lag(x, k)} AS {x}{k}" for x in ("o", "h", "l", "c", "b", "us", "r", "br") for k in (1, 2, 3, 4)) + " FROM s2)"
for _base in ("hourly", "daily"):
    add(f"candlesticks_{_base}", candlesticks.patterns, list(candlesticks.PATTERNS), plain(_base, {k: f"CASE WHEN {v} THEN 1 ELSE 0 END" for k, v in candlesticks.PATTERNS.items()}, _SHAPES, _LAGS, source="s3"), _base)


def _cross_rank(spark, sf_dir):
    """For each symbol the latest bar: above or below the 20-bar mean, for how many bars, ranked by distance."""
    from ..functions.windows import W, crosses_down, crosses_up, persist_sign, run_length, sma

    d = candles.hourly(spark, sf_dir).withColumn("m", sma("close", 20))
    event = F.when(crosses_up(F.col("close"), F.col("m")), 1).when(crosses_down(F.col("close"), F.col("m")), -1).otherwise(0)
    d = d.withColumn("event", event).withColumn("signal", persist_sign("event"))
    d = run_length(d, F.col("signal"), "bars").withColumn("back", F.row_number().over(W().orderBy(F.desc("ts"))))
    d = d.where("back = 1").withColumn("distance", r6(F.try_divide(F.col("close"), F.col("m")) - 1))
    return d.select("symbol", "ts", "signal", F.col("bars").cast("long").alias("bars"), "distance").orderBy(F.abs("distance").desc(), "symbol").limit(20)


QUERIES["sma_cross_rank"] = _cross_rank
ORACLES["sma_cross_rank"] = o.query(
    o.HOURLY,
    f"a AS (SELECT *, {guarded('avg(close)', 'close', 20)} AS m FROM c), b AS (SELECT *, CASE WHEN close > m AND {o.lag('close')} <= {o.lag('m')} THEN 1 WHEN close < m AND {o.lag('close')} >= {o.lag('m')} THEN -1 END AS e FROM a), d AS (SELECT *, coalesce(last_value(e IGNORE NULLS) {_up}, 0) AS signal FROM b), f AS (SELECT *, CASE WHEN signal = {o.lag('signal')} THEN 0 ELSE 1 END AS ch FROM d), g AS (SELECT *, sum(ch) {_up} AS grp FROM f), h AS (SELECT *, row_number() OVER (PARTITION BY symbol, grp ORDER BY ts) AS bars, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM g)",
    select=f"SELECT symbol, ts, CAST(signal AS INTEGER) AS signal, CAST(bars AS BIGINT) AS bars, {o.r6('close / nullif(m, 0) - 1')} AS distance FROM h WHERE back = 1 ORDER BY abs(distance) DESC, symbol LIMIT 20",
)

"""Queries of clustering, votes, metrics, pairs, portfolio, back-tests, labels and models, with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.windows import r6
from ..operators import backtest, engine, labels, models, pairs, portfolio, quant, relational, sampling, spc, voting
from ..operators import indicators as ind
from ..operators.atc import ma_signal
from ..sources import candles
from . import oracle_text as o
from .indicator_queries import _TR, _atr, _pct, _up, guarded

QUERIES, ORACLES = {}, {}
R = o.r6


def add(name, fn, oracle=None):
    """``fn`` takes candles by the hour; doubles of its result are rounded."""

    def run(spark, sf_dir):
        df = fn(candles.hourly(spark, sf_dir))
        return df.select(*[r6(c).alias(c) if k == "double" else F.col(c).cast("long").alias(c) if k == "bigint" else F.col(c) for c, k in df.dtypes])

    QUERIES[name] = run
    if oracle:
        ORACLES[name] = oracle


def q(select, *ctes, recursive=False):
    return o.query(o.HOURLY, *ctes, select=select, recursive=recursive)


# --- clustering: two features whose oracles need no recursion
_TWO = ("zscore", "mar")
_N = 60


def _clustered(d):
    return spc.cluster(ind.moving_average_ratio(ind.z_score(d)), _TWO, _N)


def _center(x):
    mid = guarded(f"avg({x})", x, _N)
    lo, hi = (f"CASE WHEN count({x}) {o.over(_N)} = {_N} THEN list_sort(list({x}) {o.over(_N)})[{int((_N - 1) * p) + 1}] END" for p in (0.05, 0.95))
    return f"(({lo}) + ({mid})) / 2 AS {x}0, (({hi}) + ({mid})) / 2 AS {x}1"


_SPC = [
    f"f AS (SELECT *, (close - avg(close) {o.over(20)}) / nullif(stddev_samp(close) {o.over(20)}, 0) AS zscore, close / nullif({guarded('avg(close)', 'close', 14)}, 0) AS mar FROM c)",
    f"k AS (SELECT *, {_center('zscore')}, {_center('mar')} FROM f)", "d AS (SELECT *, (abs(zscore - zscore0) + abs(mar - mar0)) / 2 AS d0, (abs(zscore - zscore1) + abs(mar - mar1)) / 2 AS d1 FROM k)",
    "l AS (SELECT *, CASE WHEN d0 IS NULL OR d1 IS NULL THEN NULL WHEN d0 <= d1 THEN 0 ELSE 1 END AS cl, least(d0, d1) AS dn, greatest(d0, d1) AS df FROM d)",
    "e AS MATERIALIZED (SELECT *, 1 - cl AS sec, CASE WHEN cl IS NULL THEN NULL WHEN dn = 0 AND df = 0 THEN 0.5 ELSE coalesce(dn / nullif(dn + df, 0), 0) END AS rel FROM l), s AS MATERIALIZED (SELECT *, cl + (sec - cl) * rel AS rc, 1 - 2 * rel AS conf FROM e)",
]
add("spc_clusters", lambda d: _clustered(d).select("symbol", "ts", "cluster", "rel_pos", "real_clust", "confidence"), q(f"SELECT symbol, ts, {R('cl')} AS cluster, {R('rel')} AS rel_pos, {R('rc')} AS real_clust, {R('conf')} AS confidence FROM s", *_SPC))
add(
    "spc_stability", lambda d: spc.stabilize(_clustered(d)).select("symbol", "ts", "stable"),
    q(f"SELECT n.symbol, n.ts, {R('r.c')} AS stable FROM n JOIN r ON r.symbol = n.symbol AND r.i = n.i", *_SPC,
      o.recursion("s", {"c": "cl", "k": "1"}, {"c": "CASE WHEN r.c IS NULL THEN n.cl WHEN n.cl = r.c THEN r.c WHEN r.k >= 3 AND n.conf >= 0.6 THEN n.cl ELSE r.c END", "k": "CASE WHEN r.c IS NULL THEN 1 WHEN n.cl = r.c THEN r.k + 1 WHEN r.k >= 3 AND n.conf >= 0.6 THEN 1 ELSE r.k + 1 END"}), recursive=True),
)
_c01 = lambda x: f"greatest(0.0, least(1.0, {x}))"
_t = lambda x: f"coalesce({x}, false)"
add(
    "spc_cluster_transition", lambda d: spc.transition_strategy(_clustered(d)).select("symbol", "ts", "signal", "strength"),
    q(f"SELECT symbol, ts, CAST(CASE WHEN up THEN 1 WHEN dwn THEN -1 WHEN ov THEN 1 WHEN un THEN -1 ELSE 0 END AS INTEGER) AS signal, {R('CASE WHEN up OR dwn THEN st WHEN ov OR un THEN st * 0.8 ELSE 0 END')} AS strength FROM z", *_SPC,
      f"y AS (SELECT *, ({_c01('abs(rc - ' + o.lag('rc') + ')')} + 1 - least(rel, 1.0)) / 2 AS st0, rc - {o.lag('rc')} AS drc, {_pct(1)} AS pc, {o.lag('cl')} AS pcl, {o.lag('rc')} AS prl FROM s), y2 AS (SELECT *, CASE WHEN drc IS NOT NULL THEN st0 END AS st FROM y)",
      f"z AS (SELECT *, {_t('cl > pcl AND pc > 0 AND st >= 0.3')} AS up, {_t('cl < pcl AND pc < 0 AND st >= 0.3')} AS dwn, {_t('prl < 0.5 AND rc >= 0.5 AND st >= 0.3')} AS ov, {_t('prl > 0.5 AND rc <= 0.5 AND st >= 0.3')} AS un FROM y2)"),
)
_DUR = f"u1 AS (SELECT *, CASE WHEN cl IS NOT DISTINCT FROM {o.lag('cl')} AND lag(ts) OVER {o.W} IS NOT NULL THEN 0 ELSE 1 END AS ch FROM s), u2 AS (SELECT *, sum(ch) {_up} AS g FROM u1), u3 AS (SELECT *, row_number() OVER (PARTITION BY symbol, g ORDER BY ts) AS dur FROM u2)"
add(
    "spc_regime_following", lambda d: spc.regime_strategy(_clustered(d)).select("symbol", "ts", "signal", "strength"),
    q(f"SELECT symbol, ts, CAST(CASE WHEN up THEN 1 WHEN dwn THEN -1 ELSE 0 END AS INTEGER) AS signal, {R('CASE WHEN up THEN (st + rc) / 2 WHEN dwn THEN (st + 1 - rc) / 2 ELSE 0 END')} AS strength FROM z", *_SPC, _DUR,
      f"y AS (SELECT *, {_pct(5)} AS mo, 1 - coalesce(rel, 0.5) AS st FROM u3), z AS (SELECT *, {_t('st >= 0.7 AND dur >= 2 AND cl = 1 AND rc >= 0.5 AND mo >= 0')} AS up, {_t('st >= 0.7 AND dur >= 2 AND cl = 0 AND rc <= 0.5 AND mo <= 0')} AS dwn FROM y)"),
)
add(
    "spc_mean_reversion", lambda d: spc.reversion_strategy(_clustered(d)).select("symbol", "ts", "signal", "strength"),
    q(f"SELECT symbol, ts, CAST(CASE WHEN dwn THEN -1 WHEN up THEN 1 ELSE 0 END AS INTEGER) AS signal, {R('CASE WHEN dwn THEN hig WHEN up THEN lw ELSE 0 END')} AS strength FROM y5", *_SPC,
      f"y1 AS (SELECT *, {_t('rc <= 0.2 OR rc >= 0.8')} AS ex, 1 - least(abs(rc - 0.5), 1.0) AS nr, count(*) {o.over(4)} = 4 AND close > min(close) {o.over(4)} AS tu, count(*) {o.over(4)} = 4 AND close < max(close) {o.over(4)} AS td FROM s), y2 AS (SELECT *, CASE WHEN ex = lag(ex) OVER {o.W} THEN 0 ELSE 1 END AS ch FROM y1), y3 AS (SELECT *, sum(ch) {_up} AS gg FROM y2)",
      f"y4 AS (SELECT *, row_number() OVER (PARTITION BY symbol, gg ORDER BY ts) AS dur, (nr + 1 - rc / 0.2) / 2 AS lw, (nr + (rc - 0.8) / 0.2) / 2 AS hig FROM y3), y5 AS (SELECT *, {_t('ex AND dur >= 3 AND rc <= 0.2 AND tu AND lw >= 0.4')} AS up, {_t('ex AND dur >= 3 AND rc >= 0.8 AND td AND hig >= 0.4')} AS dwn FROM y4)"),
)
add("spc_all_features", lambda d: spc.cluster(spc.features(d), lookback=100).select("symbol", "ts", "cluster", "real_clust"))
add("spc_multi_timeframe", lambda d: spc.multi_timeframe(_clustered(d), spc.cluster(ind.moving_average_ratio(ind.z_score(candles.resample(d, "day"), 5), 3), _TWO, 10)).where("cluster IS NOT NULL"))


def _three(d):
    t = _clustered(d)
    out = None
    for n, fn in spc.STRATEGIES.items():
        one = fn(t).select("symbol", "ts", F.col("signal").alias(f"{n}_signal"), F.col("strength").alias(f"{n}_strength"))
        out = one if out is None else out.join(one, ["symbol", "ts"])
    return out


add("spc_vote", lambda d: spc.aggregate_votes(_three(d), {"cluster_transition": 0.68, "regime_following": 0.66, "mean_reversion": 0.64}).select("symbol", "ts", "vote", "vote_strength"))

# --- votes: signals from plain crossings of three averages
_V = lambda d: d.withColumns({f"m{n}": F.when(F.col("close") > F.avg("close").over(Window.partitionBy("symbol").orderBy("ts").rowsBetween(-n + 1, 0)), 1).otherwise(0) for n in (5, 20, 50)})
_VS = "v AS (SELECT symbol, ts, " + ", ".join(f"CASE WHEN close > avg(close) {o.over(n)} THEN 1 ELSE 0 END AS m{n}" for n in (5, 20, 50)) + " FROM c)"
_IMP = {"m5": 0.65, "m20": 0.70, "m50": 0.68}
_WT = [0.65 / 2.03, 0.70 / 2.03, 0.68 / 2.03]
add(
    "decision_matrix_vote", lambda d: voting.cumulative_vote(_V(d), _IMP).select("symbol", "ts", "score", "votes", "vote", voting.vote_source(list(_IMP)).alias("source")),
    q(f"SELECT symbol, ts, {R(' + '.join(f'm{n} * {w!r}' for n, w in zip((5, 20, 50), _WT, strict=True)))} AS score, m5 + m20 + m50 AS votes, CASE WHEN m5 + m20 + m50 >= 2 AND {' + '.join(f'm{n} * {w!r}' for n, w in zip((5, 20, 50), _WT, strict=True))} >= 0.5 THEN 1 ELSE 0 END AS vote, CASE m5 + m20 + m50 WHEN 3 THEN 'ALL' WHEN 2 THEN 'MAJORITY' ELSE 'WEIGHTED' END AS source FROM v", _VS),
)
add(
    "hybrid_filter", lambda d: voting.hybrid_filter(_V(d).select("symbol", F.col("m5").alias("atc"), F.col("m20").alias("oscillator"), F.col("m50").alias("spc"), "ts"), False).select("symbol", "ts", "atc"),
    q("SELECT symbol, ts, m5 AS atc FROM v WHERE m5 != 0 AND m20 = m5 AND (m50 = m5 OR m50 = 0)", _VS),
)
_conf = lambda d: _V(d).select("symbol", "ts", *[(F.col(f"m{n}") * 2 - 1).alias(f"m{n}_signal") for n in (5, 20, 50)], *[F.lit(0.5 + n / 200).alias(f"m{n}_confidence") for n in (5, 20, 50)])
add(
    "signal_majority", lambda d: voting.majority(_conf(d), ["m5", "m20", "m50"], 2).select("symbol", "ts", "signal", "confidence"),
    q(f"SELECT symbol, ts, CASE WHEN m5 + m20 + m50 >= 2 THEN 1 ELSE -1 END AS signal, {R('CASE WHEN m5 + m20 + m50 >= 2 THEN (m5 * 0.525 + m20 * 0.6 + m50 * 0.75) / (m5 + m20 + m50) ELSE ((1 - m5) * 0.525 + (1 - m20) * 0.6 + (1 - m50) * 0.75) / (3 - m5 - m20 - m50) END')} AS confidence FROM v", _VS),
)
add("signal_highest_confidence", lambda d: voting.highest_confidence(_conf(d), ["m5", "m20", "m50"]).select("symbol", "ts", "signal", "confidence"), q(f"SELECT symbol, ts, m50 * 2 - 1 AS signal, {R('0.75')} AS confidence FROM v", _VS))
_MTF = "x(timeframe, n, w) AS (VALUES ('15m', 5, 0.2), ('30m', 20, 0.3), ('1h', 50, 0.5)), t AS (SELECT symbol, timeframe, w, 0.5 + n / 200.0 AS conf, CASE WHEN (CASE n WHEN 5 THEN arg_max(m5, ts) WHEN 20 THEN arg_max(m20, ts) ELSE arg_max(m50, ts) END) = 1 THEN 'LONG' ELSE 'SHORT' END AS signal FROM v, x GROUP BY symbol, timeframe, n, w)"


def _mtf(d):
    last = _V(d).groupBy("symbol").agg(*[F.max_by(f"m{n}", "ts").alias(f"m{n}") for n in (5, 20, 50)])
    rows = F.explode(F.array(*[F.struct(F.lit(tf).alias("timeframe"), F.when(F.col(f"m{n}") == 1, "LONG").otherwise("SHORT").alias("signal"), F.lit(0.5 + n / 200).alias("confidence")) for tf, n in (("15m", 5), ("30m", 20), ("1h", 50))])).alias("t")
    return voting.timeframe_vote(last.select("symbol", rows).select("symbol", "t.*"))


add("multi_timeframe_vote", _mtf, q(f"SELECT symbol, CASE WHEN sum(CASE WHEN signal = 'LONG' THEN w ELSE 0 END ORDER BY timeframe) / sum(w ORDER BY timeframe) > 0.5 THEN 'LONG' WHEN sum(CASE WHEN signal = 'SHORT' THEN w ELSE 0 END ORDER BY timeframe) / sum(w ORDER BY timeframe) > 0.5 THEN 'SHORT' ELSE 'NONE' END AS signal, {R('sum(w * conf) / sum(w)')} AS confidence FROM t GROUP BY symbol", _VS, _MTF))
add(
    "similar_rows", lambda d: voting.similar_rows(d.withColumn("label", (F.col("close") > F.col("open")).cast("int")), d.groupBy("symbol").agg(F.max_by("close", "ts").alias("close"), F.max_by("high", "ts").alias("high")), {"close": 10.0, "high": 20.0}),
    q(f"SELECT l.symbol, count_if(c.close > c.open)::BIGINT AS passed, count_if(c.close <= c.open)::BIGINT AS failed, {R('coalesce(count_if(c.close > c.open) / nullif(count(c.ts), 0), 0.5)')} AS share FROM l LEFT JOIN c ON c.symbol = l.symbol AND abs(c.close - l.close) <= 10 AND abs(c.high - l.high) <= 20 GROUP BY l.symbol", "l AS (SELECT symbol, arg_max(close, ts) AS close, arg_max(high, ts) AS high FROM c GROUP BY symbol)"),
)

# --- metrics and pairs: every two event types
_ALIGN = """p AS (SELECT a.symbol AS long_symbol, b.symbol AS short_symbol, a.ts, a.close AS y, b.close AS x FROM c a JOIN c b ON a.ts = b.ts AND a.symbol < b.symbol),
j AS (SELECT *, y / nullif(lag(y) OVER pw, 0) - 1 AS ry, x / nullif(lag(x) OVER pw, 0) - 1 AS rx FROM p WINDOW pw AS (PARTITION BY long_symbol, short_symbol ORDER BY ts))"""


def _all_pairs(d):
    s = d.select("symbol").distinct()
    return s.select(F.col("symbol").alias("long_symbol")).join(s.select(F.col("symbol").alias("short_symbol")), F.col("long_symbol") < F.col("short_symbol"))


def _spread(d):
    j = pairs.aligned(d, _all_pairs(d))
    b = j.groupBy(*pairs.KEYS).agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"))
    return j.join(b, pairs.KEYS).withColumn("spread", F.col("y") - F.col("b") * F.col("x") - F.col("a"))


_SPREAD = "b AS (SELECT long_symbol, short_symbol, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM j GROUP BY ALL), sp AS MATERIALIZED (SELECT j.*, y - b.b * x - b.a AS spread FROM j JOIN b USING (long_symbol, short_symbol))"
_PW = "OVER (PARTITION BY long_symbol, short_symbol ORDER BY ts)"
add(
    "pair_regression", lambda d: pairs.aligned(d, _all_pairs(d)).groupBy(*pairs.KEYS).agg(F.count("ry").alias("points"), F.corr("ry", "rx").alias("correlation"), F.regr_slope("y", "x").alias("ols_beta"), F.regr_intercept("y", "x").alias("ols_alpha")),
    q(f"SELECT long_symbol, short_symbol, count(ry)::BIGINT AS points, {R('corr(ry, rx)')} AS correlation, {R('regr_slope(y, x)')} AS ols_beta, {R('regr_intercept(y, x)')} AS ols_alpha FROM j GROUP BY ALL", _ALIGN),
)
add(
    "spread_metrics", lambda d: quant.spread_metrics(_spread(d), pairs.KEYS).select(*pairs.KEYS, "n", "std", "skew", "kurt", "current_zscore", "half_life", "max_drawdown", "sharpe", "calmar"),
    q(f"""SELECT long_symbol, short_symbol, count(spread)::BIGINT AS n, {R('stddev_samp(spread)')} AS std, {R('skewness(spread)')} AS skew, {R('kurtosis(spread)')} AS kurt, {R('(arg_max(spread, ts) - avg(spread)) / stddev_samp(spread)')} AS current_zscore,
      {R('CASE WHEN regr_slope(d, p) < 0 AND -ln(2) / regr_slope(d, p) <= 50 THEN -ln(2) / regr_slope(d, p) END')} AS half_life, {R('min(spread - peak)')} AS max_drawdown, {R('avg(d) / stddev_samp(d) * sqrt(8760)')} AS sharpe, {R('avg(d) * 8760 / abs(min(spread - peak))')} AS calmar FROM t GROUP BY ALL""",
      _ALIGN, _SPREAD, f"t0 AS (SELECT *, lag(spread) {_PW} AS p, max(spread) OVER (PARTITION BY long_symbol, short_symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS peak FROM sp), t AS (SELECT *, spread - p AS d FROM t0)"),
)
add(
    "hurst_exponent", lambda d: quant.hurst(d, ["symbol"], "close", 30),
    q(f"SELECT symbol, {R('greatest(0.0, least(2.0, 2 * regr_slope(ln(sqrt(s)), ln(k))))')} AS hurst FROM h GROUP BY symbol", f"l AS (SELECT unnest(range(2, 30)) AS k), n AS (SELECT *, row_number() OVER {o.W} AS i FROM c), z AS (SELECT a.symbol, k, stddev_pop(a.close - b.close) AS s FROM n a, l, n b WHERE b.symbol = a.symbol AND b.i = a.i - k GROUP BY a.symbol, k), h AS (SELECT * FROM z WHERE s > 0)"),
)
add(
    "direction_metrics", lambda d: quant.direction_metrics(_spread(d).withColumn("z", (F.col("spread") - F.avg("spread").over(Window.partitionBy(*pairs.KEYS))) / F.stddev_samp("spread").over(Window.partitionBy(*pairs.KEYS))), pairs.KEYS, "z"),
    q(f"SELECT long_symbol, short_symbol, {R('tp / nullif(tp + fp, 0)')} AS precision, {R('tp / nullif(tp + fn, 0)')} AS recall, {R('2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / nullif(tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0), 0)')} AS f1, {R('ok / n')} AS accuracy FROM g WHERE n >= 20", _ALIGN, _SPREAD,
      f"z0 AS (SELECT *, (spread - avg(spread) OVER (PARTITION BY long_symbol, short_symbol)) / stddev_samp(spread) OVER (PARTITION BY long_symbol, short_symbol) AS z, lead(spread) {_PW} - spread AS nxt FROM sp), z1 AS (SELECT *, CASE WHEN z > 0.5 THEN -1 WHEN z < -0.5 THEN 1 END AS pr, sign(nxt) AS re FROM z0), g AS (SELECT long_symbol, short_symbol, count(*) AS n, count_if(pr = 1 AND re = 1)::DOUBLE AS tp, count_if(pr = 1 AND re != 1) AS fp, count_if(pr = -1 AND re = 1) AS fn, count_if(pr = re)::DOUBLE AS ok FROM z1 WHERE pr IS NOT NULL AND nxt IS NOT NULL GROUP BY ALL)"),
)
add(
    "kalman_hedge_ratio", lambda d: quant.kalman_hedge(pairs.aligned(d, _all_pairs(d)), pairs.KEYS, "y", "x"),
    o.query(
        o.HOURLY, _ALIGN, f"n AS (SELECT *, row_number() {_PW} AS i FROM j)",
        f"r(long_symbol, short_symbol, i, b, a, p11, p12, p22) AS (SELECT DISTINCT long_symbol, short_symbol, CAST(0 AS BIGINT), 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE FROM n UNION ALL SELECT long_symbol, short_symbol, i, b + k1 / f * e, a + k2 / f * e, m11 - k1 / f * k1, m12 - k1 / f * k2, m22 - k2 / f * k2 FROM (SELECT *, m11 * x + m12 AS k1, m12 * x + m22 AS k2, x * (m11 * x + m12) + m12 * x + m22 + 1 AS f FROM (SELECT n.long_symbol, n.short_symbol, n.i, r.b, r.a, r.p11 + {1e-5 / (1 - 1e-5)!r} AS m11, r.p12 AS m12, r.p22 + {1e-5 / (1 - 1e-5)!r} AS m22, n.y - (r.b * n.x + r.a) AS e, n.x AS x FROM r JOIN n ON n.long_symbol = r.long_symbol AND n.short_symbol = r.short_symbol AND n.i = r.i + 1) q1) q2)",
        select=f"SELECT long_symbol, short_symbol, {R('arg_max(b, i)')} AS kalman_beta FROM r GROUP BY ALL", recursive=True),
)
add("adf_test", lambda d: quant.adf(d, ["symbol"], "close"))
add("johansen_test", lambda d: quant.johansen(pairs.aligned(d, _all_pairs(d)), pairs.KEYS, "y", "x"))
_PERF = "nw AS (SELECT symbol, max(ts) AS now, arg_max(close, ts) AS price, count(*) AS n FROM c GROUP BY symbol HAVING count(*) >= 168), pf AS (SELECT c.symbol, any_value(price) AS price, arg_max(close, c.ts) FILTER (c.ts <= now - INTERVAL 1 DAY) AS p1, arg_max(close, c.ts) FILTER (c.ts <= now - INTERVAL 3 DAY) AS p3, arg_max(close, c.ts) FILTER (c.ts <= now - INTERVAL 7 DAY) AS p7 FROM c JOIN nw USING (symbol) GROUP BY c.symbol), rt AS (SELECT symbol, coalesce((price - p1) / nullif(p1, 0), 0) AS r1d, coalesce((price - p3) / nullif(p3, 0), 0) AS r3d, coalesce((price - p7) / nullif(p7, 0), 0) AS r1w FROM pf), sc AS (SELECT *, 0.5 * r1d + 0.3 * r3d + 0.2 * r1w AS score FROM rt)"
add("performance_rank", lambda d: pairs.ranked(pairs.performance(d)), q(f"SELECT symbol, {R('r1d')} AS r1d, {R('r3d')} AS r3d, {R('r1w')} AS r1w, {R('score')} AS score, CAST(row_number() OVER (ORDER BY score DESC, symbol) AS INTEGER) AS rank FROM sc", _PERF))
add(
    "pair_candidates", lambda d: pairs.candidates(pairs.performance(d)).select("long_symbol", "short_symbol", "spread"),
    q(f"SELECT a.symbol AS long_symbol, b.symbol AS short_symbol, {R('abs(b.score - a.score)')} AS spread FROM (SELECT * FROM sc ORDER BY score, symbol LIMIT 3) a JOIN (SELECT * FROM sc ORDER BY score DESC, symbol LIMIT 3) b ON a.symbol != b.symbol", _PERF),
)
add("pair_metrics_scored", lambda d: pairs.valid(pairs.opportunity_score(pairs.quantitative_score(pairs.pair_metrics(d, pairs.candidates(pairs.performance(d))).join(pairs.candidates(pairs.performance(d)).select(*pairs.KEYS, "spread"), pairs.KEYS)))).select(*pairs.KEYS, "correlation", "half_life", "quant_score", "opportunity"))
add("pairs_validated", lambda d: pairs.valid(pairs.opportunity_score(pairs.quantitative_score(pairs.pair_metrics(d, pairs.candidates(pairs.performance(d))).join(pairs.candidates(pairs.performance(d)).select(*pairs.KEYS, "spread"), pairs.KEYS))), 0.001, 5.0, 0.0, 0.95, True, 40.0, 0.9, -0.15, 340.0, 30.0).select(*pairs.KEYS, "correlation", "half_life", "quant_score", "opportunity"))
add("pairs_unique_selection", lambda d: relational.greedy_unique_pairs(pairs.candidates(pairs.performance(d)).withColumn("score", F.col("spread")), 4))
add(
    "pairs_by_target", lambda d: pairs.by_target(pairs.candidates(pairs.performance(d)).select("long_symbol", "short_symbol", F.col("spread").alias("score")), d.select("symbol").distinct()),
    q(f"SELECT target, long_symbol, short_symbol, {R('score')} AS score FROM (SELECT c.symbol AS target, ca.*, row_number() OVER (PARTITION BY c.symbol ORDER BY ca.score DESC, long_symbol, short_symbol) AS rn FROM (SELECT DISTINCT symbol FROM c) c JOIN ca ON c.symbol IN (long_symbol, short_symbol)) WHERE rn = 1", _PERF,
      "ca AS (SELECT a.symbol AS long_symbol, b.symbol AS short_symbol, abs(b.score - a.score) AS score FROM (SELECT * FROM sc ORDER BY score, symbol LIMIT 3) a JOIN (SELECT * FROM sc ORDER BY score DESC, symbol LIMIT 3) b ON a.symbol != b.symbol)"),
)
add(
    "confusion_by_threshold", lambda d: quant.confusion_at(d.select((F.col("close") / (F.col("close") + F.col("open"))).alias("s"), (F.col("high") > 100).cast("int").alias("y")), "s", "y", [0.3, 0.5, 0.7]),
    q(f"SELECT t AS threshold, count(*)::BIGINT AS n, count_if(high > 100)::BIGINT AS hits, {R('count_if(high > 100) / count(*)')} AS precision FROM c, (VALUES (0.3::DOUBLE), (0.5), (0.7)) v(t) WHERE close / (close + open) >= t GROUP BY t"),
)
add("threshold_search", lambda d: quant.best_threshold(d.withColumns({"s": F.try_divide(F.col("close") - F.col("open"), F.col("open")), "r": F.lead("close").over(Window.partitionBy("symbol").orderBy("ts")) / F.col("close") - 1}), "s", "r", [0.01 * k for k in range(1, 15)]))

# --- portfolio
_POS = "SELECT * FROM VALUES ('click', 'LONG', 100D, 1000D), ('view', 'SHORT', 90D, 500D), ('purchase', 'LONG', 80D, 700D) AS t(symbol, direction, entry_price, size_usdt)"
_POSQ = "po(symbol, direction, entry_price, size_usdt) AS (VALUES ('click', 'LONG', 100.0::DOUBLE, 1000.0::DOUBLE), ('view', 'SHORT', 90.0, 500.0), ('purchase', 'LONG', 80.0, 700.0))"
_RET = f"rr AS (SELECT symbol, ts, close, {_pct(1)} AS r FROM c)"
pos = lambda d: d.sparkSession.sql(_POS)
add(
    "portfolio_beta", lambda d: portfolio.beta(d, "view"),
    q(f"SELECT symbol, {R("CASE WHEN symbol = 'view' THEN 1 ELSE covar_samp(r, m) / nullif(var_samp(m), 0) END")} AS beta FROM bj WHERE r IS NOT NULL AND m IS NOT NULL GROUP BY symbol HAVING count(*) >= 50", _RET, "bj AS (SELECT rr.*, b.r AS m FROM rr JOIN rr b ON b.symbol = 'view' AND b.ts = rr.ts)"),
)
_SG = "CASE direction WHEN 'LONG' THEN 1 ELSE -1 END"
_PX = "px AS (SELECT symbol, arg_max(close, ts) AS price FROM c GROUP BY symbol)"
add(
    "portfolio_pnl", lambda d: portfolio.profit(pos(d), d, portfolio.beta(d, "view")).select("symbol", "direction", "pnl", "delta"),
    q(f"SELECT symbol, direction, {R(_SG + ' * (price - entry_price) / entry_price * size_usdt')} AS pnl, {R(_SG + ' * size_usdt')} AS delta FROM po JOIN px USING (symbol)", _POSQ, _PX),
)
add(
    "value_at_risk", lambda d: portfolio.value_at_risk(d, pos(d)),
    q(f"SELECT {R('greatest(0, -quantile_cont(x, 0.05))')} AS value_at_risk, count(*)::BIGINT AS n FROM l", _POSQ, _RET, f"v AS (SELECT ts, sum({_SG} * size_usdt * r) AS x FROM rr JOIN po USING (symbol) WHERE r IS NOT NULL GROUP BY ts), l AS (SELECT * FROM v ORDER BY ts DESC LIMIT 60)"),
)
_COR = "co AS (SELECT a.symbol AS a, b.symbol AS b, corr(a.r, b.r) AS corr FROM rr a JOIN rr b ON a.ts = b.ts AND a.symbol < b.symbol WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY ALL HAVING count(*) >= 20)"
add("return_correlations", lambda d: portfolio.correlations(d).select("a", "b", "corr"), q(f"SELECT a, b, {R('corr')} AS corr FROM co", _RET, _COR))
add(
    "weighted_correlation", lambda d: portfolio.weighted_correlation(d, pos(d)),
    q(f"SELECT {R('sum(corr * sa * sb * (wa + wb)) / sum(wa + wb)')} AS correlation, count(*)::BIGINT AS n_pairs FROM z", _POSQ, _RET, _COR, f"z AS (SELECT corr, {_SG.replace('direction', 'p.direction')} AS sa, {_SG.replace('direction', 'q.direction')} AS sb, p.size_usdt AS wa, q.size_usdt AS wb FROM co JOIN po p ON p.symbol = a JOIN po q ON q.symbol = b)"),
)
add("hedge_candidates", lambda d: portfolio.hedge_candidates(d, pos(d)))
add("correlation_impact", lambda d: portfolio.correlation_impact(d, pos(d), d.sparkSession.sql("SELECT 'signup' AS symbol, 'SHORT' AS direction, 50D AS entry_price, 300D AS size_usdt")))
add("hedge_size", lambda d: portfolio.hedge_size(portfolio.profit(pos(d), d, portfolio.beta(d, "view")), portfolio.beta(d, "view"), "click"))
def _held(d):
    """A position a symbol, by its newest candle."""
    last = spc.latest(d, ["open", "close", "volume"])
    return last.select("symbol", F.when(F.col("close") >= F.col("open"), "LONG").otherwise("SHORT").alias("direction"), F.col("close").alias("entry_price"), F.col("volume").alias("size_usdt"))


add("position_totals", lambda d: portfolio.totals(_held(d)))
add(
    "atr_targets", lambda d: portfolio.atr_targets(spc.latest(ind.atr(d), ["close", "atr"])),
    q(f"SELECT symbol, side, CAST(k AS INTEGER) AS k, {R('close + sg * k * atr')} AS target FROM (SELECT n.symbol, arg_max(n.close, n.ts) AS close, arg_max(coalesce(r.m, n.close * 0.01), n.ts) AS atr FROM n JOIN r ON r.symbol = n.symbol AND r.i = n.i GROUP BY n.symbol) t, (VALUES ('UP', 1), ('DOWN', -1)) s(side, sg), (VALUES (1), (2), (3)) k(k)", _TR, _atr(14), recursive=True),
)
_PIV = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"
add(
    "pivot_levels", lambda d: portfolio.pivot_view(portfolio.pivots(d), spc.latest(d, ["close"])).select("symbol", "ts", "kind", "distance", "percent", "side", "near"),
    q(f"SELECT symbol, ts, kind, {R('level - price')} AS distance, {R('(level - price) * 100 / price')} AS percent, CASE WHEN level > price THEN 'ABOVE' ELSE 'BELOW' END AS side, CASE WHEN abs((level - price) * 100 / price) <= 5 THEN 1 ELSE 0 END AS near FROM u JOIN px USING (symbol)", _PX,
      f"w AS (SELECT *, count(*) {_PIV} = 5 AS fu, max(high) {_PIV} AS mh, min(low) {_PIV} AS ml FROM c), u AS (SELECT symbol, ts, 'HIGH' AS kind, high AS level FROM w WHERE fu AND high = mh UNION ALL SELECT symbol, ts, 'LOW', low FROM w WHERE fu AND low = ml)"),
)


# --- back-tests: entries at crossings of the 20-bar mean
def _signalled(d):
    return d.withColumn("m", F.avg("close").over(Window.partitionBy("symbol").orderBy("ts").rowsBetween(-19, 0))).withColumn("signal", ma_signal(F.col("close"), F.col("m"))).drop("m")


_SIG = f"sg0 AS (SELECT *, avg(close) {o.over(20)} AS m FROM c), sg AS (SELECT *, CASE WHEN close > m AND {o.lag('close')} <= {o.lag('m')} THEN 1 WHEN close < m AND {o.lag('close')} >= {o.lag('m')} THEN -1 ELSE 0 END AS signal, lead(ts) OVER {o.W} IS NULL AS final FROM sg0)"
_WHY = "CASE WHEN r.i0 IS NULL THEN NULL WHEN n.low <= r.px * 0.98 THEN 1 WHEN n.high >= r.px * 1.04 THEN 2 WHEN r.trail IS NOT NULL AND n.close <= r.trail THEN 3 WHEN n.i - r.i0 >= 20 THEN 4 WHEN n.final THEN 5 END"
_OUT = "CASE WHEN r.i0 IS NULL THEN NULL WHEN n.low <= r.px * 0.98 THEN r.px * 0.98 WHEN n.high >= r.px * 1.04 THEN r.px * 1.04 WHEN r.trail IS NOT NULL AND n.close <= r.trail THEN r.trail ELSE n.close END"
_NEW = "(r.i0 IS NULL AND n.signal > 0)"
_BT = o.recursion(
    "sg", {"i0": "CASE WHEN signal > 0 THEN 0 END", "px": "CASE WHEN signal > 0 THEN close END", "best": "CASE WHEN signal > 0 THEN close END", "trail": "NULL", "why": "NULL", "e0": "NULL", "epx": "NULL", "outp": "NULL"},
    {
        "i0": f"CASE WHEN ({_WHY}) IS NOT NULL THEN NULL WHEN {_NEW} THEN CASE WHEN n.final THEN NULL ELSE n.i END ELSE r.i0 END", "px": f"CASE WHEN ({_WHY}) IS NOT NULL THEN NULL WHEN {_NEW} THEN CASE WHEN n.final THEN NULL ELSE n.close END ELSE r.px END",
        "best": f"CASE WHEN ({_WHY}) IS NOT NULL THEN NULL WHEN {_NEW} THEN n.close WHEN n.close > r.best THEN n.close ELSE r.best END", "trail": f"CASE WHEN ({_WHY}) IS NOT NULL OR {_NEW} THEN NULL WHEN r.i0 IS NOT NULL AND n.close > r.best THEN n.close * {1 - 0.015!r} ELSE r.trail END",
        "why": f"CASE WHEN {_NEW} AND n.final THEN 5 ELSE {_WHY} END", "e0": f"CASE WHEN {_NEW} AND n.final THEN n.i ELSE r.i0 END", "epx": f"CASE WHEN {_NEW} AND n.final THEN n.close ELSE r.px END", "outp": f"CASE WHEN {_NEW} AND n.final THEN n.close ELSE {_OUT} END",
    },
)
_TRADES = "tr AS MATERIALIZED (SELECT n.symbol, n.ts, CAST(r.e0 AS INTEGER) AS entry_index, CAST(n.i AS INTEGER) AS exit_index, r.epx, r.outp, CAST(r.why AS INTEGER) AS why, (r.outp - r.epx) / nullif(r.epx, 0) AS pnl FROM n JOIN r ON r.symbol = n.symbol AND r.i = n.i WHERE r.why IS NOT NULL)"
add(
    "backtest_trades", lambda d: backtest.trades(_signalled(d)).drop("exit_time"),
    q(f"SELECT symbol, entry_index, exit_index, {R('epx')} AS entry_price, {R('outp')} AS exit_price, 'LONG' AS signal_type, ['STOP_LOSS', 'TAKE_PROFIT', 'TRAILING_STOP', 'MAX_HOLD', 'END_OF_DATA'][why] AS exit_reason, {R('pnl')} AS pnl, exit_index - entry_index AS hold_periods FROM tr", _SIG, _BT, _TRADES, recursive=True),
)
add("backtest_trades_short", lambda d: backtest.trades(_signalled(d), "SHORT").drop("exit_time"))
_EQ = f"ef AS (SELECT symbol, ts, sum(ln(1 + 0.01 * pnl)) AS g FROM tr GROUP BY symbol, ts), eq AS MATERIALIZED (SELECT c.symbol, c.ts, 10000 * exp(sum(coalesce(g, 0)) {_up.replace('symbol', 'c.symbol').replace('ORDER BY ts', 'ORDER BY c.ts')}) AS e FROM c LEFT JOIN ef ON ef.symbol = c.symbol AND ef.ts = c.ts)"
add("equity_curve", lambda d: (lambda s: backtest.equity(s, backtest.trades(s)))(_signalled(d)), q(f"SELECT symbol, ts, {R('e')} AS equity FROM eq", _SIG, _BT, _TRADES, _EQ, recursive=True))
add(
    "backtest_metrics", lambda d: (lambda s, t: backtest.metrics(t, backtest.equity(s, t)))(_signalled(d), backtest.trades(_signalled(d))),
    q(f"""SELECT symbol, coalesce(k, 0)::BIGINT AS num_trades, {R('coalesce(wr, 0)')} AS win_rate, {R('coalesce(aw, 0)')} AS avg_win, {R('coalesce(al, 0)')} AS avg_loss, {R('CASE WHEN k IS NULL THEN 0 ELSE tot END')} AS total_return, {R('CASE WHEN k IS NULL THEN 0 ELSE coalesce(sh, 0) END')} AS sharpe, {R('CASE WHEN k IS NULL THEN 0 ELSE md END')} AS max_drawdown, {R('CASE WHEN k IS NULL THEN 0 WHEN lo > 0 THEN ga / lo ELSE ga END')} AS profit_factor
      FROM es LEFT JOIN tg USING (symbol)""", _SIG, _BT, _TRADES, _EQ,
      f"e1 AS (SELECT *, max(e) {_up} AS pk, e / nullif({o.lag('e')}, 0) - 1 AS r FROM eq), es AS (SELECT symbol, arg_max(e, ts) / arg_min(e, ts) - 1 AS tot, avg(r) / nullif(stddev_samp(r), 0) * sqrt(8760) AS sh, min(e - pk) / max(e) * 100 AS md FROM e1 GROUP BY symbol)",
      "tg AS (SELECT symbol, count(*) AS k, count_if(pnl > 0) / count(*) AS wr, avg(pnl) FILTER (pnl > 0) AS aw, -avg(pnl) FILTER (pnl < 0) AS al, coalesce(sum(pnl) FILTER (pnl > 0), 0) AS ga, coalesce(-sum(pnl) FILTER (pnl < 0), 0) AS lo FROM tr GROUP BY symbol)", recursive=True),
)
add("kelly_allocation", lambda d: (lambda s, t: backtest.allocate(backtest.kelly(backtest.metrics(t, backtest.equity(s, t)))))(_signalled(d), backtest.trades(_signalled(d))))

# --- labels, features, splits
_FW = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING)"
add(
    "triple_barrier", lambda d: labels.triple_barrier(d).select("symbol", "ts", "label"),
    q("SELECT symbol, ts, CAST(CASE WHEN len(f) < 24 OR f IS NULL THEN NULL WHEN up IS NULL AND dn IS NULL THEN 0 WHEN dn IS NULL OR up < dn THEN 1 ELSE -1 END AS INTEGER) AS label FROM h", f"g AS (SELECT *, list(close) {_FW} AS f FROM c), h AS (SELECT *, list_min(list_filter(list_transform(f, lambda v, i: CASE WHEN v >= close * 1.02 THEN i END), lambda k: k IS NOT NULL)) AS up, list_min(list_filter(list_transform(f, lambda v, i: CASE WHEN v <= close * 0.99 THEN i END), lambda k: k IS NOT NULL)) AS dn FROM g)"),
)
add("future_returns", lambda d: labels.future_returns(d).select("symbol", "ts", *[f"future_{h}" for h in (1, 5, 24)], "future_log_5"), q("SELECT symbol, ts, " + ", ".join(f"{R(f'lead(close, {h}) OVER {o.W} / nullif(close, 0) - 1')} AS future_{h}" for h in (1, 5, 24)) + f", {R(f'ln(lead(close, 5) OVER {o.W} / nullif(close, 0))')} AS future_log_5 FROM c"))
add(
    "directional_labels", lambda d: labels.directional(d).select("symbol", "ts", "threshold", "label", "target"),
    q(f"SELECT symbol, ts, {R('th')} AS threshold, label, CAST(CASE label WHEN 'DOWN' THEN 0 WHEN 'NEUTRAL' THEN 1 WHEN 'UP' THEN 2 END AS INTEGER) AS target FROM l",
      f"a AS (SELECT *, coalesce({_pct(1)}, 0) AS r, lag(close, 36) OVER {o.W} AS lo0, lag(close, 72) OVER {o.W} AS hi0, lead(close, 24) OVER {o.W} AS fc FROM c), b AS (SELECT *, coalesce(stddev_samp(r) {o.over(20)}, 0.01) AS vol FROM a), d AS (SELECT *, quantile_cont(vol, 0.5) {o.over(50)} AS med FROM b)",
      "e AS (SELECT *, greatest(1.5, least(3.0, coalesce(vol / nullif(med, 0), 2.0))) AS mult, first_value(lo0 IGNORE NULLS) OVER fw AS lo, first_value(hi0 IGNORE NULLS) OVER fw AS hi FROM d WINDOW fw AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), g AS (SELECT *, greatest(0.0, least(1.0, (mult - 1.5) / (1.5 + 1e-8))) AS t FROM e), h AS (SELECT *, lo * (1 - t) + hi * t AS ref FROM g), k AS (SELECT *, greatest(0.01, coalesce(abs((close - ref) / nullif(ref, 0)), 0.01)) AS th, (fc - close) / nullif(close, 0) AS fu FROM h), l AS (SELECT *, CASE WHEN fu >= th THEN 'UP' WHEN fu <= -th THEN 'DOWN' WHEN fu IS NOT NULL THEN 'NEUTRAL' END AS label FROM k)"),
)
add(
    "calendar_features", lambda d: labels.calendar(d).select("symbol", "ts", "hour_sin", "hour_cos", "day_sin", "day_cos", "is_funding_hour", "hours_to_funding", "candle_index"),
    q(f"SELECT symbol, ts, {R('sin(2 * pi() * hour(ts) / 24)')} AS hour_sin, {R('cos(2 * pi() * hour(ts) / 24)')} AS hour_cos, {R('sin(2 * pi() * (isodow(ts) - 1) / 7)')} AS day_sin, {R('cos(2 * pi() * (isodow(ts) - 1) / 7)')} AS day_cos, CASE WHEN hour(ts) IN (0, 8, 16) THEN 1 ELSE 0 END AS is_funding_hour, CAST(hour(ts) % 8 AS INTEGER) AS hours_to_funding, row_number() OVER {o.W} - 1 AS candle_index FROM c"),
)
add("standardized_features", lambda d: labels.standardized(d, ["close", "volume"]).select("symbol", "ts", "close_z", "volume_z"), q("SELECT symbol, ts, " + ", ".join(f"{R(f'coalesce(({x} - avg({x}) OVER (PARTITION BY symbol)) / nullif(stddev_pop({x}) OVER (PARTITION BY symbol), 0), 0)')} AS {x}_z" for x in ("close", "volume")) + " FROM c"))
add("chronological_split", lambda d: labels.split(d).groupBy("symbol", "part").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")), q("SELECT symbol, part, count(*)::BIGINT AS n, min(ts) AS first, max(ts) AS last FROM (SELECT *, CASE WHEN i < floor(k * 0.7::DOUBLE) - 24 THEN 'train' WHEN i < floor(k * 0.7::DOUBLE) THEN 'gap' WHEN i < floor(k * 0.85::DOUBLE) - 24 THEN 'validation' WHEN i < floor(k * 0.85::DOUBLE) THEN 'gap' ELSE 'test' END AS part FROM z) GROUP BY ALL", f"z AS (SELECT *, row_number() OVER {o.W} - 1 AS i, count(*) OVER (PARTITION BY symbol) AS k FROM c)"))
add("walk_forward_folds", lambda d: labels.walk_forward(d).groupBy("symbol", "fold", "part").agg(F.count(F.lit(1)).alias("n")), q("SELECT symbol, CAST(k AS INTEGER) AS fold, CASE WHEN i < 200 + k * 50 THEN 'train' ELSE 'test' END AS part, count(*)::BIGINT AS n FROM z, range(4) t(k) WHERE i >= k * 50 AND i < 250 + k * 50 GROUP BY ALL", f"z AS (SELECT *, row_number() OVER {o.W} - 1 AS i FROM c)"))
add("feature_drift", lambda d: labels.drift(d), q(f"SELECT symbol, {R('(avg(close) FILTER (rn <= 50) - avg(close) FILTER (rn > 50)) / nullif(stddev_samp(close) FILTER (rn > 50), 0)')} AS shift FROM z GROUP BY symbol", "z AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM c)"))
_RETS = f"fr AS (SELECT *, {_pct(1)} AS ret FROM c)"
add(
    "forest_features", lambda d: labels.forest_features(d).select("symbol", "ts", "roc_2", "roc_5", "roc_10", "high_low", "close_open", "ret_std", "ret_skew", "ret_lag_1", "ret_lag_3"),
    q("SELECT symbol, ts, " + ", ".join(f"{R(_pct(n))} AS roc_{n}" for n in (2, 5, 10)) + f", {R('high / nullif(low, 0)')} AS high_low, {R('close / nullif(open, 0)')} AS close_open, {R(guarded('stddev_samp(ret)', 'ret', 10))} AS ret_std, {R(guarded('skewness(ret)', 'ret', 10))} AS ret_skew, {R(o.lag('ret'))} AS ret_lag_1, {R(o.lag('ret', 3))} AS ret_lag_3 FROM fr", _RETS),
)
add(
    "forest_targets", lambda d: labels.forest_targets(d).select("symbol", "ts", "target_3", "target_6", "target_12", "target"),
    q("SELECT symbol, ts, t3 AS target_3, t6 AS target_6, t12 AS target_12, CAST(sign(t3 + t6 + t12) AS INTEGER) AS target FROM v2", _RETS, f"v AS (SELECT *, {guarded('stddev_samp(ret)', 'ret', 20)} AS vol, " + ", ".join(f"lead(close, {h}) OVER {o.W} / nullif(close, 0) - 1 AS f{h}" for h in (3, 6, 12)) + " FROM fr), v2 AS (SELECT *, " + ", ".join(f"CAST(CASE WHEN f{h} IS NULL OR vol IS NULL THEN NULL WHEN f{h} > 0.5 * vol * {h**0.5!r} THEN 1 WHEN f{h} < -0.5 * vol * {h**0.5!r} THEN -1 ELSE 0 END AS INTEGER) AS t{h}" for h in (3, 6, 12)) + " FROM v)"),
)
add("correlated_features", lambda d: labels.correlated_features(d, ["open", "high", "low", "close", "volume"], 0.2), q("SELECT a, b, " + R("corr") + " AS corr FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM c" for i, a in enumerate(("open", "high", "low", "close", "volume")) for b in ("open", "high", "low", "close", "volume")[i + 1 :]) + ") WHERE abs(corr) > 0.2"))
add("sequence_tensors", lambda d: labels.sequences(d, ["close", "volume"], 5).select("symbol", "ts", F.size("sequence").cast("long").alias("n"), F.expr("aggregate(sequence, 0D, (a, v) -> a + v[0])").alias("total")), q(f"SELECT symbol, ts, 5::BIGINT AS n, {R('t')} AS total FROM (SELECT symbol, ts, count(*) {o.over(5)} AS k, sum(close) {o.over(5)} AS t FROM c) WHERE k = 5"))
add("balanced_targets", lambda d: labels.balanced_target(d).select("symbol", "ts", "target"))

# --- models: results depend on library details, so rows only; tests hold them to properties
_COLS = ["roc_2", "roc_5", "roc_10", "high_low", "close_open", "ret_std", "ret_skew"]


def _modelled(d, fit):
    t = labels.split(labels.forest_features(labels.directional(d)), 0.7, 0.1, 24)
    model = fit(t.where("part = 'train'"), _COLS)
    return models.accuracy(models.predict(model, t.where("part = 'test'"), _COLS))


add("forest_accuracy", lambda d: _modelled(d, models.forest))
add("boosted_accuracy", lambda d: _modelled(d, models.boosted))
_bef, _aft = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)", "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)"
_SWING = f"w AS (SELECT *, count(*) {_bef} = 5 AND count(*) {_aft} = 5 AS fu, max(high) {_bef} AS hb, max(high) {_aft} AS ha, min(low) {_bef} AS lb, min(low) {_aft} AS la FROM c), sw AS (SELECT symbol, ts, 'HIGH' AS kind, high AS price FROM w WHERE fu AND high > hb AND high > ha UNION ALL SELECT symbol, ts, 'LOW', low FROM w WHERE fu AND low < lb AND low < la)"
_STATE = "d1 AS (SELECT *, sign(price - lag(price) OVER (PARTITION BY symbol, kind ORDER BY ts)) AS dir FROM sw), d2 AS (SELECT *, last_value(CASE WHEN kind = 'HIGH' THEN dir END IGNORE NULLS) OVER aw AS h, last_value(CASE WHEN kind = 'LOW' THEN dir END IGNORE NULLS) OVER aw AS l FROM d1 WINDOW aw AS (PARTITION BY symbol ORDER BY ts, kind ROWS UNBOUNDED PRECEDING)), st AS (SELECT *, CASE WHEN h > 0 AND l > 0 THEN 2 WHEN h < 0 AND l < 0 THEN 0 ELSE 1 END AS state FROM d2)"
add("hmm_swing_states", lambda d: models.swing_states(d), q(f"SELECT symbol, ts, kind, {R('price')} AS price, state FROM st", _SWING, _STATE))
_HIST = "hs AS (SELECT *, lag(state) OVER (PARTITION BY symbol ORDER BY ts, kind) AS p1, lag(state, 2) OVER (PARTITION BY symbol ORDER BY ts, kind) AS p2 FROM st), tq AS (SELECT symbol, p2 * 3 + p1 AS history, state, count(*) AS n FROM hs WHERE p2 IS NOT NULL GROUP BY ALL)"
add("hmm_high_order_transitions", lambda d: models.transitions(models.swing_states(d), 2), q(f"SELECT symbol, CAST(history AS BIGINT) AS history, state, n::BIGINT AS n, {R('n / sum(n) OVER (PARTITION BY symbol, history)')} AS p FROM tq", _SWING, _STATE, _HIST))
add(
    "hmm_next_state", lambda d: models.next_state(models.swing_states(d)),
    q(f"SELECT symbol, CAST(arg_min(state, row(-p, state)) AS INTEGER) AS predicted, {R('max(p)')} AS p FROM (SELECT symbol, state, n / sum(n) OVER (PARTITION BY symbol) AS p FROM nz) GROUP BY symbol", _SWING, _STATE,
      "nx AS (SELECT *, lag(state) OVER (PARTITION BY symbol ORDER BY ts, kind) AS p1 FROM st), nw AS (SELECT symbol, arg_max(state, row(ts, kind)) AS cur FROM st GROUP BY symbol), nz AS (SELECT nx.symbol, state, count(*) AS n FROM nx JOIN nw ON nw.symbol = nx.symbol AND nx.p1 = nw.cur GROUP BY nx.symbol, state)"),
)
add("hmm_gaussian_states", lambda d: models.hmm_states(d).select("symbol", "ts", "state", "duration"))
add("hmm_durations", lambda d: models.duration_table(models.hmm_states(d)))
add("hmm_duration_clusters", lambda d: models.duration_clusters(models.duration_table(models.hmm_states(d))))
add("hmm_state_rules", lambda d: models.state_rules(models.hmm_states(d)).select(F.array_join("antecedent", ",").alias("antecedent"), F.array_join("consequent", ",").alias("consequent"), "confidence"))


def _strategies(d):
    out = None
    for n, fn in models.STRATEGIES.items():
        one = fn(d).withColumn("weight", F.lit(1.0))
        out = one if out is None else out.unionByName(one)
    return models.strategy_vote(out, "confidence")


add("hmm_strategy_vote", _strategies)
add("indicator_engine", lambda d: (lambda r: r[0].select("symbol", "ts", "adx", "macd", "stoch_k", "atr", "obv", "bb_percent"))(engine.compute(d, "core")))


def _prefilter(d):
    t = _V(d).groupBy("symbol").agg(*[F.max_by(f"m{n}", "ts").alias(f"m{n}") for n in (5, 20, 50)], F.max_by("close", "ts").alias("score"))
    return sampling.prefilter(t.select("symbol", F.col("m5").alias("atc"), F.col("m20").alias("osc"), F.col("m50").alias("spc"), F.col("m20").alias("ml"), "score")).select("symbol", "score")


add("staged_prefilter", _prefilter)

# --- stand-ins, sizes and feature selection
add(
    "approximate_averages", lambda d: ind.approximate_averages(d).select("symbol", "ts", "ema_approx", "lsma_approx", "kama_approx"),
    q(f"SELECT n.symbol, n.ts, {R('n.m')} AS ema_approx, {R('n.m + (n.close - n.l) / 2')} AS lsma_approx, {R('r.k')} AS kama_approx FROM n JOIN r ON r.symbol = n.symbol AND r.i = n.i",
      f"a AS (SELECT *, {guarded('avg(close)', 'close', 14)} AS m, {o.lag('close', 13)} AS l FROM c)", o.recursion("a", {"k": "close"}, {"k": "r.k + 0.1 * (n.close - r.k)"}), recursive=True),
)
add("adaptive_tolerance", lambda d: ind.adaptive_tolerance(d).select("symbol", "ts", "tolerance"), q(f"SELECT symbol, ts, {R(f'0.05 * (1 + coalesce(stddev_samp(ret) {o.over(20)}, 0))')} AS tolerance FROM fr", _RETS))


def _stats(d):
    s = _signalled(d)
    t = backtest.trades(s)
    return backtest.metrics(t, backtest.equity(s, t))


add("position_size", lambda d: backtest.position_size(backtest.kelly(_stats(d))))
add(
    "win_rate_posterior", lambda d: backtest.posterior(_stats(d)),
    q(f"SELECT symbol, {R('a')} AS alpha, {R('b')} AS beta, {R('a / (a + b)')} AS mean, {R('(a - 1) / (a + b - 2)')} AS mode FROM z", _SIG, _BT, _TRADES,
      "g AS (SELECT symbol, count(*) AS k, floor(count_if(pnl > 0) / count(*) * count(*)) AS w FROM tr GROUP BY symbol), z AS (SELECT symbol, 2.0::DOUBLE + w AS a, 2.0::DOUBLE + k - w AS b FROM g)", recursive=True),
)
_FEAT = lambda d: labels.forest_features(labels.directional(d))
# selectors fit a model before they can name its features: these two queries run a job when they are built and return a few names
add("feature_f_test", lambda d: d.sparkSession.createDataFrame([(c,) for c in models.select_by_f_test(_FEAT(d), _COLS)], "feature string"))
add("feature_importance", lambda d: d.sparkSession.createDataFrame([(c,) for c in models.select_by_forest(_FEAT(d), _COLS)], "feature string"))
add("feature_mutual_information", lambda d: models.mutual_information(_FEAT(d), _COLS))
add("feature_validity", lambda d: models.invalid_features(_FEAT(d), ["roc_5", "close", "ret_std"]), q("SELECT 'close' AS feature, 0::BIGINT AS nulls, 0 AS constant UNION ALL SELECT 'roc_5', count_if(x IS NULL)::BIGINT, 0 FROM v UNION ALL SELECT 'ret_std', count_if(s IS NULL)::BIGINT, 0 FROM v", _RETS, f"v AS (SELECT {_pct(5)} AS x, {guarded('stddev_samp(ret)', 'ret', 10)} AS s FROM fr)"))

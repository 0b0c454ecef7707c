"""Oracles of composed queries, from the oracles of their parts and further SQL written by hand."""

from __future__ import annotations

from . import oracle_text as o
from .analysis_queries import _ALIGN, _BT, _COR, _PERF, _POSQ, _PW, _PX, _RET, _SG, _SIG, _SPC, _STATE, _SWING, _TRADES, _VS
from .indicator_queries import ORACLES as INDICATORS
from .indicator_queries import _pct, guarded

ORACLES: dict[str, str] = {}
R = o.r6
unrounded = o.unrounded


def q(select, *ctes, recursive=False):
    return o.query(o.HOURLY, *ctes, select=select, recursive=recursive)


# --- the engine: blocks side by side
_BLOCKS = {"adx": "adx", "macd": "macd", "stochastic_rsi": "stoch_k", "atr": "atr", "on_balance_volume": "obv", "bollinger": "bb_percent"}
ORACLES["indicator_engine"] = "SELECT symbol, ts, " + ", ".join(_BLOCKS.values()) + f" FROM ({INDICATORS['adx']}) a " + " ".join(f"JOIN ({INDICATORS[n]}) USING (symbol, ts)" for n in _BLOCKS if n != "adx")

# --- clustering
_SIX = {"rsi": "rsi", "cci": "cci", "fisher": "fisher", "dmi_difference": "dmi", "z_score": "zscore", "moving_average_ratio": "mar"}


def _centers(x: str, n: int) -> str:
    lo, hi = (f"CASE WHEN count({x}) {o.over(n)} = {n} THEN list_sort(list({x}) {o.over(n)})[{int((n - 1) * p) + 1}] END" for p in (0.05, 0.95))
    mid = guarded(f"avg({x})", x, n)
    return f"(({lo}) + ({mid})) / 2 AS {x}0, (({hi}) + ({mid})) / 2 AS {x}1"


def _clusters(names, n: int, source: str, out: str) -> str:
    """CTEs that end in ``out`` with cl, and rc between the clusters."""
    d0, d1 = ("(" + " + ".join(f"abs({x} - {x}{k})" for x in names) + f") / {len(names)}" for k in (0, 1))
    return (
        f"{out}_k AS (SELECT *, {', '.join(_centers(x, n) for x in names)} FROM {source}), {out}_d AS MATERIALIZED (SELECT *, {d0} AS d0, {d1} AS d1 FROM {out}_k), "
        f"{out}_e AS (SELECT *, CASE WHEN d0 IS NULL OR d1 IS NULL THEN NULL WHEN d0 <= d1 THEN 0 ELSE 1 END AS cl, CASE WHEN d0 IS NULL OR d1 IS NULL THEN NULL WHEN d0 = 0 AND d1 = 0 THEN 0.5 ELSE coalesce(least(d0, d1) / nullif(least(d0, d1) + greatest(d0, d1), 0), 0) END AS rel FROM {out}_d), "
        f"{out} AS (SELECT *, cl + (1 - 2 * cl) * rel AS rc FROM {out}_e)"
    )


ORACLES["spc_all_features"] = "WITH f AS MATERIALIZED (SELECT * FROM (" + unrounded(INDICATORS["rsi"]) + ") " + " ".join(f"JOIN ({unrounded(INDICATORS[n])}) USING (symbol, ts)" for n in _SIX if n != "rsi") + f"), {_clusters(list(_SIX.values()), 100, 'f', 's')} SELECT symbol, ts, {R('cl')} AS cluster, {R('rc')} AS real_clust FROM s"
_DAY = "dc AS (SELECT symbol, date_trunc('day', ts)::TIMESTAMP AS ts, arg_max(close, ts) AS close FROM c GROUP BY symbol, date_trunc('day', ts)), df AS (SELECT *, (close - avg(close) {z}) / nullif(stddev_samp(close) {z}, 0) AS zscore, close / nullif({m}, 0) AS mar FROM dc)".format(z=o.over(5), m=guarded("avg(close)", "close", 3))
ORACLES["spc_multi_timeframe"] = q(
    f"SELECT s.symbol, s.ts, {R('s.cl')} AS cluster, {R('h.cl')} AS cluster_high, CASE WHEN s.cl = h.cl THEN 1 ELSE 0 END AS agree FROM s ASOF LEFT JOIN h ON s.symbol = h.symbol AND s.ts >= h.ts WHERE s.cl IS NOT NULL", *_SPC, _DAY, _clusters(["zscore", "mar"], 10, "df", "h"),
)


def spc_vote(parts: dict[str, str]) -> str:
    weights = {"cluster_transition": 0.68, "regime_following": 0.66, "mean_reversion": 0.64}
    total = sum(weights.values())
    side = lambda v: "(" + " + ".join(f"CASE WHEN s{k} = {v} THEN {w!r} ELSE 0.0 END" for k, w in enumerate(weights.values())) + f") / {total!r}"
    ctes = ", ".join(f"p{k} AS ({unrounded(parts[f'spc_{n}'])})" for k, n in enumerate(weights))
    return (
        f"WITH {ctes}, j AS (SELECT p0.symbol, p0.ts, " + ", ".join(f"p{k}.signal AS s{k}, CASE WHEN p{k}.signal != 0 THEN p{k}.strength ELSE 0 END AS f{k}" for k in range(3)) + " FROM p0 JOIN p1 USING (symbol, ts) JOIN p2 USING (symbol, ts)), "
        f"v AS (SELECT *, {side(1)} AS vu, {side(-1)} AS vd, greatest(f0, f1, f2) AS fm FROM j), b AS (SELECT *, greatest(" + ", ".join(f"CASE WHEN f{k} = fm THEN s{k} ELSE -2 END" for k in range(3)) + ") AS sm FROM v) "
        f"SELECT symbol, ts, CASE WHEN vu >= 0.5 AND vu > vd THEN 1 WHEN vd >= 0.5 AND vd > vu THEN -1 WHEN fm >= 0.7 THEN sm ELSE 0 END AS vote, {R('greatest(vu, vd)')} AS vote_strength FROM b"
    )


# --- tests of stationarity
def _adf(rows: str, by: str, x: str = "close", prefix: str = "") -> str:
    """CTEs that end in {prefix}adf(by, adf_stat, adf_stationary)."""
    w = f"(PARTITION BY {by} ORDER BY ts)"
    cov = ", ".join(f"covar_pop({a}, {b}) AS {a}{b}" for a, b in (("l", "l"), ("l", "m"), ("m", "m"), ("d", "l"), ("d", "m"), ("d", "d")))
    return (
        f"{prefix}a1 AS (SELECT *, lag({x}) OVER {w} AS l FROM {rows}), {prefix}a2 AS (SELECT *, {x} - l AS d FROM {prefix}a1), {prefix}a3 AS (SELECT *, lag(d) OVER {w} AS m FROM {prefix}a2), "
        f"{prefix}a4 AS (SELECT {by}, count(*)::DOUBLE AS n, {cov} FROM {prefix}a3 WHERE m IS NOT NULL GROUP BY {by}), {prefix}a5 AS (SELECT *, (dl * mm - dm * lm) / nullif(ll * mm - lm * lm, 0) AS b1, (dm * ll - dl * lm) / nullif(ll * mm - lm * lm, 0) AS b2 FROM {prefix}a4 WHERE n > 3), "
        f"{prefix}a6 AS (SELECT *, b1 / nullif(sqrt(greatest((dd - b1 * dl - b2 * dm) * n / (n - 3) * mm / ((ll * mm - lm * lm) * n), 0)), 0) AS t FROM {prefix}a5), "
        f"{prefix}adf AS (SELECT {by}, t AS adf_stat, CASE WHEN t < -2.86154 - 2.8903 / n - 4.234 / n ** 2 - 40.040 / n ** 3 THEN 1 ELSE 0 END AS adf_stationary FROM {prefix}a6)"
    )


ORACLES["adf_test"] = q(f"SELECT symbol, {R('adf_stat')} AS adf_stat, adf_stationary FROM adf", _adf("c", "symbol"))


def _johansen(rows: str) -> str:
    """CTEs that end in jo(long_symbol, short_symbol, trace_stat, johansen_cointegrated)."""
    names = ("da", "db", "la", "lb", "ma", "mb")
    cov = ", ".join(f"covar_pop({a}, {b}) AS {a}_{b}" for i, a in enumerate(names) for b in names[i:])
    m = lambda a, b: f"{a}_{b}" if names.index(a) <= names.index(b) else f"{b}_{a}"
    inverse = {("ma", "ma"): f"mb_mb / ({(det := '(ma_ma * mb_mb - ma_mb * ma_mb)')})", ("ma", "mb"): f"-ma_mb / ({det})", ("mb", "mb"): f"ma_ma / ({det})"}
    # what is left of two columns' covariance once the last changes are taken out
    rest = lambda a, b: f"{m(a, b)} - (" + " + ".join(f"{m(a, u)} * ({inverse[tuple(sorted((u, v)))]}) * {m(b, v)}" for u in ("ma", "mb") for v in ("ma", "mb")) + ")"
    four = names[:4]
    left = ", ".join(f"{rest(a, b)} AS r_{a}_{b}" for i, a in enumerate(four) for b in four[i:])
    r = lambda a, b: f"r_{a}_{b}" if four.index(a) <= four.index(b) else f"r_{b}_{a}"
    q_ = lambda u, v: f"({r(u, 'da')} * (r_db_db * {r('da', v)} - r_da_db * {r('db', v)}) + {r(u, 'db')} * (r_da_da * {r('db', v)} - r_da_db * {r('da', v)})) / (r_da_da * r_db_db - r_da_db * r_da_db)"
    return (
        f"j1 AS (SELECT *, lag(y) {_PW} AS la, lag(x) {_PW} AS lb FROM {rows}), j2 AS (SELECT *, y - la AS da, x - lb AS db FROM j1), j3 AS (SELECT *, lag(da) {_PW} AS ma, lag(db) {_PW} AS mb FROM j2), "
        f"j4 AS (SELECT long_symbol, short_symbol, count(*) AS n, {cov} FROM j3 WHERE ma IS NOT NULL AND mb IS NOT NULL GROUP BY ALL), j5 AS (SELECT *, {left} FROM j4 WHERE n > 10), "
        f"j6 AS (SELECT *, {q_('la', 'la')} AS q11, {q_('la', 'lb')} AS q12, {q_('lb', 'lb')} AS q22, r_la_la * r_lb_lb - r_la_lb * r_la_lb AS d1 FROM j5), "
        # the product of one minus each eigenvalue is one minus their sum plus their product
        "jo AS (SELECT long_symbol, short_symbol, -n * ln(1 - (r_lb_lb * q11 - 2 * r_la_lb * q12 + r_la_la * q22) / d1 + (q11 * q22 - q12 * q12) / d1) AS trace_stat, CASE WHEN trace_stat > 15.4943 THEN 1 ELSE 0 END AS johansen_cointegrated FROM j6)"
    )


ORACLES["johansen_test"] = q(f"SELECT long_symbol, short_symbol, {R('trace_stat')} AS trace_stat, johansen_cointegrated FROM jo", _ALIGN, _johansen("j"))

# --- pairs
_CAND = "ca AS MATERIALIZED (SELECT a.symbol AS long_symbol, b.symbol AS short_symbol, abs(b.score - a.score) AS gap FROM (SELECT * FROM sc ORDER BY score, symbol LIMIT 3) a JOIN (SELECT * FROM sc ORDER BY score DESC, symbol LIMIT 3) b ON a.symbol != b.symbol)"
_ladder = lambda x, op, better, good, a, b: f"CASE WHEN {x} {op} {better} THEN {a} WHEN {x} {op} {good} THEN {b} ELSE 0 END"
_SCORED = [
    _PERF, _CAND, "al AS (SELECT ca.long_symbol, ca.short_symbol, gap, a.ts, a.close AS y, b.close AS x FROM ca JOIN c a ON a.symbol = ca.long_symbol JOIN c b ON b.symbol = ca.short_symbol AND b.ts = a.ts)",
    f"j AS MATERIALIZED (SELECT *, y / nullif(lag(y) {_PW}, 0) - 1 AS ry, x / nullif(lag(x) {_PW}, 0) - 1 AS rx FROM al)",
    "bs AS (SELECT long_symbol, short_symbol, any_value(gap) AS gap, corr(ry, rx) AS correlation, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM j GROUP BY ALL HAVING count(ry) >= 50)",
    "sp AS MATERIALIZED (SELECT long_symbol, short_symbol, ts, y - b * x - a AS spread FROM j JOIN bs USING (long_symbol, short_symbol))",
    f"t0 AS (SELECT *, lag(spread) {_PW} AS p, max(spread) OVER (PARTITION BY long_symbol, short_symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS peak FROM sp), t1 AS (SELECT *, spread - p AS d FROM t0)",
    "t2 AS MATERIALIZED (SELECT long_symbol, short_symbol, avg(spread) AS me, stddev_samp(spread) AS sd, (arg_max(spread, ts) - avg(spread)) / nullif(stddev_samp(spread), 0) AS zs, CASE WHEN regr_slope(d, p) < 0 AND -ln(2) / regr_slope(d, p) <= 50 THEN -ln(2) / regr_slope(d, p) END AS half_life, min(spread - peak) AS dd, CASE WHEN abs(avg(d) / stddev_samp(d) * sqrt(8760)) <= 1e6 THEN avg(d) / stddev_samp(d) * sqrt(8760) END AS sharpe, CASE WHEN min(spread - peak) != 0 THEN avg(d) * 8760 / abs(min(spread - peak)) END AS calmar FROM t1 GROUP BY ALL)",
    f"hn AS (SELECT *, row_number() {_PW} AS i, count(*) OVER (PARTITION BY long_symbol, short_symbol) AS k FROM sp), hz AS (SELECT a.long_symbol, a.short_symbol, l.lag, stddev_pop(a.spread - b.spread) AS s FROM hn a, range(2, 100) l(lag), hn b WHERE b.long_symbol = a.long_symbol AND b.short_symbol = a.short_symbol AND b.i = a.i - l.lag AND l.lag < least(100, a.k // 2) GROUP BY ALL)",
    "hu AS (SELECT long_symbol, short_symbol, greatest(0.0, least(2.0, 2 * regr_slope(ln(sqrt(s)), ln(lag)))) AS hurst FROM hz WHERE s > 0 GROUP BY ALL HAVING count(*) >= 2)",
    _adf("sp", "long_symbol, short_symbol", "spread"), _johansen("j"),
    f"z0 AS (SELECT sp.*, (spread - me) / nullif(sd, 0) AS z, lead(spread) {_PW} - spread AS nxt FROM sp JOIN t2 USING (long_symbol, short_symbol)), z1 AS (SELECT *, CASE WHEN z > 0.5 THEN -1 WHEN z < -0.5 THEN 1 END AS pr, sign(nxt) AS re FROM z0), g AS (SELECT long_symbol, short_symbol, count_if(pr = 1 AND re = 1)::DOUBLE AS tp, count_if(pr = 1 AND re != 1) AS fp, count_if(pr = -1 AND re = 1) AS fn FROM z1 WHERE pr IS NOT NULL AND nxt IS NOT NULL GROUP BY ALL HAVING count(*) >= 20)",
    "f AS (SELECT long_symbol, short_symbol, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1 FROM g WHERE tp > 0)",
    "m AS MATERIALIZED (SELECT * FROM bs JOIN t2 USING (long_symbol, short_symbol) LEFT JOIN hu USING (long_symbol, short_symbol) LEFT JOIN adf USING (long_symbol, short_symbol) LEFT JOIN jo USING (long_symbol, short_symbol) LEFT JOIN f USING (long_symbol, short_symbol))",
    "qs AS MATERIALIZED (SELECT *, least(100, CASE WHEN adf_stationary = 1 OR johansen_cointegrated = 1 THEN 30 ELSE 0 END + " + " + ".join((_ladder("half_life", "<", 20, 50, 20, 10), _ladder("hurst", "<", 0.4, 0.5, 15, 8), _ladder("sharpe", ">", 2, 1, 15, 8), _ladder("f1", ">", 0.7, 0.6, 10, 5), _ladder("abs(dd)", "<", 0.2, 0.3, 10, 5), _ladder("calmar", ">=", 1, 0.5, 5, 2.5))) + ")::DOUBLE AS quant_score, "
    "greatest(0, gap * CASE WHEN abs(correlation) BETWEEN 0.3 AND 0.9 THEN 1.2 WHEN abs(correlation) < 0.3 THEN 0.8 WHEN abs(correlation) > 0.9 THEN 0.9 ELSE 1 END * CASE WHEN adf_stationary = 1 THEN 1.15 ELSE 1 END * CASE WHEN half_life <= 50 THEN 1.1 ELSE 1 END * (1 + coalesce(least(abs(zs) / 5, 0.2), 0)) * CASE WHEN hurst <= 0.5 THEN 1.08 WHEN hurst < 0.6 THEN 1.02 ELSE 1 END * CASE WHEN sharpe >= 1 THEN 1.08 WHEN sharpe >= 0.5 THEN 1.03 ELSE 1 END "
    "* CASE WHEN abs(dd) <= 0.3 THEN 1.05 ELSE 1 END * CASE WHEN calmar >= 1 THEN 1.05 ELSE 1 END * CASE WHEN johansen_cointegrated = 1 THEN 1.08 ELSE 1 END * CASE WHEN f1 >= 0.7 THEN 1.05 WHEN f1 >= 0.6 THEN 1.02 ELSE 1 END) AS opportunity FROM m)",
]
_PAIR = f"SELECT long_symbol, short_symbol, {R('correlation')} AS correlation, {R('half_life')} AS half_life, {R('quant_score')} AS quant_score, {R('opportunity')} AS opportunity FROM qs"
ORACLES["pair_metrics_scored"] = q(f"{_PAIR} WHERE coalesce(half_life, 0) <= 50", *_SCORED)
ORACLES["pairs_validated"] = q(f"{_PAIR} WHERE gap BETWEEN 0.001 AND 5 AND abs(correlation) <= 0.95 AND coalesce(adf_stationary, johansen_cointegrated) = 1 AND coalesce(half_life <= 40, true) AND coalesce(hurst < 0.9, true) AND coalesce(sharpe >= -0.15, true) AND coalesce(abs(dd) <= 340, true) AND quant_score >= 30", *_SCORED)
ORACLES["pairs_unique_selection"] = q(
    f"SELECT row_number() OVER (ORDER BY late, i)::BIGINT AS rank, long_symbol, short_symbol, {R('gap')} AS score FROM done QUALIFY row_number() OVER (ORDER BY late, i) <= 4", _PERF, _CAND,
    "o AS (SELECT *, row_number() OVER (ORDER BY gap DESC, long_symbol, short_symbol) AS i FROM ca), w(i, used, late) AS (SELECT 0::BIGINT, []::VARCHAR[], false UNION ALL SELECT o.i, CASE WHEN list_has_any(w.used, [o.long_symbol, o.short_symbol]) THEN w.used ELSE list_concat(w.used, [o.long_symbol, o.short_symbol]) END, list_has_any(w.used, [o.long_symbol, o.short_symbol]) FROM w JOIN o ON o.i = w.i + 1), done AS (SELECT o.*, w.late FROM o JOIN w USING (i))",
    recursive=True,
)
ORACLES["threshold_search"] = q(
    f"SELECT symbol, {R('arg_min(t, row(-sh, t))')} AS threshold, {R('max(sh)')} AS sharpe FROM g GROUP BY symbol",
    f"s AS (SELECT symbol, (close - open) / nullif(open, 0) AS s, lead(close) OVER {o.W} / close - 1 AS r FROM c), th(t) AS (VALUES " + ", ".join(f"({0.01 * k!r}::DOUBLE)" for k in range(1, 15)) + "), g0 AS (SELECT symbol, t, avg(sign(s) * r) / nullif(stddev_samp(sign(s) * r), 0) AS sh FROM s, th WHERE abs(s) >= t GROUP BY ALL), g AS (SELECT * FROM g0 WHERE sh IS NOT NULL)",
)

# --- portfolio
_POC = f"SELECT symbol, size_usdt, {_SG} AS s FROM po"
ORACLES["hedge_candidates"] = q(
    f"SELECT symbol, {R('weighted')} AS weighted, {R('joint')} AS joint, {R('(abs(weighted) + abs(joint)) / 2')} AS score FROM jt JOIN wt USING (symbol)", _POSQ, _RET, _COR,
    f"pp AS ({_POC}), pr AS (SELECT ts, sum(s * size_usdt * r) / sum(size_usdt) AS p FROM rr JOIN pp USING (symbol) WHERE r IS NOT NULL GROUP BY ts), jt AS (SELECT symbol, corr(r, p) AS joint FROM rr JOIN pr USING (ts) WHERE r IS NOT NULL AND symbol NOT IN (SELECT symbol FROM po) GROUP BY symbol HAVING count(*) >= 20)",
    "bo AS (SELECT a AS symbol, b AS other, corr FROM co UNION ALL SELECT b, a, corr FROM co), wt AS (SELECT bo.symbol, sum(corr * s * size_usdt) / sum(size_usdt) AS weighted FROM bo JOIN pp ON pp.symbol = bo.other GROUP BY bo.symbol)",
)
_WC = "(SELECT sum(corr * p.s * q.s * (p.size_usdt + q.size_usdt)) / sum(p.size_usdt + q.size_usdt) FROM co JOIN {t} p ON p.symbol = a JOIN {t} q ON q.symbol = b)"
ORACLES["correlation_impact"] = q(f"SELECT {R(_WC.format(t='pp'))} AS before, {R(_WC.format(t='pq'))} AS after", _POSQ, _RET, _COR, f"pp AS ({_POC}), pq AS (SELECT * FROM pp UNION ALL SELECT 'signup', 300.0, -1)")
ORACLES["hedge_size"] = q(
    f"SELECT 'click' AS hedge, CASE WHEN need >= 0 THEN 'LONG' ELSE 'SHORT' END AS direction, {R('abs(need)')} AS size FROM nd", _POSQ, _RET, _PX,
    "bj AS (SELECT rr.*, b.r AS m FROM rr JOIN rr b ON b.symbol = 'view' AND b.ts = rr.ts), be AS (SELECT symbol, CASE WHEN symbol = 'view' THEN 1 ELSE covar_samp(r, m) / nullif(var_samp(m), 0) END AS beta FROM bj WHERE r IS NOT NULL AND m IS NOT NULL GROUP BY symbol HAVING count(*) >= 50)",
    f"ex AS (SELECT sum({_SG} * size_usdt) AS de, sum({_SG} * size_usdt * coalesce(beta, 1)) AS bd FROM po JOIN px USING (symbol) LEFT JOIN be USING (symbol)), nd AS (SELECT CASE WHEN abs(b) > 1e-9 THEN -bd / b ELSE -de END AS need FROM ex, (SELECT max(beta) AS b FROM be WHERE symbol = 'click'))",
)
ORACLES["position_totals"] = q(
    f"SELECT {R('sum(CASE WHEN close >= open THEN volume ELSE 0 END)')} AS long_total, {R('sum(CASE WHEN close < open THEN volume ELSE 0 END)')} AS short_total, {R('sum(volume)')} AS combined, {R('sum(CASE WHEN close >= open THEN volume ELSE -volume END)')} AS net FROM l", "l AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1)"
)

# --- back-test of the other side: the same recursion with all comparisons turned round
_TURN = (("n.low <= r.px * 0.98", "n.high >= r.px * 1.02"), ("n.high >= r.px * 1.04", "n.low <= r.px * 0.96"), ("n.close <= r.trail", "n.close >= r.trail"), ("n.close > r.best", "n.close < r.best"), ("n.signal > 0", "n.signal < 0"), ("CASE WHEN signal > 0", "CASE WHEN signal < 0"),
         ("THEN r.px * 0.98", "THEN r.px * 1.02"), ("THEN r.px * 1.04", "THEN r.px * 0.96"), (f"n.close * {1 - 0.015!r}", f"n.close * {1 + 0.015!r}"))
_SHORT = _BT
for _a, _b in _TURN:
    assert _a in _SHORT, _a
    _SHORT = _SHORT.replace(_a, _b)
ORACLES["backtest_trades_short"] = q(
    f"SELECT symbol, entry_index, exit_index, {R('epx')} AS entry_price, {R('outp')} AS exit_price, 'SHORT' AS signal_type, ['STOP_LOSS', 'TAKE_PROFIT', 'TRAILING_STOP', 'MAX_HOLD', 'END_OF_DATA'][why] AS exit_reason, {R('-pnl')} AS pnl, exit_index - entry_index AS hold_periods FROM tr", _SIG, _SHORT, _TRADES, recursive=True,
)

# --- labels and features
ORACLES["balanced_targets"] = q(
    "SELECT symbol, ts, CAST(CASE WHEN f IS NULL THEN NULL WHEN abs(f) >= 0.01 THEN sign(f) WHEN abs(f) <= 0.005 THEN 0 WHEN ('0x' || substr(md5('42:' || symbol || ':' || strftime(ts, '%Y-%m-%d %H:%M:%S')), 1, 8))::BIGINT % 2 = 0 THEN sign(f) ELSE 0 END AS INTEGER) AS target FROM z",
    f"z AS (SELECT *, lead(close) OVER {o.W} / nullif(close, 0) - 1 AS f FROM c)",
)
_COLS = ("roc_2", "roc_5", "roc_10", "high_low", "close_open", "ret_std", "ret_skew")


def mutual_information(parts: dict[str, str]) -> str:
    """Deciles are the values at the ceiling of their share of the rows."""
    rank = lambda k: f"list_extract(v, CAST(ceil({k / 10!r} * n) AS BIGINT))"
    return (
        f"WITH f AS ({unrounded(parts['forest_features'])}), l AS ({parts['directional_labels']}), t AS MATERIALIZED (SELECT l.target AS y, {', '.join('f.' + c for c in _COLS)} FROM f JOIN l USING (symbol, ts) WHERE target IS NOT NULL AND " + " AND ".join(f"{c} IS NOT NULL" for c in _COLS) + "), "
        "u AS (UNPIVOT t ON " + ", ".join(_COLS) + " INTO NAME feature VALUE x), k AS (SELECT feature, list(x ORDER BY x) AS v, count(*) AS n FROM u GROUP BY feature), "
        f"cut AS (SELECT feature, [{', '.join(rank(k) for k in range(1, 10))}] AS cs FROM k), b AS (SELECT feature, y, len(list_filter(cs, lambda e: e < x)) AS b, count(*)::DOUBLE AS n FROM u JOIN cut USING (feature) GROUP BY ALL), "
        "p AS (SELECT feature, n / sum(n) OVER (PARTITION BY feature) AS p, sum(n) OVER (PARTITION BY feature, b) / sum(n) OVER (PARTITION BY feature) AS pb, sum(n) OVER (PARTITION BY feature, y) / sum(n) OVER (PARTITION BY feature) AS py FROM b) "
        f"SELECT feature, {R('sum(p * ln(p / (pb * py)))')} AS mi FROM p GROUP BY feature"
    )


# --- votes of the swing strategies
_LAST = "(PARTITION BY symbol ORDER BY ts, kind)"
ORACLES["hmm_strategy_vote"] = q(
    f"SELECT symbol, CASE WHEN l = greatest(l, s, h) AND l > 0 THEN 'LONG' WHEN s = greatest(l, s, h) AND s > 0 THEN 'SHORT' ELSE 'HOLD' END AS signal, {R('l')} AS score_long, {R('s')} AS score_short, {R('h')} AS score_hold FROM sc", _SWING, _STATE,
    f"hs AS (SELECT *, lag(state) OVER {_LAST} AS p1, lag(state, 2) OVER {_LAST} AS p2 FROM st), hi AS (SELECT symbol, 1 AS k, p1 AS h, state FROM hs WHERE p1 IS NOT NULL UNION ALL SELECT symbol, 2, p2 * 3 + p1, state FROM hs WHERE p2 IS NOT NULL)",
    "pn AS (SELECT symbol, k, h, state, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY symbol, k, h) AS p FROM hi GROUP BY symbol, k, h, state), nw AS (SELECT symbol, 1 AS k, arg_max(state, row(ts, kind)) AS h FROM hs GROUP BY symbol UNION ALL SELECT symbol, 2, last(p1 * 3 + state ORDER BY ts, kind) FROM hs GROUP BY symbol)",
    "be AS (SELECT symbol, k, arg_min(state, row(-p, state)) AS state, max(p) AS p FROM pn JOIN nw USING (symbol, k, h) GROUP BY symbol, k), sc AS (SELECT symbol, sum(CASE WHEN state = 2 THEN p ELSE 0 END) AS l, sum(CASE WHEN state = 0 THEN p ELSE 0 END) AS s, sum(CASE WHEN state = 1 THEN p ELSE 0 END) AS h FROM be GROUP BY symbol)",
)

# --- staged pre-filter and weighted samples
_STAGE = "{n} AS (SELECT * EXCLUDE (ok, found) FROM (SELECT *, max(CASE WHEN ok THEN 1 ELSE 0 END) OVER () AS found FROM (SELECT *, {c} AS ok FROM {f})) WHERE ok OR found = 0)"
ORACLES["staged_prefilter"] = q(
    f"SELECT symbol, {R('score')} AS score FROM (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY abs(score) DESC, symbol) AS rn FROM s3) WHERE n < 10 OR rn <= greatest(1, ceil(n * 10.0 / 100))", _VS,
    "l AS (SELECT v.symbol, arg_max(m5, v.ts) AS atc, arg_max(m20, v.ts) AS osc, arg_max(m50, v.ts) AS spc, arg_max(m20, v.ts) AS ml, arg_max(c.close, v.ts) AS score FROM v JOIN c USING (symbol, ts) GROUP BY v.symbol)",
    _STAGE.format(n="s1", c="atc != 0", f="l"), _STAGE.format(n="s2", c="osc = atc OR spc = atc", f="s1"), _STAGE.format(n="s3", c="ml = atc", f="s2"),
)
_DRAW = "(('0x' || substr(md5('7:' || symbol), 1, 12))::BIGINT::DOUBLE + 1) / 281474976710657.0::DOUBLE"
_TAKE = "r AS (SELECT symbol, row_number() OVER (ORDER BY CASE WHEN w > 0 THEN -ln(" + _DRAW + ") / w ELSE 'inf'::DOUBLE END, symbol) AS rn FROM {t})"
_MANY = "n AS (SELECT greatest(1, CAST(floor(count(*) * 0.2) AS BIGINT)) AS k FROM v)"
ORACLES["sample_volume_weighted"] = o.query(o.DAILY, "v AS (SELECT symbol, sum(volume) AS w FROM c GROUP BY symbol)", _MANY, _TAKE.format(t="v"), select="SELECT symbol FROM r, n WHERE rn <= k")
_unit = lambda x: f"coalesce(({x} - min({x}) OVER ()) / nullif(max({x}) OVER () - min({x}) OVER (), 0), 0.5)"
ORACLES["sample_liquidity_weighted"] = o.query(
    o.DAILY, "v AS (SELECT symbol, sum(volume) AS volume, avg((high - low) / nullif(close, 0)) AS spread, stddev_samp(close) AS volatility FROM c GROUP BY symbol)", _MANY,
    f"u AS (SELECT symbol, {_unit('volume')} AS a, {_unit('spread')} AS b, {_unit('volatility')} AS d FROM v), x AS (SELECT symbol, 0.4 * a + 0.2 * (1 - b) + 0.4 * exp(-(((d - 0.5) / 0.25) ** 2) / 2) AS w FROM u)", _TAKE.format(t="x"), select="SELECT symbol FROM r, n WHERE rn <= k",
)

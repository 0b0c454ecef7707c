"""Queries of the trend classification and the range oscillator, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.windows import r6
from ..operators import atc, oscillator
from ..sources import candles
from . import oracle_text as o
from .indicator_queries import _BAND, _BAND_R, _BAND_V, _DW, _TR, _up
from .oracle_text import unrounded

QUERIES, ORACLES = {}, {}
#: Shorter than the production length: the small tables have few bars.
CFG = atc.Config(length=14)


def rounded(df, keys, values):
    kinds = dict(df.dtypes)
    return df.select(*keys, *[r6(v).alias(v) if kinds[v] == "double" else F.col(v) for v in values])


# --- adaptive trend classification
def _ma_ctes(kind: str) -> list[str]:
    """CTEs that end in ma(symbol, ts, i, close, v, m): nine averages in long form, v being the variant."""
    ls = atc.lengths(CFG.length, CFG.robustness)
    out = [f"b AS (SELECT *, row_number() OVER {o.W} - 1 AS i FROM c)"]
    if kind in ("WMA", "LSMA"):
        parts = []
        for v, n in enumerate(ls):
            if kind == "WMA":
                total = " + ".join(f"{n - k} * lag(close, {k}) OVER {o.W}" for k in range(n))
                parts.append(f"SELECT symbol, ts, i, close, {v} AS v, ({total}) / {n * (n + 1) // 2} AS m FROM b")
            else:
                parts.append(f"SELECT symbol, ts, i, close, {v} AS v, CASE WHEN count(close) {o.over(n)} = {n} THEN regr_intercept(close, i) {o.over(n)} + i * regr_slope(close, i) {o.over(n)} END AS m FROM b")
        return [*out, "ma AS (" + " UNION ALL ".join(parts) + ")"]
    if kind == "HMA":
        w = lambda x, n: "(" + " + ".join(f"{n - k} * lag({x}, {k}) OVER {o.W}" for k in range(n)) + f") / {n * (n + 1) // 2}"
        out.append("hh AS (SELECT *, " + ", ".join(f"2 * {w('close', n // 2)} - {w('close', n)} AS h{v}" for v, n in enumerate(ls)) + " FROM b)")
        return [*out, "ma AS (" + " UNION ALL ".join(f"SELECT symbol, ts, i, close, {v} AS v, {w(f'h{v}', int(n**0.5))} AS m FROM hh" for v, n in enumerate(ls)) + ")"]
    first, step, source, shown = {}, {}, "c", "r.m{v}"
    for v, n in enumerate(ls):
        if kind == "KAMA":
            first |= {f"k{v}": "close"}
            step |= {f"k{v}": f"CASE WHEN n.i < {n} THEN r.k{v} ELSE r.k{v} + n.sc{v} * (n.close - r.k{v}) END"}
            source, shown = "k2", "r.k{v}"
            continue
        first |= {f"m{v}": "NULL", f"t{v}": "close"}
        step |= (one := o.ema_step(f"m{v}", f"t{v}", "n.close", n))
        if kind == "DEMA":
            m = f"({one[f'm{v}']})"
            first |= {f"d{v}": "NULL", f"u{v}": "0"}
            step |= {f"d{v}": f"CASE WHEN n.i < {2 * n - 2} THEN NULL WHEN n.i = {2 * n - 2} THEN (r.u{v} + {m}) / {n} ELSE r.d{v} + {2 / (n + 1)!r} * ({m} - r.d{v}) END", f"u{v}": f"CASE WHEN n.i BETWEEN {n - 1} AND {2 * n - 2} THEN r.u{v} + {m} ELSE r.u{v} END"}
            shown = "2 * r.m{v} - r.d{v}"
    before = []
    if kind == "KAMA":
        before = [f"k0 AS (SELECT *, abs(close - {o.lag('close')}) AS dc FROM c)", "k2 AS (SELECT *, " + ", ".join(f"(coalesce(abs(close - {o.lag('close', n)}) / nullif(sum(dc) {o.over(n)}, 0), 0) * (0.666 - 0.064) + 0.064) ** 2 AS sc{v}" for v, n in enumerate(ls)) + " FROM k0)"]
    return [*before, o.recursion(source, first, step), "ma AS (" + " UNION ALL ".join(f"SELECT n.symbol, n.ts, n.i, n.close, {v} AS v, {shown.format(v=v)} AS m FROM n JOIN r ON r.symbol = n.symbol AND r.i = n.i" for v in range(9)) + ")"]


def _layer_one_sql(kind: str, base: str = o.HOURLY, ctes=None) -> str:
    by = "(PARTITION BY symbol, v ORDER BY ts)"
    d = CFG.decay / 100
    return o.query(
        base, *(ctes or _ma_ctes)(kind),
        f"ev AS (SELECT *, CASE WHEN close > m AND lag(close) OVER {by} <= lag(m) OVER {by} THEN 1 WHEN close < m AND lag(close) OVER {by} >= lag(m) OVER {by} THEN -1 END AS e, close / nullif(lag(close) OVER {by}, 0) - 1 AS rr FROM ma)",
        f"sg AS (SELECT *, coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY symbol, v ORDER BY ts ROWS UNBOUNDED PRECEDING), 0) AS s, rr * exp({CFG.lam / 1000!r} * greatest(i, 1)) AS rg FROM ev)",
        f"sp AS (SELECT *, lag(s) OVER {by} AS p FROM sg)",
        f"eq(symbol, v, i, q) AS (SELECT symbol, v, i, CAST(1 AS DOUBLE) FROM sp WHERE i = 0 UNION ALL SELECT sp.symbol, sp.v, sp.i, greatest(0.25, eq.q * {1 - d!r} * (1 + CASE WHEN sp.p > 0 THEN coalesce(sp.rg, 0) WHEN sp.p < 0 THEN -coalesce(sp.rg, 0) ELSE 0 END)) FROM eq JOIN sp ON sp.symbol = eq.symbol AND sp.v = eq.v AND sp.i = eq.i + 1)",
        select="SELECT sp.symbol, sp.ts, round_even(sum(sp.s * eq.q ORDER BY sp.v) / nullif(sum(eq.q ORDER BY sp.v), 0) * 100, 0) / 100 + 0.0 AS layer_one FROM sp JOIN eq ON eq.symbol = sp.symbol AND eq.v = sp.v AND eq.i = sp.i GROUP BY sp.symbol, sp.ts",
        recursive=True,
    )


def _layer(kind):
    def run(spark, sf_dir):
        return atc.classify(candles.hourly(spark, sf_dir), CFG).select("symbol", "ts", (F.col(kind) + 0.0).alias("layer_one"))

    return run


for _kind in atc.KINDS:
    QUERIES[f"atc_layer_one_{_kind.lower()}"] = _layer(_kind)
    ORACLES[f"atc_layer_one_{_kind.lower()}"] = _layer_one_sql(_kind)


def _classify_sql(select: str, base: str = o.HOURLY, ctes=None) -> str:
    """All six layers side by side (l0 ... l5), their equities w0 ... w5, and the weighted vote av."""
    n, d = len(atc.KINDS), CFG.decay / 100
    layers = ", ".join(f"y{k} AS MATERIALIZED ({_layer_one_sql(kind, base, ctes)})" for k, kind in enumerate(atc.KINDS))
    joined = f"lx AS (SELECT c.symbol, c.ts, c.close, " + ", ".join(f"y{k}.layer_one AS l{k}" for k in range(n)) + ", c.close / nullif(lag(c.close) OVER (PARTITION BY c.symbol ORDER BY c.ts), 0) - 1 AS rr FROM c " + " ".join(f"JOIN y{k} ON y{k}.symbol = c.symbol AND y{k}.ts = c.ts" for k in range(n)) + ")"
    lagged = "ly AS (SELECT *, rr * exp({lam} * greatest(row_number() OVER {w} - 1, 1)) AS rg, ".format(lam=repr(CFG.lam / 1000), w=o.W) + ", ".join(f"{o.lag(f'l{k}')} AS p{k}" for k in range(n)) + " FROM lx)"
    step = {f"w{k}": f"greatest(0.25, r.w{k} * {1 - d!r} * (1 + CASE WHEN n.p{k} > 0 THEN coalesce(n.rg, 0) WHEN n.p{k} < 0 THEN -coalesce(n.rg, 0) ELSE 0 END))" for k in range(n)}
    cut = lambda k: f"CASE WHEN n.l{k} > 0.1 THEN 1 WHEN n.l{k} < -0.1 THEN -1 ELSE 0 END"
    vote = "(" + " + ".join(f"{cut(k)} * r.w{k}" for k in range(n)) + ") / nullif(" + " + ".join(f"r.w{k}" for k in range(n)) + ", 0)"
    final = f"fin AS (SELECT n.*, coalesce({vote}, 0) AS av FROM n JOIN r ON r.symbol = n.symbol AND r.i = n.i)"
    return f"WITH RECURSIVE {base}, {layers}, {joined}, {lagged}, {o.recursion('ly', {f'w{k}': '1' for k in range(n)}, step)}, {final} {select}"


def _classify(spark, sf_dir):
    return rounded(atc.classify(candles.hourly(spark, sf_dir), CFG), ["symbol", "ts"], [*atc.KINDS, "average"])


def _scan(spark, sf_dir):
    return rounded(atc.scan(candles.hourly(spark, sf_dir), 200, 0.0, CFG), ["symbol", "direction"], ["signal", "confidence", "price"])


def _prefiltered(spark, sf_dir):
    return rounded(atc.prefiltered_scan(candles.hourly(spark, sf_dir), 200, cfg=CFG), ["symbol", "direction"], ["signal", "confidence", "price"])


QUERIES |= {"atc_classify": _classify, "atc_scan": _scan, "atc_prefiltered_scan": _prefiltered}
ORACLES["atc_classify"] = _classify_sql("SELECT symbol, ts, " + ", ".join(f"{o.r6(f'l{k}')} AS {kind}" for k, kind in enumerate(atc.KINDS)) + f", {o.r6('av')} AS average FROM fin")
_RECENT = o.HOURLY.replace("c AS (", "c0 AS (", 1) + ", c AS (SELECT * EXCLUDE (cnt, back) FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS cnt, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM c0) WHERE cnt >= 200 AND back <= 200)"
_NEWEST = "(SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS newest FROM fin) WHERE newest = 1"


def _found(least: float) -> str:
    return f"SELECT symbol, CASE WHEN av > 0.05 THEN 'UP' WHEN av < -0.05 THEN 'DOWN' ELSE 'NEUTRAL' END AS direction, {o.r6('av')} AS signal, {o.r6('abs(av)')} AS confidence, {o.r6('close')} AS price FROM {_NEWEST} AND close > 0 AND abs(av) >= {least}"


def _rough_ctes(kind: str) -> list[str]:
    """CTEs that end in ma(symbol, ts, i, close, v, m) with the cheap averages."""
    ls = atc.lengths(CFG.length, CFG.robustness)
    line = lambda x, n: f"CASE WHEN i >= {n - 1} THEN (" + " + ".join(f"{n - k} * lag({x}, {k}) OVER {o.W}" for k in range(n)) + f") / {n * (n + 1) // 2} ELSE avg({x}) {o.over(n)} END"
    out = [f"b AS (SELECT *, row_number() OVER {o.W} - 1 AS i FROM c)"]
    one = lambda form, rows="b": "ma AS (" + " UNION ALL ".join(f"SELECT symbol, ts, i, close, {v} AS v, {form(v, n)} AS m FROM {rows}" for v, n in enumerate(ls)) + ")"
    if kind == "EMA":
        return [*out, one(lambda v, n: f"avg(close) {o.over(n)}")]
    if kind == "WMA":
        return [*out, one(lambda v, n: line("close", n))]
    if kind == "LSMA":
        return [*out, one(lambda v, n: f"CASE WHEN i >= {n - 1} THEN (close + lag(close, {n - 1}) OVER {o.W}) / 2 ELSE avg(close) {o.over(n)} END")]
    if kind == "HMA":
        return [*out, "hh AS (SELECT *, " + ", ".join(f"2 * ({line('close', n // 2)}) - ({line('close', n)}) AS h{v}" for v, n in enumerate(ls)) + " FROM b)", one(lambda v, n: line(f"h{v}", int(n**0.5)), "hh")]
    if kind == "DEMA":
        return [*out, "dd AS (SELECT *, " + ", ".join(f"avg(close) {o.over(n)} AS p{v}" for v, n in enumerate(ls)) + " FROM b)", one(lambda v, n: f"2 * p{v} - avg(p{v}) {o.over(n)}", "dd")]
    first, step = {f"k{v}": "close" for v in range(len(ls))}, {f"k{v}": f"r.k{v} + {2 / (n + 1) ** 2!r} * (n.close - r.k{v})" for v, n in enumerate(ls)}
    return [o.recursion("c", first, step), "ma AS (" + " UNION ALL ".join(f"SELECT n.symbol, n.ts, n.i, n.close, {v} AS v, r.k{v} AS m FROM n JOIN r ON r.symbol = n.symbol AND r.i = n.i" for v in range(len(ls))) + ")"]


ORACLES["atc_scan"] = _classify_sql(_found(0.0), _RECENT)
ORACLES["atc_prefiltered_scan"] = f"SELECT * FROM ({_classify_sql(_found(0.01), _RECENT)}) WHERE symbol IN (SELECT symbol FROM ({_classify_sql(f'SELECT symbol FROM {_NEWEST} AND abs(av) >= 0.05', _RECENT, _rough_ctes)}))"

# --- range oscillator
_OSC = [
    _DW, f"dw AS (SELECT symbol, ts, CASE WHEN count(dw) {o.over(50)} = 50 THEN CASE WHEN sum(dw) {o.over(50)} > 0 THEN sum(close * dw) {o.over(50)} / sum(dw) {o.over(50)} ELSE avg(close) {o.over(50)} END END AS dwma FROM a)",
    _TR, _BAND, _BAND_R, _BAND_V, "ob AS (SELECT band.symbol, band.ts, high, low, close, dwma, range_atr, 100 * (close - dwma) / nullif(range_atr, 0) AS osc FROM band JOIN dw USING (symbol, ts))",
    "oz AS MATERIALIZED (SELECT *, lag(osc) OVER (PARTITION BY symbol ORDER BY ts) AS po FROM ob)",
]


def _osc_sql(select, *ctes):
    return o.query(o.HOURLY, *_OSC, *ctes, select=select, recursive=True)


def _held_sql(name, cond, source):
    """A CTE with the bars for which a condition has held."""
    return f"{name}_a AS (SELECT *, coalesce({cond}, false) AS {name}_c FROM {source}), {name}_b AS (SELECT *, CASE WHEN {name}_c IS NOT DISTINCT FROM lag({name}_c) OVER {o.W} THEN 0 ELSE 1 END AS {name}_f FROM {name}_a), {name}_g AS (SELECT *, sum({name}_f) {_up} AS {name}_n FROM {name}_b), {name}_t AS (SELECT * EXCLUDE ({name}_f, {name}_n), CASE WHEN {name}_c THEN row_number() OVER (PARTITION BY symbol, {name}_n ORDER BY ts) ELSE 0 END AS {name} FROM {name}_g)"


def _result(n, signal, force, source):
    return f"SELECT symbol, ts, CAST(coalesce({signal}, 0) AS INTEGER) AS signal, {o.r6(f'coalesce({force}, 0)')} AS strength FROM {source}"


_clip = lambda x: f"greatest(0.0, least(1.0, {x}))"
_c = lambda x: f"coalesce({x}, false)"
_B = f"CASE WHEN osc IS NOT NULL AND dwma IS NOT NULL AND range_atr IS NOT NULL AND NOT {_c('(po <= 0 AND osc > 0) OR (po >= 0 AND osc < 0)')} THEN kept ELSE 0 END"
SQL = {
    1: _osc_sql(
        _result(1, "sg", f"CASE WHEN sg != 0 THEN CASE WHEN {_c('close > dwma + range_atr OR close < dwma - range_atr')} THEN {_clip(_clip('abs(osc) / 100') + ' * 1.5')} ELSE {_clip('abs(osc) / 100')} END ELSE 0 END", "b3"),
        f"b1 AS (SELECT *, CASE WHEN osc > 0 AND (close > dwma OR close > dwma + range_atr) THEN 1 WHEN osc < 0 AND (close < dwma OR close < dwma - range_atr) THEN -1 END AS raw FROM oz), b2 AS (SELECT *, coalesce(last_value(raw IGNORE NULLS) {_up}, 0) AS kept FROM b1), b3 AS (SELECT *, {_B} AS sg FROM b2)",
    ),
    2: _osc_sql(
        _result(2, "sg", f"CASE WHEN sg != 0 THEN greatest({_clip('greatest(hu, hd) / 6.0')}, {_clip('abs(osc) / 100')} * 0.7) ELSE 0 END", "b3"),
        _held_sql("hu", "osc > 0", "oz"), _held_sql("hd", "osc < 0", "hu_t"), "b3 AS (SELECT *, CASE WHEN hu >= 3 THEN 1 WHEN hd >= 3 THEN -1 ELSE 0 END AS sg FROM hd_t)",
    ),
    4: _osc_sql(
        _result(4, "CASE WHEN mo > 5 THEN 1 WHEN mo < -5 THEN -1 ELSE 0 END", f"CASE WHEN abs(mo) > 5 THEN greatest({_clip('abs(mo) / 15')}, {_clip('abs(osc) / 100')} * 0.5) ELSE 0 END", "b1"),
        f"b1 AS (SELECT *, osc - lag(osc, 3) OVER {o.W} AS mo FROM oz)",
    ),
    9: _osc_sql(
        _result(9, "sg", f"CASE WHEN sg != 0 THEN greatest(0.4, ({_clip('abs(po) / 100')} + {_clip('1 - abs(osc) / 10')}) / 2) ELSE 0 END", "b3"),
        _held_sql("hu", "osc > 80", "oz"), _held_sql("hd", "osc < -80", "hu_t"), f"b3 AS (SELECT *, CASE WHEN abs(osc) <= 10 AND lag(hd) OVER {o.W} >= 3 THEN 1 WHEN abs(osc) <= 10 AND lag(hu) OVER {o.W} >= 3 THEN -1 ELSE 0 END AS sg FROM hd_t)",
    ),
    8: _osc_sql(
        _result(8, "sg", f"CASE WHEN sg != 0 THEN ({_clip('abs(osc) / 100')} + {_clip('abs(sl) / 10')}) / 2 ELSE 0 END", "b3"),
        f"b1 AS (SELECT *, CASE WHEN count(osc) {o.over(10)} >= 7 THEN (osc - lag(osc, 9) OVER {o.W}) / 10 END AS sl, sum(CASE WHEN osc > 20 THEN 1 ELSE 0 END) {o.over(10)} AS ov, sum(CASE WHEN osc < -20 THEN 1 ELSE 0 END) {o.over(10)} AS un, count(*) {o.over(10)} AS k FROM oz)",
        "b3 AS (SELECT *, CASE WHEN osc > 20 AND sl > 0 AND greatest(ov, un) >= 7 AND k >= 7 THEN 1 WHEN osc < -20 AND sl < 0 AND greatest(ov, un) >= 7 AND k >= 7 THEN -1 ELSE 0 END AS sg FROM b1)",
    ),
}


def _zone_sql(upper, lower, tired):
    """Confirmed crossings, carried while the bar stays in its zone; ends in z2 with sg, cu, cd."""
    return [
        _held_sql("hu", f"osc > {upper}", "oz"), _held_sql("hd", f"osc < {lower}", "hu_t"),
        f"x1 AS (SELECT *, {_c(f'po <= {upper} AND osc > {upper}')} AS xu, {_c(f'po >= {lower} AND osc < {lower}')} AS xd, {_c(tired)} AS tired FROM hd_t)",
        f"x2 AS (SELECT *, hu >= 2 AND coalesce(lag(xu, 2) OVER {o.W}, true) AS cu, hd >= 2 AND coalesce(lag(xd, 2) OVER {o.W}, true) AS cd FROM x1)",
        f"x3 AS (SELECT *, sum(CASE WHEN hu_c THEN 0 ELSE 1 END) {_up} AS zu, sum(CASE WHEN hd_c THEN 0 ELSE 1 END) {_up} AS zd FROM x2)",
        "z2 AS (SELECT *, CASE WHEN hu_c AND max(CASE WHEN cu AND NOT tired THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, zu ORDER BY ts ROWS UNBOUNDED PRECEDING) = 1 THEN 1 WHEN hd_c AND max(CASE WHEN cd AND NOT cu AND NOT tired THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, zd ORDER BY ts ROWS UNBOUNDED PRECEDING) = 1 THEN -1 ELSE 0 END AS sg FROM x3)",
    ]


SQL[3] = _osc_sql(_result(3, "sg", f"CASE WHEN sg != 0 THEN {_clip('abs(osc) / 100')} ELSE 0 END", "z2"), *_zone_sql("0", "0", "false"))
SQL[6] = _osc_sql(
    _result(6, "CASE WHEN tired OR osc IS NULL THEN 0 ELSE sg END", f"CASE WHEN tired THEN 0 WHEN sg = 1 THEN greatest({_clip('(osc - 100) / 50')}, CASE WHEN cu THEN 0.3 ELSE 0.2 END) WHEN sg = -1 THEN greatest({_clip('(-100 - osc) / 50')}, CASE WHEN cd THEN 0.3 ELSE 0.2 END) ELSE 0 END", "z2"),
    *_zone_sql("100", "-100", "abs(osc) >= 150"),
)
_five, _bef = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)", "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
SQL[7] = _osc_sql(
    _result(7, f"CASE WHEN lag(bull, 5) OVER {o.W} THEN 1 WHEN lag(bear, 5) OVER {o.W} THEN -1 ELSE 0 END", f"CASE WHEN lag(bull, 5) OVER {o.W} OR lag(bear, 5) OVER {o.W} THEN lag(fo, 5) OVER {o.W} ELSE 0 END", "v4"),
    f"v1 AS (SELECT *, {_c(f'high >= max(high) {_five}')} AS hp, {_c(f'osc >= max(osc) {_five}')} AS op, {_c(f'low <= min(low) {_five}')} AS lp, {_c(f'osc <= min(osc) {_five}')} AS ot FROM oz)",
    f"v2 AS (SELECT *, last_value(CASE WHEN hp THEN high END IGNORE NULLS) {_bef} AS hq, last_value(CASE WHEN op THEN osc END IGNORE NULLS) {_bef} AS oq, last_value(CASE WHEN lp THEN low END IGNORE NULLS) {_bef} AS lq, last_value(CASE WHEN ot THEN osc END IGNORE NULLS) {_bef} AS oo FROM v1)",
    f"v3 AS (SELECT *, {_c('hp AND op AND high > hq AND osc < oq AND abs(osc - oq) >= 10')} AS be, {_c('lp AND ot AND low < lq AND osc > oo AND abs(osc - oo) >= 10')} AS bu FROM v2)",
    f"v4 AS (SELECT *, be AND NOT bu AS bear, bu AND NOT be AS bull, CASE WHEN be AND NOT bu THEN {_clip('(coalesce((high - hq) / nullif(hq, 0) * 100, 0) + abs(osc - oq) / 100) / 2')} WHEN bu AND NOT be THEN {_clip('(coalesce((lq - low) / nullif(lq, 0) * 100, 0) + abs(osc - oo) / 100) / 2')} END AS fo FROM v3)",
)


def _strategy(n):
    def run(spark, sf_dir):
        df = oscillator.STRATEGIES[n](oscillator.oscillator(candles.hourly(spark, sf_dir)))
        return df.select("symbol", "ts", F.col(f"s{n}").alias("signal"), r6(f"f{n}").alias("strength"))

    return run


for _n, _f in oscillator.STRATEGIES.items():
    QUERIES[f"oscillator_{_f.__name__}"] = _strategy(_n)
    ORACLES[f"oscillator_{_f.__name__}"] = SQL[_n]
QUERIES["range_oscillator"] = lambda spark, sf_dir: rounded(oscillator.oscillator(candles.hourly(spark, sf_dir)), ["symbol", "ts"], ["osc"])
ORACLES["range_oscillator"] = _osc_sql(f"SELECT symbol, ts, {o.r6('osc')} AS osc FROM oz")


def _strategies(spark, sf_dir):
    return oscillator.all_strategies(oscillator.oscillator(candles.hourly(spark, sf_dir)))


def _consensus(spark, sf_dir):
    return rounded(oscillator.consensus(_strategies(spark, sf_dir)), ["symbol", "ts"], ["signal", "confidence"])


def _joined_strategies(which):
    """One CTE a strategy, each from its own query text, side by side."""
    ctes = ", ".join(f"q{k} AS MATERIALIZED ({unrounded(SQL[k])})" for k in which)
    cols = ", ".join(f"q{k}.signal AS s{k}, q{k}.strength AS f{k}" for k in which)
    return f"WITH {ctes}, al AS (SELECT q2.symbol, q2.ts, {cols} FROM q2 " + " ".join(f"JOIN q{k} USING (symbol, ts)" for k in which if k != 2) + ")"


_WHICH = (2, 4, 8)
QUERIES["oscillator_consensus"] = lambda spark, sf_dir: rounded(oscillator.consensus(oscillator.all_strategies(oscillator.oscillator(candles.hourly(spark, sf_dir)), _WHICH), _WHICH), ["symbol", "ts"], ["signal", "confidence"])
_ALL = (2, 3, 4, 6, 7, 8, 9)


def _consensus_sql(which, need):
    votes = lambda v: " + ".join(f"CASE WHEN s{k} = {v} THEN 1 ELSE 0 END" for k in which)
    forces = " + ".join(f"CASE WHEN s{k} = sg THEN f{k} ELSE 0 END" for k in which)
    return _joined_strategies(which) + f", v AS (SELECT *, {votes(1)} AS up, {votes(-1)} AS dn FROM al), g AS (SELECT *, CASE WHEN up >= {need} AND up > dn THEN 1 WHEN dn >= {need} AND dn > up THEN -1 ELSE 0 END AS sg FROM v) SELECT symbol, ts, sg AS signal, {o.r6(f'CASE WHEN sg = 0 THEN 0.0 ELSE 0.6 * (greatest(up, dn) / {len(which)}) + 0.4 * (({forces}) / greatest(up, dn)) END')} AS confidence FROM g"


ORACLES["oscillator_consensus"], ORACLES["oscillator_consensus_full"] = _consensus_sql(_WHICH, 2), _consensus_sql(_ALL, 4)
QUERIES["oscillator_consensus_full"] = _consensus
QUERIES["oscillator_weighted_consensus"] = lambda spark, sf_dir: oscillator.weighted_consensus(_strategies(spark, sf_dir), {2: 1.0, 3: 0.8, 4: 0.6, 8: 1.2}).select("symbol", "ts", "signal")
ORACLES["oscillator_weighted_consensus"] = (
    _joined_strategies((2, 3, 4, 8))
    + ", v AS (SELECT *, (CASE WHEN s2 = 1 THEN 1.0 ELSE 0 END + CASE WHEN s3 = 1 THEN 0.8 ELSE 0 END + CASE WHEN s4 = 1 THEN 0.6 ELSE 0 END + CASE WHEN s8 = 1 THEN 1.2 ELSE 0 END) AS up, (CASE WHEN s2 = -1 THEN 1.0 ELSE 0 END + CASE WHEN s3 = -1 THEN 0.8 ELSE 0 END + CASE WHEN s4 = -1 THEN 0.6 ELSE 0 END + CASE WHEN s8 = -1 THEN 1.2 ELSE 0 END) AS dn FROM al) SELECT symbol, ts, CAST(CASE WHEN up > dn AND up > 0.5 AND up - dn > 0.1 THEN 1 WHEN dn > up AND dn > 0.5 AND dn - up > 0.1 THEN -1 ELSE 0 END AS INTEGER) AS signal FROM v"
)
QUERIES["oscillator_market_conditions"] = lambda spark, sf_dir: rounded(oscillator.market_conditions(oscillator.oscillator(candles.hourly(spark, sf_dir))), ["symbol"], ["volatility", "trend", "ranging", "strategies"])
ORACLES["oscillator_market_conditions"] = _osc_sql(
    f"SELECT symbol, {o.r6('vo')} AS volatility, {o.r6('tr')} AS trend, {o.r6('1 - tr')} AS ranging, array_to_string(CASE WHEN len(pk) > 0 THEN pk ELSE [2, 3, 4, 6, 7, 8, 9] END, ',') AS strategies FROM w3",
    f"w0 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn, abs(osc - po) AS mv FROM oz), w1 AS (SELECT symbol, stddev_samp(range_atr) AS sd, avg(range_atr) AS m, avg(CASE WHEN rn < 20 THEN mv END) AS mv, max(osc) - min(osc) AS sp FROM w0 WHERE rn <= 20 GROUP BY symbol), w2 AS (SELECT symbol, CASE WHEN m > 0 THEN least(1.0, sd / (m + 1e-10) * 2) ELSE 0.5 END AS vo, CASE WHEN sp > 0 THEN least(1.0, mv / (sp + 1e-10) * 2) ELSE 0.5 END AS tr FROM w1), w3 AS (SELECT *, list_sort(list_distinct(list_concat(CASE WHEN vo >= 0.6 THEN [6, 7] ELSE [] END, CASE WHEN tr >= 0.5 THEN [3, 4, 6, 8] ELSE [] END, CASE WHEN 1 - tr >= 0.5 THEN [2, 7, 9] ELSE [] END))) AS pk FROM w2)",
)
QUERIES["oscillator_adaptive_weights"] = lambda spark, sf_dir: rounded(oscillator.adaptive_weights(_strategies(spark, sf_dir), (2, 3, 4, 8)), ["symbol"], ["w2", "w3", "w4", "w8"])
_FOUR = (2, 3, 4, 8)
ORACLES["oscillator_adaptive_weights"] = (
    _joined_strategies(_FOUR) + ", t AS (SELECT *, sign(s2 + s3 + s4 + s8) AS vote FROM al QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 10), g AS (SELECT symbol, "
    + ", ".join(f"greatest(0.1, 0.6 * avg(CASE WHEN s{k} = vote THEN 1.0 ELSE 0.0 END) + 0.4 * coalesce(avg(CASE WHEN s{k} != 0 THEN f{k} END), 0)) AS w{k}" for k in _FOUR) + " FROM t GROUP BY symbol) SELECT symbol, " + ", ".join(f"{o.r6(f'w{k} / (w2 + w3 + w4 + w8) * 4')} AS w{k}" for k in _FOUR) + " FROM g"
)


def _combined_sql(mode):
    """The joint vote of the strategies that each symbol's market conditions choose."""
    on = lambda k: f"list_contains(string_split(strategies, ','), '{k}')"
    side = lambda v: " + ".join(f"CASE WHEN {on(k)} AND s{k} = {v} THEN 1 ELSE 0 END" for k in _ALL)
    enough = {"threshold": ("up >= ceil(n * 0.5) AND up > dn", "dn >= ceil(n * 0.5) AND dn > up"), "weighted": ("up > 0.5 AND up - dn > 0.1", "dn > 0.5 AND dn - up > 0.1")}[mode]
    force = lambda what: " + ".join(f"CASE WHEN {on(k)} AND vote != 0 AND s{k} = vote THEN {what.format(k=k)} ELSE 0 END" for k in _ALL)
    return (
        _joined_strategies(_ALL) + f", mc AS ({ORACLES['oscillator_market_conditions']}), os AS ({unrounded(ORACLES['range_oscillator'])}), j AS (SELECT al.*, strategies, osc, len(string_split(strategies, ',')) AS n FROM al JOIN mc USING (symbol) JOIN os USING (symbol, ts)), v AS (SELECT *, {side(1)} AS up, {side(-1)} AS dn FROM j), "
        f"w AS (SELECT *, CASE WHEN osc IS NULL THEN 0 WHEN {enough[0]} THEN 1 WHEN {enough[1]} THEN -1 ELSE 0 END AS vote FROM v) SELECT symbol, ts, vote AS signal, {o.r6(f'coalesce(({force("f{k}")}) / nullif({force("1")}, 0), 0)')} AS strength, strategies FROM w"
    )


for _mode in ("threshold", "weighted"):
    QUERIES[f"oscillator_dynamic_{_mode}"] = lambda spark, sf_dir, mode=_mode: rounded(oscillator.combined(oscillator.oscillator(candles.hourly(spark, sf_dir)), mode=mode, dynamic=True), ["symbol", "ts", "signal", "strategies"], ["strength"])
    ORACLES[f"oscillator_dynamic_{_mode}"] = _combined_sql(_mode)
QUERIES["oscillator_fallback"] = lambda spark, sf_dir: rounded(oscillator.combined(oscillator.oscillator(candles.hourly(spark, sf_dir)), ()), ["symbol", "ts", "signal"], ["strength"])
ORACLES["oscillator_fallback"] = SQL[1]
QUERIES["oscillator_summary"] = lambda spark, sf_dir: rounded(oscillator.summary(oscillator.basic(oscillator.oscillator(candles.hourly(spark, sf_dir))), "s1", "f1"), ["symbol", "bars", "longs", "shorts", "flats"], ["active_percent"])
ORACLES["oscillator_summary"] = f"SELECT symbol, count(*)::BIGINT AS bars, count_if(signal = 1)::BIGINT AS longs, count_if(signal = -1)::BIGINT AS shorts, count_if(signal = 0)::BIGINT AS flats, {o.r6('100.0 * count_if(signal != 0) / count(*)')} AS active_percent FROM ({SQL[1]}) GROUP BY symbol"
QUERIES["oscillator_heat"] = lambda spark, sf_dir: oscillator.heat(candles.hourly(spark, sf_dir)).select("symbol", "ts", F.col("level").cast("long").alias("level"), F.col("touches").cast("long").alias("touches"))
ORACLES["oscillator_heat"] = o.query(
    o.HOURLY, f"h AS (SELECT *, max(high) {o.over(100)} AS hi, min(low) {o.over(100)} AS lo, list(close) {o.over(100)} AS cs FROM c), h2 AS (SELECT *, coalesce(least(9, CAST(floor((close - lo) / nullif(hi - lo, 0) * 10) AS BIGINT)), 0) AS level FROM h)",
    select="SELECT symbol, ts, CAST(level AS BIGINT) AS level, CAST(len(list_filter(cs, lambda v: coalesce(least(9, CAST(floor((v - lo) / nullif(hi - lo, 0) * 10) AS BIGINT)), 0) = level)) AS BIGINT) AS touches FROM h2",
)

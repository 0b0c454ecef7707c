"""Queries of strategy views, adaptive centres, momentum pairs, targets, walk-forward signals, models on disk and fetched candles."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions.windows import r6
from ..operators import atc, backtest, labels, models, oscillator, pairs, sampling, spc, targets, voting
from ..operators import indicators as ind
from ..sources import candles, fetch
from ..streaming import live
from . import oracle_text as o
from .analysis_queries import _BT, _N, _SIG, _TRADES, _VS, _clustered, _conf, _signalled
from .indicator_queries import ORACLES as INDICATORS
from .indicator_queries import guarded
from .more_oracles import _SCORED, unrounded
from .relational_queries import ORACLES as RELATIONAL
from .signal_queries import CFG, SQL, _classify_sql
from .streaming_queries import _work, finished

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


# --- trend classification: as known a bar before, of one symbol, over files
_KINDS = ", ".join(f"{R(f'l{k}')} AS {kind}" for k, kind in enumerate(atc.KINDS))
add("atc_strategy_view", lambda d: atc.strategy_view(atc.classify(d, CFG)).select("symbol", "ts", "average", "trend"), _classify_sql(f"SELECT symbol, ts, {R('coalesce(b, 0)')} AS average, CAST(sign(coalesce(b, 0)) AS INTEGER) AS trend FROM (SELECT *, {o.lag('av')} AS b FROM fin)"))
_ONE = o.HOURLY.replace("c AS (", "c0 AS (", 1) + ", c AS (SELECT symbol, ts, high AS close FROM c0 WHERE symbol = 'view' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 150)"
add("atc_analyze_symbol", lambda d: atc.analyze(d, "view", 150, "HIGH", CFG), _classify_sql(f"SELECT symbol, ts, {R('close')} AS price, {_KINDS}, {R('av')} AS average, CAST(sign(av) AS INTEGER) AS trend FROM fin", _ONE))


def _file_backtest(d):
    at = _work(d.sparkSession)
    candles.write(d.repartition("symbol"), f"{at}/bars", "csv")
    return atc.backtest(candles.read_csv(d.sparkSession, f"{at}/bars"), CFG)


add(
    "atc_file_backtest", _file_backtest,
    _classify_sql(f"SELECT symbol, count(*)::BIGINT AS bars, count_if(t != 0)::BIGINT AS active, count_if(t * rr > 0)::BIGINT AS hits, {R('sum(t * coalesce(rr, 0))')} AS gain FROM (SELECT *, sign(coalesce({o.lag('av')}, 0)) AS t FROM fin) GROUP BY symbol"),
)

# --- clustering
_ADAPTIVE = f"z AS ({unrounded(INDICATORS['rsi'])}), y AS (SELECT *, {guarded('avg(rsi)', 'rsi', _N)} AS m, coalesce({guarded('stddev_samp(rsi)', 'rsi', _N)} / nullif(abs({guarded('avg(rsi)', 'rsi', _N)}), 0), 0) AS vol, CASE WHEN count(rsi) {o.over(_N)} = {_N} THEN list_sort(list(rsi) {o.over(_N)}) END AS v FROM z), x AS (SELECT *, (vol - median(vol) OVER (PARTITION BY symbol)) * 2 AS more FROM y)"
_pick = lambda p, lo, hi: f"v[CAST(floor({_N - 1} * greatest({lo}, least({hi}, {p})) / 100) AS INTEGER) + 1]"
add("spc_adaptive_centers", lambda d: spc.adaptive_centers(ind.rsi(d), "rsi", _N).select("symbol", "ts", "rsi_low", "rsi_high"), f"WITH {_ADAPTIVE} SELECT symbol, ts, {R('(' + _pick('5 - more', '1.0', '20.0') + ' + m) / 2')} AS rsi_low, {R('(' + _pick('95 + more', '80.0', '99.0') + ' + m) / 2')} AS rsi_high FROM x")
_THREE = ("rsi", "zscore", "mar")
_W = {"rsi": "1 - (abs(corr(rsi, zscore)) + abs(corr(rsi, mar))) / 2", "zscore": "1 - (abs(corr(rsi, zscore)) + abs(corr(zscore, mar))) / 2", "mar": "1 - (abs(corr(rsi, mar)) + abs(corr(zscore, mar))) / 2"}


def _center(x, n, p):
    return f"(CASE WHEN count({x}) {o.over(n)} = {n} THEN list_sort(list({x}) {o.over(n)})[{int((n - 1) * p) + 1}] END + ({guarded(f'avg({x})', x, n)})) / 2"


_dist = lambda j: "(" + " + ".join(f"coalesce(abs({x} - {x}{j}) * w_{x}, 0)" for x in _THREE) + ") / nullif(" + " + ".join(f"CASE WHEN {x} - {x}{j} IS NULL THEN 0 ELSE w_{x} END" for x in _THREE) + f", 0) * pow({0.999!r}, age)"
add(
    "spc_unique_decayed", lambda d: spc.cluster(ind.moving_average_ratio(ind.z_score(ind.rsi(d))), _THREE, _N, unique=True, decay=0.999).select("symbol", "ts", "cluster", "real_clust", "distance"),
    f"WITH f AS MATERIALIZED (SELECT * FROM ({unrounded(INDICATORS['rsi'])}) JOIN ({unrounded(INDICATORS['z_score'])}) USING (symbol, ts) JOIN ({unrounded(INDICATORS['moving_average_ratio'])}) USING (symbol, ts)), w AS (SELECT symbol, " + ", ".join(f"{e} AS w_{x}" for x, e in _W.items()) + " FROM f GROUP BY symbol), "
    f"k AS (SELECT f.*, count(*) OVER (PARTITION BY symbol) - row_number() OVER {o.W} AS age, " + ", ".join(f"{_center(x, _N, p)} AS {x}{j}" for x in _THREE for j, p in enumerate((0.05, 0.95))) + f" FROM f), d AS (SELECT *, {_dist(0)} AS d0, {_dist(1)} AS d1 FROM k JOIN w USING (symbol)), "
    f"e AS (SELECT *, CASE WHEN d0 + d1 IS NULL THEN NULL WHEN d0 <= d1 THEN 0 ELSE 1 END AS cl, CASE WHEN d0 + d1 IS NULL THEN NULL WHEN d0 = 0 AND d1 = 0 THEN 0.5 ELSE coalesce(least(d0, d1) / nullif(d0 + d1, 0), 0) END AS rel FROM d) SELECT symbol, ts, {R('cl')} AS cluster, {R('cl + (1 - 2 * cl) * rel')} AS real_clust, {R('CASE WHEN cl IS NOT NULL THEN least(d0, d1) END')} AS distance FROM e",
)

# --- pairs for the momentum strategy, metrics by least squares
_M = pairs.MOMENTUM


def _momentum(d):
    found = pairs.candidates(pairs.performance(d))
    t = pairs.pair_metrics(d, found).join(found.select(*pairs.KEYS, "spread"), pairs.KEYS)
    a = spc.latest(ind.adx(d), ["adx"])
    for side in ("long", "short"):
        t = t.join(a.withColumnsRenamed({"symbol": f"{side}_symbol", "adx": f"{side}_adx"}), f"{side}_symbol")
    return pairs.momentum_score(t, "ols").select(*pairs.KEYS, "opportunity")


_leg = lambda x: f"CASE WHEN {x} >= {_M['adx']} THEN 1 WHEN {x} < {_M['adx_none']} THEN {_M['adx_none_factor']} ELSE ({x} / {_M['adx']}) ** 2 END"
add(
    "pair_momentum", _momentum,
    q(f"SELECT long_symbol, short_symbol, {R('''greatest(0, gap * CASE WHEN correlation < 0 THEN 1.1 WHEN abs(correlation) < 0.3 THEN 1.05 WHEN abs(correlation) > 0.75 THEN 0.9 ELSE 1 END * CASE WHEN hurst > 0.5 THEN 1.08 ELSE 1 END * CASE WHEN abs(zs) > 2 THEN 1.15 WHEN abs(zs) > 1 THEN 1.08 ELSE 1 END
      * CASE WHEN la.adx IS NULL OR sa.adx IS NULL THEN 1 ELSE (''' + _leg('la.adx') + ") * (" + _leg('sa.adx') + ''') * CASE WHEN least(la.adx, sa.adx) >= 18 THEN 1.03 ELSE 1 END * CASE WHEN least(la.adx, sa.adx) >= 25 THEN 1.08 ELSE 1 END END
      * CASE WHEN adf_stationary = 1 OR johansen_cointegrated = 1 THEN 0.95 ELSE 1 END * CASE WHEN sharpe < 0.5 THEN 0.97 ELSE 1 END * CASE WHEN abs(dd) > 0.45 THEN 0.97 ELSE 1 END * CASE WHEN calmar < 0.5 THEN 0.98 ELSE 1 END)''')} AS opportunity FROM m JOIN ax la ON la.symbol = long_symbol JOIN ax sa ON sa.symbol = short_symbol""",
      *_SCORED, f"ax AS (SELECT symbol, arg_max(adx, ts) AS adx FROM ({unrounded(INDICATORS['adx'])}) GROUP BY symbol)"),
)

# --- signals for every bar from indicators computed once
_OSC1 = unrounded(SQL[1])


def _hybrid(d):
    osc = oscillator.basic(oscillator.oscillator(d)).select("symbol", "ts", F.col("s1").alias("osc_signal"), F.col("f1").alias("osc_confidence"))
    clusters = spc.transition_strategy(_clustered(d)).select("symbol", "ts", F.col("signal").alias("spc_signal"), F.col("strength").alias("spc_confidence"))
    mean = _conf(d).select("symbol", "ts", F.col("m20_signal").alias("ma_signal"), F.col("m20_confidence").alias("ma_confidence"))
    return osc.join(clusters, ["symbol", "ts"]).join(mean, ["symbol", "ts"])


def _hybrid_sql(select):
    from .analysis_queries import ORACLES as ANALYSIS

    return f"WITH a AS MATERIALIZED ({_OSC1}), b AS MATERIALIZED ({unrounded(ANALYSIS['spc_cluster_transition'])}), m AS ({q('SELECT symbol, ts, m20 * 2 - 1 AS signal FROM v', _VS)}), j AS (SELECT a.symbol, a.ts, a.signal AS s1, a.strength AS f1, b.signal AS s2, b.strength AS f2, m.signal AS s3, 0.6 AS f3 FROM a JOIN b USING (symbol, ts) JOIN m USING (symbol, ts)){select}"


_VOTERS = ["osc", "spc", "ma"]
_n = lambda v: f"(CASE WHEN s1 = {v} THEN 1 ELSE 0 END + CASE WHEN s2 = {v} THEN 1 ELSE 0 END + CASE WHEN s3 = {v} THEN 1 ELSE 0 END)"
add(
    "hybrid_signals", lambda d: voting.majority(_hybrid(d), _VOTERS, 2).select("symbol", "ts", "signal", "confidence"),
    _hybrid_sql(f", g AS (SELECT *, {_n(1)} AS up, {_n(-1)} AS dn FROM j), h AS (SELECT *, CASE WHEN up > dn AND up >= 2 THEN 1 WHEN dn > up AND dn >= 2 THEN -1 ELSE 0 END AS sg FROM g) SELECT symbol, ts, sg AS signal, {R('CASE WHEN sg = 0 THEN 0 ELSE (CASE WHEN s1 = sg THEN f1 ELSE 0 END + CASE WHEN s2 = sg THEN f2 ELSE 0 END + CASE WHEN s3 = sg THEN f3 ELSE 0 END) / greatest(up, dn) END')} AS confidence FROM h"),
)
add(
    "single_signals", lambda d: voting.highest_confidence(_hybrid(d), _VOTERS).select("symbol", "ts", "signal", "confidence"),
    _hybrid_sql(f", e AS (SELECT symbol, ts, s1 AS s, f1 AS f FROM j WHERE s1 != 0 UNION ALL SELECT symbol, ts, s2, f2 FROM j WHERE s2 != 0 UNION ALL SELECT symbol, ts, s3, f3 FROM j WHERE s3 != 0) SELECT symbol, ts, CAST(arg_max(s, row(f, s)) AS INTEGER) AS signal, {R('max(f)')} AS confidence FROM e GROUP BY symbol, ts"),
)
add(
    "incremental_signals", lambda d: (lambda s: backtest.incremental_signals(s, backtest.trades(s)))(_signalled(d)),
    q("SELECT n.symbol, n.ts, CASE WHEN EXISTS (SELECT 1 FROM tr WHERE tr.symbol = n.symbol AND n.i > tr.entry_index AND n.i <= tr.exit_index) THEN 0 ELSE n.signal END AS signal FROM n", _SIG, _BT, _TRADES, recursive=True),
)


def _three_rises(history):
    """An example of a callback: the side of three moves in a row, and how far they went."""
    x = history["close"].to_numpy()
    up, down = (x[-3:] > x[-4:-1]).all(), (x[-3:] < x[-4:-1]).all()
    return (1 if up else -1 if down else 0, float(abs(x[-1] / x[-4] - 1)))


add(
    "walk_forward_callback", lambda d: backtest.walk_forward(d, _three_rises, 4),
    q(f"SELECT symbol, ts, CASE WHEN close > a AND a > b AND b > c3 THEN 1 WHEN close < a AND a < b AND b < c3 THEN -1 ELSE 0 END AS signal, {R('coalesce(abs(close / c3 - 1), 0)')} AS confidence FROM z", f"z AS (SELECT symbol, ts, close, {o.lag('close')} AS a, {o.lag('close', 2)} AS b, {o.lag('close', 3)} AS c3 FROM c)"),
)

# --- targets
_LAST = "l AS (SELECT symbol, arg_max(close, ts) AS price, max(high) - min(low) AS span FROM c GROUP BY symbol)"
_side = lambda labels_: "s(direction, sg) AS (VALUES ('UP', 1), ('DOWN', -1)), f(label, x) AS (VALUES " + ", ".join(f"('{n}', {x!r}::DOUBLE)" for n, x in labels_) + ")"
add("targets_fibonacci", lambda d: targets.targets(d, "fibonacci", "NEUTRAL"), q(f"SELECT symbol, direction, label, {R('price + sg * span * x')} AS target_price, {R('sg * span * x')} AS delta, {R('sg * span * x * 100 / price')} AS delta_pct FROM l, s, f", _LAST, _side([(f"Fibonacci {x:g}", x) for x in targets.FIBONACCI])))
add("targets_percent", lambda d: targets.targets(d, "percent", "DOWN"), q(f"SELECT symbol, direction, label, {R('price - price * x / 100')} AS target_price, {R('-price * x / 100')} AS delta, {R('-x')} AS delta_pct FROM l, s, f WHERE direction = 'DOWN'", _LAST, _side([(f"{x:g} %", x) for x in (1.0, 2.0, 5.0)])))

# --- models on disk, rarer classes, hidden states
_TWO = ["close", "volume"]


def _round_trip(d):
    """A fitted model written to shared storage, read back and applied."""
    at = f"{_work(d.sparkSession)}/model"
    models.save_model(models.scaler(d, _TWO), at)
    t = models.load_model(at).transform(d).withColumn("z", vector_to_array("scaled"))
    return t.select("symbol", "ts", *[F.col("z")[i].alias(f"{c}_z") for i, c in enumerate(_TWO)])


add("model_round_trip", _round_trip, q("SELECT symbol, ts, " + ", ".join(f"{R(f'({x} - avg({x}) OVER ()) / stddev_samp({x}) OVER ()')} AS {x}_z" for x in _TWO) + " FROM c"))
_PER = "(PARTITION BY symbol, target ORDER BY ts)"
add(
    "oversampled_classes", lambda d: models.oversampled(d.withColumn("target", F.when(F.col("close") > 300, 2).when(F.col("close") > F.col("open"), 1).otherwise(0)), _TWO),
    q(f"SELECT symbol, target, {R('close')} AS close, {R('volume')} AS volume, 0 AS synthetic FROM t UNION ALL SELECT symbol, target, {R('close + i / (u + 1) * (c1 - close)')}, {R('volume + i / (u + 1) * (v1 - volume)')}, 1 FROM (SELECT *, unnest(range(1, u + 1)) AS i FROM x)",
      "t AS (SELECT *, CASE WHEN close > 300 THEN 2 WHEN close > open THEN 1 ELSE 0 END AS target FROM c)", f"p AS (SELECT *, lead(close) OVER {_PER} AS c1, lead(volume) OVER {_PER} AS v1, max(k) OVER () - k AS need FROM (SELECT *, count(*) OVER (PARTITION BY target) AS k FROM t))",
      "w AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY ts, symbol) - 1 AS nth, count(*) OVER (PARTITION BY target) AS np FROM p WHERE c1 IS NOT NULL), x AS (SELECT *, need // np + CASE WHEN nth < need % np THEN 1 ELSE 0 END AS u FROM w)"),
)
add("hmm_hidden_swings", lambda d: models.swing_hmm(models.swing_states(d)))
_COLS = ["roc_2", "roc_5", "roc_10", "high_low", "close_open", "ret_std", "ret_skew"]
add("forest_cross_validated", lambda d: models.cross_validated(labels.forest_features(labels.directional(d)), _COLS, lambda t, c, y: models.forest(t, c, y, trees=5, depth=3), folds=3))

# --- sources
QUERIES["fetched_candles"] = lambda spark, sf_dir: fetch.fetch(spark, "ohlcraft.sources.fetch:rehearsal", ["EURUSD", "XAU", "btc"], 240, 28_400_000, 28_440_000)
ORACLES["fetched_candles"] = "SELECT symbol, TIMESTAMP '1970-01-01' + to_minutes(m) AS ts, b AS open, b + 3.0 AS high, b - 2.0 AS low, b + (m // 240) % 4 - 1.5 AS close, 10.0::DOUBLE + (m // 240) % 5 AS volume FROM (SELECT symbol, m, (100 + (m // 240 * 7 + length(symbol) * 13) % 50)::DOUBLE AS b FROM (VALUES ('EURUSD'), ('XAU'), ('btc')) s(symbol), range(28400000, 28440000, 240) r(m))"


def _spot(spark, sf_dir):
    s = candles.table(spark, sf_dir, "supplier")
    m = s.select(F.upper(F.concat(F.lit("s"), F.col("s_suppkey"))).alias("symbol"), F.when(F.col("s_nationkey") % 3 == 0, "BTC").otherwise("USDT").alias("quote"), (F.col("s_suppkey") % 7 != 0).alias("active"), (F.col("s_suppkey") % 5 != 0).alias("contract"))
    return candles.discover_spot(m, "USDT")


QUERIES["spot_symbols"] = _spot
ORACLES["spot_symbols"] = "SELECT DISTINCT upper('s' || s_suppkey) AS symbol FROM supplier WHERE s_nationkey % 3 != 0 AND s_suppkey % 7 != 0 AND s_suppkey % 5 = 0"


def _symbol_lists(spark, sf_dir):
    """Three lists, one a format, with repeats, spaces and remarks."""
    n = candles.table(spark, sf_dir, "nation").select(F.concat(F.lit("  "), F.col("n_name"), F.lit(" ")).alias("symbol"), "n_nationkey")
    at = _work(spark)
    n.where("n_nationkey < 10").select("symbol").unionByName(n.where("n_nationkey < 3").select("symbol")).write.option("header", True).csv(f"{at}/csv")
    n.where("n_nationkey BETWEEN 8 AND 15").select(F.concat("symbol", F.lit("# a remark")).alias("value")).unionByName(spark.sql("SELECT '# only a remark' AS value")).write.text(f"{at}/txt")
    n.where("n_nationkey > 15").select("symbol").write.json(f"{at}/json")
    lists = [candles.read_symbols(spark, f"{at}/{fmt}", fmt).withColumn("format", F.lit(fmt)) for fmt in ("csv", "txt", "json")]
    return lists[0].unionByName(lists[1]).unionByName(lists[2])


QUERIES["symbol_lists"] = _symbol_lists
ORACLES["symbol_lists"] = "SELECT n_name AS symbol, 'csv' AS format FROM nation WHERE n_nationkey < 10 UNION ALL SELECT n_name, 'txt' FROM nation WHERE n_nationkey BETWEEN 8 AND 15 UNION ALL SELECT n_name, 'json' FROM nation WHERE n_nationkey > 15"


def _many_files(d):
    """Candles in several folders of several files each, read in one scan."""
    at = _work(d.sparkSession)
    for k in range(3):
        candles.write(d.where(F.dayofmonth("ts") % 3 == k).repartition(2), f"{at}/part{k}", "csv")
    return candles.read_csv(d.sparkSession, [f"{at}/part{k}" for k in range(3)]).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.sum("close").alias("total"))


add("multi_file_scan", _many_files, q(f"SELECT symbol, count(*)::BIGINT AS n, min(ts) AS first, max(ts) AS last, {R('sum(close)')} AS total FROM c GROUP BY symbol"))
QUERIES["sample_without_volumes"] = lambda spark, sf_dir: sampling.sample(candles.daily(spark, sf_dir).select("symbol").distinct(), "stratified", 20, 7)
ORACLES["sample_without_volumes"] = RELATIONAL["sample_random"]


# --- streams
def _stream(spark, sf_dir, make, value):
    c = candles.hourly(spark, sf_dir).select("symbol", F.col("ts").cast("timestamp").alias("ts"), F.col("close").alias(value))
    at = _work(spark)
    c.coalesce(1).sortWithinPartitions("ts").write.parquet(f"{at}/bars")
    return finished(make(live.ticks(spark, f"{at}/bars", c.schema)), spark).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _stream_centers(spark, sf_dir):
    s = _stream(spark, sf_dir, lambda t: live.streaming_centers(t, 50), "value")
    return s.select("symbol", "ts", *[r6(F.col(x) + 1e-10).alias(x) for x in ("low", "mid", "high")])  # means of prices in cents end in fives


QUERIES["streaming_centers"] = _stream_centers
_win = f"list_sort(list(close) {o.over(50)})"
ORACLES["streaming_centers"] = q(f"SELECT symbol, ts, {R('(v[CAST(floor((len(v) - 1) * 5 / 100) AS INTEGER) + 1] + m) / 2 + 1e-10')} AS low, {R('m + 1e-10')} AS mid, {R('(v[CAST(floor((len(v) - 1) * 95 / 100) AS INTEGER) + 1] + m) / 2 + 1e-10')} AS high FROM z", f"z AS (SELECT *, {_win} AS v, avg(close) {o.over(50)} AS m FROM c)")


def _stream_higher(spark, sf_dir):
    s = _stream(spark, sf_dir, live.with_higher, "close")
    return s.select("symbol", "ts", r6("close").alias("close"), r6("higher_close").alias("higher_close"), F.col("higher_ts").cast("timestamp_ntz").alias("higher_ts"))


QUERIES["streaming_higher_timeframe"] = _stream_higher
ORACLES["streaming_higher_timeframe"] = q(
    f"SELECT c.symbol, c.ts, {R('c.close')} AS close, {R('p.close')} AS higher_close, p.day AS higher_ts FROM c JOIN dn ON dn.symbol = c.symbol AND dn.day = date_trunc('day', c.ts) LEFT JOIN dn p ON p.symbol = c.symbol AND p.n = dn.n - 1",
    "dn AS (SELECT symbol, date_trunc('day', ts)::TIMESTAMP AS day, arg_max(close, ts) AS close, row_number() OVER (PARTITION BY symbol ORDER BY date_trunc('day', ts)) AS n FROM c GROUP BY symbol, date_trunc('day', ts))",
)

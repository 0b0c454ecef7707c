"""Operators against plain loops, on hand-made candles with awkward series."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ohlcraft.functions.windows import fold
from ohlcraft.operators import atc, backtest, engine, models, oscillator, pairs, quant, relational, sampling, voting
from ohlcraft.operators import indicators as ind
from ohlcraft.sources import candles


def make(spark, series):
    """Candles from closes by symbol; symbols interleaved, hours in a row."""
    t0, rows = dt.datetime(2024, 1, 1), []
    for symbol, closes in series.items():
        for i, c in enumerate(closes):
            rows.append((symbol, t0 + dt.timedelta(hours=i), c, None if c is None else c * 1.01, None if c is None else c * 0.99, c, 1.0 * i))
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, candles.OHLCV)


@pytest.fixture(scope="module")
def prices():
    rng = random.Random(3)
    walk = [100.0]
    for _ in range(120):
        walk.append(max(1.0, walk[-1] + rng.uniform(-3, 3)))
    return {"walk": walk, "flat": [5.0] * 60, "one": [7.0], "up": [float(i + 1) for i in range(80)]}


def collect(df, *cols):
    out = {}
    for r in df.orderBy("symbol", "ts").collect():
        out.setdefault(r.symbol, []).append(r[cols[0]] if len(cols) == 1 else tuple(r[c] for c in cols))
    return out


def slow_ema(x, n):
    out, m = [], None
    for i, v in enumerate(x):
        if i == n - 1:
            m = sum(x[:n]) / n
        elif i >= n:
            m += 2 / (n + 1) * (v - m)
        out.append(m)
    return out


def near(a, b):
    return a is b is None or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


def test_fold_keeps_symbols_apart(spark, prices):
    got = collect(fold(make(spark, prices), ["close"], "struct(0D AS t)", "struct(s.t + x.close AS t)", {"total": "s.t"}), "total")
    for s, x in prices.items():
        assert all(near(a, b) for a, b in zip(got[s], np.cumsum(x).tolist(), strict=True))


def test_ema_rsi_kama(spark, prices):
    df = make(spark, prices)
    got, rsi, kama = collect(ind.ema(df, 14), "ema"), collect(ind.rsi(df), "rsi"), collect(ind.kama_atc(df, 10), "kama_atc")
    for s, x in prices.items():
        assert all(near(a, b) for a, b in zip(got[s], slow_ema(x, 14), strict=True))
        k, want = x[0], []
        for i, v in enumerate(x):
            if i >= 10:
                path = sum(abs(x[j] - x[j - 1]) for j in range(i - 9, i + 1))
                er = abs(v - x[i - 10]) / path if path else 0
                k += (er * (0.666 - 0.064) + 0.064) ** 2 * (v - k)
            want.append(k)
        assert all(near(a, b) for a, b in zip(kama[s], want, strict=True))
    assert set(rsi["flat"]) == {50.0} and rsi["one"] == [50.0] and rsi["up"][-1] == 100.0


def test_atc_against_loops(spark, prices):
    cfg = atc.Config(length=10, robustness="Narrow")
    kinds = ("EMA", "WMA")
    got = collect(atc.classify_by_kind(make(spark, prices), cfg, kinds), *kinds, "average")

    def wma(x, n):
        return [None if i < n - 1 else sum((n - k) * x[i - k] for k in range(n)) / (n * (n + 1) // 2) for i in range(len(x))]

    def persisted(x, m):
        s, out = 0, []
        for i in range(len(x)):
            if i and None not in (m[i], m[i - 1]):
                s = 1 if x[i] > m[i] and x[i - 1] <= m[i - 1] else -1 if x[i] < m[i] and x[i - 1] >= m[i - 1] else s
            out.append(s)
        return out

    def equity(sig, rg):
        e, out = 1.0, []
        for i in range(len(sig)):
            if i:
                a = rg[i] if sig[i - 1] > 0 else -rg[i] if sig[i - 1] < 0 else 0
                e = max(0.25, e * (1 - cfg.decay / 100) * (1 + a))
            out.append(e)
        return out

    for s, x in prices.items():
        rg = [0.0] + [(x[i] / x[i - 1] - 1) * math.exp(cfg.lam / 1000 * max(i, 1)) for i in range(1, len(x))]
        layers, weights = [], []
        for make_ma in (slow_ema, wma):
            sig = [persisted(x, make_ma(x, n)) for n in atc.lengths(10, "Narrow")]
            eq = [equity(g, rg) for g in sig]
            layer = [round(sum(g[i] * e[i] for g, e in zip(sig, eq, strict=True)) / sum(e[i] for e in eq) * 100) / 100 for i in range(len(x))]
            layers.append(layer)
            weights.append(equity(layer, rg))
        for i, (a, b, avg) in enumerate(got[s]):
            assert near(a, layers[0][i]) and near(b, layers[1][i])
            cut = [1 if v[i] > 0.1 else -1 if v[i] < -0.1 else 0 for v in layers]
            assert near(avg, sum(c * w[i] for c, w in zip(cut, weights, strict=True)) / sum(w[i] for w in weights))


def test_atc_together_equals_kind_by_kind(spark, prices):
    cfg = atc.Config(length=10, robustness="Wide")
    cols = (*atc.KINDS, "average")
    # a straight line lies on its own least-squares mean: there, crossings are rounding
    prices = {k: v[:70] for k, v in prices.items() if k != "up"}
    df = make(spark, prices)
    a, b, c = (collect(f(df, cfg), *cols) for f in (atc.classify, atc.classify_by_kind, atc.classify_native))
    for s in prices:
        assert all(near(u, v) and near(u, w) for x, y, z in zip(a[s], b[s], c[s], strict=True) for u, v, w in zip(x, y, z, strict=True))


@pytest.mark.parametrize("kind", ["HMA", "DEMA", "LSMA", "KAMA"])
def test_atc_kinds_are_bounded(spark, prices, kind):
    cfg = atc.Config(length=10)
    got = collect(atc.layer_one(atc.prepare(make(spark, prices), cfg), kind, cfg), kind)
    assert all(v is None or -1 <= v <= 1 for x in got.values() for v in x) and set(got["flat"]) == {0.0}


def test_backtest_cases(spark):
    def bars(rows):
        t0 = dt.datetime(2024, 1, 1)
        return spark.createDataFrame([("s", t0 + dt.timedelta(hours=i), c, h, lo, c, 1.0, sig) for i, (c, h, lo, sig) in enumerate(rows)], "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, signal int")

    def run(rows, **kw):
        return [(r.entry_index, r.exit_index, r.exit_reason, round(r.pnl, 6)) for r in backtest.trades(bars(rows), **kw).orderBy("exit_index").collect()]

    c = lambda p, s=0: (float(p), float(p), float(p), s)
    assert run([c(100, 1), (99.0, 105.0, 97.0, 1), c(100, 1), c(100)]) == [(0, 1, "STOP_LOSS", -0.02), (2, 3, "END_OF_DATA", 0.0)]  # stop first; no entry on the exit bar
    assert run([c(100, 1), c(105)]) == [(0, 1, "TAKE_PROFIT", 0.04)]
    assert run([c(100, 1), c(99), c(102), c(100.4), c(100)], target=0.5) == [(0, 3, "TRAILING_STOP", round(102 * 0.985 / 100 - 1, 6))]
    assert run([c(100, 1)] + [c(100)] * 4, max_hold=3) == [(0, 3, "MAX_HOLD", 0.0)]
    assert run([c(100, -1), c(95)], side="SHORT") == [(0, 1, "TAKE_PROFIT", 0.04)]
    assert run([c(100, 1)]) == [(0, 0, "END_OF_DATA", 0.0)] and run([c(100)]) == []


def test_beta_quantile_and_kelly(spark):
    # Beta(1, 1) is uniform; Beta(2, 2) has the cdf 3x^2 - 2x^3
    assert math.isclose(backtest.beta_quantile(np.array([1.0]), np.array([1.0]), 0.025)[0], 0.025, abs_tol=1e-9)
    q = backtest.beta_quantile(np.array([2.0]), np.array([2.0]), 0.1)[0]
    assert math.isclose(3 * q * q - 2 * q**3, 0.1, abs_tol=1e-9)
    s = spark.createDataFrame([("a", 100, 0.7, 0.03, 0.01), ("few", 5, 0.9, 0.03, 0.01), ("bad", 100, 0.3, 0.03, 0.01)], "symbol string, num_trades long, win_rate double, avg_win double, avg_loss double")
    k = {r.symbol: r.kelly for r in backtest.kelly(s).collect()}
    assert 0 < k["a"] <= 0.3 and k["few"] == 0 and k["bad"] == 0
    shares = {r.symbol: r.share for r in backtest.allocate(backtest.kelly(s)).collect()}
    assert shares["a"] >= 0.1 and shares["few"] == 0


def test_weights():
    w = voting.weights({"a": 0.9, "b": 0.1})
    assert math.isclose(w["a"], 0.6) and math.isclose(sum(w.values()), 1)
    w = voting.weights({"a": 8, "b": 1, "c": 1})
    assert math.isclose(sum(w.values()), 1) and max(w.values()) <= 0.5
    assert voting.weights({"a": 1}) == {"a": 1.0}


def test_adf_and_johansen(spark):
    rng = np.random.default_rng(0)
    t0 = dt.datetime(2024, 1, 1)
    walk, noise = np.cumsum(rng.normal(size=400)), rng.normal(size=400)
    rows = [(n, t0 + dt.timedelta(hours=i), float(v)) for n, x in (("walk", walk), ("noise", noise)) for i, v in enumerate(x)]
    got = {r.symbol: r for r in quant.adf(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, x double"), ["symbol"], "x").collect()}
    assert got["noise"].adf_stationary == 1 and got["walk"].adf_stationary == 0
    # the statistic from least squares
    d, lag, dl = np.diff(walk)[1:], walk[1:-1], np.diff(walk)[:-1]
    a = np.column_stack([lag, dl, np.ones(len(d))])
    b, res, *_ = np.linalg.lstsq(a, d, rcond=None)
    se = np.sqrt(res[0] / (len(d) - 3) * np.linalg.inv(a.T @ a)[0, 0])
    assert math.isclose(got["walk"].adf_stat, b[0] / se, rel_tol=1e-6)
    both = [("linked", t0 + dt.timedelta(hours=i), float(v), float(2 * v + e)) for i, (v, e) in enumerate(zip(walk, rng.normal(size=400), strict=True))]
    both += [("free", t0 + dt.timedelta(hours=i), float(v), float(u)) for i, (v, u) in enumerate(zip(walk, np.cumsum(rng.normal(size=400)), strict=True))]
    j = {r.k: r for r in quant.johansen(spark.createDataFrame(both, "k string, ts timestamp_ntz, a double, b double"), ["k"], "a", "b").collect()}
    assert j["linked"].johansen_cointegrated == 1 and j["linked"].trace_stat > 5 * j["free"].trace_stat


def test_gaussian_states_find_regimes():
    rng = np.random.default_rng(1)
    truth = np.repeat([0, 1, 0, 1], 100)
    x = np.where(truth == 0, -1.0, 1.0)[:, None] + rng.normal(size=(400, 1)) * 0.3
    assert (models.gaussian_states(x, 2) == truth).mean() > 0.97


def test_consensus_against_loops(spark, prices):
    which = (2, 4, 8)
    df = oscillator.all_strategies(oscillator.oscillator(make(spark, prices), 20), which)
    for r in oscillator.consensus(df, which).collect():
        up, down = (sum(r[f"s{k}"] == v for k in which) for v in (1, -1))
        want = 1 if up >= 2 and up > down else -1 if down >= 2 and down > up else 0
        assert r.signal == want
        if want:
            n = max(up, down)
            assert near(r.confidence, 0.6 * n / 3 + 0.4 * sum(r[f"f{k}"] for k in which if r[f"s{k}"] == want) / n)
        else:
            assert r.confidence == 0


def test_greedy_pairs_and_targets(spark):
    p = spark.createDataFrame([("a", "x", 9.0), ("a", "y", 8.0), ("b", "x", 7.0), ("b", "y", 6.0)], "long_symbol string, short_symbol string, score double")
    assert [(r.long_symbol, r.short_symbol) for r in relational.greedy_unique_pairs(p, 3).orderBy("rank").collect()] == [("a", "x"), ("b", "y"), ("a", "y")]
    t = pairs.by_target(p, spark.createDataFrame([("y",), ("b",)], "symbol string"))
    assert {r.target: r.score for r in t.collect()} == {"y": 8.0, "b": 7.0}


def test_samples(spark):
    df = spark.range(1, 101).select(F.col("id").cast("string").alias("symbol"), F.col("id").cast("double").alias("volume"), F.lit(0.1).alias("spread"), (F.col("id") / 7).alias("volatility"))
    for m in ("random", "volume_weighted", "stratified", "top_n_hybrid", "systematic", "liquidity_weighted"):
        a = {r.symbol for r in sampling.sample(df, m, 10, 5).collect()}
        assert len(a) == 10 and a == {r.symbol for r in sampling.sample(df.repartition(7), m, 10, 5).collect()}
    assert sampling.sample(df, "random", 0).count() == 100
    assert sampling.stage(df, F.col("volume") > 1000).count() == 100 and sampling.stage(df, F.col("volume") > 90).count() == 10


def test_engine_registry(spark, prices):
    df = make(spark, prices)
    out, categories = engine.compute(df, "boosting", {"mine": lambda d: d.withColumn("twice", F.col("close") * 2)})
    assert categories["twice"] == "custom" and categories["DOJI"] == "candlestick" and out.count() == df.count()
    with pytest.raises(TypeError):
        engine.compute(df, "core", {"bad": lambda d: 1})


def test_empty_and_null_candles(spark):
    df = make(spark, {"gap": [1.0, None, 3.0, None, 5.0]})
    for fn in (ind.price_derived, ind.bollinger, ind.rsi, ind.atr, ind.adx, ind.macd, ind.kama, ind.window_kit, ind.on_balance_volume):
        assert fn(df).count() == 5 and fn(df.limit(0)).count() == 0


def test_candles_ties(spark):
    t = dt.datetime(2024, 1, 1, 5)
    ticks = spark.createDataFrame([("s", t, 1.0, 2), ("s", t, 2.0, 1), ("s", t, 3.0, 3)], "k string, ts timestamp_ntz, p double, id long")
    c = candles.build_candles(ticks, F.col("k"), F.col("ts"), F.col("p"), F.col("id"), "hour", F.count(F.lit(1))).first()
    assert (c.open, c.close, c.high, c.low, c.volume) == (2.0, 3.0, 3.0, 1.0, 3.0)


def test_strategy_votes_count_hold(spark):
    t = spark.createDataFrame(
        [("a", "LONG", 1.0, 0.9), ("a", "HOLD", 1.0, 0.2), ("a", "HOLD", 1.0, 0.2), ("a", "HOLD", 1.0, 0.2), ("b", "LONG", 1.0, 0.4), ("b", "SHORT", 3.0, 0.6), ("c", "SHORT", 1.0, 0.5), ("c", "LONG", 1.0, 0.5), ("d", "HOLD", 1.0, 0.0)],
        "symbol string, signal string, weight double, probability double",
    )
    votes = {how: {r.symbol: r.signal for r in models.strategy_vote(t, how).collect()} for how in ("simple", "weighted", "confidence", "threshold")}
    assert votes["simple"] == {"a": "HOLD", "b": "LONG", "c": "LONG", "d": "HOLD"}
    assert votes["weighted"] == {"a": "HOLD", "b": "SHORT", "c": "LONG", "d": "HOLD"}
    assert votes["confidence"] == {"a": "LONG", "b": "SHORT", "c": "LONG", "d": "HOLD"}
    assert votes["threshold"] == {"a": "LONG", "b": "SHORT", "c": "LONG", "d": "HOLD"}


def test_pair_rules_one_by_one(spark):
    good = {"long_symbol": "a", "short_symbol": "b", "spread": 1.0, "correlation": -0.5, "adf_stationary": 1, "johansen_cointegrated": 0, "half_life": 10.0, "hurst": 0.4, "sharpe": 1.0, "max_drawdown": -0.1, "quant_score": 50.0}
    limits = {"min_spread": 0.5, "max_spread": 2.0, "min_correlation": 0.3, "max_correlation": 0.9, "require_cointegration": True, "max_half_life": 20.0, "max_hurst": 0.5, "min_sharpe": 0.5, "max_drawdown": 0.2, "min_quant_score": 40.0}
    bad = [{"long_symbol": None}, {"spread": None}, {"spread": float("inf")}, {"spread": 0.1}, {"spread": 3.0}, {"correlation": 0.1}, {"correlation": -0.95}, {"correlation": 1.5}, {"adf_stationary": 0, "johansen_cointegrated": 1},
           {"adf_stationary": None, "johansen_cointegrated": None}, {"half_life": 30.0}, {"hurst": 0.5}, {"sharpe": 0.1}, {"max_drawdown": -0.3}, {"quant_score": 1.0}]
    fine = [{}, {"correlation": None}, {"adf_stationary": None, "johansen_cointegrated": 1}, {"half_life": None}, {"half_life": float("inf")}, {"hurst": None}, {"sharpe": float("nan")}, {"max_drawdown": None}, {"quant_score": None}]
    schema = "i int, long_symbol string, short_symbol string, spread double, correlation double, adf_stationary int, johansen_cointegrated int, half_life double, hurst double, sharpe double, max_drawdown double, quant_score double"
    table = [(i, *(good | x).values()) for i, x in enumerate([*fine, *bad])]
    got = {r.i for r in pairs.valid(spark.createDataFrame(table, schema), **limits).collect()}
    assert got == set(range(len(fine)))


def test_picked_metrics(spark):
    d = spark.createDataFrame([(1.0, 2.0, 3.0, 1.0, None, 5.0)], "half_life double, kalman_half_life double, sharpe double, kalman_sharpe double, calmar double, kalman_calmar double")
    value = lambda name, how: d.select(pairs.picked(d, name, how)).first()[0]
    assert [value("half_life", h) for h in ("ols", "kalman", "best", "avg")] == [1.0, 2.0, 1.0, 1.5]
    assert [value("sharpe", h) for h in ("ols", "kalman", "best", "avg")] == [3.0, 1.0, 3.0, 2.0]
    assert [value("calmar", h) for h in ("ols", "kalman", "best", "avg")] == [None, 5.0, 5.0, 5.0]
    assert value("hurst", "best") is None


def test_trend_state_equals_the_series(prices):
    from ohlcraft.operators.trend_state import TrendState

    for x in prices.values():
        for cfg in (atc.Config(length=14), atc.Config(length=14, cutout=3, robustness="Wide")):
            layers, final = atc.classify_series(np.array(x), cfg)
            state = TrendState(cfg)
            for i, close in enumerate(x):
                if i % 5 == 0:
                    state = TrendState.unpack(state.pack(), cfg)
                a, b = state.update(close)
                assert np.allclose(a, layers[:, i], equal_nan=True) and near(b, float(np.nan_to_num(final[i])))


def test_streaming_centers_that_adapt():
    from ohlcraft.streaming.live import _centers

    rng = np.random.default_rng(2)
    window, usual = [], 0.0
    for v in np.concatenate([rng.normal(10, 0.1, 60), rng.normal(10, 5, 60)]):
        window = [*window, float(v)][-40:]
        before = usual
        usual, (lo, mid, hi) = _centers(window, usual, 5, 95, True)
        w = np.array(window)
        if len(w) > 1:
            now = w.std() / abs(w.mean())
            assert near(usual, now if before == 0 else 0.01 * now + 0.99 * before)
            p, q = np.clip(5 - 2 * (now - usual), 1, 20), np.clip(95 + 2 * (now - usual), 80, 99)
            s = np.sort(w)
            assert near(lo, (s[int((len(s) - 1) * p / 100)] + w.mean()) / 2) and near(hi, (s[int((len(s) - 1) * q / 100)] + w.mean()) / 2) and near(mid, w.mean())


def test_models_vote_and_are_calibrated(spark):
    from pyspark.ml.linalg import Vectors

    one = spark.createDataFrame([(1, Vectors.dense([0.6, 0.4])), (2, Vectors.dense([0.5, 0.5]))], ["id", "probability"])
    two = spark.createDataFrame([(1, Vectors.dense([0.1, 0.9])), (2, Vectors.dense([0.5, 0.5]))], ["id", "probability"])
    got = {r.id: (r.prediction, r.p) for r in models.soft_vote([one, two], ["id"], 2).collect()}
    assert got[1][0] == 1 and near(got[1][1], 0.65) and got[2] == (0, 0.5)
    scored = spark.createDataFrame([(i / 100, int((i * 7) % 100 < i)) for i in range(100)], "score double, hit int")
    model = models.calibrated(scored, "score", "hit")
    from pyspark.ml.feature import VectorAssembler

    out = [r.calibrated for r in model.transform(VectorAssembler(inputCols=["score"], outputCol="features").transform(scored)).orderBy("score").collect()]
    assert all(a <= b for a, b in zip(out, out[1:], strict=False)) and near(sum(out), sum(r.hit for r in scored.collect()))


def test_custom_indicators_may_name_categories(spark, prices):
    d = make(spark, prices)
    out, categories = engine.compute(d, "core", {"x": lambda t: (t.withColumn("x1", F.lit(1)).withColumn("x2", F.lit(2)), {"x1": "special"})})
    assert categories["x1"] == "special" and categories["x2"] == "custom" and {"x1", "x2"} <= set(out.columns)
    with pytest.raises(TypeError):
        engine.compute(d, "core", {"x": lambda t: (t, "no mapping")})


def test_targets_can_be_registered(spark, prices):
    from ohlcraft.operators import targets

    d = make(spark, prices)
    targets.register("fixed", lambda t: (t.groupBy("symbol").agg(F.max_by("close", "ts").alias("price")), {"ten": F.lit(10.0)}))
    got = {(r.symbol, r.direction): r.target_price for r in targets.targets(d, "fixed", "NEUTRAL").collect()}
    assert got[("one", "UP")] == 17.0 and got[("one", "DOWN")] == -3.0
    assert {r.label for r in targets.targets(d, "atr").collect()} == {"ATR x1", "ATR x2", "ATR x3"}
    with pytest.raises(TypeError):
        targets.register("no", 5)


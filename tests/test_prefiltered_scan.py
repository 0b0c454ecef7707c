"""The scan behind its approximate filter, against the exact scan."""

import datetime as dt

import numpy as np
import pandas as pd

from ohlcraft.operators import atc


def test_approximate_averages_against_pandas():
    close = pd.Series(np.random.default_rng(1).normal(0, 1, 90).cumsum() + 100)
    got = atc.approximate_series(close.to_numpy(), (9,))[:, 0]
    plain = close.rolling(9, min_periods=1).mean()
    line = lambda x, m: x.rolling(m).apply(lambda v: np.average(v, weights=np.arange(1, m + 1)), raw=True).fillna(x.rolling(m, min_periods=1).mean())
    chord = ((close + close.shift(8)) / 2).fillna(plain)
    want = [plain, line(2 * line(close, 4) - line(close, 9), 3), line(close, 9), 2 * plain - plain.rolling(9, min_periods=1).mean(), chord, close.ewm(alpha=2 / 100, adjust=False).mean()]
    assert all(np.allclose(a, b) for a, b in zip(got, want, strict=True))


def test_strong_votes_in_a_quiet_market_are_kept(spark):
    t0 = dt.datetime(2024, 1, 1)
    turn = [100 - 0.001 * min(i, 140 - i) for i in range(140)]
    rng = np.random.default_rng(3)
    series = {"quiet": turn, "flat": [100.0] * 140} | {f"walk{k}": (100 + rng.normal(0, 1, 140).cumsum()).tolist() for k in range(6)}
    df = spark.createDataFrame([(s, t0 + dt.timedelta(hours=i), c) for s, x in series.items() for i, c in enumerate(x)], "symbol string, ts timestamp, close double")
    keep = [s for s, x in series.items() if abs(atc.classify_series(np.array(x[-100:]), atc.Config(), True)[1][-1]) >= 0.05]
    got = [tuple(r) for r in atc.prefiltered_scan(df, 100).collect()]
    assert got == [tuple(r) for r in atc.scan(df.where(df.symbol.isin(keep)), 100).collect()]
    assert "quiet" in {r[0] for r in got} and "flat" not in {r[0] for r in got}

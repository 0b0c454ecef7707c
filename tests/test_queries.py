"""Every query of the engine with an oracle, against DuckDB; the others against their own properties."""

import os
from numbers import Number

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from ohlcraft.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if pd.isna(v):
        return None
    return float(f"{float(v):.9g}") + 0.0 if isinstance(v, Number) else str(v)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_against_oracle(spark, duck, name):
    got = plans.QUERIES[name](spark, SF)
    rel = duck.execute(plans.ORACLES[name])
    columns = [c[0] for c in rel.description]
    assert sorted(got.columns) == sorted(columns)
    want = rel.df()
    order = sorted(columns)
    a = sorted((tuple(map(plain, r)) for r in got.select(*[f"`{c}`" for c in order]).toPandas().astype(object).itertuples(index=False)), key=str)
    b = sorted((tuple(map(plain, r)) for r in want[order].astype(object).itertuples(index=False)), key=str)
    assert len(a) == len(b)
    # a bar may differ in the last place where sums run in another order
    off = [(x, y) for x, y in zip(a, b, strict=True) if x != y and not all(u == v or (isinstance(u, float) and isinstance(v, float) and abs(u - v) <= 2e-6 * max(1, abs(u))) for u, v in zip(x, y, strict=True))]
    assert not off, off[:3]


def rows(spark, name, sf="/root/testdata/sf0.01"):
    return plans.QUERIES[name](spark, sf).collect()


def test_every_query_has_an_oracle_or_a_test_here():
    assert set(plans.QUERIES) - set(plans.ORACLES) == set(
        "boosted_accuracy feature_f_test feature_importance forest_accuracy forest_cross_validated hmm_duration_clusters hmm_durations hmm_gaussian_states hmm_hidden_swings hmm_state_rules kelly_allocation position_size".split()
    )


@pytest.mark.parametrize("name", ["forest_accuracy", "boosted_accuracy"])
def test_models_know_more_than_chance(spark, name):
    got = rows(spark, name)
    assert {r.symbol for r in got} == {"click", "error", "purchase", "signup", "view"}
    assert all(r.n > 100 and 0 <= r.accuracy <= 1 for r in got) and sum(r.n * r.accuracy for r in got) / sum(r.n for r in got) > 0.4


def test_cross_validation_has_later_rows_in_each_fold(spark):
    got = rows(spark, "forest_cross_validated")
    assert [r.fold for r in sorted(got)] == [1, 2, 3] and all(r.n > 700 and r.accuracy > 0.36 for r in got)


def test_chosen_features(spark):
    known = {"roc_2", "roc_5", "roc_10", "high_low", "close_open", "ret_std", "ret_skew"}
    for name in ("feature_f_test", "feature_importance"):
        got = [r.feature for r in rows(spark, name)]
        assert len(set(got)) == 3 and set(got) <= known


def test_hidden_states_and_their_stays(spark):
    """Durations count the bars of equal states; the table of stays follows from them by a plain loop."""
    bars = sorted((r.symbol, r.ts, r.state, r.duration) for r in rows(spark, "hmm_gaussian_states"))
    stays, last, run = {}, None, 0
    for i, (symbol, _, state, duration) in enumerate(bars):
        run = run + 1 if last == (symbol, state) else 1
        last = (symbol, state)
        assert duration == run and 0 <= state < 4
        if i + 1 == len(bars) or bars[i + 1][0] != symbol or bars[i + 1][2] != state:
            stays.setdefault((symbol, state), []).append(run)
    table = {(r.symbol, r.state): r for r in rows(spark, "hmm_durations")}
    assert set(table) == set(stays)
    for k, v in stays.items():
        assert table[k].stays == len(v) and table[k].longest == max(v) and abs(table[k].mean - sum(v) / len(v)) < 1e-5
    groups = rows(spark, "hmm_duration_clusters")
    means = {g: [r["mean"] for r in groups if r.group == g] for g in {r.group for r in groups}}
    assert len(means) == 2 and (max(means[0]) < min(means[1]) or max(means[1]) < min(means[0]))


def test_state_rules(spark):
    got = rows(spark, "hmm_state_rules")
    assert all(r.confidence >= 0.3 and r.antecedent and r.consequent.startswith("s") and r.consequent not in r.antecedent.split(",") for r in got)


def _beta_quantile(a, b, p):
    """By adding up the density in a million steps."""
    import numpy as np

    x = (np.arange(1_000_000) + 0.5) / 1_000_000
    d = np.exp((a - 1) * np.log(x) + (b - 1) * np.log1p(-x))
    return float(x[np.searchsorted(np.cumsum(d) / d.sum(), p)])


def test_kelly_sizes_by_plain_steps(spark):
    import math

    stats = {r.symbol: r for r in rows(spark, "backtest_metrics")}
    shares, sizes = {}, {}
    for s, r in stats.items():
        wins = math.floor(r.win_rate * r.num_trades + 1e-9)
        a, b = 2 + wins, 2 + r.num_trades - wins
        low, mean = _beta_quantile(a, b, 0.025), a / (a + b)
        p = 0.9 * mean if low < 0.1 or (r.num_trades < 20 and low < 0.7 * mean) else low
        kelly = 0.0
        if r.num_trades >= 10 and r.win_rate >= 0.4 and r.avg_win > 0 and r.avg_loss > 0:
            odds = r.avg_win / r.avg_loss
            kelly = max(0.0, min(0.3, 0.25 * (p * odds - (1 - p)) / odds))
        shares[s] = max(kelly, 0.1) if kelly > 0 else 0.0
        trust = 1 / (1 + math.exp(-(r.num_trades - 30) / 10))
        raw = trust * kelly + (1 - trust) * (0.02 if kelly > 0 else 0)
        sizes[s] = min(0.3, max(0.1, raw)) if raw > 0 else 0.0
    total = sum(shares.values())
    for r in rows(spark, "kelly_allocation"):
        want = shares[r.symbol] / total * 0.8 if total > 0.8 else shares[r.symbol]
        assert abs(r.share - want) < 1e-4 and abs(r.size - 10_000 * want) < 1
    for r in rows(spark, "position_size"):
        assert abs(r.share - sizes[r.symbol]) < 1e-4


def test_hidden_swings_by_the_forward_sum(spark):
    """The likelihood grows with the rounds and is that of summing over all paths; the number of states is the best by BIC."""
    import itertools

    import numpy as np

    from ohlcraft.operators import models
    from ohlcraft.sources import candles

    seen = np.array([0, 0, 1, 2, 2, 1, 0, 0])
    logs = [models.fit_discrete(seen, 2, n)["loglik"] for n in (0, 1, 3, 10, 40)]
    assert all(b >= a - 1e-9 for a, b in zip(logs, logs[1:], strict=False))
    m = models.fit_discrete(seen, 2, 5)
    total = 0.0
    for path in itertools.product(range(2), repeat=len(seen)):
        p = m["pi"][path[0]] * m["b"][path[0], seen[0]]
        for t in range(1, len(seen)):
            p *= m["a"][path[t - 1], path[t]] * m["b"][path[t], seen[t]]
        total += p
    assert abs(np.log(total) - m["loglik"]) < 1e-9
    states = models.swing_states(candles.hourly(spark, "/root/testdata/sf0.01")).toPandas().sort_values(["symbol", "ts", "kind"])
    got = {r.symbol: r for r in rows(spark, "hmm_hidden_swings")}
    for symbol, part in states.groupby("symbol"):
        bics = [models.fit_discrete(part["state"].to_numpy(int), k)["bic"] for k in range(1, 5)]
        assert got[symbol].hidden == int(np.argmin(bics)) + 1 and abs(got[symbol].bic - min(bics)) < 1e-4 and 1 / 3 - 1e-9 <= got[symbol].p <= 1


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_import_without_llm(tmp_path):
    """The library must import and list its queries where the training-data operators are gone."""
    import shutil
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(here, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert out.stdout.split()[1:] == ["False"], out.stderr[-500:]
    # and its tests still run there
    args = [sys.executable, "-m", "pytest", "-q", "-x", "-p", "no:cacheprovider", "tests/test_prefiltered_scan.py", "tests/test_queries.py", "-k", "quiet or approximate_averages_against or group_by or semi_join"]
    run = subprocess.run(args, cwd=tmp_path / "r", capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert run.returncode == 0, run.stdout[-1500:]

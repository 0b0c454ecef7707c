"""Simplified percentile clustering: each bar lies near the low or the high centre of its features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import clip
from ..functions.windows import W, change, crosses_up, fold, last_n, prev, rolling_lower_quantile, run_length, sma, truth
from . import indicators as ind

FEATURES = ("rsi", "cci", "fisher", "dmi", "zscore", "mar")
KEEP = ("symbol", "ts", "open", "high", "low", "close", "volume")


def features(df: DataFrame) -> DataFrame:
    """The six features beside the candles."""
    out = ind.dmi_difference(ind.fisher(ind.cci(ind.rsi(df))))
    return ind.moving_average_ratio(ind.z_score(out)).select(*KEEP, *FEATURES)


def centers(df: DataFrame, feature: str, lookback: int, low: float = 5, high: float = 95, k: int = 2) -> list[Column]:
    """Centres of a feature: halfway from its rolling mean to its lower and upper percentile, and for three the mean itself."""
    mid = sma(feature, lookback)
    lo, hi = rolling_lower_quantile(feature, lookback, low / 100), rolling_lower_quantile(feature, lookback, high / 100)
    return [(lo + mid) / 2, (hi + mid) / 2] if k == 2 else [(lo + mid) / 2, mid, (hi + mid) / 2]


def adaptive_centers(df: DataFrame, feature: str, lookback: int, low: float = 5, high: float = 95) -> DataFrame:
    """Adds <feature>_low and <feature>_high, the two centres from percentiles that widen when the feature varies more than it mostly does.

    The variation is the deviation over the mean's size in the window (0 while unknown); twice what it is over the symbol's
    median of it moves both percentiles outwards, the lower one within 1 and 20, the upper one within 80 and 99.
    """
    w = last_n(lookback)
    full = F.count(feature).over(w) == lookback
    mean = sma(feature, lookback)
    vol = F.coalesce(F.when(full, F.try_divide(F.stddev_samp(feature).over(w), F.abs(mean))), F.lit(0.0))
    out = df.withColumns({"__vol": vol, "__v": F.when(full, F.array_sort(F.collect_list(feature).over(w))), "__mean": mean})
    out = out.withColumn("__more", (F.col("__vol") - F.median("__vol").over(Window.partitionBy("symbol"))) * 2)
    at = lambda p: F.col("__v")[F.floor((lookback - 1) * p / 100).cast("int")]
    lo, hi = at(clip(low - F.col("__more"), 1.0, 20.0)), at(clip(high + F.col("__more"), 80.0, 99.0))
    return out.withColumns({f"{feature}_low": (lo + F.col("__mean")) / 2, f"{feature}_high": (hi + F.col("__mean")) / 2}).drop("__vol", "__v", "__mean", "__more")


def uniqueness(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(symbol, __w_<feature> ...): one less a feature's mean correlation, by size, with the others; all 1 if none is unique."""
    pairs = {(a, b): F.coalesce(F.abs(F.corr(a, b)), F.lit(0.0)) for i, a in enumerate(names) for b in names[i + 1 :]}
    g = df.groupBy("symbol").agg(*[c.alias(f"__{a}__{b}") for (a, b), c in pairs.items()])
    mean = lambda n: sum(F.col(f"__{a}__{b}") for a, b in pairs if n in (a, b)) / max(1, len(names) - 1)
    w = {n: 1 - mean(n) for n in names}
    some = sum(w.values()) > 0
    return g.select("symbol", *[F.when(some, w[n]).otherwise(1.0).alias(f"__w_{n}") for n in names])


def cluster(df: DataFrame, names: tuple[str, ...] = FEATURES, lookback: int = 100, k: int = 2, interpolation: str = "linear", unique: bool = False, decay: float = 1.0) -> DataFrame:
    """Adds cluster, second, rel_pos, real_clust, confidence and distance; null until the centres are known.

    The distance to a centre is the mean over the features; with ``unique`` the mean over the known ones, weighted by
    :func:`uniqueness`. A ``decay`` under 1 shrinks the distances of older bars by its powers. rel_pos is the nearest distance's share of the two
    nearest; real_clust lies between the two cluster numbers accordingly.
    """
    out = df
    for n in names:
        out = out.withColumns({f"__{n}_{j}": c for j, c in enumerate(centers(df, n, lookback, k=k))})
    if unique:
        out = out.join(uniqueness(df, names), "symbol")  # a row a symbol on the other side
        away = lambda n, j: F.abs(F.col(n) - F.col(f"__{n}_{j}"))
        dist = [F.try_divide(sum(F.coalesce(away(n, j) * F.col(f"__w_{n}"), F.lit(0.0)) for n in names), sum(F.when(away(n, j).isNotNull(), F.col(f"__w_{n}")).otherwise(0.0) for n in names)) for j in range(k)]
    else:
        dist = [sum(F.abs(F.col(n) - F.col(f"__{n}_{j}")) for n in names) / len(names) for j in range(k)]
    if decay < 1:
        age = F.count(F.lit(1)).over(Window.partitionBy("symbol")) - F.row_number().over(W())
        dist = [d * F.pow(F.lit(decay), age) for d in dist]
    out = out.withColumn("__d", F.when(sum(dist).isNotNull(), F.array_sort(F.array(*[F.struct(d.alias("d"), F.lit(j).alias("j")) for j, d in enumerate(dist)]))))
    near, far = F.col("__d")[0], F.col("__d")[1]
    rel = F.when((near["d"] == 0) & (far["d"] == 0), F.lit(0.5)).otherwise(F.coalesce(F.try_divide(near["d"], near["d"] + far["d"]), F.lit(0.0)))
    rel = {"linear": rel, "sigmoid": 1 / (1 + F.exp(-10 * (rel - 0.5))), "exponential": 1 - F.exp(-3 * rel)}[interpolation]
    out = out.withColumns({"cluster": near["j"].cast("double"), "second": far["j"].cast("double"), "rel_pos": F.when(F.col("__d").isNotNull(), rel), "distance": near["d"]})
    out = out.withColumn("real_clust", F.col("cluster") + (F.col("second") - F.col("cluster")) * F.col("rel_pos"))
    return out.withColumn("confidence", 1 - 2 * F.col("rel_pos")).drop("__d", *[f"__{n}_{j}" for n in names for j in range(k)], *[f"__w_{n}" for n in names])


def stabilize(df: DataFrame, min_bars: int = 3, min_confidence: float = 0.6) -> DataFrame:
    """The cluster changes only after a stay of ``min_bars`` and with enough confidence."""
    step = f"""CASE WHEN x.i = 0 OR s.c IS NULL THEN struct(x.cluster AS c, 1 AS n) WHEN x.cluster = s.c THEN struct(s.c AS c, s.n + 1 AS n)
        WHEN s.n >= {min_bars} AND x.confidence >= {min_confidence!r}D THEN struct(x.cluster AS c, 1 AS n) ELSE struct(s.c AS c, s.n + 1 AS n) END"""
    return fold(df, ["cluster", "confidence"], "struct(cast(null AS double) AS c, 1 AS n)", step, {"stable": "s.c"})


def durations(df: DataFrame) -> DataFrame:
    return run_length(df, F.col("cluster"), "duration")


def transition_strategy(df: DataFrame, least: float = 0.3, k: int = 2) -> DataFrame:
    """Into the upper cluster with a rising price, or the lower with a falling one; else a crossing of the middle, at four fifths."""
    move = clip(F.abs(F.col("real_clust") - prev("real_clust")) / (2.0 if k == 3 else 1.0), 0.0, 1.0)
    out = df.withColumns({"st": (move + 1 - F.least(F.col("rel_pos"), F.lit(1.0))) / 2, "pc": change("close"), "pcl": prev("cluster"), "prl": prev("real_clust")})
    strong = truth(F.col("st") >= least)
    up = truth((F.col("cluster") > F.col("pcl")) & (F.col("pc") > 0)) & strong
    down = truth((F.col("cluster") < F.col("pcl")) & (F.col("pc") < 0)) & strong
    over = truth((F.col("prl") < 0.5) & (F.col("real_clust") >= 0.5)) & strong
    under = truth((F.col("prl") > 0.5) & (F.col("real_clust") <= 0.5)) & strong
    if k == 3:  # both thresholds in one bar
        over, under = over & (F.col("prl") < 1.5) & (F.col("real_clust") >= 1.5), under & (F.col("prl") > 1.5) & (F.col("real_clust") <= 1.5)
    return out.withColumns({"signal": F.when(up, 1).when(down, -1).when(over, 1).when(under, -1).otherwise(0), "strength": F.when(up | down, F.col("st")).when(over | under, F.col("st") * 0.8).otherwise(0.0)}).drop("st", "pc", "pcl", "prl")


def regime_strategy(df: DataFrame, least: float = 0.7, min_bars: int = 2, period: int = 5, upper: float = 0.5, lower: float = 0.5, k: int = 2) -> DataFrame:
    """With a clear regime that has lasted and momentum on its side."""
    out = durations(df).withColumns({"mo": change("close", period), "st": 1 - F.coalesce("rel_pos", F.lit(0.5))})
    clear = F.col("real_clust").isNotNull() & (F.col("st") >= least) & (F.col("duration") >= min_bars)
    top = (k - 1) * 1.0
    up = truth(clear & (F.col("cluster") == top) & (F.col("real_clust") >= upper) & (F.col("mo") >= 0))
    down = truth(clear & (F.col("cluster") == 0) & (F.col("real_clust") <= lower) & (F.col("mo") <= 0))
    share = F.col("real_clust") / top
    return out.withColumns({"signal": F.when(up, 1).when(down, -1).otherwise(0), "strength": F.when(up, (F.col("st") + share) / 2).when(down, (F.col("st") + 1 - share) / 2).otherwise(0.0)}).drop("mo", "st", "duration")


def reversion_strategy(df: DataFrame, extreme: float = 0.2, min_bars: int = 3, lookback: int = 3, target: float = 0.5, least: float = 0.4, k: int = 2) -> DataFrame:
    """After a stay at an extreme, once the price has turned from its latest low or high."""
    top = (k - 1) * 1.0
    out = df.withColumn("ex", truth((F.col("real_clust") <= extreme) | (F.col("real_clust") >= top - extreme)))
    out = run_length(out, F.col("ex"), "exn")
    enough = F.count(F.lit(1)).over(last_n(lookback + 1)) == lookback + 1
    out = out.withColumns({"turn_up": enough & (F.col("close") > F.min("close").over(last_n(lookback + 1))), "turn_down": enough & (F.col("close") < F.max("close").over(last_n(lookback + 1)))})
    near = 1 - F.least(F.abs(F.col("real_clust") - target) / top, F.lit(1.0))
    low, high = (near + 1 - F.col("real_clust") / extreme) / 2, (near + (F.col("real_clust") - (top - extreme)) / extreme) / 2
    held = F.col("ex") & (F.col("exn") >= min_bars)
    up = truth(held & (F.col("real_clust") <= extreme) & F.col("turn_up") & (low >= least))
    down = truth(held & (F.col("real_clust") >= top - extreme) & F.col("turn_down") & (high >= least))
    return out.withColumns({"signal": F.when(down, -1).when(up, 1).otherwise(0), "strength": F.when(down, high).when(up, low).otherwise(0.0)}).drop("ex", "exn", "turn_up", "turn_down")


STRATEGIES = {"cluster_transition": transition_strategy, "regime_following": regime_strategy, "mean_reversion": reversion_strategy}


def aggregate_votes(df: DataFrame, weights: dict[str, float], mode: str = "weighted", threshold: float = 0.5, strong: float = 0.7) -> DataFrame:
    """One vote from the strategies' columns <name>_signal and <name>_strength.

    weighted: share of the weight on a side; threshold: share of the strategies; simple: more than the other side. If
    they don't settle it, the strongest single strategy does, if strong enough.
    """
    names = list(weights)
    w = {n: (v if mode == "weighted" else 1.0) for n, v in weights.items()}
    total = sum(w.values())
    up = sum(F.when(F.col(f"{n}_signal") == 1, w[n]).otherwise(0.0) for n in names) / total
    down = sum(F.when(F.col(f"{n}_signal") == -1, w[n]).otherwise(0.0) for n in names) / total
    need = 0.0 if mode == "simple" else threshold
    out = df.withColumns({"vu": up, "vd": down})
    best = F.greatest(*[F.struct(F.when(F.col(f"{n}_signal") != 0, F.col(f"{n}_strength")).otherwise(0.0).alias("f"), F.col(f"{n}_signal").alias("s")) for n in names])
    vote = F.when((F.col("vu") >= need) & (F.col("vu") > F.col("vd")), 1).when((F.col("vd") >= need) & (F.col("vd") > F.col("vu")), -1).when(best["f"] >= strong, best["s"]).otherwise(0)
    return out.withColumns({"vote": vote, "vote_strength": F.greatest("vu", "vd")}).drop("vu", "vd")


def multi_timeframe(low: DataFrame, high: DataFrame) -> DataFrame:
    """Low-timeframe clusters with the last known high-timeframe one, and whether they agree."""
    from .relational import asof

    j = asof(low.select("symbol", "ts", "cluster"), high.select("symbol", "ts", F.col("cluster").alias("cluster_high")), ["symbol"], "ts", ["cluster_high"])
    return j.withColumn("agree", truth(F.col("cluster") == F.col("cluster_high")).cast("int"))


def crossings(df: DataFrame, level: float = 0.5) -> DataFrame:
    return df.withColumn("crossing", F.when(crosses_up(F.col("real_clust"), F.lit(level)), 1).when(truth((F.col("real_clust") < level) & (F.lag("real_clust").over(W()) >= level)), -1).otherwise(0))


def latest(df: DataFrame, values: list[str]) -> DataFrame:
    """Each symbol's values at its newest bar."""
    return df.groupBy("symbol").agg(*[F.max_by(v, "ts").alias(v) for v in values])



"""Labels, features and splits for models."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import clip
from ..functions.windows import W, bfill, change, ffill, following, last_n, prev, rolling, rolling_skew

LABEL_IDS = {"DOWN": 0, "NEUTRAL": 1, "UP": 2}


def triple_barrier(df: DataFrame, take: float = 0.02, stop: float = 0.01, horizon: int = 24) -> DataFrame:
    """1 if the target comes first within the horizon, -1 if the stop does, 0 if neither; null without a full horizon."""
    w = W().rowsBetween(1, horizon)
    out = df.withColumn("fut", F.collect_list("close").over(w))
    hit = lambda cond: f"aggregate(transform(fut, (v, i) -> CASE WHEN {cond} THEN i ELSE 1000000 END), 1000000, (a, k) -> least(a, k))"
    out = out.withColumns({"up": F.expr(hit(f"v >= close * {1 + take!r}D")), "dn": F.expr(hit(f"v <= close * {1 - stop!r}D"))})
    label = F.when(F.size("fut") < horizon, None).when((F.col("up") == 1_000_000) & (F.col("dn") == 1_000_000), 0).when(F.col("up") < F.col("dn"), 1).otherwise(-1)
    return out.withColumn("label", label.cast("int")).drop("fut", "up", "dn")


def future_returns(df: DataFrame, horizons: tuple[int, ...] = (1, 5, 24)) -> DataFrame:
    return df.withColumns({f"future_{h}": F.try_divide(following("close", h), F.col("close")) - 1 for h in horizons} | {f"future_log_{h}": F.when(F.col("close") > 0, F.log(F.try_divide(following("close", h), F.col("close")))) for h in horizons})


def directional(df: DataFrame, horizon: int = 24, base: float = 0.01, window: int = 20) -> DataFrame:
    """UP, NEUTRAL or DOWN of the return over the horizon against a threshold from past moves.

    The threshold is the distance from a blend of past closes (more volatile: longer ago), ``base`` at least.
    """
    out = df.withColumn("r", F.coalesce(change("close"), F.lit(0.0)))
    out = out.withColumn("vol", F.coalesce(F.stddev_samp("r").over(last_n(window)), F.lit(0.01)))
    out = out.withColumn("med", F.percentile("vol", F.lit(0.5)).over(last_n(50)))
    out = out.withColumn("mult", clip(F.coalesce(F.try_divide(F.col("vol"), F.col("med")), F.lit(2.0)), 1.5, 3.0))
    t = clip((F.col("mult") - 1.5) / (1.5 + 1e-8), 0.0, 1.0)
    out = out.withColumns({"lo": prev("close", int(horizon * 1.5)), "hi": prev("close", int(horizon * 3)), "t": t})
    out = out.withColumns({"lo": bfill("lo"), "hi": bfill("hi")})
    ref = F.col("lo") * (1 - F.col("t")) + F.col("hi") * F.col("t")
    out = out.withColumn("threshold", F.greatest(F.lit(base), F.coalesce(F.abs(F.try_divide(F.col("close") - ref, ref)), F.lit(base))))
    fut = F.try_divide(following("close", horizon) - F.col("close"), F.col("close"))
    label = F.when(fut >= F.col("threshold"), "UP").when(fut <= -F.col("threshold"), "DOWN").when(fut.isNotNull(), "NEUTRAL")
    return out.withColumn("label", label).withColumn("target", F.when(F.col("label") == "DOWN", 0).when(F.col("label") == "NEUTRAL", 1).when(F.col("label") == "UP", 2)).drop("r", "vol", "med", "mult", "lo", "hi", "t")


def calendar(df: DataFrame) -> DataFrame:
    """Hour and weekday on the circle, hours since the last funding hour, bar number."""
    h, d = F.hour("ts"), F.weekday("ts")
    a = 2 * math.pi
    return df.withColumns({
        "hour_sin": F.sin(a * h / 24), "hour_cos": F.cos(a * h / 24), "day_sin": F.sin(a * d / 7), "day_cos": F.cos(a * d / 7),
        "is_funding_hour": h.isin(0, 8, 16).cast("int"), "hours_to_funding": (h % 8).cast("int"), "candle_index": (F.row_number().over(W()) - 1).cast("long"),
    })


def standardized(df: DataFrame, columns: list[str], train_until: str | None = None) -> DataFrame:
    """Columns as z-scores by each symbol's mean and deviation, of the rows up to ``train_until`` if given (no look-ahead)."""
    w = Window.partitionBy("symbol")
    part = (lambda c: F.when(F.col("ts") <= F.lit(train_until).cast("timestamp_ntz"), F.col(c))) if train_until else F.col
    return df.withColumns({f"{c}_z": F.coalesce(F.try_divide(F.col(c) - F.avg(part(c)).over(w), F.stddev_pop(part(c)).over(w)), F.lit(0.0)) for c in columns})


def split(df: DataFrame, train: float = 0.7, validation: float = 0.15, gap: int = 24) -> DataFrame:
    """Adds part: train, validation, test in time order within each symbol; the ``gap`` rows before a border are 'gap'."""
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    out = df.withColumns({"i": F.row_number().over(W()) - 1, "n": n})
    a, b = F.floor(F.col("n") * train), F.floor(F.col("n") * (train + validation))
    part = F.when(F.col("i") < a - gap, "train").when(F.col("i") < a, "gap").when(F.col("i") < b - gap, "validation").when(F.col("i") < b, "gap").otherwise("test")
    return out.withColumn("part", part).drop("i", "n")


def walk_forward(df: DataFrame, folds: int = 4, train: int = 200, test: int = 50) -> DataFrame:
    """(fold, part, row): each row in the folds it belongs to; the training rows of a fold end where its test begins."""
    out = df.withColumn("i", F.row_number().over(W()) - 1)
    f = F.explode(F.array(*[F.struct(F.lit(k).alias("fold"), F.lit(train + k * test).alias("at")) for k in range(folds)])).alias("f")
    t = out.select("symbol", "ts", "i", f)
    part = F.when((F.col("i") < F.col("f.at")) & (F.col("i") >= F.col("f.at") - train), "train").when((F.col("i") >= F.col("f.at")) & (F.col("i") < F.col("f.at") + test), "test")
    return t.select("symbol", "ts", F.col("f.fold").alias("fold"), part.alias("part")).where("part IS NOT NULL")


def drift(df: DataFrame, column: str = "close", recent: int = 50) -> DataFrame:
    """(symbol, shift): how many deviations the mean of the recent rows lies from that of the earlier ones."""
    t = df.withColumn("rn", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts"))))
    old, new = F.when(F.col("rn") > recent, F.col(column)), F.when(F.col("rn") <= recent, F.col(column))
    return t.groupBy("symbol").agg(F.try_divide(F.avg(new) - F.avg(old), F.stddev_samp(old)).alias("shift"))


def forest_features(df: DataFrame) -> DataFrame:
    """Rates of change, ratios, rolling spread and skew of returns, lags."""
    out = df.withColumn("ret", change("close"))
    return out.withColumns(
        {f"roc_{n}": change("close", n) for n in (2, 5, 10)}
        | {"high_low": F.try_divide(F.col("high"), F.col("low")), "close_open": F.try_divide(F.col("close"), F.col("open")), "ret_std": rolling(F.stddev_samp, "ret", 10), "ret_skew": rolling_skew("ret", 10)}
        | {f"ret_lag_{n}": prev("ret", n) for n in (1, 2, 3)}
    )


def forest_targets(df: DataFrame, horizons: tuple[int, ...] = (3, 6, 12), k: float = 0.5, window: int = 20) -> DataFrame:
    """-1, 0, 1 of the return over each horizon against k volatilities, and the majority of them."""
    out = df.withColumn("ret", change("close")).withColumn("vol", rolling(F.stddev_samp, "ret", window))
    fut = {h: F.try_divide(following("close", h), F.col("close")) - 1 for h in horizons}
    out = out.withColumns({f"target_{h}": F.when(f.isNull() | F.col("vol").isNull(), None).when(f > k * F.col("vol") * h**0.5, 1).when(f < -k * F.col("vol") * h**0.5, -1).otherwise(0) for h, f in fut.items()})
    return out.withColumn("target", F.signum(sum(F.col(f"target_{h}") for h in horizons)).cast("int")).drop("vol", "ret")


def sequences(df: DataFrame, columns: list[str], look_back: int = 10) -> DataFrame:
    """(symbol, ts, sequence): the last ``look_back`` rows of the columns, oldest first, where there are so many."""
    w = last_n(look_back)
    out = df.withColumn("sequence", F.collect_list(F.array(*columns)).over(w))
    return out.where(F.size("sequence") == look_back).select("symbol", "ts", "sequence")


def correlated_features(df: DataFrame, columns: list[str], limit: float = 0.85) -> DataFrame:
    """(a, b, corr) of feature pairs over the limit, of which the second can go; one aggregation for all pairs."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    g = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    t = g.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")
    return t.where(F.abs("corr") > limit)


def balanced_target(df: DataFrame, strong: float = 0.01, neutral: float = 0.005, seed: int = 42) -> DataFrame:
    """1 or -1 over ``strong``, 0 under ``neutral``; between them the sign or 0 by a seeded hash of the row."""
    fut = F.try_divide(following("close", 1), F.col("close")) - 1
    coin = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))), 1, 8), 16, 10).cast("long") % 2 == 0
    sign = F.signum(fut).cast("int")
    return df.withColumn("target", F.when(fut.isNull(), None).when(F.abs(fut) >= strong, sign).when(F.abs(fut) <= neutral, 0).when(coin, sign).otherwise(0))


def filled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Holes filled forwards, then backwards."""
    return df.withColumns({c: ffill(c) for c in columns}).withColumns({c: F.coalesce(F.col(c), bfill(c)) for c in columns})

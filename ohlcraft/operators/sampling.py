"""Seeded samples of symbols, and the staged pre-filter. Samples are the feature here: they are of a stated size.

A hash of symbol and seed stands for the random draw, so the same input gives the same sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

def _ALL() -> WindowSpec:
    return Window.partitionBy(F.lit(1))




def _key(seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col("symbol")))


def _unit(seed: int) -> Column:
    """Uniform in (0, 1) from the hash."""
    return (F.conv(F.substring(_key(seed), 1, 12), 16, 10).cast("double") + 1) / float((1 << 48) + 1)


def _sized(df: DataFrame, percent: float) -> DataFrame:
    return df.withColumn("__m", F.count(F.lit(1)).over(_ALL())).withColumn("__k", F.greatest(F.lit(1), F.floor(F.col("__m") * (percent / 100))).cast("long"))


def _out(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("__")])


def random_sample(df: DataFrame, percent: float, seed: int) -> DataFrame:
    """max(1, floor(n p)) symbols."""
    return _out(_sized(df, percent).withColumn("__r", F.row_number().over(_ALL().orderBy(_key(seed), "symbol"))).where("__r <= __k"))


def volume_weighted(df: DataFrame, percent: float, seed: int, weight: str = "volume") -> DataFrame:
    """Without replacement, by volume: the least -ln(u) / w."""
    draw = F.when(F.col(weight) > 0, -F.log(_unit(seed)) / F.col(weight)).otherwise(float("inf"))
    return _out(_sized(df, percent).withColumn("__r", F.row_number().over(_ALL().orderBy(draw, "symbol"))).where("__r <= __k"))


def stratified(df: DataFrame, percent: float, seed: int, strata: int = 3) -> DataFrame:
    """Equal parts of each volume stratum; the last stratum takes the remainder."""
    t = _sized(df, percent).withColumn("__r", F.row_number().over(_ALL().orderBy(F.desc("volume"), "symbol")) - 1)
    t = t.withColumn("__s", F.least(F.lit(strata - 1), F.floor(F.col("__r") / F.greatest(F.lit(1), F.floor(F.col("__m") / strata)))))
    t = t.withColumn("__q", F.row_number().over(Window.partitionBy("__s").orderBy(_key(seed), "symbol")))
    each = F.floor(F.col("__k") / strata)
    return _out(t.where(F.col("__q") <= F.when(F.col("__s") == strata - 1, F.col("__k") - (strata - 1) * each).otherwise(each)))


def top_hybrid(df: DataFrame, percent: float, seed: int) -> DataFrame:
    """Half the most traded, half drawn from the others."""
    t = _sized(df, percent).withColumn("__r", F.row_number().over(_ALL().orderBy(F.desc("volume"), "symbol")))
    half = F.floor((F.col("__k") + 1) / 2)
    t = t.withColumn("__top", F.col("__r") <= half).withColumn("__q", F.row_number().over(Window.partitionBy("__top").orderBy(_key(seed), "symbol")))
    return _out(t.where(F.col("__top") | (F.col("__q") <= F.col("__k") - half)))


def systematic(df: DataFrame, percent: float) -> DataFrame:
    """Every step-th symbol by volume."""
    t = _sized(df, percent).withColumn("__r", F.row_number().over(_ALL().orderBy(F.desc("volume"), "symbol")) - 1)
    step = F.greatest(F.lit(1), F.floor(F.col("__m") / F.col("__k")))
    return _out(t.where((F.col("__r") % step == 0) & (F.floor(F.col("__r") / step) < F.col("__k"))))


def liquidity_weighted(df: DataFrame, percent: float, seed: int) -> DataFrame:
    """Drawn by 0.4 volume + 0.2 (1 - spread) + 0.4 closeness to middling volatility, each between 0 and 1."""
    unit = lambda c: F.coalesce(F.try_divide(F.col(c) - F.min(c).over(_ALL()), F.max(c).over(_ALL()) - F.min(c).over(_ALL())), F.lit(0.5))
    t = df.withColumns({"__v": unit("volume"), "__p": unit("spread"), "__y": unit("volatility")})
    bell = F.exp(-F.pow((F.col("__y") - 0.5) / 0.25, F.lit(2.0)) / 2)
    t = t.withColumn("__w", 0.4 * F.col("__v") + 0.2 * (1 - F.col("__p")) + 0.4 * bell)
    return volume_weighted(t, percent, seed, "__w")


METHODS = {"random": random_sample, "volume_weighted": volume_weighted, "stratified": stratified, "top_n_hybrid": top_hybrid, "liquidity_weighted": liquidity_weighted}


def sample(df: DataFrame, method: str, percent: float, seed: int = 42) -> DataFrame:
    """All symbols if percent isn't inside (0, 100); else the method's sample, a random one where there are no volumes to go by."""
    if not 0 < percent < 100:
        return df
    if method != "random" and "volume" not in df.columns:
        return random_sample(df, percent, seed)
    return systematic(df, percent) if method == "systematic" else METHODS[method](df, percent, seed)


def stage(df: DataFrame, keep: Column) -> DataFrame:
    """Rows that pass; all rows if none does, so that an empty stage falls back to its input."""
    t = df.withColumn("__pass", F.coalesce(keep, F.lit(False))).withColumn("__any", F.max("__pass").over(_ALL()))
    return _out(t.where(F.col("__pass") | ~F.col("__any")))


def prefilter(df: DataFrame, percent: float = 10.0, least: int = 10) -> DataFrame:
    """Trend, then oscillator and cluster votes, then models; of ten and more survivors the strongest percent.

    ``df`` has a row a symbol: atc, osc, spc, ml in {-1, 0, 1} and score.
    """
    t = stage(df, F.col("atc") != 0)
    t = stage(t, (F.col("osc") == F.col("atc")) | (F.col("spc") == F.col("atc")))
    t = stage(t, F.col("ml") == F.col("atc"))
    t = t.withColumn("__n", F.count(F.lit(1)).over(_ALL())).withColumn("__r", F.row_number().over(_ALL().orderBy(F.desc(F.abs("score")), "symbol")))
    return _out(t.where((F.col("__n") < least) | (F.col("__r") <= F.greatest(F.lit(1), F.ceil(F.col("__n") * percent / 100)))))

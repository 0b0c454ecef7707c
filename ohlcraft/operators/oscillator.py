"""The range oscillator and its strategies: signal in {-1, 0, 1} and strength in [0, 1] per bar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import clip, gradient
from ..functions.windows import UPTO, W, last_n, persist_sign, prev, rolling, run_length, truth
from . import indicators as ind


def O() -> Column:
    return F.col("osc")


OWN = ("symbol", "ts", "open", "high", "low", "close", "volume", "dwma", "range_atr", "osc")


def oscillator(df: DataFrame, length: int = 50, mult: float = 2.0) -> DataFrame:
    """100 (close - weighted mean) / band, the band being mult times a long ATR; null without a band."""
    out = ind.atr_band(ind.delta_weighted_ma(df, length), mult)
    return out.withColumn("osc", F.try_divide(100 * (F.col("close") - F.col("dwma")), F.col("range_atr"))).select(*OWN)


def _done(df: DataFrame, n: int, signal: Column, strength: Column) -> DataFrame:
    """Adds s<n> and f<n>; both 0 where the signal isn't known."""
    return df.withColumns({f"s{n}": F.coalesce(signal.cast("int"), F.lit(0)), f"f{n}": F.coalesce(strength, F.lit(0.0))})


def basic(df: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Side of the threshold, agreed by the trend, carried on; a bar that crosses zero has none."""
    c, m, b = F.col("close"), F.col("dwma"), F.col("range_atr")
    raw = F.when(truth((O() > threshold) & ((c > m) | (c > m + b))), 1).when(truth((O() < -threshold) & ((c < m) | (c < m - b))), -1).otherwise(0)
    out = df.withColumn("raw", raw).withColumn("kept", persist_sign("raw"))
    crossing = truth(((prev("osc") <= 0) & (O() > 0)) | ((prev("osc") >= 0) & (O() < 0)))
    known = O().isNotNull() & m.isNotNull() & b.isNotNull()
    signal = F.when(known & ~crossing, F.col("kept")).otherwise(0)
    out = out.withColumn("sig", signal)
    force = clip(F.abs(O()) / 100, 0.0, 1.0)
    force = F.when(truth((c > m + b) | (c < m - b)), clip(force * 1.5, 0.0, 1.0)).otherwise(force)
    return _done(out, 1, F.col("sig"), F.when(F.col("sig") != 0, force).otherwise(0.0)).drop("raw", "kept", "sig")


def _held(df: DataFrame, cond: Column, name: str) -> DataFrame:
    """Bars for which the condition has held, 0 where it doesn't."""
    out = run_length(df.withColumn(f"{name}_c", truth(cond)), F.col(f"{name}_c"), name)
    return out.withColumn(name, F.when(F.col(f"{name}_c"), F.col(name)).otherwise(0)).drop(f"{name}_c")


def sustained(df: DataFrame, bars: int = 3, threshold: float = 0.0) -> DataFrame:
    out = _held(_held(df, O() > threshold, "up"), O() < -threshold, "down")
    base = clip(F.abs(O()) / 100, 0.0, 1.0) * 0.7
    sig = F.when(F.col("up") >= bars, 1).when(F.col("down") >= bars, -1).otherwise(0)
    held = F.greatest(F.col("up"), F.col("down"))
    return _done(out, 2, sig, F.when(sig != 0, F.greatest(clip(held / (2.0 * bars), 0.0, 1.0), base)).otherwise(0.0)).drop("up", "down")


def _confirmed(df: DataFrame, upper: Column, lower: Column, bars: int) -> DataFrame:
    """cu, cd: a crossing ``bars`` ago that has held since. Before there are so many bars it counts as crossed."""
    out = _held(_held(df, O() > upper, "up"), O() < lower, "down")
    out = out.withColumns({"xu": truth((prev("osc") <= upper) & (O() > upper)), "xd": truth((prev("osc") >= lower) & (O() < lower))})
    return out.withColumns({"cu": (F.col("up") >= bars) & F.coalesce(prev("xu", bars), F.lit(True)), "cd": (F.col("down") >= bars) & F.coalesce(prev("xd", bars), F.lit(True))})


def _carried(df: DataFrame, fresh: str, inside: Column, side: int, name: str) -> DataFrame:
    """``side`` from a fresh signal on while the bar stays inside the zone."""
    out = df.withColumn("z", F.sum(F.when(truth(inside), 0).otherwise(1)).over(UPTO()))
    seen = F.max(F.when(F.col(fresh) == side, 1).otherwise(0)).over(Window.partitionBy("symbol", "z").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn(name, truth(inside) & (seen == 1)).drop("z")


def _zone_signal(df: DataFrame, upper: Column, lower: Column) -> DataFrame:
    out = _carried(_carried(df, "fresh", O() > upper, 1, "lng"), "fresh", O() < lower, -1, "sht")
    return out.withColumn("sig", F.when(F.col("lng"), 1).when(F.col("sht"), -1).otherwise(0))


_SCRATCH = ("up", "down", "xu", "xd", "cu", "cd", "fresh", "lng", "sht", "sig", "tired")


def crossover(df: DataFrame, bars: int = 2, threshold: float = 0.0) -> DataFrame:
    hi, lo = F.lit(threshold), F.lit(-threshold)
    out = _confirmed(df, hi, lo, bars)
    out = _zone_signal(out.withColumn("fresh", F.when(F.col("cu"), 1).when(F.col("cd"), -1).otherwise(0)), hi, lo)
    return _done(out, 3, F.col("sig"), F.when(F.col("sig") != 0, clip(F.abs(O()) / 100, 0.0, 1.0)).otherwise(0.0)).drop(*_SCRATCH)


def momentum(df: DataFrame, period: int = 3, threshold: float = 5.0) -> DataFrame:
    m = O() - prev("osc", period)
    out = df.withColumn("mo", m)
    sig = F.when(F.col("mo") > threshold, 1).when(F.col("mo") < -threshold, -1).otherwise(0)
    force = F.greatest(clip(F.abs("mo") / (3 * threshold), 0.0, 1.0), clip(F.abs(O()) / 100, 0.0, 1.0) * 0.5)
    return _done(out, 4, sig, F.when(sig != 0, force).otherwise(0.0)).drop("mo")


def breakout(df: DataFrame, upper: float = 100.0, lower: float = -100.0, bars: int = 2, exhaustion: float = 150.0) -> DataFrame:
    hi, lo = F.lit(upper), F.lit(lower)
    out = _confirmed(df, hi, lo, bars).withColumn("tired", truth(F.abs(O()) >= exhaustion))
    out = out.withColumn("fresh", F.when(F.col("cu") & ~F.col("tired"), 1).when(F.col("cd") & ~F.col("tired"), -1).otherwise(0))
    out = _zone_signal(out, hi, lo)
    over, under = clip((O() - upper) / 50, 0.0, 1.0), clip((lower - O()) / 50, 0.0, 1.0)
    force = F.when(F.col("sig") == 1, F.greatest(over, F.when(F.col("cu"), 0.3).otherwise(0.2))).when(F.col("sig") == -1, F.greatest(under, F.when(F.col("cd"), 0.3).otherwise(0.2))).otherwise(0.0)
    sig = F.when(F.col("tired") | O().isNull(), 0).otherwise(F.col("sig"))
    return _done(out, 6, sig, F.when(F.col("tired"), 0.0).otherwise(force)).drop(*_SCRATCH)


def divergence(df: DataFrame, swing: int = 5, least: float = 10.0) -> DataFrame:
    """Price and oscillator extremes on one bar, known ``swing`` bars later, that move apart.

    An extreme isn't passed by the ``swing`` bars before it; each is held against the extreme before
    it in its own series.
    """
    earlier, before = W().rowsBetween(-swing, -1), W().rowsBetween(Window.unboundedPreceding, -1)
    out = df
    for x, agg, top, last in (("high", F.max, "hp", "hq"), ("osc", F.max, "op", "oq"), ("low", F.min, "lp", "lq"), ("osc", F.min, "ot", "or")):
        edge = agg(x).over(earlier)
        out = out.withColumn(top, truth(F.col(x) >= edge if agg is F.max else F.col(x) <= edge))
        out = out.withColumn(last, F.last(F.when(F.col(top), F.col(x)), ignorenulls=True).over(before))
    bear = truth(F.col("hp") & F.col("op") & (F.col("high") > F.col("hq")) & (O() < F.col("oq")) & (F.abs(O() - F.col("oq")) >= least))
    bull = truth(F.col("lp") & F.col("ot") & (F.col("low") < F.col("lq")) & (O() > F.col("or")) & (F.abs(O() - F.col("or")) >= least))
    rise = F.coalesce(F.try_divide(F.col("high") - F.col("hq"), F.col("hq")) * 100, F.lit(0.0))
    fall = F.coalesce(F.try_divide(F.col("lq") - F.col("low"), F.col("lq")) * 100, F.lit(0.0))
    force = F.when(F.col("bear"), clip((rise + F.abs(O() - F.col("oq")) / 100) / 2, 0.0, 1.0)).when(F.col("bull"), clip((fall + F.abs(O() - F.col("or")) / 100) / 2, 0.0, 1.0))
    out = out.withColumns({"bear": bear & ~bull, "bull": bull & ~bear}).withColumn("df", force)
    sig = F.when(F.coalesce(prev("bull", swing), F.lit(False)), 1).when(F.coalesce(prev("bear", swing), F.lit(False)), -1).otherwise(0)
    return _done(out, 7, sig, F.when(sig != 0, prev("df", swing)).otherwise(0.0)).drop("hp", "hq", "op", "oq", "lp", "lq", "ot", "or", "bear", "bull", "df")


def trend_following(df: DataFrame, period: int = 10, threshold: float = 20.0) -> DataFrame:
    least = int(period * 0.7)
    slope = F.when((F.count("osc").over(last_n(period)) >= least) & O().isNotNull(), (O() - prev("osc", period - 1)) / period)
    over = F.sum(F.when(truth(O() > threshold), 1).otherwise(0)).over(last_n(period))
    under = F.sum(F.when(truth(O() < -threshold), 1).otherwise(0)).over(last_n(period))
    steady = truth(F.greatest(over, under) / period >= 0.7) & (F.count(F.lit(1)).over(last_n(period)) >= least)
    out = df.withColumns({"sl": slope, "st": steady})
    sig = F.when(truth((O() > threshold) & (F.col("sl") > 0) & F.col("st")), 1).when(truth((O() < -threshold) & (F.col("sl") < 0) & F.col("st")), -1).otherwise(0)
    force = (clip(F.abs(O()) / 100, 0.0, 1.0) + clip(F.abs("sl") / 10, 0.0, 1.0)) / 2
    return _done(out, 8, sig, F.when(sig != 0, force).otherwise(0.0)).drop("sl", "st")


def mean_reversion(df: DataFrame, extreme: float = 80.0, near: float = 10.0, bars: int = 3) -> DataFrame:
    """From a stay at an extreme, which ended with the bar before, to the neighbourhood of zero."""
    out = _held(_held(df, O() > extreme, "up"), O() < -extreme, "down")
    into = truth(F.abs(O()) <= near)
    out = out.withColumns({"fu": into & truth(prev("up") >= bars), "fd": into & truth(prev("down") >= bars), "po": prev("osc")})
    sig = F.when(F.col("fd"), 1).when(F.col("fu"), -1).otherwise(0)
    force = F.greatest(F.lit(0.4), (clip(F.abs("po") / 100, 0.0, 1.0) + clip(1 - F.abs(O()) / near, 0.0, 1.0)) / 2)
    return _done(out, 9, sig, F.when(sig != 0, force).otherwise(0.0)).drop("up", "down", "fd", "fu", "po")


STRATEGIES = {1: basic, 2: sustained, 3: crossover, 4: momentum, 6: breakout, 7: divergence, 8: trend_following, 9: mean_reversion}


def all_strategies(df: DataFrame, which: tuple[int, ...] = (2, 3, 4, 6, 7, 8, 9)) -> DataFrame:
    out = df
    for n in which:
        out = STRATEGIES[n](out)
    return out


def consensus(df: DataFrame, which: tuple[int, ...] = (2, 3, 4, 6, 7, 8, 9), share: float = 0.5) -> DataFrame:
    """Votes of the strategies (ceil(n * share) of them have to agree), and a confidence from agreement and strength."""
    n = len(which)
    need = -(-int(n * share * 1000) // 1000)
    up = sum(F.when(F.col(f"s{k}") == 1, 1).otherwise(0) for k in which)
    down = sum(F.when(F.col(f"s{k}") == -1, 1).otherwise(0) for k in which)
    out = df.withColumns({"up": up, "down": down})
    out = out.withColumn("signal", F.when((F.col("up") >= need) & (F.col("up") > F.col("down")), 1).when((F.col("down") >= need) & (F.col("down") > F.col("up")), -1).otherwise(0))
    agree = F.when(F.col("signal") == 1, F.col("up")).when(F.col("signal") == -1, F.col("down")).otherwise(0)
    total = sum(F.when((F.col("signal") != 0) & (F.col(f"s{k}") == F.col("signal")), F.col(f"f{k}")).otherwise(0.0) for k in which)
    confidence = F.when(F.col("signal") != 0, 0.6 * (agree / n) + 0.4 * (total / agree)).otherwise(0.0)
    return out.withColumn("confidence", confidence).drop("up", "down")


def weighted_consensus(df: DataFrame, weights: dict[int, float], least: float = 0.5, apart: float = 0.1) -> DataFrame:
    up = sum(F.when(F.col(f"s{k}") == 1, F.lit(w)).otherwise(0.0) for k, w in weights.items())
    down = sum(F.when(F.col(f"s{k}") == -1, F.lit(w)).otherwise(0.0) for k, w in weights.items())
    return df.withColumn("signal", F.when((up > down) & (up > least) & (up - down > apart), 1).when((down > up) & (down > least) & (down - up > apart), -1).otherwise(0))


#: Strategies for each market condition, and from which score on they are taken.
SUITED = (("volatility", 0.6, (6, 7)), ("trend", 0.5, (3, 4, 6, 8)), ("ranging", 0.5, (2, 7, 9)))


def market_conditions(df: DataFrame, lookback: int = 20, which: tuple[int, ...] = (2, 3, 4, 6, 7, 8, 9)) -> DataFrame:
    """(symbol, volatility, trend, ranging, strategies) from each symbol's last bars; all strategies if none suits."""
    t = df.withColumns({"rn": F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts"))), "move": F.abs(O() - prev("osc"))}).where(F.col("rn") <= lookback)
    inner = F.when(F.col("rn") < lookback, F.col("move"))
    g = t.groupBy("symbol").agg(F.stddev_samp("range_atr").alias("sd"), F.avg("range_atr").alias("m"), F.avg(inner).alias("mv"), (F.max("osc") - F.min("osc")).alias("span"))
    g = g.withColumns({"volatility": F.when(F.col("m") > 0, F.least(F.lit(1.0), F.col("sd") / (F.col("m") + 1e-10) * 2)).otherwise(0.5), "trend": F.when(F.col("span") > 0, F.least(F.lit(1.0), F.col("mv") / (F.col("span") + 1e-10) * 2)).otherwise(0.5)})
    g = g.withColumn("ranging", 1 - F.col("trend"))
    none = F.expr("cast(array() AS array<int>)")
    pick = F.array_sort(F.array_distinct(F.concat(*[F.when(F.col(c) >= least, F.array(*[F.lit(k) for k in ids if k in which])).otherwise(none) for c, least, ids in SUITED])))
    return g.select("symbol", "volatility", "trend", "ranging", F.array_join(F.when(F.size(pick) > 0, pick).otherwise(F.array(*map(F.lit, which))), ",").alias("strategies"))


def adaptive_weights(df: DataFrame, which: tuple[int, ...], window: int = 10) -> DataFrame:
    """(symbol, w<k> ...): agreement with the joint vote and strength when active over the last bars, 0.1 at least, summing to their number."""
    t = df.withColumn("rn", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))).where(F.col("rn") <= window)
    vote = F.signum(sum(F.col(f"s{k}") for k in which))
    score = lambda k: F.greatest(F.lit(0.1), 0.6 * F.avg(F.when(F.col(f"s{k}") == vote, 1.0).otherwise(0.0)) + 0.4 * F.coalesce(F.avg(F.when(F.col(f"s{k}") != 0, F.col(f"f{k}"))), F.lit(0.0)))
    g = t.groupBy("symbol").agg(*[score(k).alias(f"w{k}") for k in which])
    total = sum(F.col(f"w{k}") for k in which)
    return g.select("symbol", *[(F.col(f"w{k}") / total * len(which)).alias(f"w{k}") for k in which])


def combined(df: DataFrame, which: tuple[int, ...] = (2, 3, 4, 6, 7, 8, 9), mode: str = "threshold", share: float = 0.5, dynamic: bool = False, adaptive: bool = False, least_strength: float = 0.0) -> DataFrame:
    """(symbol, ts, signal, strength, strategies) by the joint vote of the strategies over an oscillator.

    ``dynamic`` lets each symbol's market conditions choose among them; ``adaptive`` weighs them by how they did lately, in the mode
    "weighted"; "threshold" asks for ceil(n * share) of a symbol's n strategies. Without any strategy the basic one decides. The
    strength is the mean of the strategies that agree; signals under ``least_strength`` are 0, and bars without oscillator too.
    """
    if not which:
        out = basic(df)
        return out.select("symbol", "ts", F.col("s1").alias("signal"), F.col("f1").alias("strength"), F.lit("1").alias("strategies"))
    out = all_strategies(df, which)
    if dynamic:
        # a row a symbol: the planner's choice of join
        out = out.join(market_conditions(df, which=which).select("symbol", "strategies"), "symbol")
    else:
        out = out.withColumn("strategies", F.lit(",".join(map(str, which))))
    own = F.split("strategies", ",")
    on = {k: F.array_contains(own, str(k)) for k in which}
    n = F.size(own)
    if mode == "weighted":
        if adaptive:
            out = out.join(adaptive_weights(out, which), "symbol")
        w = {k: (F.col(f"w{k}") if adaptive else F.lit(1.0)) for k in which}
        least, apart = F.lit(0.5), F.lit(0.1)
    else:
        w, least, apart = {k: F.lit(1.0) for k in which}, F.ceil(n * share), F.lit(0.0)
    side = lambda v: sum(F.when(on[k] & (F.col(f"s{k}") == v), w[k]).otherwise(0.0) for k in which)
    out = out.withColumns({"up": side(1), "down": side(-1)})
    up, down = F.col("up"), F.col("down")
    enough = (lambda a: a >= least) if mode != "weighted" else (lambda a: a > least)
    vote = F.when((up > down) & enough(up) & (up - down > apart), 1).when((down > up) & enough(down) & (down - up > apart), -1).otherwise(0)
    out = out.withColumn("vote", F.when(O().isNotNull(), vote).otherwise(0))
    agree = lambda k: on[k] & (F.col("vote") != 0) & (F.col(f"s{k}") == F.col("vote"))
    total, count = sum(F.when(agree(k), F.col(f"f{k}")).otherwise(0.0) for k in which), sum(F.when(agree(k), 1).otherwise(0) for k in which)
    out = out.withColumn("strength", F.coalesce(F.try_divide(total, count), F.lit(0.0)))
    return out.select("symbol", "ts", F.when(F.col("strength") >= least_strength, F.col("vote")).otherwise(0).alias("signal"), "strength", "strategies")


def heat(df: DataFrame, lookback: int = 100, levels: int = 10) -> DataFrame:
    """How often the level band of the close was touched over the last bars, and its colour."""
    out = df.withColumns({"hi": F.max("high").over(last_n(lookback)), "lo": F.min("low").over(last_n(lookback)), "cs": F.collect_list("close").over(last_n(lookback))})
    level = lambda x: f"least({levels - 1}, cast(floor(try_divide({x} - lo, hi - lo) * {levels}) AS int))"
    out = out.withColumn("level", F.expr(f"coalesce({level('close')}, 0)")).withColumn("touches", F.expr(f"size(filter(cs, v -> coalesce({level('v')}, 0) = level))"))
    return out.withColumn("color", gradient(F.col("touches").cast("double"), F.lit(0.0), F.lit(lookback / levels * 2.0), "#1E90FF", "#FF4500")).drop("hi", "lo", "cs")


def summary(df: DataFrame, signal: str = "signal", strength: str = "confidence") -> DataFrame:
    """Counts, shares and mean strength of the signals of each symbol."""
    n = F.count(F.lit(1))
    return df.groupBy("symbol").agg(
        n.alias("bars"), F.count_if(F.col(signal) == 1).alias("longs"), F.count_if(F.col(signal) == -1).alias("shorts"), F.count_if(F.col(signal) == 0).alias("flats"),
        (100.0 * F.count_if(F.col(signal) != 0) / n).alias("active_percent"), F.avg(F.when(F.col(signal) != 0, F.col(strength))).alias("mean_strength"),
    )

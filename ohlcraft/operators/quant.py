"""Quantitative metrics as aggregates; an undefined metric is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def skewness(x: str) -> Column:
    """Bias-corrected skewness from central moments."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.try_divide(F.sqrt(n * (n - 1)) * F.skewness(x), n - 2))


def kurtosis(x: str) -> Column:
    """Bias-corrected excess kurtosis."""
    n = F.count(x).cast("double")
    return F.when(n > 3, F.try_divide((n - 1) * ((n + 1) * F.kurtosis(x) + 6), (n - 2) * (n - 3)))


def sharpe(x: str | Column, per_year: int, free: float = 0.0) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    s = F.try_divide(F.avg(x) - free / per_year, F.stddev_samp(x)) * per_year**0.5
    return F.when(F.abs(s) <= 1e6, s)


def spread_metrics(spread: DataFrame, keys: list[str], per_year: int = 8760) -> DataFrame:
    """Per pair: spread moments, half-life, drawdown (in units of the spread), Calmar and Sharpe ratios of its changes.

    ``spread`` has keys, ts and spread.
    """
    w = Window.partitionBy(*keys).orderBy("ts")
    t = spread.withColumns({"p": F.lag("spread").over(w), "peak": F.max("spread").over(w.rowsBetween(Window.unboundedPreceding, 0))}).withColumn("d", F.col("spread") - F.col("p"))
    g = t.groupBy(*keys).agg(
        F.count("spread").alias("n"), F.avg("spread").alias("mean"), F.stddev_samp("spread").alias("std"), skewness("spread").alias("skew"), kurtosis("spread").alias("kurt"), F.max_by("spread", "ts").alias("last"),
        F.regr_slope("d", "p").alias("theta"), F.min(F.col("spread") - F.col("peak")).alias("max_drawdown"), sharpe("d", per_year).alias("sharpe"), (F.avg("d") * per_year).alias("yearly"),
    )
    half = F.when(F.col("theta") < 0, -F.log(F.lit(2.0)) / F.col("theta"))
    return g.withColumns({"current_zscore": F.try_divide(F.col("last") - F.col("mean"), F.col("std")), "half_life": F.when(half <= 50, half), "calmar": F.when(F.col("max_drawdown") != 0, F.try_divide(F.col("yearly"), F.abs("max_drawdown")))}).drop("theta", "yearly", "last")


def hurst(df: DataFrame, keys: list[str], x: str, max_lag: int = 100) -> DataFrame:
    """(keys, hurst): twice the slope of ln sqrt(std of lagged differences) on ln lag, between 0 and 2.

    Lags run from 2 to min(100, n / 2) - 1; each is one difference column of the same window and one aggregate.
    """
    w = Window.partitionBy(*keys).orderBy("ts")
    lags = range(2, max_lag)
    t = df.select(*keys, F.count(x).over(Window.partitionBy(*keys)).alias("n"), *[(F.col(x) - F.lag(x, k).over(w)).alias(f"__d{k}") for k in lags])
    one = t.groupBy(*keys).agg(F.max("n").alias("n"), *[F.stddev_pop(f"__d{k}").alias(f"__s{k}") for k in lags])  # a row a key
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"__s{k}").alias("s")) for k in lags])).alias("r")
    s = one.select(*keys, "n", rows).select(*keys, "n", "r.lag", "r.s").where((F.col("lag") < F.least(F.lit(max_lag), F.floor(F.col("n") / 2))) & (F.col("s") > 0))
    g = s.groupBy(*keys).agg((2 * F.regr_slope(F.log(F.sqrt("s")), F.log("lag"))).alias("h"), F.count(F.lit(1)).alias("k"))
    return g.where("k >= 2").select(*keys, F.greatest(F.lit(0.0), F.least(F.lit(2.0), F.col("h"))).alias("hurst"))


def kalman_hedge(df: DataFrame, keys: list[str], y: str, x: str, delta: float = 1e-5) -> DataFrame:
    """(keys, kalman_beta): the last slope of a random-walk regression of y on x, folded in time order."""
    q = delta / (1 - delta)
    g = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ts", F.col(x).alias("x"), F.col(y).alias("y")))).alias("v"))
    step = f"""aggregate(v, named_struct('b', 0D, 'a', 0D, 'p11', 1D, 'p12', 0D, 'p22', 1D), (s, r) ->
        transform(array(named_struct('p11', s.p11 + {q!r}D, 'p12', s.p12, 'p22', s.p22 + {q!r}D, 'e', r.y - (s.b * r.x + s.a))), m ->
        transform(array(named_struct('m', m, 'k1n', m.p11 * r.x + m.p12, 'k2n', m.p12 * r.x + m.p22, 'f', r.x * (m.p11 * r.x + m.p12) + m.p12 * r.x + m.p22 + 1D)), z ->
        named_struct('b', s.b + z.k1n / z.f * z.m.e, 'a', s.a + z.k2n / z.f * z.m.e, 'p11', z.m.p11 - z.k1n / z.f * z.k1n, 'p12', z.m.p12 - z.k1n / z.f * z.k2n, 'p22', z.m.p22 - z.k2n / z.f * z.k2n))[0])[0], s -> s.b)"""
    return g.select(*keys, F.expr(step).alias("kalman_beta"))


def direction_metrics(df: DataFrame, keys: list[str], z: str, threshold: float = 0.5, least: int = 20) -> DataFrame:
    """Precision, recall, F1 and accuracy of reading the spread's next move from its z-score."""
    w = Window.partitionBy(*keys).orderBy("ts")
    t = df.withColumn("nxt", F.lead("spread").over(w) - F.col("spread"))
    t = t.withColumns({"pred": F.when(F.col(z) > threshold, -1).when(F.col(z) < -threshold, 1), "real": F.signum("nxt").cast("int")}).where("pred IS NOT NULL AND nxt IS NOT NULL")
    g = t.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("pred = 1 AND real = 1")).alias("tp"), F.count_if(F.expr("pred = 1 AND real != 1")).alias("fp"), F.count_if(F.expr("pred = -1 AND real = 1")).alias("fn"), F.count_if(F.expr("pred = real")).alias("ok"))
    p, r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    g = g.where(F.col("n") >= least).withColumns({"precision": p, "recall": r, "accuracy": F.col("ok") / F.col("n")})
    return g.select(*keys, "precision", "recall", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), "accuracy")


# MacKinnon's (2010) response surface for the ADF test with a constant: 1, 5 and 10 percent.
MACKINNON = ((-3.43035, -6.5393, -16.786, -79.433), (-2.86154, -2.8903, -4.234, -40.040), (-2.56677, -1.5384, -2.809, 0.0))
#: Johansen's 95 percent trace values for two series with a constant: no relation, one at most.
JOHANSEN_95 = (15.4943, 3.8415)


def adf(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """(keys, adf_stat, adf_stationary): t value of the level in the regression of its change on level, last change and a constant.

    All from window lags and sums, as normal equations of three unknowns.
    """
    w = Window.partitionBy(*keys).orderBy("ts")
    t = df.withColumns({"l": F.lag(x).over(w)}).withColumn("d", F.col(x) - F.col("l")).withColumn("m", F.lag("d").over(w)).where("m IS NOT NULL")
    s = t.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.covar_pop(a, b).alias(f"{a}{b}") for a, b in (("l", "l"), ("l", "m"), ("m", "m"), ("d", "l"), ("d", "m"), ("d", "d"))])
    det = F.col("ll") * F.col("mm") - F.col("lm") * F.col("lm")
    b1, b2 = F.try_divide(F.col("dl") * F.col("mm") - F.col("dm") * F.col("lm"), det), F.try_divide(F.col("dm") * F.col("ll") - F.col("dl") * F.col("lm"), det)
    rss = (F.col("dd") - b1 * F.col("dl") - b2 * F.col("dm")) * F.col("n")
    se = F.sqrt(F.greatest(F.try_divide(rss, F.col("n") - 3) * F.try_divide(F.col("mm"), det * F.col("n")), F.lit(0.0)))
    c = MACKINNON[1]
    crit = c[0] + c[1] / F.col("n") + c[2] / F.pow("n", F.lit(2)) + c[3] / F.pow("n", F.lit(3))
    return s.where("n > 3").select(*keys, F.try_divide(b1, se).alias("adf_stat"), F.coalesce(F.try_divide(b1, se) < crit, F.lit(False)).cast("int").alias("adf_stationary"))


def johansen(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, trace_stat, johansen_cointegrated): Johansen's trace statistic of two series, one lag, with a constant.

    The residuals' moment matrices come from covariances after taking out the last changes; two by two eigenvalues in
    closed form.
    """
    w = Window.partitionBy(*keys).orderBy("ts")
    t = df.withColumns({"la": F.lag(a).over(w), "lb": F.lag(b).over(w)})
    t = t.withColumns({"da": F.col(a) - F.col("la"), "db": F.col(b) - F.col("lb")}).withColumns({"ma": F.lag("da").over(w), "mb": F.lag("db").over(w)}).where("ma IS NOT NULL AND mb IS NOT NULL")
    names = ("da", "db", "la", "lb", "ma", "mb")
    s = t.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.covar_pop(x, y).alias(f"{x}_{y}") for i, x in enumerate(names) for y in names[i:]])
    m = lambda x, y: F.col(f"{x}_{y}" if names.index(x) <= names.index(y) else f"{y}_{x}")
    det = m("ma", "ma") * m("mb", "mb") - m("ma", "mb") * m("ma", "mb")

    def partial(x, y):  # covariance of x and y after regression on ma and mb
        return m(x, y) - F.try_divide(m(x, "ma") * (m("mb", "mb") * m(y, "ma") - m("ma", "mb") * m(y, "mb")) + m(x, "mb") * (m("ma", "ma") * m(y, "mb") - m("ma", "mb") * m(y, "ma")), det)

    four = ("da", "db", "la", "lb")
    s = s.withColumns({f"r_{x}_{y}": partial(x, y) for i, x in enumerate(four) for y in four[i:]})
    r = lambda x, y: F.col(f"r_{x}_{y}" if four.index(x) <= four.index(y) else f"r_{y}_{x}")
    d0, d1 = r("da", "da") * r("db", "db") - r("da", "db") * r("da", "db"), r("la", "la") * r("lb", "lb") - r("la", "lb") * r("la", "lb")

    def middle(u, v):  # (S10 S00^-1 S01)[u, v]
        return F.try_divide(r(u, "da") * (r("db", "db") * r("da", v) - r("da", "db") * r("db", v)) + r(u, "db") * (r("da", "da") * r("db", v) - r("da", "db") * r("da", v)), d0)

    s = s.withColumns({"q11": middle("la", "la"), "q12": middle("la", "lb"), "q22": middle("lb", "lb")})
    # eigenvalues of S11^-1 Q: trace and determinant are enough
    tr = F.try_divide(r("lb", "lb") * F.col("q11") - 2 * r("la", "lb") * F.col("q12") + r("la", "la") * F.col("q22"), d1)
    dt = F.try_divide(F.col("q11") * F.col("q22") - F.col("q12") * F.col("q12"), d1)
    s = s.withColumns({"tr": tr, "dt": dt}).withColumn("root", F.sqrt(F.greatest(F.col("tr") * F.col("tr") / 4 - F.col("dt"), F.lit(0.0))))
    e1, e2 = F.col("tr") / 2 + F.col("root"), F.col("tr") / 2 - F.col("root")
    stat = -F.col("n") * (F.log(1 - F.least(e1, F.lit(1 - 1e-12))) + F.log(1 - F.least(e2, F.lit(1 - 1e-12))))
    return s.where("n > 10").select(*keys, stat.alias("trace_stat"), F.coalesce(stat > JOHANSEN_95[0], F.lit(False)).cast("int").alias("johansen_cointegrated"))


def confusion_at(df: DataFrame, score: str, label: str, thresholds: list[float]) -> DataFrame:
    """Counts and precision of a classifier at each confidence threshold, in one pass."""
    t = df.select(score, label, F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")).where(F.col(score) >= F.col("threshold"))
    return t.groupBy("threshold").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("hits")).withColumn("precision", F.try_divide(F.col("hits"), F.col("n")))


def best_threshold(df: DataFrame, score: str, ret: str, thresholds: list[float]) -> DataFrame:
    """(symbol, threshold, sharpe): the threshold on |score| whose signed returns have the best Sharpe ratio."""
    t = df.select("symbol", score, ret, F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")).where(F.abs(score) >= F.col("threshold"))
    g = t.groupBy("symbol", "threshold").agg(F.try_divide(F.avg(F.signum(score) * F.col(ret)), F.stddev_samp(F.signum(score) * F.col(ret))).alias("sharpe")).where("sharpe IS NOT NULL")
    return g.groupBy("symbol").agg(F.max(F.struct("sharpe", -F.col("threshold"))).alias("m")).select("symbol", (-F.col("m.col2")).alias("threshold"), "m.sharpe")

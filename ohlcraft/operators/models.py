"""Models: MLlib forests and boosted trees, hidden Markov states, votes of strategies."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import encode_digits
from ..functions.windows import W, change, rolling, run_length
from . import indicators as ind


def assembled(df: DataFrame, columns: list[str], label: str = "target") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=columns, outputCol="features").transform(df.dropna(subset=[*columns, label]))


def forest(train: DataFrame, columns: list[str], label: str = "target", trees: int = 20, depth: int = 5, seed: int = 42):
    """A random forest, rarer classes weighing more."""
    from pyspark.ml.classification import RandomForestClassifier

    t = assembled(train, columns, label)
    n = t.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))  # a row a class
    total = F.sum("__n").over(Window.partitionBy(F.lit(1)))
    weights = n.withColumn("weight", total / (F.col("__n") * F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))))
    return RandomForestClassifier(labelCol=label, featuresCol="features", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed).fit(t.join(F.broadcast(weights), label))


def boosted(train: DataFrame, columns: list[str], label: str = "target", rounds: int = 10, depth: int = 3, seed: int = 42):
    """Boosted trees, one against the rest."""
    from pyspark.ml.classification import GBTClassifier, OneVsRest

    gbt = GBTClassifier(labelCol=label, featuresCol="features", maxIter=rounds, maxDepth=depth, seed=seed)
    return OneVsRest(classifier=gbt, labelCol=label).fit(assembled(train, columns, label))


def predict(model, df: DataFrame, columns: list[str], label: str = "target") -> DataFrame:
    return model.transform(assembled(df, columns, label)).withColumn("prediction", F.col("prediction").cast("int"))


def accuracy(predicted: DataFrame, label: str = "target") -> DataFrame:
    return predicted.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("accuracy"))


def swings(df: DataFrame, order: int = 5) -> DataFrame:
    """(symbol, ts, kind, price): highs over, lows under all of the ``order`` bars on both sides, strictly; none at the edges."""
    before, after = W().rowsBetween(-order, -1), W().rowsBetween(1, order)
    full = (F.count(F.lit(1)).over(before) == order) & (F.count(F.lit(1)).over(after) == order)
    hi = full & (F.col("high") > F.max("high").over(before)) & (F.col("high") > F.max("high").over(after))
    lo = full & (F.col("low") < F.min("low").over(before)) & (F.col("low") < F.min("low").over(after))
    t = df.withColumns({"hi": hi, "lo": lo}).where("hi OR lo")
    both = F.array(F.struct(F.lit("HIGH").alias("kind"), F.col("high").alias("price"), F.col("hi").alias("ok")), F.struct(F.lit("LOW").alias("kind"), F.col("low").alias("price"), F.col("lo").alias("ok")))
    return t.select("symbol", "ts", F.explode(both).alias("s")).where("s.ok").select("symbol", "ts", "s.kind", "s.price")


def swing_states(df: DataFrame, order: int = 5) -> DataFrame:
    """Adds state: 0 falling, 1 mixed, 2 rising, by the last two highs and lows."""
    s = swings(df, order)
    w = Window.partitionBy("symbol", "kind").orderBy("ts")
    s = s.withColumn("dir", F.signum(F.col("price") - F.lag("price").over(w)).cast("int"))
    all_ = Window.partitionBy("symbol").orderBy("ts", "kind").rowsBetween(Window.unboundedPreceding, 0)
    h, lo = (F.last(F.when(F.col("kind") == k, F.col("dir")), ignorenulls=True).over(all_) for k in ("HIGH", "LOW"))
    return s.withColumn("state", F.when((h > 0) & (lo > 0), 2).when((h < 0) & (lo < 0), 0).otherwise(1)).drop("dir")


def transitions(states: DataFrame, order: int = 1, base: int = 3) -> DataFrame:
    """(symbol, history, state, n, p): how often a state follows the last ``order`` ones, written as a base-n number."""
    w = Window.partitionBy("symbol").orderBy("ts", "kind")
    digits = F.array(*[F.lag("state", k).over(w) for k in range(order, 0, -1)])
    t = states.withColumn("h", encode_digits(digits, base)).where(F.col("h").isNotNull())
    g = t.groupBy("symbol", F.col("h").alias("history"), "state").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("symbol", "history")))


def next_state(states: DataFrame, order: int = 1, base: int = 3) -> DataFrame:
    """(symbol, predicted, p): the likeliest state after the newest history; of equals the lower one."""
    w = Window.partitionBy("symbol").orderBy("ts", "kind")
    digits = F.array(*[F.lag("state", k).over(w) for k in range(order - 1, 0, -1)], F.col("state"))
    now = states.withColumn("h", encode_digits(digits, base)).groupBy("symbol").agg(F.max_by("h", F.struct("ts", "kind")).alias("history"))
    j = now.join(transitions(states, order, base), ["symbol", "history"])
    return j.groupBy("symbol").agg(F.max(F.struct(F.col("p"), (-F.col("state")).alias("k"))).alias("m")).select("symbol", (-F.col("m.k")).alias("predicted"), F.col("m.p").alias("p"))


def hmm_features(df: DataFrame) -> DataFrame:
    """Return, distance to the adaptive mean, and volatility: what the Gaussian states are fitted on."""
    out = ind.kama(df).withColumn("ret", F.coalesce(change("close"), F.lit(0.0)))
    return out.withColumns({"dist": F.try_divide(F.col("close") - F.col("kama"), F.col("kama")), "vol": F.coalesce(rolling(F.stddev_samp, "ret", 10), F.lit(0.0))})


def gaussian_states(x: np.ndarray, k: int = 4, rounds: int = 30) -> np.ndarray:
    """Most likely states of a Gaussian hidden Markov model with diagonal covariances (Baum-Welch, then Viterbi).

    Starts from bands of the first feature, so the result is the same every time; states are numbered by its mean.
    """
    n = len(x)
    if n < 2 * k:
        return np.zeros(n, int)
    z = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    start = np.minimum(k - 1, np.argsort(np.argsort(z[:, 0], kind="stable"), kind="stable") * k // n)
    mu = np.array([z[start == s].mean(0) for s in range(k)])
    var = np.array([z[start == s].var(0) + 0.1 for s in range(k)])
    a, pi = np.full((k, k), 0.1 / (k - 1)), np.full(k, 1 / k)
    np.fill_diagonal(a, 0.9)
    for _ in range(rounds):
        e = -0.5 * (((z[:, None] - mu) ** 2 / var) + np.log(2 * np.pi * var)).sum(2)
        b = np.exp(e - e.max(1, keepdims=True))
        f, g, c = np.empty((n, k)), np.ones((n, k)), np.empty(n)
        f[0] = pi * b[0]
        c[0] = f[0].sum()
        f[0] /= c[0]
        for t in range(1, n):
            f[t] = f[t - 1] @ a * b[t]
            c[t] = max(f[t].sum(), 1e-300)
            f[t] /= c[t]
        for t in range(n - 2, -1, -1):
            g[t] = a @ (b[t + 1] * g[t + 1]) / c[t + 1]
        w = f * g
        w /= w.sum(1, keepdims=True)
        xi = (f[:-1, :, None] * a * (b[1:] * g[1:] / c[1:, None])[:, None]).sum(0)
        a = xi / np.maximum(xi.sum(1, keepdims=True), 1e-300)
        pi, total = w[0], np.maximum(w.sum(0), 1e-9)[:, None]
        mu = w.T @ z / total
        var = np.maximum(w.T @ z**2 / total - mu**2, 1e-3)
    la, e = np.log(np.maximum(a, 1e-300)), -0.5 * (((z[:, None] - mu) ** 2 / var) + np.log(2 * np.pi * var)).sum(2)
    score, back = np.log(np.maximum(pi, 1e-300)) + e[0], np.zeros((n, k), int)
    for t in range(1, n):
        m = score[:, None] + la
        back[t] = m.argmax(0)
        score = m.max(0) + e[t]
    path = np.empty(n, int)
    path[-1] = score.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return np.argsort(np.argsort(mu[:, 0], kind="stable"), kind="stable")[path]


def hmm_states(df: DataFrame, k: int = 4) -> DataFrame:
    """(symbol, ts, state, duration): a symbol's Gaussian states. The fit has no SQL form: grouped pandas, a series a task."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        return pd.DataFrame({"symbol": pdf["symbol"], "ts": pdf["ts"], "state": gaussian_states(pdf[["ret", "dist", "vol"]].to_numpy(float), k).astype("int32")})

    t = hmm_features(df).select("symbol", "ts", "ret", "dist", "vol").groupBy("symbol").applyInPandas(one, "symbol string, ts timestamp_ntz, state int")
    return run_length(t, F.col("state"), "duration")


def duration_table(states: DataFrame) -> DataFrame:
    """(symbol, state, stays, mean, std, longest) of the stays in a state."""
    ends = states.withColumn("last", F.lead("state").over(W()).isNull() | (F.lead("state").over(W()) != F.col("state"))).where("last")
    return ends.groupBy("symbol", "state").agg(F.count(F.lit(1)).alias("stays"), F.avg("duration").alias("mean"), F.stddev_samp("duration").alias("std"), F.max("duration").cast("long").alias("longest"))


def duration_clusters(table: DataFrame, k: int = 2, seed: int = 42) -> DataFrame:
    """Stays grouped by mean length with k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    t = VectorAssembler(inputCols=["mean"], outputCol="features").transform(table.dropna(subset=["mean"]))
    return KMeans(k=k, seed=seed, predictionCol="group").fit(t).transform(t).drop("features")


def state_rules(states: DataFrame, length: int = 5, support: float = 0.1, confidence: float = 0.3) -> DataFrame:
    """Association rules between the states of successive windows of bars."""
    from pyspark.ml.fpm import FPGrowth

    t = states.withColumn("i", F.floor((F.row_number().over(W()) - 1) / length))
    baskets = t.groupBy("symbol", "i").agg(F.array_sort(F.collect_set(F.concat(F.lit("s"), F.col("state")))).alias("items"))
    return FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets).associationRules


def strategy_vote(df: DataFrame, how: str = "weighted", threshold: float = 0.5) -> DataFrame:
    """(symbol, signal, score_long, score_short, score_hold) from rows a symbol and strategy: signal, weight, probability.

    simple counts, weighted adds weights, confidence adds weight times probability, threshold adds the weights of
    strategies that are at least so sure. HOLD is a side like the others. The highest score wins; of equal ones LONG, then SHORT.
    """
    w, p = F.col("weight"), F.col("probability")
    worth = {"simple": F.lit(1.0), "weighted": w, "confidence": w * p, "threshold": F.when(p >= threshold, w).otherwise(0.0)}[how]
    s = lambda side: F.sum(F.when(F.col("signal") == side, worth).otherwise(0.0))
    g = df.groupBy("symbol").agg(s("LONG").alias("score_long"), s("SHORT").alias("score_short"), s("HOLD").alias("score_hold"))
    most = F.greatest("score_long", "score_short", "score_hold")
    signal = F.when(most == 0, "HOLD").when(F.col("score_long") == most, "LONG").when(F.col("score_short") == most, "SHORT").otherwise("HOLD")
    return g.select("symbol", signal.alias("signal"), "score_long", "score_short", "score_hold")


#: Strategies by name: candles -> (symbol, signal, probability). Others can be registered.
STRATEGIES: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register(name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    STRATEGIES[name] = fn


def _swing_strategy(order: int) -> Callable[[DataFrame], DataFrame]:
    def run(df: DataFrame) -> DataFrame:
        n = next_state(swing_states(df), order)
        return n.select("symbol", F.when(F.col("predicted") == 2, "LONG").when(F.col("predicted") == 0, "SHORT").otherwise("HOLD").alias("signal"), F.col("p").alias("probability"))

    return run


register("swings", _swing_strategy(1))
register("high_order", _swing_strategy(2))


def select_by_f_test(df: DataFrame, columns: list[str], label: str = "target", k: int = 3) -> list[str]:
    """The k features that an F-test ties closest to the classes."""
    from pyspark.ml.feature import UnivariateFeatureSelector

    s = UnivariateFeatureSelector(featuresCol="features", labelCol=label, outputCol="chosen", selectionMode="numTopFeatures").setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(k)
    return [columns[i] for i in sorted(s.fit(assembled(df, columns, label)).selectedFeatures)]


def select_by_forest(df: DataFrame, columns: list[str], label: str = "target", k: int = 3) -> list[str]:
    """The k most important features of a small forest."""
    model = forest(df, columns, label, trees=10, depth=4)
    return sorted(columns, key=lambda c: -model.featureImportances[columns.index(c)])[:k]


def mutual_information(df: DataFrame, columns: list[str], label: str = "target", bins: int = 10) -> DataFrame:
    """(feature, mi): mutual information of each feature, in deciles, with the classes; counts in one pass."""
    t = df.dropna(subset=[*columns, label])
    cuts = t.agg(*[F.percentile_approx(c, [i / bins for i in range(1, bins)], 1_000_000).alias(c) for c in columns])  # a row
    bin_of = lambda c: F.size(F.filter(F.col(f"k.{c}"), lambda v: v < F.col(f"t.{c}")))
    j = t.alias("t").crossJoin(F.broadcast(cuts).alias("k"))
    rows = j.select(F.col(f"t.{label}").alias("y"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), bin_of(c).alias("b")) for c in columns])).alias("x")).groupBy("x.feature", "x.b", "y").agg(F.count(F.lit(1)).alias("n"))
    f = Window.partitionBy("feature")
    total = F.sum("n").over(f)
    p = rows.withColumns({"p": F.col("n") / total, "pb": F.sum("n").over(Window.partitionBy("feature", "b")) / total, "py": F.sum("n").over(Window.partitionBy("feature", "y")) / total})
    return p.groupBy("feature").agg(F.sum(F.col("p") * F.log(F.col("p") / (F.col("pb") * F.col("py")))).alias("mi"))


def invalid_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, nulls, constant): what can't be learnt from."""
    g = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in columns], *[(F.min(c) == F.max(c)).alias(f"c_{c}") for c in columns])
    t = g.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"n_{c}").alias("nulls"), F.coalesce(F.col(f"c_{c}"), F.lit(True)).cast("int").alias("constant")) for c in columns])).alias("x"))
    return t.select("x.*")


def save_model(model, path: str) -> None:
    """Write a fitted model to shared storage, over what was there; :func:`load_model` reads it on any cluster."""
    from pyspark.ml import PipelineModel

    PipelineModel([model]).write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def scaler(df: DataFrame, columns: list[str]):
    """A fitted pipeline's parts: columns to a vector of z-scores, ``scaled``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True)]).fit(df.dropna(subset=columns))


def oversampled(df: DataFrame, columns: list[str], label: str = "target") -> DataFrame:
    """(symbol, <label>, columns, synthetic): the rows, and rows between neighbours of rarer classes until each class is as large as the largest.

    A made row is the middle of a row and the next one in time of its symbol and class; each such pair is used as often as needed,
    in the order of (ts, symbol), the n-th time at a share of n + 1 over the times it is used and one.
    """
    t = df.dropna(subset=[*columns, label])
    size = t.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    most = size.agg(F.max("__n").alias("__most"))
    w = Window.partitionBy("symbol", label).orderBy("ts")
    pairs = t.withColumns({f"__{c}": F.lead(c).over(w) for c in columns}).where(F.col(f"__{columns[0]}").isNotNull())
    many = pairs.groupBy(label).agg(F.count(F.lit(1)).alias("__p")).join(size, label).join(F.broadcast(most))  # a row a class, and one
    many = many.select(label, "__p", (F.col("__most") - F.col("__n")).alias("__need"))
    nth = F.row_number().over(Window.partitionBy(label).orderBy("ts", "symbol")) - 1
    used = F.floor(F.col("__need") / F.col("__p")) + F.when(F.col("__k") < F.col("__need") % F.col("__p"), 1).otherwise(0)
    made = pairs.withColumn("__k", nth).join(F.broadcast(many), label).withColumn("__times", used.cast("int")).where(F.col("__times") > 0).withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    share = F.col("__i") / (F.col("__times") + 1)
    made = made.select("symbol", label, *[(F.col(c) + share * (F.col(f"__{c}") - F.col(c))).alias(c) for c in columns], F.lit(1).alias("synthetic"))
    return t.select("symbol", label, *columns, F.lit(0).alias("synthetic")).unionByName(made)


def soft_vote(predictions: list[DataFrame], keys: list[str], classes: int) -> DataFrame:
    """(keys, prediction, p): the class with the highest mean probability of several models' predictions; of equals the lower one."""
    from pyspark.ml.functions import vector_to_array

    rows = None
    for d in predictions:
        one = d.select(*keys, vector_to_array("probability").alias("p"))
        rows = one if rows is None else rows.unionByName(one)
    mean = rows.groupBy(*keys).agg(F.array(*[F.avg(F.col("p")[k]) for k in range(classes)]).alias("p"))
    best = F.array_max("p")
    return mean.select(*keys, (F.array_position("p", best) - 1).cast("int").alias("prediction"), best.alias("p"))


def calibrated(scored: DataFrame, score: str, label: str):
    """An isotonic regression of a 0/1 label on a score: turns scores into shares of hits. To be fitted on held-out rows."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    t = VectorAssembler(inputCols=[score], outputCol="features").transform(scored.select(score, F.col(label).cast("double").alias(label)))
    return IsotonicRegression(featuresCol="features", labelCol=label, predictionCol="calibrated").fit(t)


def cross_validated(df: DataFrame, columns: list[str], fit, label: str = "target", folds: int = 5, gap: int = 24) -> DataFrame:
    """(fold, n, accuracy) of models trained on what is before each of the later parts of every symbol's time, less ``gap`` bars."""
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    t = df.dropna(subset=[*columns, label]).withColumns({"__i": F.row_number().over(W()) - 1, "__n": n})
    t = t.withColumn("__fold", F.floor(F.col("__i") * (folds + 1) / F.col("__n"))).withColumn("__to_next", F.ceil((F.col("__fold") + 1) * F.col("__n") / (folds + 1)) - F.col("__i"))
    out = None
    for k in range(1, folds + 1):  # a stated number of models
        before = t.where((F.col("__fold") < k - 1) | ((F.col("__fold") == k - 1) & (F.col("__to_next") > gap)))
        p = predict(fit(before, columns, label), t.where(F.col("__fold") == k), columns, label)
        one = p.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("accuracy")).select(F.lit(k).alias("fold"), "n", "accuracy")
        out = one if out is None else out.unionByName(one)
    return out


def swing_hmm(states: DataFrame, most: int = 4, rounds: int = 60) -> DataFrame:
    """(symbol, hidden, bic, predicted, p): a hidden Markov model of each symbol's swing states, and the likeliest next state.

    Baum-Welch on the states 0, 1, 2 for one to ``most`` hidden states, the number with the lowest BIC; the next state's
    probabilities follow from the filtered hidden state. The fit has no SQL form: grouped pandas, a symbol's swings a task.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        seen = pdf.sort_values(["ts", "kind"])["state"].to_numpy(int)
        best = min((fit_discrete(seen, k, rounds) for k in range(1, most + 1)), key=lambda m: (round(m["bic"], 9), m["k"]))
        p = best["now"] @ best["a"] @ best["b"]
        return pd.DataFrame({"symbol": [pdf["symbol"].iloc[0]], "hidden": [best["k"]], "bic": [best["bic"]], "predicted": [int(p.argmax())], "p": [float(p.max())]})

    return states.select("symbol", "ts", "kind", "state").groupBy("symbol").applyInPandas(one, "symbol string, hidden int, bic double, predicted int, p double")


def fit_discrete(seen: np.ndarray, k: int, rounds: int = 60, symbols: int = 3) -> dict:
    """Baum-Welch for ``k`` hidden states: a, b, pi, loglik, bic, now (the filtered last state). Starts from leaning rows, the same every time."""
    a = np.full((k, k), 1 / k) if k == 1 else np.full((k, k), 0.3 / (k - 1)) + np.eye(k) * (0.7 - 0.3 / (k - 1))
    b = np.array([[1.0 + (j == s % symbols) + 0.1 * s * j for j in range(symbols)] for s in range(k)])
    b /= b.sum(1, keepdims=True)
    pi, n, loglik = np.full(k, 1 / k), len(seen), -np.inf
    for _ in range(rounds + 1):
        f, g, c = np.empty((n, k)), np.ones((n, k)), np.empty(n)
        for t in range(n):
            f[t] = (pi if t == 0 else f[t - 1] @ a) * b[:, seen[t]]
            c[t] = max(f[t].sum(), 1e-300)
            f[t] /= c[t]
        now, loglik = f[-1], np.log(c).sum()
        model = {"k": k, "a": a, "b": b, "pi": pi, "loglik": loglik, "now": now, "bic": -2 * loglik + (k * (k - 1) + k * (symbols - 1) + k - 1) * np.log(max(n, 1))}
        for t in range(n - 2, -1, -1):
            g[t] = a @ (b[:, seen[t + 1]] * g[t + 1]) / c[t + 1]
        w = f * g
        w /= w.sum(1, keepdims=True)
        if n > 1:
            xi = (f[:-1, :, None] * a * (b[:, seen[1:]].T * g[1:] / c[1:, None])[:, None]).sum(0)
            a = (xi + 1e-12) / (xi + 1e-12).sum(1, keepdims=True)
        b = np.stack([w[seen == s].sum(0) for s in range(symbols)], axis=1) + 1e-12
        b, pi = b / b.sum(1, keepdims=True), w[0]
    return model

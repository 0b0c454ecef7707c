"""Weighted votes over indicators, hybrid filters, and votes over timeframes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Published accuracies of the voters, and the caps on a voter's weight.
ACCURACIES = {"atc": 0.65, "oscillator": 0.70, "spc_transition": 0.68, "spc_regime": 0.66, "spc_reversion": 0.64, "boosting": 0.68, "hmm": 0.67, "forest": 0.66}
CAP_OF_TWO, CAP, ROUNDS = 0.6, 0.4, 10
TIMEFRAMES = {"15m": 0.2, "30m": 0.3, "1h": 0.5}


def weights(importance: Mapping[str, float]) -> dict[str, float]:
    """Shares of the importances, none over the cap; what is cut off goes to the others in equal parts.

    This depends on the set of voters alone, a handful of names, so it is worked out on the driver.
    """
    names = list(importance)
    total = sum(importance.values())
    w = {n: importance[n] / total if total else 1 / len(names) for n in names}
    if len(names) == 2:
        top = max(names, key=lambda n: w[n])
        if w[top] > CAP_OF_TWO:
            other = next(n for n in names if n != top)
            w[other] += w[top] - CAP_OF_TWO
            w[top] = CAP_OF_TWO
    elif len(names) > 2:
        for _ in range(ROUNDS):
            over = {n: w[n] - CAP for n in names if w[n] > CAP}
            if not over:
                break
            w |= dict.fromkeys(over, CAP)
            under = [n for n in names if w[n] < CAP]
            for n in under:
                w[n] += sum(over.values()) / len(under)
            s = sum(w.values())
            w = {n: x / s for n, x in w.items()}
    s = sum(w.values())
    return {n: x / s for n, x in w.items()}


def cumulative_vote(df: DataFrame, importance: Mapping[str, float], threshold: float = 0.5, min_votes: int = 2) -> DataFrame:
    """Adds score, vote and breakdown: 1 if enough voters say so and the score reaches min(threshold, min_votes / n).

    A voter's column is 1 for agreement, 0 otherwise; a missing vote is 0.
    """
    w = weights(importance)
    vote = {n: F.coalesce(F.col(n), F.lit(0)) for n in w}
    score = sum((vote[n] * w[n] for n in w), F.lit(0.0))
    yes = sum(F.when(vote[n] == 1, 1).otherwise(0) for n in w)
    out = df.withColumns({"score": score, "votes": yes})
    parts = F.map_from_entries(F.array(*[F.struct(F.lit(n), F.struct(vote[n].alias("vote"), F.lit(x).alias("weight"), (vote[n] * x).alias("contribution"))) for n, x in w.items()]))
    return out.withColumns({"vote": F.when((F.col("votes") >= min_votes) & (F.col("score") >= min(threshold, min_votes / len(w))), 1).otherwise(0), "breakdown": parts})


def vote_source(names: list[str]) -> Column:
    """ALL if every voter agrees, MAJORITY if more than half do, else WEIGHTED."""
    yes = sum(F.when(F.col(n) == 1, 1).otherwise(0) for n in names)
    return F.when(yes == len(names), "ALL").when(yes * 2 > len(names), "MAJORITY").otherwise("WEIGHTED")


def hybrid_filter(df: DataFrame, use_matrix: bool = True) -> DataFrame:
    """Trend, oscillator, clusters one after another; the vote over all three at the end."""
    t = df.where((F.col("atc") != 0) & (F.col("oscillator") == F.col("atc")))
    t = t.where((F.col("spc") == F.col("atc")) | (F.col("spc") == 0))
    if not use_matrix:
        return t
    as_votes = t.select("symbol", *[F.when(F.col(n) == F.col("atc"), 1).otherwise(0).alias(n) for n in ("atc", "oscillator")], F.when(F.col("spc") == F.col("atc"), 1).otherwise(0).alias("spc_transition"))
    return cumulative_vote(as_votes, {n: ACCURACIES[n] for n in ("atc", "oscillator", "spc_transition")}).where("vote = 1")


def majority(df: DataFrame, names: list[str], min_agreement: int = 3) -> DataFrame:
    """Strict plurality of signals with enough voters, and their mean confidence."""
    up = sum(F.when(F.col(f"{n}_signal") == 1, 1).otherwise(0) for n in names)
    down = sum(F.when(F.col(f"{n}_signal") == -1, 1).otherwise(0) for n in names)
    out = df.withColumns({"up": up, "down": down})
    sig = F.when((F.col("up") > F.col("down")) & (F.col("up") >= min_agreement), 1).when((F.col("down") > F.col("up")) & (F.col("down") >= min_agreement), -1).otherwise(0)
    out = out.withColumn("signal", sig)
    total = sum(F.when(F.col(f"{n}_signal") == F.col("signal"), F.col(f"{n}_confidence")).otherwise(0.0) for n in names)
    return out.withColumn("confidence", F.when(F.col("signal") != 0, total / F.greatest("up", "down")).otherwise(0.0)).drop("up", "down")


def highest_confidence(df: DataFrame, names: list[str]) -> DataFrame:
    """The most confident voter's signal; of equals a long one."""
    best = F.greatest(*[F.struct(F.when(F.col(f"{n}_signal") != 0, F.col(f"{n}_confidence")).otherwise(-1.0).alias("c"), F.col(f"{n}_signal").alias("s")) for n in names])
    return df.withColumn("b", best).withColumns({"signal": F.when(F.col("b.c") >= 0, F.col("b.s")).otherwise(0), "confidence": F.greatest(F.col("b.c"), F.lit(0.0))}).drop("b")


def timeframe_vote(df: DataFrame, known: Mapping[str, float] | None = None) -> DataFrame:
    """(symbol, signal, confidence) from rows a symbol and timeframe: the side with over half of the weight."""
    known = known or TIMEFRAMES
    w = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in known.items() for x in p]), F.col("timeframe")), F.lit(0.1))
    t = df.withColumn("w", w)
    g = t.groupBy("symbol").agg(
        F.try_divide(F.sum(F.when(F.col("signal") == "LONG", F.col("w")).otherwise(0.0)), F.sum("w")).alias("l"), F.try_divide(F.sum(F.when(F.col("signal") == "SHORT", F.col("w")).otherwise(0.0)), F.sum("w")).alias("s"),
        F.try_divide(F.sum(F.col("w") * F.col("confidence")), F.sum("w")).alias("confidence"),
    )
    return g.select("symbol", F.when(F.col("l") > 0.5, "LONG").when(F.col("s") > 0.5, "SHORT").otherwise("NONE").alias("signal"), "confidence")


def similar_rows(training: DataFrame, current: DataFrame, features: dict[str, float]) -> DataFrame:
    """Per symbol: how many training rows within a threshold of the current ones in every feature passed or failed, and the share."""
    near = [F.abs(F.col(f"t.{f}") - F.col(f"c.{f}")) <= limit for f, limit in features.items()]
    cond = F.col("t.symbol") == F.col("c.symbol")
    for n in near:
        cond = cond & n
    g = current.alias("c").join(training.alias("t"), cond, "left").groupBy("c.symbol").agg(F.count_if(F.col("t.label") == 1).alias("passed"), F.count_if(F.col("t.label") == 0).alias("failed"))
    return g.withColumn("share", F.coalesce(F.try_divide(F.col("passed"), F.col("passed") + F.col("failed")), F.lit(0.5)))

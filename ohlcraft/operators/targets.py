"""Price targets by calculators that can be registered: candles to (symbol, direction, label, target_price, delta, delta_pct)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import indicators as ind

#: A calculator gives, from candles, a row a symbol with price and one column of distance for each label.
CALCULATORS: dict[str, Callable[[DataFrame], tuple[DataFrame, dict[str, Column]]]] = {}


def register(name: str, fn: Callable[[DataFrame], tuple[DataFrame, dict[str, Column]]]) -> None:
    if not callable(fn):
        raise TypeError(f"{name} isn't callable")
    CALCULATORS[name] = fn


def _atr(df: DataFrame, multiples: tuple[float, ...] = (1.0, 2.0, 3.0)):
    last = ind.atr(df).groupBy("symbol").agg(F.max_by("close", "ts").alias("price"), F.max_by("atr", "ts").alias("__atr"))
    return last, {f"ATR x{m:g}": F.col("__atr") * m for m in multiples}


# The usual shares of the range.
FIBONACCI = (0.236, 0.382, 0.5, 0.618, 0.786)


def _fibonacci(df: DataFrame):
    last = df.groupBy("symbol").agg(F.max_by("close", "ts").alias("price"), (F.max("high") - F.min("low")).alias("__range"))
    return last, {f"Fibonacci {f:g}": F.col("__range") * f for f in FIBONACCI}


def _percent(df: DataFrame, percents: tuple[float, ...] = (1.0, 2.0, 5.0)):
    last = df.groupBy("symbol").agg(F.max_by("close", "ts").alias("price"))
    return last, {f"{p:g} %": F.col("price") * p / 100 for p in percents}


register("atr", _atr)
register("fibonacci", _fibonacci)
register("percent", _percent)


def targets(df: DataFrame, name: str, direction: str = "UP") -> DataFrame:
    """(symbol, direction, label, target_price, delta, delta_pct) of one calculator; a direction other than UP and DOWN gives both."""
    last, distances = CALCULATORS[name](df)
    sides = [direction] if direction in ("UP", "DOWN") else ["UP", "DOWN"]
    rows = F.array(*[F.struct(F.lit(s).alias("direction"), F.lit(label).alias("label"), (d if s == "UP" else -d).alias("delta")) for s in sides for label, d in distances.items()])
    t = last.select("symbol", "price", F.explode(rows).alias("t"))
    return t.select("symbol", "t.direction", "t.label", (F.col("price") + F.col("t.delta")).alias("target_price"), "t.delta", F.try_divide(F.col("t.delta") * 100, F.col("price")).alias("delta_pct"))

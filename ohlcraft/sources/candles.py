"""Candles: the one long table (symbol, ts, open, high, low, close, volume) all operators work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

OHLCV = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampNTZType())]
    + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def build_candles(ticks: DataFrame, symbol: Column, ts: Column, price: Column, tie: Column, unit: str, volume: Column) -> DataFrame:
    """Candles of one ``unit`` (hour, day ...) from ticks: one aggregation, partial on the map side.

    First and last price go by (ts, tie), so that equal times have one answer.
    """
    at = F.struct(ts, tie)
    return ticks.groupBy(symbol.cast("string").alias("symbol"), F.date_trunc(unit, ts).cast("timestamp_ntz").alias("ts")).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), volume.cast("double").alias("volume")
    )


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of ``events``, an event type being a symbol."""
    e = table(spark, sf_dir, "events")
    return build_candles(e, F.col("event_type"), F.col("ts"), F.col("value"), F.col("event_id"), "hour", F.sum("value"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of ``events``, a user being a symbol."""
    e = table(spark, sf_dir, "events")
    return build_candles(e, F.col("user_id"), F.col("ts"), F.col("value"), F.col("event_id"), "day", F.count(F.lit(1)))


def resample(candles: DataFrame, unit: str) -> DataFrame:
    """Candles of a longer unit from shorter ones."""
    return candles.groupBy("symbol", F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("ts")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")
    )


def freshest(fetches: DataFrame, now: Column, minutes: int) -> DataFrame:
    """Of each (symbol, exchange, priority, ts): the first fresh exchange, else the last stale one.

    Fresh: no older than 1.5 candles, and five minutes at least.
    """
    age = F.timestamp_diff("MINUTE", F.col("ts"), now)
    f = fetches.withColumn("is_fresh", age <= max(1.5 * minutes, 5))
    order = Window.partitionBy("symbol").orderBy(F.col("is_fresh").desc(), F.when(F.col("is_fresh"), F.col("priority")).otherwise(-F.col("priority")))
    return f.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def discover(markets: DataFrame, quote: str, limit: int) -> DataFrame:
    """Active contracts in a quote currency, the most traded first (a top-k report)."""
    good = markets.where(F.col("contract") & F.col("active") & (F.col("quote") == quote))
    return good.groupBy("symbol").agg(F.max("volume_24h").alias("volume_24h")).orderBy(F.desc("volume_24h"), "symbol").limit(limit)


def discover_spot(markets: DataFrame, quote: str) -> DataFrame:
    """All active spot markets in a quote currency, by name."""
    return markets.where(~F.col("contract") & F.col("active") & (F.col("quote") == quote)).select("symbol").distinct().orderBy("symbol")


def read_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One scan over any number of files, with the schema given."""
    return spark.read.schema(OHLCV).option("header", True).csv(paths)


def read_json(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.schema(OHLCV).json(paths)


def read_symbols(spark: SparkSession, path: str, fmt: str, column: str = "symbol") -> DataFrame:
    """(symbol), distinct and trimmed, from lists of symbols: csv (with a header), txt (one a line, # for remarks) or json (objects, one a line)."""
    if fmt == "txt":
        raw = spark.read.text(path).select(F.regexp_replace("value", "#.*", "").alias("symbol"))
    elif fmt == "csv":
        raw = spark.read.option("header", True).csv(path).select(F.col(column).alias("symbol"))
    else:
        raw = spark.read.schema(f"`{column}` string").json(path).select(F.col(column).alias("symbol"))
    return raw.select(F.trim("symbol").alias("symbol")).where("symbol != ''").distinct()


def write(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Results as Parquet, CSV (with a header), JSON or ORC."""
    w = df.write.mode("overwrite")
    (w.option("header", True).csv if fmt == "csv" else getattr(w, fmt))(path)


def validate(df: DataFrame) -> DataFrame:
    """The frame itself, or ValueError if candle columns are missing."""
    missing = [c for c in OHLCV.names if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df

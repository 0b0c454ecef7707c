"""Streaming queries run over the ticks of ``events`` to their end and read back, with batch oracles."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..functions.windows import r6
from ..operators.atc import KINDS
from ..sources import candles
from ..streaming import live
from . import oracle_text as o
from .signal_queries import CFG
from .signal_queries import ORACLES as SIGNALS
from .signal_queries import _classify_sql as classify_sql

QUERIES, ORACLES = {}, {}


def _work(spark) -> str:
    """A folder that driver and executors share; local mode without a setting uses a temporary one, a cluster needs the setting."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="ohlcraft-stream-")
    return f"{found.rstrip('/')}/stream-{uuid.uuid4().hex}"


def finished(stream, spark, mode: str = "append"):
    """All rows that a stream gives for the input there is, as a batch table."""
    at = _work(spark)
    q = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def _ticks(spark, sf_dir):
    """The event ticks in time order as a few files, and a closing tick far ahead that lets all windows end."""
    e = candles.table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.col("event_id").alias("id"))
    end = e.agg((F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts")).select(F.lit("~end").alias("symbol"), "ts", F.lit(0.0).alias("price"), F.lit(-1).cast("long").alias("id"))
    at = _work(spark)
    e.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(f"{at}/ticks")
    end.write.mode("append").parquet(f"{at}/ticks")
    return live.ticks(spark, f"{at}/ticks", e.schema, 100)


def _stream_candles(spark, sf_dir):
    c = finished(live.candle_stream(_ticks(spark, sf_dir)), spark).where("symbol != '~end'")
    return c.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), *[r6(x).alias(x) for x in ("open", "high", "low", "close", "volume")])


QUERIES["streaming_candles"] = _stream_candles
ORACLES["streaming_candles"] = o.query(
    o.HOURLY.replace("sum(value)::DOUBLE AS volume", "count(*)::DOUBLE AS volume"), select="SELECT symbol, ts, " + ", ".join(f"{o.r6(x)} AS {x}" for x in ("open", "high", "low", "close", "volume")) + " FROM c"
)


def _stream_volatility(spark, sf_dir):
    c = finished(live.sliding_volatility(_ticks(spark, sf_dir)), spark).where("symbol != '~end'")
    return c.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), r6("volatility").alias("volatility"), "n")


QUERIES["streaming_sliding_volatility"] = _stream_volatility
ORACLES["streaming_sliding_volatility"] = f"""WITH t AS (SELECT event_type AS symbol, value, unnest([date_trunc('hour', ts) - INTERVAL 3 HOUR, date_trunc('hour', ts) - INTERVAL 2 HOUR, date_trunc('hour', ts) - INTERVAL 1 HOUR, date_trunc('hour', ts)]) AS ts FROM events)
SELECT symbol, ts::TIMESTAMP AS ts, {o.r6('stddev_samp(value)')} AS volatility, count(*)::BIGINT AS n FROM t GROUP BY ALL"""


def _stream_sessions(spark, sf_dir):
    c = finished(live.sessions(_ticks(spark, sf_dir)), spark).where("symbol != '~end'")
    return c.select("symbol", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


QUERIES["streaming_sessions"] = _stream_sessions
ORACLES["streaming_sessions"] = """WITH a AS (SELECT event_type AS symbol, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
b AS (SELECT *, sum(f) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM a) SELECT symbol, min(ts)::TIMESTAMP AS start, (max(ts) + INTERVAL 2 HOUR)::TIMESTAMP AS "end", count(*)::BIGINT AS n FROM b GROUP BY symbol, g"""


def _stream_ema(spark, sf_dir):
    c = candles.hourly(spark, sf_dir).select("symbol", F.col("ts").cast("timestamp").alias("ts"), "close")
    at = _work(spark)
    c.coalesce(1).sortWithinPartitions("ts").write.parquet(f"{at}/bars")
    s = finished(live.ema_cross(live.ticks(spark, f"{at}/bars", c.schema)), spark)
    return s.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), r6("fast").alias("fast"), r6("slow").alias("slow"), "signal")


QUERIES["streaming_ema_state"] = _stream_ema
ORACLES["streaming_ema_state"] = o.query(
    o.HOURLY, o.recursion("c", {"a": "close", "b": "close"}, {"a": f"r.a + {2 / 13!r} * (n.close - r.a)", "b": f"r.b + {2 / 27!r} * (n.close - r.b)"}),
    select=o.back(f"{o.r6('r.a')} AS fast, {o.r6('r.b')} AS slow, CASE WHEN r.a > r.b THEN 1 WHEN r.a < r.b THEN -1 ELSE 0 END AS signal"), recursive=True,
)


#: Where the stream below forgets the symbol 'click'; 'view' is removed then and added two days later.
_CUT, _BACK = "2024-01-12 00:00:00", "2024-01-14 00:00:00"


def _bars(spark, sf_dir, commands: bool):
    """Hourly bars in time order as several files a batch each, and commands among them."""
    c = candles.hourly(spark, sf_dir).select("symbol", F.col("ts").cast("timestamp").alias("ts"), "close", F.lit(None).cast("string").alias("command"))
    if commands:
        rows = ", ".join(f"('{s}', timestamp '{t}', cast(null AS double), '{k}')" for s, t, k in (("click", _CUT, "reset"), ("view", _CUT, "remove"), ("view", _BACK, "add")))
        c = c.unionByName(spark.sql(f"SELECT * FROM VALUES {rows} AS t(symbol, ts, close, command)"))
    at = _work(spark)
    # one folder a week, taken in turn: the state goes from batch to batch
    weeks = [r[0] for r in c.select(F.date_trunc("week", "ts")).distinct().orderBy(F.date_trunc("week", "ts")).collect()]  # a row a week
    for w in weeks:
        c.where(F.date_trunc("week", "ts") == F.lit(w)).coalesce(1).write.mode("append").parquet(f"{at}/bars")
    return live.ticks(spark, f"{at}/bars", c.schema)


def _trend(spark, sf_dir, commands: bool):
    s = finished(live.trend_state(_bars(spark, sf_dir, commands), CFG), spark)
    return s.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), *[r6(k).alias(k) for k in (*KINDS, "average")])


QUERIES["streaming_trend_state"] = lambda spark, sf_dir: _trend(spark, sf_dir, False)
ORACLES["streaming_trend_state"] = SIGNALS["atc_classify"]
QUERIES["streaming_trend_commands"] = lambda spark, sf_dir: _trend(spark, sf_dir, True)
# a symbol that starts anew is classified like another one
_PARTS = o.HOURLY.replace("c AS (", "c0 AS (", 1) + f", c AS (SELECT * REPLACE (CASE WHEN symbol IN ('click', 'view') AND ts >= TIMESTAMP '{_CUT}' THEN symbol || ' anew' ELSE symbol END AS symbol) FROM c0 WHERE symbol != 'view' OR ts < TIMESTAMP '{_CUT}' OR ts >= TIMESTAMP '{_BACK}')"
ORACLES["streaming_trend_commands"] = classify_sql("SELECT replace(symbol, ' anew', '') AS symbol, ts, " + ", ".join(f"{o.r6(f'l{k}')} AS {kind}" for k, kind in enumerate(KINDS)) + f", {o.r6('av')} AS average FROM fin", _PARTS)


def _csv_round_trip(spark, sf_dir):
    """Candles through CSV, JSON and ORC files and back."""
    c = candles.hourly(spark, sf_dir)
    at = _work(spark)
    for fmt in ("csv", "json", "orc"):
        candles.write(c, f"{at}/{fmt}", fmt)
    back = candles.read_csv(spark, [f"{at}/csv"]).unionByName(candles.read_json(spark, f"{at}/json")).unionByName(spark.read.schema(candles.OHLCV).orc(f"{at}/orc"))
    return back.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("close")).alias("total"))


QUERIES["sources_and_sinks"] = _csv_round_trip
ORACLES["sources_and_sinks"] = o.query(o.HOURLY, select=f"SELECT symbol, 3 * count(*)::BIGINT AS n, {o.r6('3 * sum(close)')} AS total FROM c GROUP BY symbol")

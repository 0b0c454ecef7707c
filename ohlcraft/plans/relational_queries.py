"""Relational primitives on the star-schema tables, scalar functions, and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars
from ..functions.windows import r6
from ..operators import relational, sampling
from ..sources import candles
from ..sources.candles import table
from . import oracle_text as o

QUERIES, ORACLES = {}, {}


def sql(name: str, text: str, tables: str, duck: str | None = None) -> None:
    """Register SQL over the named tables, the same text (or ``duck``) being the oracle's."""

    def run(spark, sf_dir):
        views = {t: table(spark, sf_dir, t) for t in tables.split()}
        return spark.sql(text.format(**{t: "{" + t + "}" for t in views}), **views)

    QUERIES[name] = run
    ORACLES[name] = duck or text.format(**{t: t for t in tables.split()})


sql("filter_mask", "SELECT l_orderkey, l_linenumber, l_quantity FROM {lineitem} WHERE l_quantity > 45 AND l_returnflag = 'R' AND l_discount < 0.03", "lineitem")
sql("semi_join", "SELECT c_custkey, c_acctbal FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 200000)", "customer orders")
sql("anti_join", "SELECT c_custkey, c_acctbal FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 200000)", "customer orders")
sql("inner_join", "SELECT n_name, r_name FROM {nation} JOIN {region} ON n_regionkey = r_regionkey", "nation region")
sql("left_outer_join", "SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS n_orders FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey GROUP BY c_custkey", "customer orders")
sql("full_outer_join", "SELECT s_suppkey, c_custkey FROM {supplier} FULL OUTER JOIN {customer} ON s_suppkey = c_custkey WHERE coalesce(s_suppkey, c_custkey) < 300", "supplier customer")
sql("range_join", "SELECT s_suppkey, n_nationkey FROM {supplier} JOIN {nation} ON s_nationkey BETWEEN n_nationkey - 1 AND n_nationkey + 1", "supplier nation")
sql("inequality_pairs", "SELECT a.n_name AS long_name, b.n_name AS short_name FROM {nation} a JOIN {region} r ON a.n_regionkey = r.r_regionkey JOIN {nation} b ON b.n_regionkey = r.r_regionkey AND a.n_nationkey < b.n_nationkey", "nation region")
sql("union_all", "SELECT c_nationkey AS k, 'c' AS side FROM {customer} UNION ALL SELECT s_nationkey, 's' FROM {supplier}", "customer supplier")
sql("union_distinct", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}", "customer supplier")
sql("intersect", "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}", "customer supplier")
sql("except_set", "SELECT p_partkey AS k FROM {part} EXCEPT SELECT l_partkey FROM {lineitem} WHERE l_quantity > 40", "part lineitem")
sql("group_by", "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, floor(sum(l_quantity) * 100 + 0.5) / 100 AS qty, floor(avg(l_extendedprice) * 100 + 0.5) / 100 AS mean_price FROM {lineitem} GROUP BY l_returnflag, l_linestatus", "lineitem")
sql("distinct_aggregate", "SELECT o_orderpriority, CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers FROM {orders} GROUP BY o_orderpriority", "orders")
sql("conditional_totals", "SELECT c_mktsegment, floor(sum(CASE WHEN c_acctbal >= 0 THEN c_acctbal ELSE 0 END) * 100 + 0.5) / 100 AS long_total, floor(sum(CASE WHEN c_acctbal < 0 THEN -c_acctbal ELSE 0 END) * 100 + 0.5) / 100 AS short_total, floor(sum(c_acctbal) * 100 + 0.5) / 100 AS combined FROM {customer} GROUP BY c_mktsegment", "customer")
sql("rollup", "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)", "lineitem")
sql("cube", "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)", "lineitem")
sql("grouping_sets", "SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())", "orders")
sql("having", "SELECT l_suppkey, CAST(count(*) AS BIGINT) AS n FROM {lineitem} GROUP BY l_suppkey HAVING count(*) > 50 AND avg(l_quantity) > 25", "lineitem")
sql("top_k", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 50", "orders")
sql("top_k_per_group", "SELECT l_suppkey, l_orderkey, l_linenumber, rn FROM (SELECT l_suppkey, l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS BIGINT) AS rn FROM {lineitem}) t WHERE rn <= 3", "lineitem")
sql("window_ranking", "SELECT c_custkey, CAST(rank() OVER w AS BIGINT) AS rk, CAST(dense_rank() OVER w AS BIGINT) AS dr, CAST(ntile(4) OVER w AS BIGINT) AS quartile FROM {customer} WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)", "customer")
sql("bin_right_open", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 30 THEN 'mid' ELSE 'high' END AS bin FROM {lineitem} WHERE l_shipdate IS NOT NULL", "lineitem")
sql("pivot_counts", "SELECT event_type, CAST(count(CASE WHEN value < 50 THEN 1 END) AS BIGINT) AS low, CAST(count(CASE WHEN value >= 50 AND value < 100 THEN 1 END) AS BIGINT) AS mid, CAST(count(CASE WHEN value >= 100 THEN 1 END) AS BIGINT) AS high FROM {events} GROUP BY event_type", "events")
sql("json_field", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM {events}", "events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
sql(
    "star_join_revenue",
    "SELECT r_name, n_name, floor(sum(l_extendedprice * (1 - l_discount)) * 100 + 0.5) / 100 AS revenue FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey GROUP BY r_name, n_name",
    "lineitem orders customer nation region",
)


def _keep_first(spark, sf_dir):
    return relational.keep_first(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"])


QUERIES["keep_first"] = _keep_first
ORACLES["keep_first"] = "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1"


def _asof(spark, sf_dir):
    c = candles.hourly(spark, sf_dir).select("symbol", "ts", "close")
    probes = candles.daily(spark, sf_dir).select("ts").distinct().crossJoin(F.broadcast(c.select("symbol").distinct()))  # days x event types
    out = relational.asof(probes.select("symbol", "ts"), c, ["symbol"], "ts", ["close"])
    return out.select("symbol", "ts", r6("close").alias("close"))


QUERIES["asof_join"] = _asof
ORACLES["asof_join"] = o.query(
    o.HOURLY, "d AS (SELECT DISTINCT date_trunc('day', ts)::TIMESTAMP AS ts FROM events), p AS (SELECT symbol, ts FROM d, (SELECT DISTINCT symbol FROM c))",
    select=f"SELECT p.symbol, p.ts, {o.r6('c.close')} AS close FROM p ASOF LEFT JOIN c ON p.symbol = c.symbol AND p.ts >= c.ts",
)
QUERIES["calendar_fill"] = lambda spark, sf_dir: (lambda d: d.select("symbol", "ts", "was_gap", r6("close").alias("close")))(relational.calendar_fill(candles.hourly(spark, sf_dir)))
ORACLES["calendar_fill"] = o.query(
    o.HOURLY, "g AS (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM c GROUP BY symbol), j AS (SELECT g.symbol, g.ts, c.close, row_number() OVER (PARTITION BY g.symbol ORDER BY g.ts) AS i FROM g LEFT JOIN c ON c.symbol = g.symbol AND c.ts = g.ts)",
    f"k AS (SELECT *, last_value(close IGNORE NULLS) OVER a AS pc, last_value(CASE WHEN close IS NOT NULL THEN i END IGNORE NULLS) OVER a AS pi, first_value(close IGNORE NULLS) OVER b AS nc, first_value(CASE WHEN close IS NOT NULL THEN i END IGNORE NULLS) OVER b AS ni FROM j WINDOW a AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))",
    select=f"SELECT symbol, ts::TIMESTAMP AS ts, CASE WHEN close IS NULL THEN 1 ELSE 0 END AS was_gap, {o.r6('pc + (nc - pc) * coalesce((i - pi)::DOUBLE / nullif(ni - pi, 0), 0)')} AS close FROM k",
)


def _fresh(spark, sf_dir):
    c = candles.hourly(spark, sf_dir)
    latest = c.groupBy("symbol").agg(F.max("ts").alias("ts"))
    offers = F.explode(F.array(*[F.struct(F.lit(x).alias("exchange"), F.lit(p).alias("priority"), F.lit(h).alias("late")) for x, p, h in (("one", 1, 5), ("two", 2, 1), ("three", 3, 0))])).alias("x")
    f = latest.select("symbol", "ts", offers).select("symbol", "x.exchange", "x.priority", (F.col("ts") - F.expr("make_interval(0, 0, 0, 0, x.late, 0, 0)")).alias("ts"))
    return candles.freshest(f, F.lit("2024-01-31 00:30:00").cast("timestamp_ntz"), 60).select("symbol", "exchange", F.col("is_fresh").cast("int").alias("is_fresh"))


QUERIES["fresh_fallback"] = _fresh
ORACLES["fresh_fallback"] = """WITH l AS (SELECT event_type AS symbol, date_trunc('hour', max(ts)) AS ts FROM events GROUP BY 1), x(exchange, priority, late) AS (VALUES ('one', 1, 5), ('two', 2, 1), ('three', 3, 0)),
f AS (SELECT symbol, exchange, priority, ts - to_hours(late) AS ts FROM l, x), g AS (SELECT *, CASE WHEN date_diff('minute', ts, TIMESTAMP '2024-01-31 00:30:00') <= 90 THEN 1 ELSE 0 END AS is_fresh FROM f),
h AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY is_fresh DESC, CASE WHEN is_fresh = 1 THEN priority ELSE -priority END) AS rn FROM g) SELECT symbol, exchange, is_fresh FROM h WHERE rn = 1"""


def _markets(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.upper(F.concat(F.lit("s"), F.col("s_suppkey"))).alias("symbol"), F.when(F.col("s_nationkey") % 3 == 0, "BTC").otherwise("USDT").alias("quote"), (F.col("s_suppkey") % 7 != 0).alias("active"), (F.col("s_suppkey") % 5 != 0).alias("contract"), F.col("s_acctbal").alias("volume_24h"))
    return candles.discover(s, "USDT", 30)


QUERIES["symbol_discovery"] = _markets
ORACLES["symbol_discovery"] = "SELECT upper('s' || s_suppkey) AS symbol, max(s_acctbal) AS volume_24h FROM supplier WHERE s_nationkey % 3 != 0 AND s_suppkey % 7 != 0 AND s_suppkey % 5 != 0 GROUP BY 1 ORDER BY volume_24h DESC, symbol LIMIT 30"


def _scalars(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    tf = F.element_at(F.array(*map(F.lit, ("15m", "h1", "4H", "1d", "w1", "odd"))), (F.col("p_size") % 6 + 1).cast("int"))
    raw = F.element_at(F.array(F.lit(" btc "), F.lit("ethusdt"), F.lit("sol/usdt")), (F.col("p_size") % 3 + 1).cast("int"))
    t = F.col("p_size") / 50
    return p.select(
        "p_partkey", scalars.normalize_symbol(raw).alias("symbol"), scalars.symbol_key(raw).alias("key"), scalars.normalize_timeframe(tf).alias("timeframe"), scalars.timeframe_minutes(tf).cast("long").alias("minutes"),
        scalars.days_to_candles(F.col("p_size"), tf).alias("candles"), r6(scalars.sigmoid(t)).alias("sigmoid"), scalars.gradient(t, F.lit(0.0), F.lit(1.0), "#000000", "#FF8000").alias("color"),
        scalars.encode_digits(scalars.decode_digits(F.col("p_size"), 3, 5), 3).alias("round_trip"), F.array_join(scalars.decode_digits(F.col("p_size"), 3, 5), "").alias("base3"),
        scalars.extract_json(F.concat(F.lit("answer: {\"signal\": \"LONG\", \"n\": "), F.col("p_size"), F.lit("} done")), "$.signal").alias("json_signal"),
    )


QUERIES["scalar_functions"] = _scalars
ORACLES["scalar_functions"] = """WITH t AS (SELECT p_partkey, p_size, ['15m', '1h', '4h', '1d', '1w', 'odd'][p_size % 6 + 1] AS timeframe, [15, 60, 240, 1440, 10080, 60][p_size % 6 + 1] AS minutes FROM part)
SELECT p_partkey, ['BTC/USDT', 'ETH/USDT', 'SOL/USDT'][p_size % 3 + 1] AS symbol, ['BTC', 'ETHUSDT', 'SOLUSDT'][p_size % 3 + 1] AS key, timeframe, CAST(minutes AS BIGINT) AS minutes, CAST(ceil(p_size * 1440 / minutes) AS BIGINT) AS candles,
floor((1 / (1 + exp(-10 * (p_size / 50 - 0.5)))) * 1e6 + 0.5) / 1e6 AS sigmoid, printf('#%02X%02X00', CAST(floor(255 * least(1, p_size / 50)) AS INTEGER), CAST(floor(128 * least(1, p_size / 50)) AS INTEGER)) AS color, CAST(p_size AS BIGINT) AS round_trip,
concat((p_size // 81) % 3, (p_size // 27) % 3, (p_size // 9) % 3, (p_size // 3) % 3, p_size % 3) AS base3, 'LONG' AS json_signal FROM t"""


def _volumes(spark, sf_dir):
    return candles.daily(spark, sf_dir).groupBy("symbol").agg(F.sum("volume").alias("volume"), F.avg(F.try_divide(F.col("high") - F.col("low"), F.col("close"))).alias("spread"), F.stddev_samp("close").alias("volatility"))


_KEY = "md5('7:' || symbol)"
for _name, _fn, _sql in (
    ("sample_random", lambda v: sampling.random_sample(v, 20, 7), f"n AS (SELECT greatest(1, CAST(floor(count(*) * 0.2) AS BIGINT)) AS k FROM v), r AS (SELECT symbol, row_number() OVER (ORDER BY {_KEY}, symbol) AS rn FROM v) SELECT symbol FROM r, n WHERE rn <= k"),
    ("sample_systematic", lambda v: sampling.systematic(v, 20), "n AS (SELECT greatest(1, CAST(floor(count(*) * 0.2) AS BIGINT)) AS k, count(*) AS m FROM v), r AS (SELECT symbol, row_number() OVER (ORDER BY volume DESC, symbol) - 1 AS rn FROM v) SELECT symbol FROM r, n WHERE rn % greatest(1, m // k) = 0 AND rn // greatest(1, m // k) < k"),
    ("sample_stratified", lambda v: sampling.stratified(v, 20, 7), f"m AS (SELECT count(*) AS m, greatest(1, CAST(floor(count(*) * 0.2) AS BIGINT)) AS k FROM v), r AS (SELECT symbol, row_number() OVER (ORDER BY volume DESC, symbol) - 1 AS rn FROM v), s AS (SELECT symbol, least(2, rn // greatest(1, m // 3)) AS st, k FROM r, m), t AS (SELECT symbol, st, k, row_number() OVER (PARTITION BY st ORDER BY {_KEY}, symbol) AS q FROM s) SELECT symbol FROM t WHERE q <= CASE WHEN st = 2 THEN k - 2 * (k // 3) ELSE k // 3 END"),
    ("sample_top_hybrid", lambda v: sampling.top_hybrid(v, 20, 7), f"n AS (SELECT greatest(1, CAST(floor(count(*) * 0.2) AS BIGINT)) AS k FROM v), r AS (SELECT symbol, row_number() OVER (ORDER BY volume DESC, symbol) AS rn FROM v), a AS (SELECT symbol, rn, k, rn <= (k + 1) // 2 AS top FROM r, n), b AS (SELECT symbol, top, k, row_number() OVER (PARTITION BY top ORDER BY {_KEY}, symbol) AS q FROM a) SELECT symbol FROM b WHERE top OR q <= k - (k + 1) // 2"),
):
    QUERIES[_name] = lambda spark, sf_dir, f=_fn: f(_volumes(spark, sf_dir)).select("symbol")
    ORACLES[_name] = o.query(o.DAILY, "v AS (SELECT symbol, sum(volume) AS volume FROM c GROUP BY symbol)", _sql.rsplit(" SELECT symbol FROM ", 1)[0], select="SELECT symbol FROM " + _sql.rsplit(" SELECT symbol FROM ", 1)[1])
QUERIES["sample_volume_weighted"] = lambda spark, sf_dir: sampling.volume_weighted(_volumes(spark, sf_dir), 20, 7).select("symbol")
QUERIES["sample_liquidity_weighted"] = lambda spark, sf_dir: sampling.liquidity_weighted(_volumes(spark, sf_dir), 20, 7).select("symbol")

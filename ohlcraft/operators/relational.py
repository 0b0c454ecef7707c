"""Relational helpers that the analyses share: as-of lookups, calendars, greedy selection, keep-first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One row a key, the first by a full order (dropDuplicates would take any)."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def asof(left: DataFrame, right: DataFrame, keys: list[str], ts: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the last right row at or before its time.

    One union, one window: rows of a key lie on one partition, and no row is compared with another.
    """
    lcols = [c for c in left.columns if c not in (*keys, ts)]
    a = left.select(*keys, ts, F.lit(1).alias("__side"), *lcols, *[F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values])
    b = right.select(*keys, ts, F.lit(0).alias("__side"), *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in lcols], *values)
    w = Window.partitionBy(*keys).orderBy(ts, "__side").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.last(F.when(F.col("__side") == 0, F.struct(*values)), ignorenulls=True).over(w)
    out = a.unionByName(b).withColumn("__hit", hit).where("__side = 1")
    return out.select(*keys, ts, *lcols, *[F.col(f"__hit.{v}").alias(v) for v in values])


def calendar_fill(df: DataFrame, hours: int = 1) -> DataFrame:
    """Candles on every hour between a symbol's first and last, the close by the straight line between known ones."""
    span = df.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    grid = span.select("symbol", F.explode(F.sequence("a", "b", F.expr(f"INTERVAL {hours} HOURS"))).alias("ts"))
    j = grid.join(df.select("symbol", "ts", "close"), ["symbol", "ts"], "left")
    w = Window.partitionBy("symbol").orderBy("ts")
    j = j.withColumn("i", F.row_number().over(w))
    known = F.when(F.col("close").isNotNull(), F.struct(F.col("i"), F.col("close")))
    j = j.withColumns({"p": F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "n": F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    line = F.col("p.close") + (F.col("n.close") - F.col("p.close")) * F.coalesce(F.try_divide(F.col("i") - F.col("p.i"), F.col("n.i") - F.col("p.i")), F.lit(0.0))
    return j.select("symbol", "ts", F.col("close").isNull().cast("int").alias("was_gap"), line.alias("close"))


def greedy_unique_pairs(pairs: DataFrame, n: int) -> DataFrame:
    """The best pairs in which no symbol comes twice, then the best of the rest up to n (a top-k report).

    Taking one by one depends on what was taken before: a fold over the ranked candidates. Candidates
    are a list of top symbols against bottom symbols, so it's short.
    """
    ranked = pairs.groupBy().agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("k"), "long_symbol", "short_symbol", "score"))).alias("r"))
    fold = """aggregate(r, named_struct('used', cast(array() AS array<string>), 'got', filter(r, x -> false), 'rest', filter(r, x -> false)), (a, x) ->
        CASE WHEN array_contains(a.used, x.long_symbol) OR array_contains(a.used, x.short_symbol) THEN named_struct('used', a.used, 'got', a.got, 'rest', concat(a.rest, array(x)))
        ELSE named_struct('used', concat(a.used, array(x.long_symbol, x.short_symbol)), 'got', concat(a.got, array(x)), 'rest', a.rest) END)"""
    out = ranked.select(F.expr(fold).alias("f")).select(F.posexplode(F.slice(F.concat("f.got", "f.rest"), 1, n)).alias("pos", "p"))
    return out.select((F.col("pos") + 1).cast("long").alias("rank"), "p.long_symbol", "p.short_symbol", "p.score")

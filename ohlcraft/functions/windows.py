"""Window and fold helpers over one symbol's rows in time order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

def W() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("ts")


def ALL() -> WindowSpec:
    return Window.partitionBy("symbol")


def UPTO() -> WindowSpec:
    return W().rowsBetween(Window.unboundedPreceding, 0)




def last_n(n: int, upto: int = 0) -> WindowSpec:
    return W().rowsBetween(upto - n + 1, upto)


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def prev(x: Column | str, n: int = 1) -> Column:
    return F.lag(col(x), n).over(W())


def following(x: Column | str, n: int = 1) -> Column:
    return F.lead(col(x), n).over(W())


def rolling(agg, x: Column | str, n: int, least: int | None = None) -> Column:
    """An aggregate over the last n rows, null until ``least`` (n if not given) of them have a value."""
    x = col(x)
    return F.when(F.count(x).over(last_n(n)) >= (n if least is None else least), agg(x).over(last_n(n)))


def sma(x: Column | str, n: int) -> Column:
    return rolling(F.avg, x, n)


def rolling_lower_quantile(x: Column | str, n: int, q: float) -> Column:
    """Element floor((n - 1) q) of the last n sorted values; null before there are n."""
    x = col(x)
    sorted_ = F.array_sort(F.collect_list(x).over(last_n(n)))
    return F.when(F.count(x).over(last_n(n)) == n, F.element_at(sorted_, F.lit(int((n - 1) * q) + 1)))


def rolling_quantile(x: Column | str, n: int, q: float) -> Column:
    """Linear quantile of the last n values."""
    return rolling(lambda v: F.percentile(v, F.lit(q)), x, n)


def rolling_skew(x: Column | str, n: int) -> Column:
    """Bias-corrected skewness of the last n values, from sums of powers."""
    x = col(x)
    m = sma(x, n)
    m2, m3 = rolling(F.avg, x * x, n) - m * m, rolling(F.avg, x * x * x, n) - 3 * m * rolling(F.avg, x * x, n) + 2 * m * m * m
    return F.try_divide(m3, F.pow(m2, F.lit(1.5))) * (n * (n - 1)) ** 0.5 / (n - 2)


def change(x: Column | str, n: int = 1) -> Column:
    return F.try_divide(col(x), prev(x, n)) - 1


def ffill(x: Column | str) -> Column:
    return F.last(col(x), ignorenulls=True).over(UPTO())


def bfill(x: Column | str) -> Column:
    return F.first(col(x), ignorenulls=True).over(W().rowsBetween(0, Window.unboundedFollowing))


def persist_sign(x: Column | str) -> Column:
    """The last value that isn't zero, zero before there is one."""
    return F.coalesce(F.last(F.nullif(col(x), F.lit(0)), ignorenulls=True).over(UPTO()), F.lit(0))


def truth(x: Column) -> Column:
    """A condition in which an unknown counts as false."""
    return F.coalesce(x, F.lit(False))


def crosses_up(a: Column, b: Column) -> Column:
    return truth((a > b) & (prev(a) <= prev(b)))


def crosses_down(a: Column, b: Column) -> Column:
    return truth((a < b) & (prev(a) >= prev(b)))


def run_length(df: DataFrame, state: Column, name: str) -> DataFrame:
    """Adds the number of rows for which ``state`` has held, this one included (gaps and islands)."""
    s, g = f"{name}__s", f"{name}__g"
    out = df.withColumn(s, state)
    out = out.withColumn(g, F.sum(F.when(F.col(s).eqNullSafe(prev(s)), 0).otherwise(1)).over(UPTO()))
    return out.withColumn(name, F.row_number().over(Window.partitionBy("symbol", g).orderBy("ts"))).drop(s, g)


def row_index(df: DataFrame, name: str = "i") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W()) - 1)


def fold(df: DataFrame, inputs: list[str], init: str, step: str, outputs: dict[str, str], keep: list[str] | None = None) -> DataFrame:
    """Adds columns from a recursion over a symbol's rows in time order, inside the JVM.

    ``init`` is an SQL struct, the state before the first row. ``step`` is an SQL struct, the state after
    a row, in terms of ``s`` (the state before) and ``x`` (the row's inputs and its index ``i``, from 0).
    ``outputs`` are SQL expressions over the new state, named ``s``. One symbol's series is held by a task.
    """
    keep = keep or [c for c in df.columns if c != "symbol"]
    cells = F.struct("ts", *[F.col(c) for c in dict.fromkeys([*keep, *inputs]) if c != "ts"])
    g = df.groupBy("symbol").agg(F.array_sort(F.collect_list(cells)).alias("__x"))
    named = ", ".join(f"{e} AS {n}" for n, e in outputs.items())
    # x carries its index by its position; the state and the rows' results travel together
    expr = f"""aggregate(zip_with(__x, sequence(0, size(__x) - 1), (v, i) -> struct(v AS v, i AS i)),
        struct({init} AS s, filter(array({_results(init, named)}), q -> false) AS o),
        (a, w) -> transform(array(struct(a.s AS s, struct(w.v.*, w.i AS i) AS x, a.o AS o)), z ->
            transform(array(struct({_bind(step)} AS s, z.o AS o)), n -> struct(n.s AS s, concat(n.o, array({_results('n.s', named)})) AS o))[0])[0],
        a -> a.o)"""
    expr = expr.replace("struct(w.v.*, w.i AS i)", "struct(" + ", ".join(f"w.v.{c} AS {c}" for c in dict.fromkeys([*inputs])) + ", w.i AS i)")
    out = g.select("symbol", F.inline(F.arrays_zip(F.col("__x").alias("v"), F.expr(expr).alias("o"))))
    return out.select("symbol", *[F.col(f"v.{c}").alias(c) for c in keep], *[F.col(f"o.{n}").alias(n) for n in outputs])


def _bind(step: str) -> str:
    import re

    return re.sub(r"\bx\.", "z.x.", re.sub(r"(?<![\w.])s\.", "z.s.", step))


def _results(state: str, named: str) -> str:
    import re

    if state.startswith(("struct", "named_struct")):
        state = f"({state})"
    return "struct(" + re.sub(r"(?<![\w.])s\.", f"{state}.", named) + ")"


def r6(x: Column | str) -> Column:
    """Rounded to six places in the same steps as the oracles'."""
    return F.floor(col(x) * 1e6 + 0.5) / 1e6

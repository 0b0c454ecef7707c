"""Adaptive trend classification.

Six kinds of moving average, nine lengths each. Every average gives a persisted crossover signal,
every signal an equity curve; the equity-weighted mean of the nine signals, rounded to hundredths, is
the kind's layer-1 signal, whose own equity is the kind's weight in the final vote.

A symbol's series is the unit of work, so symbols spread over the cluster; nothing is exchanged but once by symbol.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.windows import W, crosses_down, crosses_up, fold, last_n, persist_sign, prev
from . import indicators as ind

KINDS = ("EMA", "HMA", "WMA", "DEMA", "LSMA", "KAMA")
_STEPS = {"Narrow": (1, 2, 3, 4), "Medium": (1, 2, 4, 6), "Wide": (1, 3, 5, 7)}


@dataclass(frozen=True)
class Config:
    length: int = 28
    robustness: str = "Medium"
    lam: float = 0.02
    decay: float = 0.03
    cutout: int = 0
    long_threshold: float = 0.1
    short_threshold: float = -0.1


def lengths(n: int, robustness: str = "Medium") -> tuple[int, ...]:
    """The nine lengths around n: itself, the longer ones, the shorter ones."""
    s = _STEPS.get(robustness, _STEPS["Wide"])
    return (n, *(n + k for k in s), *(n - k for k in s))


def growth(i: Column, lam: float, cutout: int = 0) -> Column:
    """e^(lam * bar), the first bar counting as the second; 1 before the cutout."""
    return F.when(i < cutout, F.lit(1.0)).otherwise(F.exp(lam * (F.greatest(i, F.lit(1)) - cutout)))


def _averages(df: DataFrame, kind: str, n: int) -> DataFrame:
    """``df`` with the moving average of one kind and length as ``ma``."""
    if kind == "EMA":
        return ind.ema(df, n, name="ma")
    if kind == "DEMA":
        return ind.dema(df, n).withColumnRenamed("dema", "ma")
    if kind == "KAMA":
        return ind.kama_atc(df, n).withColumnRenamed("kama_atc", "ma")
    if kind == "WMA":
        return df.withColumn("ma", ind.weighted_ma("close", n))
    if kind == "LSMA":
        return ind.lsma(df, n).withColumnRenamed("lsma", "ma")
    return ind.hma(df, n).withColumnRenamed("hma", "ma")


def ma_signal(close: Column, ma: Column) -> Column:
    """1 from a crossing up, -1 from a crossing down, until the other; 0 at first."""
    event = F.when(crosses_up(close, ma), 1).when(crosses_down(close, ma), -1).otherwise(0)
    return event


def prepare(df: DataFrame, cfg: Config) -> DataFrame:
    """Candles with row index, relative change and its growth-weighted form."""
    out = df.select("symbol", "ts", "close").withColumn("i", F.row_number().over(W()) - 1)
    return out.withColumn("r", F.try_divide(F.col("close"), prev("close")) - 1).withColumn("rg", F.col("r") * growth(F.col("i"), cfg.lam / 1000, cfg.cutout))


def signals(df: DataFrame, kind: str, cfg: Config) -> DataFrame:
    """Prepared candles with the nine persisted signals s0 ... s8 of one kind.

    All nine averages ride along in one table: windows share the sort by (symbol, ts), and the folds of the
    recursive kinds come from the same arrays.
    """
    out = df
    for k, n in enumerate(lengths(cfg.length, cfg.robustness)):
        out = _averages(out, kind, n).withColumn(f"e{k}", ma_signal(F.col("close"), F.col("ma"))).drop("ma")
    return out.withColumns({f"s{k}": persist_sign(f"e{k}") for k in range(9)}).drop(*[f"e{k}" for k in range(9)])


def equities(df: DataFrame, names: list[str], starts: list[str], cfg: Config, prefix: str = "q") -> DataFrame:
    """Equity curves of the signals: decayed, moved by the change on the side of the bar before, 0.25 at least."""
    out = df.withColumns({f"p_{n}": prev(n).cast("double") for n in names})
    d = cfg.decay / 100
    state = ", ".join(f"cast(null AS double) AS {prefix}{k}" for k in range(len(names)))
    step = ", ".join(
        f"CASE WHEN x.i < {cfg.cutout} THEN null WHEN s.{prefix}{k} IS NULL THEN {start} ELSE greatest(0.25D, s.{prefix}{k} * {1 - d!r}D * (1D + CASE WHEN x.p_{n} > 0 THEN coalesce(x.rg, 0D) WHEN x.p_{n} < 0 THEN -coalesce(x.rg, 0D) ELSE 0D END)) END AS {prefix}{k}"
        for k, (n, start) in enumerate(zip(names, starts, strict=True))
    )
    folded = fold(out, ["rg", *[f"p_{n}" for n in names]], f"struct({state})", f"struct({step})", {f"{prefix}{k}": f"s.{prefix}{k}" for k in range(len(names))})
    return folded.drop(*[f"p_{n}" for n in names])


def layer_one(df: DataFrame, kind: str, cfg: Config) -> DataFrame:
    """(symbol, ts, i, close, rg, <kind>): the equity-weighted mean of the nine signals, to hundredths."""
    out = equities(signals(df, kind, cfg), [f"s{k}" for k in range(9)], ["1D"] * 9, cfg)
    num = sum(F.col(f"s{k}") * F.col(f"q{k}") for k in range(9))
    den = sum(F.col(f"q{k}") for k in range(9))
    return out.select("symbol", "ts", "i", "close", "r", "rg", (F.rint(F.try_divide(num, den) * 100) / 100).alias(kind))


def cut(signal: Column, i: Column, cfg: Config) -> Column:
    return F.when(i < cfg.cutout, 0).when(signal > cfg.long_threshold, 1).when(signal < cfg.short_threshold, -1).otherwise(0)


def _line(n: int) -> list[float]:
    """Weights, oldest first, of the linearly weighted mean of n values."""
    return [2 * (k + 1) / (n * (n + 1)) for k in range(n)]


def _convolved(a: list[float], b: list[float]) -> list[float]:
    out = [0.0] * (len(a) + len(b) - 1)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            out[i + j] += x * y
    return out


def _filters(ls: tuple[int, ...]) -> list[list[float]]:
    """HMA, WMA and LSMA of all lengths as weights on the last closes: all three are linear."""
    hull, line, square = [], [], []
    for n in ls:
        half = [0.0] * (n - n // 2) + _line(n // 2)
        hull.append(_convolved([2 * u - v for u, v in zip(half, _line(n), strict=True)], _line(int(n**0.5))))
        line.append(_line(n))
        mid, sxx = (n - 1) / 2, n * (n * n - 1) / 12
        square.append([1 / n + (k - mid) * mid / sxx for k in range(n)])
    return [*hull, *line, *square]


def _literal(rows: list) -> str:
    return "array(" + ", ".join(_literal(r) if isinstance(r, list) else f"{r!r}D" if isinstance(r, float) else str(r) for r in rows) + ")"


def approximate_series(close: np.ndarray, ls: tuple[int, ...]) -> np.ndarray:
    """(kind, length, bar): cheap averages, none unknown. Plain means stand for exponential ones, the middle of the
    chord for the least-squares line, a fixed rate for the adaptive mean."""

    def mean(x: np.ndarray, m: int) -> np.ndarray:
        known = ~np.isnan(x)
        total, count = (np.concatenate([np.zeros(m), np.cumsum(v)]) for v in (np.where(known, x, 0.0), known.astype(float)))
        return np.divide(total[m:] - total[:-m], count[m:] - count[:-m], out=np.full(len(x), np.nan), where=count[m:] > count[:-m])

    def weighted(x: np.ndarray, m: int) -> np.ndarray:
        out = mean(x, m)
        if len(x) >= m:
            out[m - 1 :] = np.convolve(x, _line(m)[::-1], "valid")
        return out

    ma = np.empty((6, len(ls), len(close)))
    for k, m in enumerate(ls):
        plain = mean(close, m)
        chord = plain.copy()
        if len(close) >= m:
            chord[m - 1 :] = (close[m - 1 :] + close[: len(close) - m + 1]) / 2
        hull = weighted(2 * weighted(close, max(1, m // 2)) - weighted(close, m), max(1, int(m**0.5)))
        ma[:5, k] = plain, hull, weighted(close, m), 2 * plain - mean(plain, m), chord
    rate, kama = 2 / (np.array(ls) + 1) ** 2, np.full(len(ls), close[0] if len(close) else np.nan)
    for i, x in enumerate(close.tolist()):
        kama = kama + rate * (x - kama)
        ma[5, :, i] = kama
    return ma


def classify_series(close: np.ndarray, cfg: Config, approximate: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(layer-1 signals by kind and bar, final signal by bar) of one series of closes; unknown closes are NaN."""
    return classify_batch([close], cfg, approximate)[0]


def classify_batch(series: list[np.ndarray], cfg: Config, approximate: bool = False) -> list[tuple[np.ndarray, np.ndarray]]:
    """:func:`classify_series` of several series side by side.

    Averages that are linear are convolutions; the recursive ones, the equities and the layers go bar by bar, all lengths or
    all 54 of all series at once; a shorter series is padded behind its end. ``approximate``: signals, equities and votes from cheap averages.
    """
    ls = np.array(lengths(cfg.length, cfg.robustness))
    many, n = len(series), max(map(len, series), default=0)
    close = np.full((many, n), np.nan)
    ma, sc = np.full((many, 6, 9, n), np.nan), np.zeros((many, 9, n))
    filters = [np.array(f[::-1]) for f in _filters(tuple(ls.tolist()))]
    for s, x in enumerate(series):
        size = len(x)
        close[s, :size] = x
        if approximate:
            ma[s, :, :, :size] = approximate_series(x, tuple(ls.tolist()))
            continue
        for k, f in enumerate(filters):
            if size >= len(f):
                ma[s, (1, 2, 4)[k // 9], k % 9, len(f) - 1 : size] = np.convolve(x, f, "valid")
        moves = np.abs(np.diff(x))
        for j, k in enumerate(ls.tolist()):
            if size > k:
                path = np.convolve(moves, np.ones(k), "valid")
                ratio = np.divide(np.abs(x[k:] - x[:-k]), path, out=np.zeros(size - k), where=path > 0)
                sc[s, j, k:size] = (ratio * (0.666 - 0.064) + 0.064) ** 2
    alpha, first = 2 / (ls + 1), ls - 1
    shape = (many, 9)
    m, d, held, upto = np.full(shape, np.nan), np.full(shape, np.nan), np.zeros(shape), np.zeros((many, 1))
    kama = np.repeat(close[:, :1], 9, axis=1) if n else np.full(shape, np.nan)
    for i in range(0 if approximate else n):
        x = close[:, i : i + 1]
        upto = upto + x
        m = np.where(i > first, m + alpha * (x - m), np.where(i == first, upto / ls, np.nan))
        second = i - first
        held = np.where((second >= 0) & (second < ls), held + m, held)
        d = np.where(second > first, d + alpha * (m - d), np.where(second == first, held / ls, np.nan))
        kama = np.where(i < ls, kama, kama + sc[:, :, i] * (x - kama))
        ma[:, 0, :, i], ma[:, 3, :, i], ma[:, 5, :, i] = m, 2 * m - d, kama
    ma = ma.reshape(many, 54, n)
    event = np.zeros((many, 54, n), np.int8)
    change = np.zeros((many, n))
    with np.errstate(invalid="ignore", divide="ignore"):
        if n:
            now, before = close[:, None, 1:], close[:, None, :-1]
            event[:, :, 1:] = ((now > ma[:, :, 1:]) & (before <= ma[:, :, :-1])).astype(np.int8) - ((now < ma[:, :, 1:]) & (before >= ma[:, :, :-1]))
            change[:, 1:] = np.where(close[:, :-1] != 0, close[:, 1:] / close[:, :-1] - 1, 0)
    del ma
    bar = np.arange(n)
    rg = np.nan_to_num(change) * np.where(bar < cfg.cutout, 1.0, np.exp(cfg.lam / 1000 * (np.maximum(bar, 1) - cfg.cutout)))
    keep, layers, final = 1 - cfg.decay / 100, np.full((many, 6, n), np.nan), np.zeros((many, n))
    signal, q, w, votes = np.zeros((many, 54)), np.ones((many, 54)), np.ones((many, 6)), np.zeros((many, 6))
    for i in range(n):
        held_signal = signal
        signal = np.where(event[:, :, i] != 0, event[:, :, i], signal)
        if i < cfg.cutout:
            continue
        if i > cfg.cutout:
            r = rg[:, i : i + 1]
            q = np.maximum(0.25, q * keep * (1 + held_signal * r))
            w = np.maximum(0.25, w * keep * (1 + votes * r))
        by = q.reshape(many, 6, 9)
        layer = np.rint((signal.reshape(many, 6, 9) * by).sum(2) / by.sum(2) * 100) / 100
        layers[:, :, i], votes = layer, np.sign(layer)
        final[:, i] = (((layer > cfg.long_threshold) * 1.0 - (layer < cfg.short_threshold)) * w).sum(1) / w.sum(1)
    return [(layers[s, :, : len(x)], final[s, : len(x)]) for s, x in enumerate(series)]


#: Bars of all symbols of a batch together, padding included: some 60 MB of averages and signals.
_BATCH = 100_000


def _classified(cfg: Config, approximate: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by symbol and time -> the classification, several symbols at a time."""

    def done(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        found = classify_batch([t["close"].to_numpy().astype(float) for t in held], cfg, approximate)
        for t, (layers, final) in zip(held, found, strict=True):
            known = [pa.array(np.where(np.isnan(x), 0.0, x), mask=np.isnan(x)) for x in layers]
            index = pa.array(np.arange(t.num_rows, dtype=np.int32))
            yield from pa.Table.from_arrays([t["symbol"], t["ts"], index, t["close"], *known, pa.array(np.nan_to_num(final))], ["symbol", "ts", "i", "close", *KINDS, "average"]).to_batches()

    held, longest, parts, last = [], 0, [], None

    def close_symbol() -> Iterator[pa.RecordBatch]:
        nonlocal held, longest, parts
        if not parts:
            return
        t, parts = pa.Table.from_batches(parts), []
        if held and max(longest, t.num_rows) * (len(held) + 1) > _BATCH:
            yield from done(held)
            held, longest = [], 0
        held.append(t)
        longest = max(longest, t.num_rows)

    for b in batches:
        if not b.num_rows:
            continue
        names = b.column(0).to_pylist()
        cut = [0, *[k for k in range(1, len(names)) if names[k] != names[k - 1]], len(names)]
        for lo, hi in zip(cut, cut[1:], strict=False):
            if parts and names[lo] != last:
                yield from close_symbol()
            last = names[lo]
            parts.append(b.slice(lo, hi - lo))
    yield from close_symbol()
    if held:
        yield from done(held)


def classify(df: DataFrame, cfg: Config | None = None, approximate: bool = False) -> DataFrame:
    """(symbol, ts, i, close, <kind> ..., average): the layer-1 signals and the final one.

    The thousand steps a bar are far quicker as numpy vectors than as interpreted folds (measured at 20 x 500 bars: 17
    times), so this is an Arrow function over symbols dealt out by one exchange, several symbols' series at a time. The number of partitions
    is the session's: adaptive execution would put small tables, which are work enough, into one task. :func:`classify_native` does the same
    in SQL folds. Rows whose weights don't give a finite answer have 0.
    """
    cfg = cfg or Config()
    stamp = dict(df.dtypes)["ts"]
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.select("symbol", "ts", "close").repartition(tasks, "symbol").sortWithinPartitions("symbol", "ts")
    return dealt.mapInArrow(partial(_classified, cfg, approximate), f"symbol string, ts {stamp}, i int, close double, " + ", ".join(f"{k} double" for k in KINDS) + ", average double")


def classify_native(df: DataFrame, cfg: Config | None = None) -> DataFrame:
    """:func:`classify` without Python.

    Three kinds of average are constant filters over one window of closes; folds carry the other three, the 54
    signals and equities, and the six layer-1 equities, all arrays. A symbol costs one exchange. Rows whose weights don't give a finite answer have 0.
    """
    cfg = cfg or Config()
    ls, d, n = lengths(cfg.length, cfg.robustness), cfg.decay / 100, len(KINDS)
    filters = _filters(ls)
    window = max(*map(len, filters), max(ls) + 1)
    out = prepare(df, cfg).withColumn("cw", F.collect_list("close").over(last_n(window)))
    dot = "aggregate(zip_with(slice(cw, -size(f), size(f)), f, (u, v) -> u * v), 0D, (t, v) -> t + v)"
    out = out.withColumn("plain", F.expr(f"transform({_literal(filters)}, f -> CASE WHEN size(cw) >= size(f) THEN {dot} END)"))
    path = "aggregate(zip_with(slice(cw, -m, m), slice(cw, -m - 1, m), (u, v) -> abs(u - v)), 0D, (t, v) -> t + v)"
    out = out.withColumn("sc", F.expr(f"transform({_literal(list(ls))}, m -> CASE WHEN size(cw) > m THEN pow(coalesce(try_divide(abs(close - element_at(cw, -m - 1)), {path}), 0D) * {0.666 - 0.064!r}D + 0.064D, 2D) ELSE 0D END)"))
    at, nine = f"element_at({_literal(list(ls))}, j + 1)", "sequence(0, 8)"
    none = lambda k, v="cast(null AS double)": f"array_repeat({v}, {k})"
    # four folds of little depth rather than one: the analyser's work grows fast with nested lambdas
    ema = f"transform({nine}, j -> CASE WHEN x.i < {at} - 1 THEN null WHEN x.i = {at} - 1 THEN (s.t + x.close) / {at} ELSE s.m[j] + 2D / ({at} + 1) * (x.close - s.m[j]) END)"
    kama = f"transform({nine}, j -> CASE WHEN x.i = 0 THEN x.close WHEN x.i < {at} THEN s.k[j] ELSE s.k[j] + x.sc[j] * (x.close - s.k[j]) END)"
    out = fold(out, ["close", "sc"], f"struct(0D AS t, {none(9)} AS m, {none(9)} AS k)", f"struct(s.t + x.close AS t, {ema} AS m, {kama} AS k)", {"ema": "s.m", "kama": "s.k"}, ["ts", "i", "close", "rg", "plain"])
    # the second mean starts with the plain mean of the first n values of the first
    twice = f"transform({nine}, j -> CASE WHEN x.i < 2 * {at} - 2 THEN null WHEN x.i = 2 * {at} - 2 THEN (s.u[j] + x.ema[j]) / {at} ELSE s.d[j] + 2D / ({at} + 1) * (x.ema[j] - s.d[j]) END)"
    summed = f"transform({nine}, j -> CASE WHEN x.i >= {at} - 1 AND x.i < 2 * {at} - 1 THEN s.u[j] + x.ema[j] ELSE s.u[j] END)"
    out = fold(out, ["ema"], f"struct({none(9)} AS d, {none(9, '0D')} AS u)", f"struct({twice} AS d, {summed} AS u)", {"second": "s.d"}, ["ts", "i", "close", "rg", "plain", "ema", "kama"])
    out = out.withColumn("ma", F.expr("concat(ema, slice(plain, 1, 9), slice(plain, 10, 9), zip_with(ema, second, (u, v) -> 2 * u - v), slice(plain, 19, 9), kama)"))
    out = out.withColumns({"pm": prev("ma"), "pc": prev("close")})
    out = out.withColumn("event", F.expr("CASE WHEN pm IS NULL THEN transform(ma, u -> 0) ELSE zip_with(ma, pm, (u, v) -> CASE WHEN close > u AND pc <= v THEN 1 WHEN close < u AND pc >= v THEN -1 ELSE 0 END) END"))
    grown = "CASE WHEN g > 0 THEN coalesce(x.rg, 0D) WHEN g < 0 THEN -coalesce(x.rg, 0D) ELSE 0D END"
    equity = lambda q, g: f"CASE WHEN x.i >= {cfg.cutout} THEN zip_with({q}, {g}, (q, g) -> CASE WHEN q IS NULL THEN 1D ELSE greatest(0.25D, q * {1 - d!r}D * (1D + {grown})) END) ELSE {q} END"
    step = f"struct(zip_with(s.g, x.event, (g, v) -> CASE WHEN v = 0 THEN g ELSE v END) AS g, {equity('s.q', 's.g')} AS q)"
    out = fold(out, ["rg", "event"], f"struct({none(9 * n, 0)} AS g, {none(9 * n)} AS q)", step, {"g": "s.g", "q": "s.q"}, ["ts", "i", "close", "rg"])
    total = lambda e: f"aggregate(zip_with(slice(g, 9 * j + 1, 9), slice(q, 9 * j + 1, 9), (u, v) -> {e}), 0D, (t, v) -> t + v)"
    out = out.withColumn("layers", F.expr(f"transform(sequence(0, {n - 1}), j -> rint(try_divide({total('u * v')}, {total('v')}) * 100) / 100)")).withColumn("pl", prev("layers"))
    out = fold(out, ["rg", "pl"], f"struct({none(n)} AS w)", f"struct({equity('s.w', 'coalesce(x.pl, ' + none(n, '0D') + ')')} AS w)", {"weights": "s.w"}, ["ts", "i", "close", "layers"])
    kinds = [F.col("layers")[k].alias(name) for k, name in enumerate(KINDS)]
    num = sum(cut(F.col("layers")[k], F.col("i"), cfg) * F.col("weights")[k] for k in range(n))
    den = sum(F.col("weights")[k] for k in range(n))
    return out.select("symbol", "ts", "i", "close", *kinds, F.coalesce(F.try_divide(num, den), F.lit(0.0)).alias("average"))


def classify_by_kind(df: DataFrame, cfg: Config | None = None, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """The same from the single steps, for some kinds only."""
    cfg = cfg or Config()
    base = prepare(df, cfg)
    out = None
    for kind in kinds:
        one = layer_one(base, kind, cfg)
        out = one if out is None else out.join(one.select("symbol", "ts", kind), ["symbol", "ts"])
    out = equities(out, list(kinds), ["1D"] * len(kinds), cfg, "w")
    num = sum(cut(F.col(k), F.col("i"), cfg) * F.col(f"w{n}") for n, k in enumerate(kinds))
    den = sum(F.col(f"w{n}") for n in range(len(kinds)))
    return out.withColumn("average", F.coalesce(F.try_divide(num, den), F.lit(0.0))).drop("r", "rg")


def latest(df: DataFrame) -> DataFrame:
    """Each symbol's newest row."""
    order = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    return df.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def recent(df: DataFrame, limit: int) -> DataFrame:
    """The last ``limit`` bars of each symbol that has as many."""
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))
    last = df.withColumn("back", back).where(F.col("back") <= limit)
    return last.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("symbol"))).where(F.col("n") == limit).drop("n", "back")


def scan(df: DataFrame, limit: int = 1500, min_signal: float = 0.01, cfg: Config | None = None) -> DataFrame:
    """(symbol, signal, direction, confidence, price) from the last ``limit`` bars of symbols with as many and a signal, the strongest first."""
    found = latest(classify(recent(df, limit), cfg)).where((F.col("close") > 0) & (F.abs("average") >= min_signal))
    s = F.col("average")
    side = F.when(s > 0.05, "UP").when(s < -0.05, "DOWN").otherwise("NEUTRAL")
    return found.select("symbol", s.alias("signal"), side.alias("direction"), F.abs(s).alias("confidence"), F.col("close").alias("price")).orderBy(F.desc("confidence"), "symbol")


def prefiltered_scan(df: DataFrame, limit: int = 1500, least: float = 0.05, cfg: Config | None = None) -> DataFrame:
    """The scan over symbols whose approximate signal, from cheap averages, is at least ``least`` in size."""
    some = recent(df, limit)
    rough = latest(classify(some, cfg, approximate=True)).where(F.abs("average") >= least).select("symbol")
    return scan(some.join(rough, "symbol", "left_semi"), limit, cfg=cfg)


def strategy_view(classified: DataFrame) -> DataFrame:
    """The classification as it was known one bar before, so that no signal is of the bar it is acted on: average, and trend -1, 0, 1."""
    before = F.coalesce(prev("average"), F.lit(0.0))
    return classified.withColumn("average", before).withColumn("trend", F.signum("average").cast("int"))


def analyze(df: DataFrame, symbol: str, limit: int = 1500, source: str = "close", cfg: Config | None = None) -> DataFrame:
    """(symbol, ts, price, <kind> ..., average, trend): one symbol's last bars, from its close, open, high or low (else its close)."""
    source = source.lower() if source.lower() in ("close", "open", "high", "low") else "close"
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))
    one = df.where(F.col("symbol") == symbol).withColumn("back", back).where(F.col("back") <= limit)
    out = classify(one.select("symbol", "ts", F.col(source).alias("close")), cfg)
    return out.select("symbol", "ts", F.col("close").alias("price"), *KINDS, "average", F.signum("average").cast("int").alias("trend"))


def backtest(df: DataFrame, cfg: Config | None = None) -> DataFrame:
    """(symbol, bars, active, hits, gain): how the signal known before each bar did on it, over candles as they were read from files.

    active counts the bars with a signal, hits those that it had right, gain sums the returns it would have taken.
    """
    t = strategy_view(classify(df, cfg)).withColumn("r", F.coalesce(F.try_divide(F.col("close"), prev("close")) - 1, F.lit(0.0)))
    taken = F.col("trend") * F.col("r")
    return t.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), F.count_if(F.col("trend") != 0).alias("active"), F.count_if(taken > 0).alias("hits"), F.sum(taken).alias("gain"))

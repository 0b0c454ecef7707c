"""Scalar functions: symbols, timeframes, colours, interpolation, digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_symbol(s: Column, quote: str = "USDT") -> Column:
    """BASE/QUOTE in capitals; a bare base, or one with the quote glued on, gets the slash."""
    u = F.upper(F.trim(s))
    glued = F.when(u.endswith(quote) & (F.length(u) > len(quote)), F.concat(F.regexp_replace(u, f"{quote}$", ""), F.lit(f"/{quote}"))).otherwise(F.concat(u, F.lit(f"/{quote}")))
    return F.when(u.contains("/"), u).otherwise(glued)


def symbol_key(s: Column) -> Column:
    return F.regexp_replace(F.upper(s), "[^A-Z0-9]", "")


def normalize_timeframe(tf: Column) -> Column:
    """'h1' and '1H' are '1h'."""
    t = F.lower(F.trim(tf))
    return F.regexp_replace(t, "^([a-z])([0-9]+)$", "$2$1")


def timeframe_minutes(tf: Column) -> Column:
    """Minutes of a timeframe; 60 for what isn't one."""
    t = normalize_timeframe(tf)
    unit = F.regexp_extract(t, "^([0-9]{1,6})([mhdw])$", 2)
    n = F.regexp_extract(t, "^([0-9]{1,6})([mhdw])$", 1).try_cast("int")
    return F.coalesce(n * F.when(unit == "m", 1).when(unit == "h", 60).when(unit == "d", 1440).when(unit == "w", 10080), F.lit(60))


def days_to_candles(days: Column, tf: Column) -> Column:
    return F.ceil(days * 1440 / timeframe_minutes(tf)).cast("long")


def hex_to_rgb(h: Column) -> Column:
    part = lambda at: F.conv(F.substring(h, at, 2), 16, 10).cast("int")
    return F.struct(part(2).alias("r"), part(4).alias("g"), part(6).alias("b"))


def rgb_to_hex(r: Column, g: Column, b: Column) -> Column:
    two = lambda c: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), c)).cast("int")), 2, "0")
    return F.concat(F.lit("#"), two(r), two(g), two(b))


def gradient(value: Column, low: Column, high: Column, c0: str, c1: str) -> Column:
    """The colour between two as value goes from low to high."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(value - low, high - low), F.lit(0.0))))
    a, b = hex_to_rgb(F.lit(c0)), hex_to_rgb(F.lit(c1))
    return rgb_to_hex(*[F.floor(a[k] + (b[k] - a[k]) * t) for k in ("r", "g", "b")])


def clip(x: Column, lo: float, hi: float) -> Column:
    """x between the two; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def sigmoid(x: Column, steep: float = 10.0, middle: float = 0.5) -> Column:
    return 1 / (1 + F.exp(-steep * (x - middle)))


def encode_digits(digits: Column, base: int) -> Column:
    """A number from its digits, the first the most significant."""
    return F.aggregate(digits, F.lit(0).cast("long"), lambda n, d: n * base + d)


def decode_digits(n: Column, base: int, count: int) -> Column:
    return F.transform(F.sequence(F.lit(count - 1), F.lit(0), F.lit(-1)), lambda k: (F.floor(n / F.pow(F.lit(float(base)), k)).cast("long") % base).cast("int"))


def extract_json(text: Column, path: str) -> Column:
    """A value from the first {...} in a model's answer."""
    return F.get_json_object(F.regexp_extract(text, r"(?s)\{.*\}", 0), path)

"""The indicator engine: blocks by profile, and registered transforms of candles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .candlesticks import patterns
from .indicators import BLOCKS, PROFILES

CUSTOM: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {}


def register_indicator(name: str, fn: Callable[[DataFrame], DataFrame], category: str = "custom") -> None:
    """Add a transform that runs after the blocks of every profile."""
    if not callable(fn):
        raise TypeError(f"{name} isn't callable")
    CUSTOM[name] = (category, fn)


def compute(df: DataFrame, profile: str = "core", custom: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """(candles with all columns, category of each new one)."""
    steps = [(b, patterns if b == "candlestick" else BLOCKS[b]) for b in PROFILES[profile]]
    steps += list(CUSTOM.values()) + [("custom", f) for f in (custom or {}).values()]
    out, categories = df, {}
    for category, fn in steps:
        after = fn(out)
        after, named = after if isinstance(after, tuple) and len(after) == 2 else (after, {})
        if not isinstance(after, DataFrame) or not isinstance(named, dict):
            raise TypeError("an indicator must return a DataFrame, or one and the categories of its columns")
        categories |= {c: named.get(c, category) for c in after.columns if c not in out.columns}
        out = after
    return out, categories

"""Candlestick patterns: each a condition over a candle and the few before it, given as 0 or 1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import W

# The 38 patterns and their bounds, as conditions in SQL over o, h, l, c and what is made of them; a number is how many candles ago.
PATTERNS = {
    "DOJI": "br < 0.1",
    "HAMMER": "ls > 2 * b AND us < 0.3 * b AND br < 0.3",
    "INVERTED_HAMMER": "us > 2 * b AND ls < 0.3 * b AND br < 0.3",
    "SHOOTING_STAR": "us > 2 * b AND ls < 0.3 * b AND c < o",
    "MARUBOZU_BULL": "c > o AND br > 0.9 AND us < 0.05 * b AND ls < 0.05 * b",
    "MARUBOZU_BEAR": "o > c AND br > 0.9 AND us < 0.05 * b AND ls < 0.05 * b",
    "SPINNING_TOP": "br < 0.3 AND us > b AND ls > b",
    "DRAGONFLY_DOJI": "br < 0.1 AND us / r < 0.1 AND ls / r > 0.6",
    "GRAVESTONE_DOJI": "br < 0.1 AND ls / r < 0.1 AND us / r > 0.6",
    "BULLISH_ENGULFING": "o1 > c1 AND c > o AND c > o1 AND o < c1",
    "BEARISH_ENGULFING": "c1 > o1 AND o > c AND o > c1 AND c < o1",
    "BULLISH_HARAMI": "o1 > c1 AND c > o AND o >= c1 AND c <= o1 AND b <= 0.6 * b1",
    "BEARISH_HARAMI": "c1 > o1 AND o > c AND o <= c1 AND c >= o1 AND b <= 0.6 * b1",
    "HARAMI_CROSS_BULL": "o1 > c1 AND c > o AND o >= c1 AND c <= o1 AND b <= 0.6 * b1 AND br < 0.1",
    "HARAMI_CROSS_BEAR": "c1 > o1 AND o > c AND o <= c1 AND c >= o1 AND b <= 0.6 * b1 AND br < 0.1",
    "MORNING_STAR": "o2 > c2 AND br1 < 0.3 AND c > o AND c > (o2 + c2) / 2",
    "EVENING_STAR": "c2 > o2 AND br1 < 0.3 AND o > c AND c < (o2 + c2) / 2",
    "PIERCING": "o1 > c1 AND c > o AND o < c1 AND c > (o1 + c1) / 2 AND c < o1",
    "DARK_CLOUD": "c1 > o1 AND o > c AND o > c1 AND c < (o1 + c1) / 2 AND c > o1",
    "THREE_WHITE_SOLDIERS": "c > o AND c1 > o1 AND c2 > o2 AND c > c1 AND c1 > c2 AND o BETWEEN o1 AND c1 AND o1 BETWEEN o2 AND c2",
    "THREE_BLACK_CROWS": "o > c AND o1 > c1 AND o2 > c2 AND c < c1 AND c1 < c2 AND o BETWEEN c1 AND o1 AND o1 BETWEEN c2 AND o2",
    "THREE_INSIDE_UP": "o2 > c2 AND c1 > o1 AND c > o AND o1 >= c2 AND c1 <= o2 AND c > c1",
    "THREE_INSIDE_DOWN": "c2 > o2 AND o1 > c1 AND o > c AND o1 <= c2 AND c1 >= o2 AND c < c1",
    "TWEEZER_TOP": "c1 > o1 AND o > c AND abs(h - h1) <= 0.1 * least(r, r1)",
    "TWEEZER_BOTTOM": "o1 > c1 AND c > o AND abs(l - l1) <= 0.1 * least(r, r1)",
    "RISING_WINDOW": "l > h1",
    "FALLING_WINDOW": "h < l1",
    "TASUKI_GAP_BULL": "l1 > h2 AND c2 > o2 AND c1 > o1 AND o > c AND o BETWEEN o1 AND c1 AND c > o2 AND c < o1",
    "TASUKI_GAP_BEAR": "h1 < l2 AND o2 > c2 AND o1 > c1 AND c > o AND o BETWEEN c1 AND o1 AND c < c2 AND c > c1",
    "MAT_HOLD_BULL": "c4 > o4 AND br4 > 0.6 AND c3 > o3 AND l2 > h3 AND br2 < 0.3 AND br1 < 0.3 AND l2 > o4 AND l1 > o4 AND h2 < c3 AND h1 < c3 AND c > o AND c > h1",
    "MAT_HOLD_BEAR": "o4 > c4 AND br4 > 0.6 AND o3 > c3 AND h2 < l3 AND br2 < 0.3 AND br1 < 0.3 AND l2 > o4 AND l1 > o4 AND h2 < c3 AND h1 < c3 AND o > c AND c < l1",
    "ADVANCE_BLOCK": "c > o AND c1 > o1 AND c2 > o2 AND b < b1 AND b1 < b2 AND us > b AND us1 > b1 AND us2 > b2",
    "STALLED_PATTERN": "c > o AND c1 > o1 AND c2 > o2 AND br2 > 0.6 AND br1 > 0.6 AND br < 0.4 AND us > b",
    "BELT_HOLD_BULL": "c > o AND (o - l) / r < 0.05 AND us / r < 0.3",
    "BELT_HOLD_BEAR": "o > c AND (h - o) / r < 0.05 AND ls / r < 0.3",
    "KICKER_BULL": "o1 > c1 AND c > o AND o >= h1 AND br > 0.5",
    "KICKER_BEAR": "c1 > o1 AND o > c AND o <= l1 AND br > 0.5",
    "HANGING_MAN": "ls > 2 * b AND us < b AND br < 0.4 AND c1 > o1",
}
_SHAPE = {"b": "abs(c - o)", "us": "h - greatest(c, o)", "ls": "least(c, o) - l", "r": "CASE WHEN h = l THEN 1e-4 ELSE h - l END"}
_LAGGED = ("o", "h", "l", "c", "b", "us", "r", "br")


def patterns(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Adds a 0/1 column for each pattern; a candle with too little history has 0."""
    out = df.withColumns({"o": F.col("open"), "h": F.col("high"), "l": F.col("low"), "c": F.col("close")})
    out = out.withColumns({k: F.expr(v) for k, v in _SHAPE.items()}).withColumn("br", F.expr("b / r"))
    lags = {f"{x}{n}": F.lag(x, n).over(W()) for x in _LAGGED for n in (1, 2, 3, 4)}
    out = out.withColumns(lags)
    chosen = {n: F.when(F.expr(PATTERNS[n]), 1).otherwise(0) for n in names or PATTERNS}
    return out.select(*df.columns, *[c.alias(n) for n, c in chosen.items()])

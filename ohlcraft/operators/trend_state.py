"""The trend classification bar by bar: all that a symbol carries from one bar to the next."""

from __future__ import annotations

import numpy as np

from .atc import Config, _filters, lengths


class TrendState:
    """What :func:`atc.classify_series` knows after each bar, of bounded size, so that a new bar costs the same however long the history.

    Kept are as many closes as the longest filter needs, the recursive averages (two exponential ones and the adaptive one),
    the last averages and signals, and the equities of all 54 and of the six layers.
    """

    def __init__(self, cfg: Config | None = None):
        self.cfg = cfg or Config()
        self.ls = np.array(lengths(self.cfg.length, self.cfg.robustness))
        self.filters = _filters(tuple(self.ls.tolist()))
        self.room = max(max(map(len, self.filters)), int(self.ls.max()) + 1)
        self.bars = 0
        self.closes = np.empty(0)
        self.upto = 0.0
        k = len(self.ls)
        self.ema, self.second, self.kama, self.held = np.full(k, np.nan), np.full(k, np.nan), np.full(k, np.nan), np.zeros(k)
        self.averages, self.signals, self.equity = np.full(6 * k, np.nan), np.zeros(6 * k), np.ones(6 * k)
        self.weights, self.votes = np.ones(6), np.zeros(6)

    _ARRAYS = ("ema", "second", "kama", "held", "averages", "signals", "equity", "weights", "votes")

    def pack(self) -> list[float]:
        """The state as numbers; :meth:`unpack` takes them back."""
        return [float(self.bars), self.upto, *np.concatenate([getattr(self, a) for a in self._ARRAYS] + [self.closes]).tolist()]

    @classmethod
    def unpack(cls, numbers: list[float], cfg: Config | None = None) -> TrendState:
        out = cls(cfg)
        out.bars, out.upto, rest = int(numbers[0]), numbers[1], np.array(numbers[2:])
        for a in cls._ARRAYS:
            n = len(getattr(out, a))
            setattr(out, a, rest[:n])
            rest = rest[n:]
        out.closes = rest
        return out

    def update(self, close: float) -> tuple[np.ndarray, float]:
        """(layer-1 signals by kind, final signal) after one more bar."""
        cfg, ls, i, k = self.cfg, self.ls, self.bars, len(self.ls)
        before = self.closes[-1] if i else np.nan
        window = self.closes = np.append(self.closes, close)[-self.room :]
        ma = np.full((6, k), np.nan)
        for n, f in enumerate(self.filters):
            if len(window) >= len(f):
                ma[(1, 2, 4)[n // k], n % k] = np.convolve(window[-len(f) :], f[::-1], "valid")[0]
        alpha, first = 2 / (ls + 1), ls - 1
        self.upto += close
        self.ema = np.where(i > first, self.ema + alpha * (close - self.ema), np.where(i == first, self.upto / ls, np.nan))
        since = i - first
        self.held = np.where((since >= 0) & (since < ls), self.held + self.ema, self.held)
        self.second = np.where(since > first, self.second + alpha * (self.ema - self.second), np.where(since == first, self.held / ls, np.nan))
        if i == 0:
            self.kama = np.full(k, close)
        moves = np.abs(np.diff(window))
        for j, m in enumerate(ls.tolist()):
            if i >= m:
                path = np.convolve(moves[-m:], np.ones(m), "valid")[0]
                ratio = abs(close - window[-m - 1]) / path if path > 0 else 0.0
                self.kama[j] += (ratio * (0.666 - 0.064) + 0.064) ** 2 * (close - self.kama[j])
        ma[0], ma[3], ma[5] = self.ema, 2 * self.ema - self.second, self.kama
        ma = ma.ravel()
        with np.errstate(invalid="ignore"):
            event = ((close > ma) & (before <= self.averages)) * 1.0 - ((close < ma) & (before >= self.averages))
        change = close / before - 1 if i and before != 0 else 0.0
        growth = np.nan_to_num(change) * (1.0 if i < cfg.cutout else np.exp(cfg.lam / 1000 * (max(i, 1) - cfg.cutout)))
        keep = 1 - cfg.decay / 100
        if i > cfg.cutout:
            self.equity = np.maximum(0.25, self.equity * keep * (1 + self.signals * growth))
            self.weights = np.maximum(0.25, self.weights * keep * (1 + self.votes * growth))
        self.signals = np.where(event != 0, event, self.signals)
        self.averages = ma
        self.bars += 1
        if i < cfg.cutout:
            return np.full(6, np.nan), 0.0
        by = self.equity.reshape(6, k)
        layers = np.rint((self.signals.reshape(6, k) * by).sum(1) / by.sum(1) * 100) / 100
        self.votes = np.sign(layers)
        final = (((layers > cfg.long_threshold) * 1.0 - (layers < cfg.short_threshold)) * self.weights).sum() / self.weights.sum()
        return layers, float(np.nan_to_num(final))

"""Candles from a provider of the user's, as a Spark data source: spark.read.format("candles").

A provider is a function (symbol, timeframe in minutes, start and end in epoch minutes) -> rows (epoch minute, open, high, low, close,
volume), named "module:function" so that executors can import it. Each symbol is a partition, fetched by an executor; a lost
one is fetched again. Networks are the provider's affair.
"""

from __future__ import annotations

import datetime as dt
import importlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_SCHEMA = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"
_EPOCH = dt.datetime(1970, 1, 1)


class SymbolPartition(InputPartition):
    def __init__(self, symbol: str):
        super().__init__(symbol)
        self.symbol = symbol


class CandleReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.symbols = [s for s in options.get("symbols", "").split(",") if s]
        self.provider = options["provider"]
        self.minutes = int(options.get("minutes", "60"))
        self.start, self.end = int(options.get("start", "0")), int(options["end"])

    def partitions(self) -> list[InputPartition]:
        return [SymbolPartition(s) for s in self.symbols]

    def read(self, partition: SymbolPartition) -> Iterator[tuple]:
        module, name = self.provider.split(":")
        for minute, *prices in getattr(importlib.import_module(module), name)(partition.symbol, self.minutes, self.start, self.end):
            yield (partition.symbol, _EPOCH + dt.timedelta(minutes=minute), *map(float, prices))


class CandleSource(DataSource):
    """Options: provider, symbols (with commas), minutes, start and end (epoch minutes; end isn't fetched)."""

    @classmethod
    def name(cls) -> str:
        return "candles"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return CandleReader(self.options)


def fetch(spark: SparkSession, provider: str, symbols: list[str], minutes: int, start: int, end: int):
    spark.dataSource.register(CandleSource)
    return spark.read.format("candles").option("provider", provider).option("symbols", ",".join(symbols)).option("minutes", str(minutes)).option("start", str(start)).option("end", str(end)).load()


def rehearsal(symbol: str, minutes: int, start: int, end: int) -> Iterator[tuple]:
    """A provider without a network, for tests and trials: prices follow from the time and the symbol's length."""
    for at in range(start, end, minutes):
        base = 100.0 + (at // minutes * 7 + len(symbol) * 13) % 50
        yield at, base, base + 3.0, base - 2.0, base + (at // minutes) % 4 - 1.5, 10.0 + (at // minutes) % 5

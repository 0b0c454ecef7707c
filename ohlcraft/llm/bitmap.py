"""Bitmaps of hashes: a first look of bounded size before a join that would shuffle whole texts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: Bits for each expected hash, and at most: 16 MB, whatever the table's size.
BITS_EACH, MOST = 32, 1 << 27
_BUCKET = 1 << 15


def bitmap_of(hashes: DataFrame, expected: int, each: int | None = None) -> np.ndarray:
    """A bitmap (a byte array, a power of two of bits) that has the bits of all ``h`` of the table set; MOST / 8 bytes at most."""
    bits = _BUCKET
    while bits < min(MOST, (each or BITS_EACH) * expected):
        bits *= 2
    at = F.col("h").bitwiseAND(F.lit(bits - 1))
    # built on the executors in pieces of 4 KB, of which there are MOST / 2 ** 15 at most
    pieces = hashes.where("h IS NOT NULL").groupBy(F.shiftright(at, 15).cast("int").alias("bucket")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(_BUCKET - 1))).alias("piece"))
    out = np.zeros(bits // 8, np.uint8)
    for r in pieces.collect():
        out[r["bucket"] * (_BUCKET // 8) : (r["bucket"] + 1) * (_BUCKET // 8)] = np.frombuffer(bytes(r["piece"]), np.uint8)
    return out


def probe(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the bits of the hashes are set: true for all that were put in, and for few others."""
    at = h & np.int64(len(bitmap) * 8 - 1)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def without_rows(docs: DataFrame, key: Sequence[Column], drop: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``key`` isn't in ``drop``, a written table of as many columns; keys with nulls are in no table.

    Rows whose key misses the bitmap stay where they are; only the few others are joined, so that what is
    shuffled follows the rows that go, not all the texts.
    """
    names = [fresh(docs, f"__key{i}") for i in range(len(key))]
    drop = drop.toDF(*names)
    hashed = F.xxhash64(F.lit(3), *names)
    bits = docs.sparkSession.sparkContext.broadcast(bitmap_of(drop.select(hashed.alias("h")), drop.count()))

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        return pd.Series(probe(bits.value, h.to_numpy()))

    keyed = docs.withColumns(dict(zip(names, key, strict=True)))
    flag = fresh(docs, "__maybe")
    marked = keyed.withColumn(flag, maybe(hashed))
    stay = marked.where(~F.col(flag))
    gone = marked.where(F.col(flag)).join(drop.hint("merge"), names, "left_anti")  # sort-merge at every size
    return stay.unionByName(gone).select(*[F.col(f"`{c}`") for c in docs.columns])

"""Benchmark decontamination: rare n-gram seeds join passages to test items, then Smith-Waterman alignment.

1. Every test item is a table of its word trigrams, as hashes. A first pass over the corpus counts in how many documents
   each of them occurs. In each run of ``WINDOW`` successive trigrams of an item the rarest is a seed, so that
   every copied stretch of WINDOW + 2 words holds one, however often the passage was copied, while
   phrases that are common by chance are seeds only where an item has nothing rarer.
2. A second pass cuts the passages around seeds out of the documents, as word hashes. The seeds' places in passages are joined to
   the seeds of items in the JVM, by hash or by sort and merge, as their written sizes ask for.
3. Each passage on a near diagonal with an item is aligned with it locally, which forgives
   changed, missing and added words. A document whose alignment scores enough of the item is contaminated.

Nothing of the benchmark's size goes to the driver or into a task: both passes drop trigrams of no item by a bitmap of at most 16 MB
(:mod:`bitmap`), and the joins do the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bitmap import bitmap_of, probe, without_rows
from .common import forget_words, materialize, text_of

N = 3
WINDOW = 4
#: Local alignment: +1 a matching word, -1 a changed, missing or added one. The score asked for, as a share of the item's words.
MIN_SHARE = 0.5
_SIGNS = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
_CELLS = 4 << 20
#: Bytes of text hashed at once; words over _LONG bytes are hashed alone; the odd base of word hashes.
_SPAN, _LONG, _BASE = 1 << 16, 4096, 0x9E3779B97F4A7C15 | 1
#: Bits for each trigram of the items in the bitmaps (16 MB at most): a document has hundreds that may pass by chance, and each worker keeps the bitmaps.
_BITS = 1 << 12
_MIX = tuple(np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def words_of(text: str) -> list[bytes]:
    """Lower-case words; ASCII punctuation counts as space."""
    return text.lower().encode("utf-8", "replace").translate(_SIGNS).split()


def _powers(base: int) -> np.ndarray:
    out = np.full(_SPAN + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_POWERS, _INVERSE = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def word_hashes(text: str) -> np.ndarray:
    """A hash for each of :func:`words_of`, without cutting them out.

    A word's bytes are a number to an odd base, modulo 2^64, from differences of running sums; words over _LONG bytes are hashed one by one.
    """
    raw = text.lower().encode("utf-8", "replace").translate(_SIGNS)
    data = np.frombuffer(raw, np.uint8)
    inside = np.concatenate([[False], data != 32, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        base = starts[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, base + _SPAN, "right")))
        part = data[base : min(base + _SPAN, ends[hi - 1])].astype(np.uint64) * _POWERS[: min(_SPAN, ends[hi - 1] - base)]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part)])
        a, b = starts[lo:hi] - base, np.minimum(ends[lo:hi] - base, len(part))
        out[lo:hi] = (sums[b] - sums[a]) * _INVERSE[a]
        lo = hi
    for i in np.flatnonzero(ends - starts > _LONG).tolist():
        out[i] = xxhash.xxh64_intdigest(raw[starts[i] : ends[i]])
    out = (out ^ (out >> np.uint64(32))) * _MIX[0]
    return ((out ^ (out >> np.uint64(29))) >> np.uint64(2)).astype(np.int64)


def grams(x: np.ndarray, n: int = N) -> np.ndarray:
    """A hash for each run of ``n`` words."""
    if len(x) < n:
        return np.empty(0, np.int64)
    u = x.view(np.uint64)
    out = np.full(len(x) - n + 1, n, np.uint64)
    for i in range(n):
        out = (out ^ u[i : len(u) - n + 1 + i]) * _MIX[i]
        out ^= out >> np.uint64(29)
    return out.view(np.int64) & np.int64((1 << 62) - 1)


def _item_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) -> (key, words, n, gram, at): an item's words and the hashes of its trigrams (of all its words, if fewer)."""
    for b in batches:
        for lo in range(0, b.num_rows, 256):
            key, words, gram, at = [], [], [], []
            for k, text in zip(b.column(0).slice(lo, 256).to_pylist(), b.column(1).slice(lo, 256).to_pylist(), strict=True):
                x = word_hashes(text)
                if len(x):
                    g = grams(x, min(N, len(x)))
                    key.append(k)
                    words.append(x)
                    gram.append(g)
                    at.append(np.arange(len(g), dtype=np.int32))
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(words, kind), pa.array(gram, kind)], ["key", "words", "grams"])


def _count(bits: np.ndarray, sizes: list[int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> (gram, n): in how many of the texts the grams that pass the bitmap occur, added up in parts."""
    forget_words()
    seen, room = [], 0

    def done():
        gram, n = np.unique(np.concatenate(seen), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n.astype(np.int64))], ["gram", "n"])

    for b in batches:
        for text in b.column(0).to_pylist():
            x = word_hashes(text)
            for n in sizes:
                g = grams(x, n)
                seen.append(np.unique(g[probe(bits, g)]))
                room += len(seen[-1])
            if room > 1 << 20:
                yield done()
                seen, room = [], 0
    if seen:
        yield done()


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman of each item with its window: (best score, end of it in the window).

    All pairs go row by row together; the running maximum of score plus column resolves gaps along
    a row at once.
    """
    m, w = max(map(len, items)), max(map(len, windows))
    a, b = np.full((len(items), m), -1), np.full((len(items), w), -2)
    for i, (x, y) in enumerate(zip(items, windows, strict=True)):
        a[i, : len(x)], b[i, : len(y)] = x, y
    column = np.arange(w + 1, dtype=np.int32)
    h = np.zeros((len(items), w + 1), np.int32)
    best, end = np.zeros(len(items), np.int32), np.zeros(len(items), np.int64)
    for i in range(m):
        s = np.where(a[:, i : i + 1] == b, 1, -1).astype(np.int32)
        t = np.maximum(h - 1, 0)
        t[:, 1:] = np.maximum(t[:, 1:], h[:, :-1] + s)
        h = np.maximum.accumulate(t + column, axis=1) - column
        top = h.max(axis=1)
        better = top > best
        end = np.where(better, h.argmax(axis=1), end)
        best = np.maximum(best, top)
    return best, end


_PASSAGES = "row long, id {kind}, h1 long, h2 long, start int, words array<long>, grams array<long>, ats array<int>"


def _passages(bits: np.ndarray, sizes: list[int], reach: int, kind: pa.DataType, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, id, h1, h2, text) -> the stretches of words within ``reach`` of a seed, with the seeds and where they stand in the text."""
    forget_words()
    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
    for b in batches:
        for lo in range(0, b.num_rows, 1000):
            part = b.slice(lo, 1000)
            of, start, words, gram, ats = [], [], [], [], []
            for i, text in enumerate(part.column(4).to_pylist()):
                x = word_hashes(text)
                found, place = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                for n in sizes:
                    g = grams(x, n)
                    at = np.flatnonzero(probe(bits, g))
                    found.append(g[at])
                    place.append(at)
                place, found = np.concatenate(place), np.concatenate(found)
                if not len(place):
                    continue
                order = np.argsort(place, kind="stable")
                place, found = place[order], found[order]
                cut = [0, *(np.flatnonzero(np.diff(place) > 2 * reach) + 1).tolist(), len(place)]
                for p, q in zip(cut, cut[1:], strict=False):
                    first = max(0, int(place[p]) - reach)
                    of.append(i)
                    start.append(first)
                    words.append(x[first : int(place[q - 1]) + reach])
                    gram.append(found[p:q])
                    ats.append(place[p:q].astype(np.int32))
            take = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(part.column(k).take(take) for k in range(4)), pa.array(start, pa.int32()), pa.array(words, longs), pa.array(gram, longs), pa.array(ats, ints)],
                ["row", "id", "h1", "h2", "start", "words", "grams", "ats"],
            )


def _align_all(min_share: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, id, h1, h2, key, lo, passage, item) -> those whose alignment scores enough, with (score, first, last)."""
    for b in batches:
        item, passage = ([np.asarray(x.values.to_numpy(zero_copy_only=False)) for x in b.column(k)] for k in (7, 6))
        lo = b.column(5).to_pylist()
        order = sorted(range(b.num_rows), key=lambda i: (len(item[i]), len(passage[i])))
        hit, score, first, last, at = [], [], [], [], 0
        while at < len(order):
            to, cells = at, 0
            while to < len(order) and (to == at or cells < _CELLS):
                cells = (to + 1 - at) * (len(passage[order[to]]) + 1)
                to += 1
            part = order[at:to]
            for i, s, e in zip(part, *(x.tolist() for x in align([item[i] for i in part], [passage[i] for i in part])), strict=True):
                n = len(item[i])
                if s >= min_share * n and s >= min(n, N):
                    hit.append(i)
                    score.append(s)
                    last.append(lo[i] + e - 1)
                    first.append(max(0, lo[i] + e - n))
            at = to
        take = pa.array(hit, pa.int64())
        yield pa.RecordBatch.from_arrays([*(b.column(k).take(take) for k in range(5)), pa.array(score, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64())], ["row", "id", "h1", "h2", "key", "score", "first_word", "last_word"])


def _alignments(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, min_share: float) -> DataFrame:
    """(row, id, h1, h2, item_id, n, score, first_word, last_word): the best alignment of each row with each item it holds."""
    kind = docs.select(F.col(id_col).alias("id")).schema[0].dataType
    arrow = pa.string() if kind.simpleString() == "string" else pa.int64() if kind.simpleString() == "bigint" else pa.int32()
    items = benchmark.select(F.col(item_col).alias("item_id"), text_of(item_text).alias("text")).where("item_id IS NOT NULL").distinct()
    items, _ = materialize(items.withColumn("key", F.monotonically_increasing_id()), "leak-items")
    cut, _ = materialize(items.select("key", "text").mapInArrow(_item_grams, "key long, words array<long>, grams array<long>"), "leak-words")
    one = cut.select("key", F.posexplode("grams").alias("at", "gram"))
    facts = cut.agg(F.coalesce(F.sum(F.size("grams")), F.lit(0)), F.coalesce(F.max(F.size("words")), F.lit(0)), F.sort_array(F.collect_set(F.least(F.lit(N), F.size("words"))))).first()
    total, longest, sizes = facts
    bits = bitmap_of(one.select(F.col("gram").alias("h")), total, _BITS)
    counted = docs.select(text_of(text_col).alias("t")).mapInArrow(partial(_count, bits, sizes), "gram long, n long")
    counts = counted.groupBy("gram").agg(F.sum("n").alias("n"))
    # the rarest of each window of successive trigrams, the first of equally rare ones
    rated, _ = materialize(one.join(counts, "gram", "left").select("key", "at", "gram", F.coalesce("n", F.lit(0)).alias("n")), "leak-counts")
    window = Window.partitionBy("key").orderBy("at").rowsBetween(0, WINDOW - 1)
    least = rated.select("key", "at", F.min(F.struct("n", "at", "gram")).over(window).alias("s"), F.max("at").over(Window.partitionBy("key")).alias("end"))
    seeds = least.where((F.col("at") <= F.col("end") - (WINDOW - 1)) | (F.col("at") == 0)).select("key", F.col("s.at").alias("seed_at"), F.col("s.gram").alias("gram"))
    seeds = seeds.distinct().join(cut.select("key", F.size("words").alias("n")), "key")
    seeds, _ = materialize(seeds, "leak-seeds")
    bits = bitmap_of(seeds.select(F.col("gram").alias("h")), total, _BITS)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.lit(1), text_of(text_col)).alias("h1"), F.xxhash64(F.lit(2), text_of(text_col)).alias("h2"), text_of(text_col).alias("text"))
    found = rows.mapInArrow(partial(_passages, bits, sizes, 2 * longest + 8, arrow), _PASSAGES.format(kind=kind.simpleString()))
    found, _ = materialize(found, "leak-passages")
    places = found.select("row", "start", F.explode(F.arrays_zip("grams", "ats")).alias("g")).select("row", "start", F.col("g.grams").alias("gram"), F.col("g.ats").alias("at"))
    # one alignment for hits on near diagonals
    slack, diagonal = F.expr("n div 3 + 2"), F.expr("floor((at - seed_at) / (n div 3 + 2))").cast("int")
    near = places.join(seeds, "gram").select("row", "start", "key", (diagonal * slack - slack).cast("int").alias("lo"), ((diagonal + 1) * slack + F.col("n") + slack).cast("int").alias("hi")).distinct()
    joined = near.join(found.select("row", "start", "id", "h1", "h2", "words"), ["row", "start"]).join(cut.select("key", F.col("words").alias("item")), "key")
    low = F.greatest(F.col("lo"), F.col("start"))
    pairs = joined.select("row", "id", "h1", "h2", "key", low.alias("lo"), F.slice("words", low - F.col("start") + 1, F.greatest(F.col("hi") - low, F.lit(0))).alias("passage"), "item")
    scored = pairs.mapInArrow(partial(_align_all, min_share), f"row long, id {kind.simpleString()}, h1 long, h2 long, key long, score long, first_word long, last_word long")
    best = scored.groupBy("row", "key").agg(F.min(F.struct((-F.col("score")).alias("less"), "first_word", "last_word", "id", "h1", "h2")).alias("b"))
    lengths = cut.select("key", F.size("words").alias("n")).join(items.select("key", "item_id"), "key")
    return best.join(lengths, "key").select("row", "b.id", "b.h1", "b.h2", "item_id", "n", (-F.col("b.less")).alias("score"), "b.first_word", "b.last_word")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_share: float = MIN_SHARE) -> DataFrame:
    """(id_col, item_col, score, share, first_word, last_word): every contaminated document with every item it holds.

    share is the alignment's score over the item's words; the words of a document count from 0; of equal alignments the first one is
    given. Items of one or two words match whole words alone; items without words match nothing. Null
    texts count as empty; null and repeated document ids are returned as they come; null item ids
    are left out, repeated items count once; other columns aren't looked at; empty tables give an empty result.
    """
    a = _alignments(docs, benchmark, id_col, text_col, item_col, item_text, min_share)
    return a.select(F.col("id").alias(id_col), F.col("item_id").alias(item_col), "score", (F.col("score") / F.col("n")).alias("share"), "first_word", "last_word")


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their columns. Rows with a text that does go, whatever their ids."""
    found = _alignments(docs.select(F.lit(0).cast("long").alias("id"), text_col), benchmark, "id", text_col, "item_id", "text", MIN_SHARE)
    leaking, _ = materialize(found.select("h1", "h2").distinct(), "leak-texts")
    return without_rows(docs, [F.xxhash64(F.lit(1), text_of(text_col)), F.xxhash64(F.lit(2), text_of(text_col))], leaking)

"""SimHash near-duplicates, found by pigeonring filtering of the fingerprints.

Fingerprint: words are runs of non-space bytes of the text with A-Z lowered; each window of four
words is hashed (XXH64, seed 42); a bit is set if more than half of the hashes have it.

Pigeonring: the 64 bits form a ring of ``BITS``-wide segments. If two fingerprints differ in at
most T bits, then some segment starts a chain in which the differences of the first l segments add
up to at most l * T / m, for every l up to m. With T = 4 and m = 5 the budgets are 0, 1, 2, 3, 4.
Candidates therefore share a key made of one whole segment and its successor with one bit blanked;
later links of the chain are checked next, and only what passes gets the full Hamming check.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmap import without_rows
from .common import forget_words, fresh, materialize, text_of
from .components import connected_components, spanning_forest

T = 4
BITS = (13, 13, 13, 13, 12)
#: A key with more rows than this is dealt out as pairs of blocks.
BLOCK = 4096
_STARTS = np.cumsum((0, *BITS))
_SEGMENTS = [((1 << w) - 1) << int(s) for w, s in zip(BITS, _STARTS, strict=False)]
_PIECE = 1 << 20


def _words(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists of about a megabyte; each after the first repeats three words."""
    at, tail = 0, []
    while at < len(data):
        end = at + _PIECE
        if end < len(data):
            cut = next((i for i in range(end, min(len(data), end + 4096)) if data[i] in b" \t\n\v\f\r"), None)
            if cut is None:  # a word of thousands of bytes: its end may be anywhere
                rest = data[end:].split(None, 1)
                cut = len(data) - (len(rest[1]) if len(rest) > 1 else 0) if rest and data[end] not in b" \t\n\v\f\r" else end
            end = cut
        words = tail + data[at:end].lower().split()
        yield words
        at, tail = end, words[-3:]


def fingerprint(data: bytes) -> int:
    """The fingerprint of a UTF-8 text, as an unsigned number; 0 without words."""
    digest, seen, ones, last = partial(xxhash.xxh64_intdigest, seed=42), 0, np.zeros(64, np.int64), []
    for words in _words(data):
        last = words
        if len(words) < 4:
            continue
        h = np.fromiter(map(digest, map(b" ".join, zip(words, words[1:], words[2:], words[3:]))), np.uint64, len(words) - 3)
        seen += len(h)
        for i in range(0, len(h), 1 << 15):
            part = h[i : i + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    if not seen:
        return digest(b" ".join(last)) if last else 0
    return int(np.packbits(ones * 2 > seen, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget_words()
    for b in batches:
        texts = b.column(1).cast(pa.binary())
        out = np.fromiter((fingerprint(x.as_py()) for x in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out.view(np.int64)), b.column(2)], ["id", "fp", "h"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, h) of every row; fp holds the 64 bits as a signed long, h is a hash of the text. Null texts count as empty."""
    return docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"), F.xxhash64(text_of(text_col)).alias("h")).mapInArrow(_fingerprints, "id long, fp long, h long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keyed(classes: DataFrame) -> DataFrame:
    """(ring, key, fp, rep): 64 keys a fingerprint, one for each blanked bit of a successor segment."""
    keys = []
    for i in range(len(BITS)):
        k = (i + 1) % len(BITS)
        for j in range(BITS[k]):
            mask = _signed(_SEGMENTS[i] | _SEGMENTS[k] & ~(1 << (int(_STARTS[k]) + j)))
            keys.append((i, i * 16 + j, mask))
    all_keys = F.array(*[F.struct(F.lit(i).alias("ring"), F.lit(t).alias("tag"), F.lit(m).alias("mask")) for i, t, m in keys])
    return classes.select("fp", "rep", F.explode(all_keys).alias("k")).select("k.ring", F.xxhash64("k.tag", F.col("fp").bitwiseAND(F.col("k.mask"))).alias("key"), "fp", "rep")


def _chain_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning edges (a, b) of the pairs that pass, from rows sorted by (ring, key)."""
    masks = [np.uint64(m) for m in _SEGMENTS]
    m = len(BITS)
    names = ["a", "b"]
    left: list[np.ndarray] | None = None
    kept_a, kept_b = np.empty(0, np.int64), np.empty(0, np.int64)

    def pairs(ring, key, fp, rep):
        nonlocal kept_a, kept_b
        if len(key) < 2:
            return
        at, lag = np.arange(len(key) - 1), 1
        while len(at):
            at = at[at + lag < len(key)]
            at = at[(key[at] == key[at + lag]) & (ring[at] == ring[at + lag])]
            if not len(at):
                break
            x, r = fp[at] ^ fp[at + lag], ring[at]
            ok = np.ones(len(at), bool)
            for i in range(m):  # the chain from this ring position on, then the full check as its last link
                own = r == i
                if own.any():
                    total, y = np.zeros(int(own.sum()), np.int64), x[own]
                    good = np.ones(len(y), bool)
                    for n in range(m):
                        total += np.bitwise_count(y & masks[(i + n) % m])
                        good &= total <= (n + 1) * T // m
                    ok[own] = good
            got = at[ok]
            if len(got):
                kept_a, kept_b = np.concatenate([kept_a, rep[got]]), np.concatenate([kept_b, rep[got + lag]])
                if len(kept_a) > 1 << 18:
                    kept_a, kept_b = spanning_forest(kept_a, kept_b)
            lag += 1

    for b in batches:
        new = [b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy().view(np.uint64), b.column(3).to_numpy()]
        cols = new if left is None else [np.concatenate([x, y]) for x, y in zip(left, new, strict=True)]
        if not len(cols[0]):
            continue
        whole = (cols[1] != cols[1][-1]) | (cols[0] != cols[0][-1])
        cut = int(np.nonzero(whole)[0][-1]) + 1 if whole.any() else 0
        pairs(*[c[:cut] for c in cols])
        left = [c[cut:] for c in cols]
        if len(kept_a) > 1 << 20:  # a forest that has grown large goes on at once
            kept_a, kept_b = spanning_forest(kept_a, kept_b)
            yield pa.RecordBatch.from_arrays([pa.array(kept_a), pa.array(kept_b)], names)
            kept_a, kept_b = np.empty(0, np.int64), np.empty(0, np.int64)
    if left is not None:
        pairs(*left)
    kept_a, kept_b = spanning_forest(kept_a, kept_b)
    yield pa.RecordBatch.from_arrays([pa.array(kept_a), pa.array(kept_b)], names)


def _dealt(classes: DataFrame) -> DataFrame:
    """The keyed rows, with hot keys spread over pairs of blocks.

    A key is at most as frequent as its whole segment, of which there are 5 * 2^13 at most: those
    counts (a table of proven size) tell where fine counts are needed at all.
    """
    segs = F.array(*[F.struct(F.lit(i).alias("ring"), F.col("fp").bitwiseAND(F.lit(_signed(s))).alias("seg")) for i, s in enumerate(_SEGMENTS)])
    dense = classes.select(F.explode(segs).alias("s")).groupBy("s.ring", "s.seg").count().where(F.col("count") > BLOCK).select("ring", "seg")
    dense = [(r["ring"], r["seg"]) for r in dense.collect()]  # at most 5 * 2^13 rows
    keyed = _keyed(classes)
    if not dense:
        return keyed
    spark = classes.sparkSession
    seg_of = F.element_at(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(s))) for s in _SEGMENTS]), F.col("ring") + 1)
    where = F.broadcast(spark.createDataFrame(dense, "ring int, seg long"))
    fine = keyed.withColumn("seg", seg_of).join(where, ["ring", "seg"], "left_semi")
    hot = fine.groupBy("ring", "key").count().where(F.col("count") > BLOCK).select("ring", "key", F.ceil(F.col("count") / BLOCK).cast("int").alias("n"))
    hot, _ = materialize(hot, "simhash-hot")
    j = keyed.join(hot, ["ring", "key"], "left")
    block = F.pmod(F.xxhash64(F.lit(7), "fp"), F.col("n")).cast("int")
    others = F.when(F.col("n").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.coalesce(F.col("n"), F.lit(1)) - 1))
    spread = j.select("ring", "key", "fp", "rep", "n", block.alias("own"), F.explode(others).alias("other"))
    pair = F.when(F.col("n").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
    return spread.select("ring", pair.alias("key"), "fp", "rep")


def near_duplicate_classes(fps: DataFrame) -> DataFrame:
    """(fp, rep, component) of the distinct fingerprints of (id, fp).

    rep is the least id with that fingerprint, component the least id linked to it, directly or
    over others. Rows without an id are left out.
    """
    classes, _ = materialize(fps.where("id is not null").groupBy("fp").agg(F.min("id").alias("rep")), "simhash-classes")
    sorted_ = _dealt(classes).repartition("ring", "key").sortWithinPartitions("ring", "key")
    edges = sorted_.mapInArrow(_chain_links, "a long, b long")
    labels = connected_components(edges)
    return classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("fp", "rep", F.coalesce("component", "rep").alias("component"))


def _with_components(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fp, h, component) of every row."""
    fps, _ = materialize(fingerprints(docs, id_col, text_col), "simhash-fp")
    return fps.join(near_duplicate_classes(fps).select("fp", "component"), "fp", "left").select("id", "fp", "h", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint, component_id) for every row of ``docs``.

    Fingerprints with at most four differing bits are linked; component_id is the least id
    reachable. Null and empty texts have fingerprint zero and link like any other. Rows with a null
    id get a fingerprint and a null component. Repeated rows are returned as often as they come.
    Other columns are not looked at; an empty table gives an empty result.
    """
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return _with_components(docs, id_col, text_col).select(F.col("id").alias(id_col), digits.alias("fingerprint"), F.col("component").alias("component_id"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one document of each near-duplicate group, that of the least id.

    Of rows with the kept id and one fingerprint, one stays; rows with one id but different texts that aren't near
    duplicates both stay, as do rows with a null id. Rows are told apart by id and a hash of the text.
    """
    found, _ = materialize(_with_components(docs, id_col, text_col).where("id IS NOT NULL"), "simhash-found")
    kept = found.where("component = id").groupBy("id", "fp").agg(F.min("h").alias("h"))
    repeated = found.join(kept, ["id", "fp", "h"], "left_semi").groupBy("id", "h").count().where("count > 1").select("id", "h")
    repeated, _ = materialize(repeated, "simhash-repeated")
    dropped, _ = materialize(found.select("id", "fp", "h").distinct().join(kept, ["id", "fp", "h"], "left_anti").select("id", "h").unionByName(repeated).distinct(), "simhash-dropped")
    key = [F.col(id_col).cast("long"), F.xxhash64(text_of(text_col))]
    stay = without_rows(docs, key, dropped)
    if repeated.limit(1).count():
        a, b = fresh(docs, "__id"), fresh(docs, "__text")
        again = docs.withColumns({a: key[0], b: key[1]}).join(repeated.toDF(a, b), [a, b], "left_semi").dropDuplicates([a, b])
        stay = stay.unionByName(again.select(*[F.col(f"`{c}`") for c in docs.columns]))
    return stay

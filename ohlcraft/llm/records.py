"""Token ids as length-delimited binary records, with a separate offset index.

A shard file holds records one after another:
    u64 length | u32 masked CRC-32C of the length | payload | u32 masked CRC-32C of the payload
and the payload is
    u32 flags (1: the id is null, 2: ids have 32 bits) | u32 number of ids | i64 doc id | ids
all little-endian; ids take 16 bits where the vocabulary allows. The index file beside it holds the
u64 offset of each record, so that a reader can fetch records in any order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .crc32c import crc32c, masked
from .encoding import default_tokenizer, encoder

END_ID = 1
_HEAD = "<IIq"
_HEAD_BYTES = struct.calcsize(_HEAD)
_FLUSH = 4 << 20


def frame(payloads: list[bytes]) -> list[bytes]:
    """Each payload as a framed record."""
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    a, b = masked(crc32c(lengths)).astype("<u4"), masked(crc32c(payloads)).astype("<u4")
    return [n + a[i].tobytes() + p + b[i].tobytes() for i, (n, p) in enumerate(zip(lengths, payloads, strict=True))]


def unframe(data: bytes, offsets: list[int]) -> list[bytes]:
    """The payloads of the records at the offsets; a damaged record raises ValueError."""
    lengths, payloads, sums = [], [], []
    for o in offsets:
        n = int.from_bytes(data[o : o + 8], "little")
        lengths.append(data[o : o + 8])
        payloads.append(data[o + 12 : o + 12 + n])
        sums.append((int.from_bytes(data[o + 8 : o + 12], "little"), int.from_bytes(data[o + 12 + n : o + 16 + n], "little"), n))
    if any(len(p) != s[2] for p, s in zip(payloads, sums, strict=True)):
        raise ValueError("a record is cut short")
    want = np.array([s[:2] for s in sums], np.uint32).reshape(-1, 2)
    if (masked(crc32c(lengths)) != want[:, 0]).any() or (masked(crc32c(payloads)) != want[:, 1]).any():
        raise ValueError("a record's checksum doesn't match")
    return payloads


def _writer(folder: str, tokenizer: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        wide = 2 if enc.dtype.itemsize == 4 else 0
        end = np.array([end_id], enc.dtype).tobytes()
        offsets, at, tokens = [], 0, 0

        def chunks():
            nonlocal at, tokens
            held, size = [], 0
            for b in batches:
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                    ids = enc.encode(text.as_py()) + end
                    n = len(ids) // enc.dtype.itemsize
                    held.append(struct.pack(_HEAD, wide | (doc_id is None), n, doc_id or 0) + ids)
                    tokens += n
                    size += len(ids)
                    if size >= _FLUSH:
                        yield from out(held)
                        held, size = [], 0
            if held:
                yield from out(held)

        def out(held):
            nonlocal at
            for r in frame(held):
                offsets.append(at)
                at += len(r)
                yield r

        path = f"{folder}/part-{part:06d}.rec"
        common.write_file(path, chunks())
        if offsets:
            common.write_file(f"{path}.idx", [np.array(offsets, "<u8").tobytes()])
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "n_docs": [len(offsets)], "n_tokens": [tokens], "n_bytes": [at]})

    return write


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) in partitions that follow one another by id, sorted within; null ids come first."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), common.text_of(text_col).alias("text"))
    tie = F.xxhash64("text")
    return rows.repartitionByRange("id", tie).sortWithinPartitions("id", tie)


def write_records(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write every text's ids and ``end_id`` as record shards; returns (part, path, n_docs, n_tokens, n_bytes).

    Shards follow one another in ascending id order, nulls first. Null texts count as empty and
    have the end id alone; repeated rows are written as often as they come. A shard appears whole
    or not at all, and a task that runs again replaces it by the same bytes.
    """
    return in_order(docs, id_col, text_col).mapInArrow(_writer(folder, tokenizer or default_tokenizer(), end_id), "part long, path string, n_docs long, n_tokens long, n_bytes long")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in b.to_pylist():
            index = np.frombuffer(common.read_range(f"{row['path']}.idx", 0, 8 * row["n_docs"]), "<u8").astype(np.int64)
            ends = np.append(index[1:], row["n_bytes"])
            at, start = 0, row["start"]
            while at < len(index):
                to = max(at + 1, int(np.searchsorted(ends, index[at] + _FLUSH, "right")))
                data = common.read_range(row["path"], int(index[at]), int(ends[to - 1] - index[at]))
                ids, starts, counts, sums = [], [], [], []
                for p in unframe(data, (index[at:to] - index[at]).tolist()):
                    flags, n, doc_id = struct.unpack_from(_HEAD, p)
                    seq = np.frombuffer(p, "<u4" if flags & 2 else "<u2", offset=_HEAD_BYTES)
                    if len(seq) != n:
                        raise ValueError("a record's length doesn't match its ids")
                    ids.append(None if flags & 1 else doc_id)
                    starts.append(start)
                    counts.append(n)
                    sums.append(zlib.crc32(seq.astype("<u4").tobytes()))
                    start += n
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])
                at = to


def shard_starts(shards: list) -> list[tuple]:
    """The shards in order, each with the number of tokens before it: one row a file."""
    total, out = 0, []
    for s in sorted(shards, key=lambda s: s["part"]):
        out.append((s["path"], s["n_docs"], s["n_bytes"], total))
        total += s["n_tokens"]
    return out


def token_records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` as records and read the files back: (id_col, start, n_tokens, ids_crc32).

    One row a document row, from the files: start counts the ids of all documents before it. Null
    texts count as empty; a null id is kept and sorts first; other columns aren't looked at; an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    folder = folder or common.work_path(spark, "records")
    manifest, _ = common.materialize(write_records(docs, folder, id_col, text_col, tokenizer, end_id), "records-manifest")
    files = shard_starts(manifest.collect())  # one row a shard file
    jobs = spark.createDataFrame(files, "path string, n_docs long, n_bytes long, start long")
    read = jobs.repartition(max(1, len(files))).mapInArrow(_reader, "id long, start long, n_tokens long, ids_crc32 long")
    return read.withColumnRenamed("id", id_col)

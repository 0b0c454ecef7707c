"""Token counts from flat token files that have no index, by scanning for the separator.

A flat file is nothing but token ids of a fixed width, each document ended by a separator id. Files
are cut into blocks of equal size. Each block is searched by itself, with one vectorised comparison;
what it cannot know is where the document at its head began. A prefix scan over the block summaries
carries that across blocks, however many blocks a document spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .encoding import default_tokenizer, encoder

#: <|endoftext|> of the default vocabulary; no text yields it, as its string is encoded as plain text.
SEPARATOR = 49407
BLOCK_BYTES = 4 << 20
_FLUSH = 4 << 20


def _flat_writer(folder: str, tokenizer: str, separator: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer, True), TaskContext.get().partitionId()
        end, path, ids = np.array([separator], enc.dtype).tobytes(), f"{folder}/part-{part:06d}.bin", []

        def chunks():
            held, size = [], 0
            for b in batches:
                ids.append(b.column(0))
                for text in b.column(1).cast(pa.binary()):
                    held += (enc.encode(text.as_py()), end)
                    size += len(held[-2])
                    if size >= _FLUSH:
                        yield b"".join(held)
                        held, size = [], 0
            yield b"".join(held)

        n_bytes, at = common.write_file(path, chunks()), 0
        for x in ids:
            n = len(x)
            yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array([n_bytes] * n, pa.int64()), pa.array(range(at, at + n), pa.int64()), x], ["path", "n_bytes", "seq", "id"])
            at += n

    return write


def write_flat(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, separator: int = SEPARATOR) -> DataFrame:
    """Write the ids of every text and a separator as flat files, one for each partition of ``docs`` in its order.

    Returns which document is where, without offsets: (path, n_bytes, seq, id), seq counting from 0
    in each file. Null texts count as empty and leave the separator alone.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), common.text_of(text_col).alias("text"))
    return rows.mapInArrow(_flat_writer(folder, tokenizer or default_tokenizer(), separator), "path string, n_bytes long, seq long, id long")


def _scan(width: int, separator: int):
    dtype = np.dtype(f"<u{width}")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                tokens = np.frombuffer(common.read_range(r["path"], r["offset"], r["length"]), dtype)
                ends = np.flatnonzero(tokens == separator) + 1
                first = int(ends[0]) if len(ends) else len(tokens)
                inner = np.diff(ends)
                yield pa.RecordBatch.from_pydict(
                    {"path": [r["path"]], "offset": [r["offset"]], "n": [len(tokens)], "ends": [len(ends)], "first": [first], "tail": [len(tokens) - int(ends[-1]) if len(ends) else len(tokens)], "inner": [inner.tolist()]},
                    schema=pa.schema([("path", pa.string()), ("offset", pa.int64()), ("n", pa.int64()), ("ends", pa.int64()), ("first", pa.int64()), ("tail", pa.int64()), ("inner", pa.list_(pa.int64()))]),
                )

    return scan


def scan_flat(spark: SparkSession, files: DataFrame, width: int = 2, separator: int = SEPARATOR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, seq, start, n_tokens) of every document in flat files given as (path, n_bytes).

    n_tokens counts the separator; start counts the tokens before the document in its file. Tokens
    after a file's last separator are a last document without one. Empty files hold no documents.
    """
    step = max(1, block_bytes // width) * width
    blocks = files.where("n_bytes > 0").select("path", "n_bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bytes") - 1, F.lit(step).cast("long"))).alias("offset"))
    blocks = blocks.select("path", "offset", F.least(F.lit(step), F.col("n_bytes") - F.col("offset")).alias("length"))
    found = blocks.repartition("path", "offset").mapInArrow(_scan(width, separator), "path string, offset long, n long, ends long, first long, tail long, inner array<long>")
    found, _ = common.materialize(found, "scan-blocks")
    # The prefix scan over summaries alone: a file has n_bytes / block_bytes of them.
    before = Window.partitionBy("path").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    tokens = F.coalesce(F.sum("n").over(before), F.lit(0))
    known_end = F.max(F.when(F.col("ends") > 0, F.col("upto") - F.col("tail"))).over(before)
    s = found.select("path", "offset", "n", "ends", "first", "tail", tokens.alias("base"), F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("seq"))
    s = s.withColumn("upto", F.col("base") + F.col("n"))
    s = s.withColumn("open", F.coalesce(known_end, F.lit(0)))
    s = s.withColumn("is_last", F.lead("offset").over(Window.partitionBy("path").orderBy("offset")).isNull())
    s = s.select("path", "offset", "base", "seq", "first", "ends", "open", "upto", "tail", "is_last")
    head = s.where("ends > 0").select("path", "seq", F.col("open").alias("start"), (F.col("base") + F.col("first") - F.col("open")).alias("n_tokens"))
    last_start = F.when(F.col("ends") > 0, F.col("upto") - F.col("tail")).otherwise(F.col("open"))
    rest = s.where(F.col("is_last") & (last_start < F.col("upto"))).select("path", (F.col("seq") + F.col("ends")).alias("seq"), last_start.alias("start"), (F.col("upto") - last_start).alias("n_tokens"))
    inner = found.where("size(inner) > 0").select("path", "offset", "inner").join(s.select("path", "offset", "base", "seq", "first"), ["path", "offset"])
    # starts inside a block: running sums over its own documents, made by the block's task
    inner = inner.select("path", "base", "seq", "first", "inner").mapInArrow(_inner, "path string, seq long, start long, n_tokens long")
    return head.unionByName(inner).unionByName(rest)


def _inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            n = b.column(4)[i].values.to_numpy()
            base, seq, first = (b.column(k)[i].as_py() for k in (1, 2, 3))
            starts = base + first + np.cumsum(n) - n
            yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[i].as_py()] * len(n)), pa.array(seq + 1 + np.arange(len(n))), pa.array(starts), pa.array(n)], ["path", "seq", "start", "n_tokens"])


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, separator: int = SEPARATOR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Write ``docs`` as flat token files, scan them, and return (id_col, start, n_tokens).

    One row a document row, counted from the files alone: n_tokens with the separator, start the
    tokens before the document in the files, one after another. Null ids are kept; null texts count as
    empty; other columns aren't looked at; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or default_tokenizer()
    where, _ = common.materialize(write_flat(docs, common.work_path(spark, "flat"), id_col, text_col, tokenizer, separator), "flat-docs")
    files, _ = common.materialize(where.groupBy("path").agg(F.first("n_bytes").alias("n_bytes")), "flat-files")
    width = encoder(tokenizer, True).dtype.itemsize
    scanned = scan_flat(spark, files, width, separator, block_bytes)
    # one row a file
    base = files.select("path", (F.sum("n_bytes").over(Window.orderBy("path")) - F.col("n_bytes")).alias("b"))
    base = base.select("path", F.floor(F.col("b") / width).alias("tokens"))
    out = scanned.join(where.select("path", "seq", "id"), ["path", "seq"]).join(base, "path")
    return out.select(F.col("id").alias(id_col), (F.col("start") + F.col("tokens")).alias("start"), "n_tokens")

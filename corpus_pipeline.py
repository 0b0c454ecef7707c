"""The corpus pipeline: toxicity, near-duplicates, decontamination, mixing, binary output.

All stages take null texts as empty, null and repeated ids, repeated rows, empty tables, very long texts and further columns of any
name; what each makes of them is said below. All but the last return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ohlcraft.llm import decontam, mixing, records, simhash, toxicity
from ohlcraft.llm.common import materialize, ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity chain, trained on the labelled ones, doesn't reject. Rows are judged one by one; without labels all stay."""
    ship(spark)
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the least id; one of repeated rows. Empty texts are a group; rows without an id stay."""
    ship(spark)
    return simhash.keep_one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a passage of the benchmark. Rows with one text go or stay together; without items all stay."""
    ship(spark)
    return decontam.keep_uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, once for each epoch that takes them. Null labels are the label ''; of rows equal to a cut the first by a hash of all columns are taken."""
    return mixing.mixed_rows(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token records of the documents, as read back from their files, in the order of ids. A row without a text is its end id alone."""
    ship(spark)
    return records.token_records(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("token_records", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, _ = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: Tokenising and the toxicity model are not SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None

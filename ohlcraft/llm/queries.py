"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontam, flat_graph, html_template, licenses, mixing, pii, records, separator_scan, simhash, toxicity
from .common import materialize, ship


def _t(spark, sf_dir, name):
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_text(spark, sf_dir):
    return html_template.extract_text(_t(spark, sf_dir, "pages"))


def op2_toxicity(spark, sf_dir):
    return toxicity.toxicity(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"))


def op3_pii(spark, sf_dir):
    return pii.digest(pii.find_private(_t(spark, sf_dir, "documents")))


def op4_separator_scan(spark, sf_dir):
    return separator_scan.token_counts(_t(spark, sf_dir, "documents"))


def op5_token_records(spark, sf_dir):
    return records.token_records(_t(spark, sf_dir, "documents"))


def op6_flat_graph(spark, sf_dir):
    return flat_graph.near_duplicate_vectors(_t(spark, sf_dir, "embeddings"))


def flat_graph_recall(spark, sf_dir):
    """How op6's links of the stated audit rows compare with brute force over all rows."""
    vectors = _t(spark, sf_dir, "embeddings")
    found, _ = materialize(flat_graph.near_duplicate_vectors(vectors), "graph-found")
    return flat_graph.audit_recall(vectors, found)


def op7_licenses(spark, sf_dir):
    return licenses.scan_documents(_t(spark, sf_dir, "documents"))


def op8_decontamination(spark, sf_dir):
    return decontam.decontaminate(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))


def op9_mixing(spark, sf_dir):
    return mixing.mix_documents(_t(spark, sf_dir, "documents"))


def op10_simhash(spark, sf_dir):
    return simhash.simhash_dedup(_t(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_html_text, op2_toxicity, op3_pii, op4_separator_scan, op5_token_records, op6_flat_graph, flat_graph_recall, op7_licenses, op8_decontamination, op9_mixing, op10_simhash)}
ORACLES: dict[str, str] = {"op6_flat_graph": flat_graph.ORACLE, "op9_mixing": mixing.ORACLE}

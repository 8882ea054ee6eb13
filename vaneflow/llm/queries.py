"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import SCHEMAS
from .alignment import alignment_statistics
from .licenses import scan_licenses
from .manifest import audit_documents
from .mixing import select_mixture
from .oracles import ORACLES
from .packing import pack_documents
from .pii import pii_digest
from .quality import score_quality
from .secrets import secret_digest
from .sketches import near_duplicates
from .spotsigs import fingerprint_documents
from .tokens import token_counts
from .topk import exact_top_k
from .warc import archived_pages

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(table(spark, sf_dir, "documents"))


def op3_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, numerator=85, denominator=100)


def op4_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"), by_line=False)


def op5_certified_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), capacity=1024, end_id=2)


def op6_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op7_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(table(spark, sf_dir, "documents"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_mixture(table(spark, sf_dir, "documents"))


def op10_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), limit=512, store=True)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_documents(table(spark, sf_dir, "documents"))


def op12_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(table(spark, sf_dir, "pages"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_statistics(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_pii_spans, op3_setsketch_dedup, op4_license_join, op5_certified_packing,
        op6_spot_signatures, op7_secret_ledger, op8_exact_top_k, op9_source_mix, op10_prefix_token_counts,
        op11_merkle_manifest, op12_warc_archives, op13_token_alignment,
    )
}

__all__ = ["ORACLES", "QUERIES"]

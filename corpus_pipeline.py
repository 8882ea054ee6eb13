"""A training corpus from `documents`: quality, near duplicates, personal data, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as
the docs of the next.  All but the last return the columns of the documents they were given.

In every stage null and empty texts are texts without words, rows may repeat, keys may be null or repeat, other
columns pass through unread whatever their names, and no rows give no rows; what a stage does beyond that
stands with it."""

from __future__ import annotations

from dataclasses import replace
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaneflow.llm.mixing import MixPlan, select_mixture, text_md5
from vaneflow.llm.packing import pack_documents
from vaneflow.llm.pii import mask_pii
from vaneflow.llm.quality import keep_good
from vaneflow.llm.queries import table
from vaneflow.llm.sketches import near_duplicates
from vaneflow.session import release, stage, staged_paths

#: A document goes into the corpus once at most.
PLAN = replace(MixPlan(), max_epochs=1)


def _identity(docs: DataFrame) -> tuple[DataFrame, str]:
    """`docs` with a number of the row that any evaluation gives alike, and that column's name, which no other has.

    The number is the doc_id where it belongs to one row only.  Rows without one, or that share one, get a hash
    of the whole row beyond all doc_ids, so only rows that agree in every column share a number."""
    name = "_row_" + "_".join(docs.columns)
    hashed = F.lit(1 << 62) + F.pmod(F.xxhash64(*docs.columns), F.lit(1 << 61))
    repeated = docs.filter("doc_id is not null").groupBy(F.col("doc_id").alias(f"{name}_key")).agg(F.count(F.lit(1)).alias(f"{name}_n"))
    repeated = stage(repeated.filter(F.col(f"{name}_n") > 1), "repeated")
    if repeated.isEmpty():
        return docs.withColumn(name, F.coalesce(F.col("doc_id"), hashed)), name
    known = docs.join(repeated, F.col("doc_id") == F.col(f"{name}_key"), "left")
    alone = F.col("doc_id").isNotNull() & F.col(f"{name}_n").isNull()
    return known.select(*docs.columns, F.when(alone, F.col("doc_id")).otherwise(hashed).alias(name)), name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble does not reject; it learns from `labels` outside the held-out fold.

    A null text is judged as an empty one; each row is judged by its own text, whatever its key."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each near-duplicate group (five-word shingles, similarity 0.8 or more).

    Rows that share a doc_id, or have none, are documents of their own and are judged by their own text; they
    stand behind all others in a group.  Rows equal in every column are one document.  Texts without words are
    near nothing and stay."""
    rows, name = _identity(docs)
    kept = near_duplicates(rows, k=5, numerator=80, denominator=100, key=name).filter("kept").select(name)
    return rows.join(kept, name, "left_semi").dropDuplicates([name]).select(docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; texts without any, and null ones, stay as they are."""
    return mask_pii(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the budgets of the domain-language-source tree select.

    A row is known by its doc_id and its text, so rows that share a doc_id, or have none, are chosen one by
    one; rows equal in both stay together.  Documents without tokens are not selected."""
    chosen = select_mixture(docs, PLAN, with_hash=True).select(F.col("doc_id").alias("_key"), "text_md5").distinct()
    same = docs["doc_id"].eqNullSafe(chosen["_key"]) & (text_md5(docs["text"]) == chosen["text_md5"])
    return docs.join(chosen, same, "left_semi")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens; a text without any is its end token."""
    return pack_documents(docs, capacity=1024, end_id=2)


#: Scratch folders of the stage that ran last, by application.
_LAST: dict[str, list[str]] = {}


def _freeing(step, first: bool):
    """`step`, which first deletes what the stage before it had staged: its output has been written by then."""

    @wraps(step)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        if not first:
            release(spark, _LAST.pop(app, []))
        before = set(staged_paths(spark))
        out = step(spark, docs, sf_dir)
        _LAST[app] = [p for p in staged_paths(spark) if p not in before]
        return out

    return call


_STEPS = [("quality", quality), ("near_dedup", near_dedup), ("pii", pii), ("mixture", mixture), ("packing", packing)]
STAGES = [(name, _freeing(step, name == "quality")) for name, step in _STEPS]

#: Learnt rules and token ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""Rows without a key, or with a repeated one, through the mixture, the quality score and the pipeline's stages."""

import math

import duckdb
import pytest
from oracle import compare
from pyspark.sql import functions as F

import corpus_pipeline
from vaneflow.llm import quality
from vaneflow.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def written(frame, folder):
    frame.coalesce(1).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    return con


def test_mixture_of_keyless_and_repeated_rows_equals_sql(spark, tmp_path):
    """Half of all rows have no key; among those and the others some are equal in everything."""
    rows = [(None if i % 2 else i % 700, f"text {i % 1_900} " + "word " * (i % 13), "en" if i % 3 else "de", f"src{i % 4}", 5) for i in range(6_000)]
    rows += [(None, "the same words", "en", "src0", 5)] * 500 + [(3, "the same words", "en", "src0", 5)] * 40 + [(None, None, None, None, None), (None, "", "en", "src1", 0)]
    con = written(spark.createDataFrame(rows, SCHEMA), tmp_path)
    assert compare(QUERIES["op9_source_mix"](spark, str(tmp_path)), con, ORACLES["op9_source_mix"]) == []


def test_scores_equal_the_rules_by_hand(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    statistics = docs.select("doc_id", *[c.alias(n) for n, c in quality.text_statistics(F.col("text")).items()])
    model = quality.learn(statistics, labels, "doc_id", "quality")
    assert model.terms
    got = {r["doc_id"]: r for r in quality.score_quality(docs, labels).collect()}
    for r in got.values():
        logit = model.intercept + sum(w for rule, w in model.terms if all(low < r[name] <= high for name, low, high in rule.bounds))
        assert math.isclose(r["score"], 1 / (1 + math.exp(-logit)), abs_tol=1e-12)


def test_the_sample_is_bounded(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    statistics = docs.select("doc_id", *[c.alias(n) for n, c in quality.text_statistics(F.col("text")).items()])
    assert quality.learn(statistics, labels, "doc_id", "quality", fit_rows=60) == quality.learn(statistics, labels, "doc_id", "quality", fit_rows=60)


WORDS = "one two three four five six seven eight nine ten eleven twelve"


@pytest.mark.parametrize("extra", [{}, {"_row": 1, "_id": 2, "v": 3, "_repeated": 4, "text_md5": 5, "_key": 6}])
def test_stages_judge_every_text(spark, extra):
    other = "an entirely different text of quite a few words that nothing else shares at all"
    rows = [
        (5, WORDS, "en", "src0", 1), (5, other, "en", "src0", 1), (5, other, "en", "src0", 1), (2, WORDS, "en", "src1", 1), (None, WORDS, "en", "src0", 1),
        (None, "alone and without any key, but kept, as no other text is near it", "en", "src0", 1), (None, None, "en", "src0", None), (7, " ", "en", "src0", 1),
    ]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(x) for c, x in extra.items()})
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(2, WORDS), (5, other), (None, rows[5][1]), (None, None), (7, " ")], key=str)
    chosen = corpus_pipeline.mixture(spark, docs, "")
    assert chosen.columns == docs.columns and {r["text"] for r in chosen.collect()} <= {r[1] for r in rows} - {None}


def test_one_keyless_row_does_not_take_the_others_along(spark):
    """An eighth of equal keyless texts is budgeted: about that share of them is chosen, not all."""
    rows = [(None, f"{i} " + "word " * 9, "en", "src0", 1) for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert 250 <= corpus_pipeline.mixture(spark, docs, "").count() <= 330

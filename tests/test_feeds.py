"""Readers on documents in the shape that the feeds write, and on values that cannot be typed."""

import json
import pathlib

import pytest
from pyspark.sql import functions as F

from vaneflow.functions import parsing
from vaneflow.session import scratch_path
from vaneflow.sources import readers, sinks
from vaneflow.streaming.book import route_messages


def one(df):
    return [tuple(r) for r in df.collect()]


def test_indented_market(spark, tmp_path):
    doc = {"slug": "a", "conditionId": "c", "clobTokenIds": '["y", "n"]', "outcomePrices": '["0.25", "0.75"]', "volume": "12.5"}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=2))
    assert one(readers.read_markets(spark, str(tmp_path)).select("slug", "yes_token_id", "no_token_id", "volume_num")) == [("a", "y", "n", 12.5)]


def test_fills_of_one_file_for_each_slug(spark, tmp_path):
    event = {"makerAssetId": "0", "takerAssetId": "y", "makerAmountFilled": "500000", "takerAmountFilled": "1000000", "timestamp": "1700000000", "maker": "m", "taker": "t"}
    (tmp_path / "some-slug.json").write_text(json.dumps({"y": [event, event], "n": []}, indent=2))
    (tmp_path / "broken.json").write_text("{")
    rows = readers.read_fill_documents(spark, str(tmp_path))
    assert one(rows.select("slug", "token", "timestamp")) == [("some-slug", "y", "1700000000")] * 2
    markets = spark.createDataFrame([("some-slug", "c", "y", "n")], "slug string, condition_id string, yes_token_id string, no_token_id string")
    typed = readers.type_fills(rows, markets)
    assert one(typed.select("slug", "price", "shares", F.unix_seconds("timestamp"))) == [("some-slug", 0.5, 1.0, 1700000000)] * 2


@pytest.mark.parametrize("series", ["history_max_h60", "history_1d_min1"])
def test_both_price_series(spark, tmp_path, series):
    doc = {"slug": "a", "closed": False, "fetched_at": "2026-04-20 10:00:00", series: [{"t": 60, "p": 0.5}, {"t": None, "p": 1}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    got = readers.read_price_history(spark, str(tmp_path), series).select(F.unix_seconds("timestamp"), "p_yes", F.col("fetched_at").cast("string"))
    assert one(got) == [(60, 0.5, "2026-04-20 10:00:00")]


def test_values_that_cannot_be_typed(spark, tmp_path):
    (tmp_path / "f.csv").write_text("station,runtime,ftime,tmp\nKATL,2026-01-01 00:00:00,yesterday,1e12\nKATL,2026-01-01 00:00:00,2026-01-01 06:00:00,51\n")
    rows = readers.read_forecast_csv(spark, str(tmp_path), ["station", "runtime", "ftime", "tmp"], ["tmp"])
    assert sorted(one(rows.select("tmp", "lead_hours")), key=str) == sorted([(None, None), (51, 6)], key=str)
    messages = spark.createDataFrame([("x", "not a time")], "asset_id string, _received_at string")
    assert one(route_messages(messages, spark.createDataFrame([("x", "s")], "asset_id string, slug string")).select("received_at", "slug")) == [(None, "s")]


def test_rewritten_parsers(spark):
    reports = [("KATL 011653Z RMK AO2 TSB05E30",), ("KATL RMK TSB0159 TSE13",), ("KATL RMK TSX",)]
    fields = parsing.remark_fields("r")
    got = spark.createDataFrame(reports, "r string").select(fields["tsb_minute"].alias("b"), fields["tse_minute"].alias("e"))
    assert one(got) == [(5, 30), (59, 13), (None, None)]
    slugs = [("high-in-nyc-on-april-1-2026-50-51f",), ("turn-on-the-heat-on-may-31-2025",), ("x-on-june-31-2025",), ("none",)]
    assert [str(r[0]) for r in spark.createDataFrame(slugs, "s string").select(parsing.slug_date("s")).collect()] == ["2026-04-01", "2025-05-31", "None", "None"]
    questions = [("Will the highest temperature in New York be 50-51°F on May 1?",), ("Will the high temperature in D.C. exceed 60?",), ("Rain?",)]
    assert [r[0] for r in spark.createDataFrame(questions, "q string").select(parsing.city_from_question("q")).collect()] == ["New York City", "D.C", ""]


def test_documents_become_one_file_each_in_few_folders(spark):
    """Each row is a file of its name, written again without a trace, and read back with the slug of the file."""
    path = scratch_path(spark, "documents")
    made = json.dumps({"Y1": [{"makerAssetId": "0", "takerAssetId": "Y1", "makerAmountFilled": "5", "takerAmountFilled": "10", "timestamp": "7"}]})
    rows = spark.createDataFrame([(f"{i % 2}/{i % 3}", f"m-{i}", made) for i in range(60)], "folder STRING, slug STRING, value STRING")
    assert sinks.write_documents(rows, path, "folder", "slug", "value") == 60
    assert sinks.write_documents(rows.filter("slug = 'm-7'"), path, "folder", "slug", "value") == 1
    files = [p for p in pathlib.Path(path.removeprefix("file://")).rglob("*") if p.is_file()]
    assert sorted(p.name for p in files) == sorted(f"m-{i}.json" for i in range(60)) and len({p.parent for p in files}) == 6
    assert sorted(r.slug for r in readers.read_fill_documents(spark, path).collect()) == sorted(f"m-{i}" for i in range(60))
    empty = scratch_path(spark, "documents")
    assert sinks.write_documents(rows.filter("false"), empty, "folder", "slug", "value") == 0 and readers.read_fill_documents(spark, empty).count() == 0

"""A stream of the same rows gives what the batch gives; SQL table functions too."""

import math

import pytest

from tidemark.functions.tables import register
from tidemark.operators import Feature, features
from tidemark.sources.series import read, write
from tidemark.streaming.stateful import stream
from tidemark.streaming.windows import bars, sink

ROWS = [(k, i, f"2024-01-01 {i // 60:02d}:{i % 60:02d}:00", math.sin(i * 0.3) * 0.02) for k in ("a", "b") for i in range(120)]


@pytest.fixture
def table(spark, tmp_path):
    df = spark.createDataFrame(ROWS, ["series", "seq", "at", "r"]).selectExpr("series", "seq", "cast(at as timestamp) ts", "r")
    write(df.repartition(3), str(tmp_path / "in"))
    return df


@pytest.mark.parametrize("in_order", [True, False])
def test_stream_equals_batch(spark, tmp_path, table, in_order):
    wanted = [Feature("EwmaVolatility", ["r"], "v"), Feature("EntropicVaR", ["r"], "e", {"window": 16, "update_every": 8})]
    live = read(spark, str(tmp_path / "in"), schema="series string, seq long, ts timestamp, r double", stream=True)
    live = live.withWatermark("ts", "1 minute") if in_order else live
    out = stream(live, ["series"], ["ts", "seq"], wanted, "ts", in_order)
    sink(out, str(tmp_path / "out"), str(tmp_path / "check"), once=True).awaitTermination(120)
    got = {(r.series, r.seq): (r.v, r.e) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.series, r.seq): (r.v, r.e) for r in features(table, ["series"], ["ts", "seq"], wanted).collect()}
    # rows within the watermark's delay of the end still wait
    assert len(got) == 240 if not in_order else len(got) >= 230
    for k, v in got.items():
        assert v == pytest.approx(want[k])


def test_streaming_bars(spark, tmp_path, table):
    live = read(spark, str(tmp_path / "in"), schema="series string, seq long, ts timestamp, r double", stream=True)
    sink(bars(live, "series", "ts", "r"), str(tmp_path / "bars"), str(tmp_path / "c2"), once=True).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "bars"))
    assert got.filter("series = 'a'").count() >= 1 and got.agg({"volume": "max"}).first()[0] == 60


def test_only_kernels_stream(spark, tmp_path, table):
    live = read(spark, str(tmp_path / "in"), schema="series string, seq long, ts timestamp, r double", stream=True)
    with pytest.raises(ValueError):
        stream(live, ["series"], ["ts"], [Feature("RollingVolatility", ["r"], "v", {"period": 3})], "ts")


def test_table_function(spark, table):
    register(spark, "ewma_vol", "EwmaVolatility", "series string, seq long, r double", ["r"])
    table.select("series", "seq", "r").createOrReplaceTempView("t")
    got = {(r.series, r.seq): r.value for r in spark.sql("SELECT * FROM ewma_vol(TABLE(t) PARTITION BY series ORDER BY seq)").collect()}
    want = {(r.series, r.seq): r.v for r in features(table, ["series"], ["seq"], [Feature("EwmaVolatility", ["r"], "v")]).collect()}
    assert got == pytest.approx(want)

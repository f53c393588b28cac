"""Streams against the same rows as a table."""

import json
import os

import pandas as pd
import pytest

from tidemark.sources import exchange
from tidemark.streaming import live


def frame(i, confirm=True, topic="kline.60.AAA", **more):
    return json.dumps({"topic": topic, "ts": i, "data": [{"start": i, "end": i + 1, "open": "1", "high": "2", "low": "0.5", "close": str(i), "volume": "3", "confirm": confirm, "timestamp": i}], **more})


def test_closed_bars(spark):
    lines = [frame(1), frame(2, confirm=False), frame(3, topic="trade.AAA"), json.dumps({"op": "pong"}), "{bad", frame(4, topic="kline.60"), frame(5, topic="kline.5.BBB")]
    got = live.closed_bars(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert sorted((r["symbol"], r["interval"], r["start_ms"], r["close_price"]) for r in got) == [("AAA", "60", 1, 1.0), ("BBB", "5", 5, 5.0)]
    assert live.closed_bars(spark.createDataFrame([(x,) for x in lines], "value string"), ["kline.5.BBB"]).count() == 1


def run(query, out):
    q = query.trigger(availableNow=True).start(out)
    q.awaitTermination(120)
    assert q.exception() is None


@pytest.fixture
def lines(tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        path = tmp_path / "in" / f"{k}.txt"
        path.write_text("\n".join(frame(i) for i in range(1 + k * 5, k * 5 + 7)))  # one bar of each file comes again
        os.utime(path, (1_000_000 + 10 * k, 1_000_000 + 10 * k))  # files are read in order of their time
    return tmp_path


def test_stream_of_frames(spark, lines):
    source = spark.readStream.format("text").option("maxFilesPerTrigger", 1).load(str(lines / "in"))
    bars = live.once_each(live.closed_bars(source))
    run(bars.writeStream.format("parquet").option("checkpointLocation", str(lines / "c1")), str(lines / "o1"))
    assert sorted(r["start_ms"] for r in spark.read.parquet(str(lines / "o1")).collect()) == list(range(1, 17))


def test_running_ema(spark, lines):
    source = spark.readStream.format("text").option("maxFilesPerTrigger", 1).load(str(lines / "in"))
    run(live.running_ema(live.closed_bars(source), 5).writeStream.format("parquet").option("checkpointLocation", str(lines / "c2")), str(lines / "o2"))
    got = spark.read.parquet(str(lines / "o2")).toPandas().sort_values("start_ms").reset_index(drop=True)
    want = pd.Series(range(1, 17), dtype=float).ewm(span=5, adjust=False).mean()
    assert got.start_ms.tolist() == list(range(1, 17)) and got.ema.tolist() == pytest.approx(want.tolist())


def test_tumbling_stream_equals_table(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "e"))
    source = spark.readStream.schema(spark.read.parquet(str(tmp_path / "e")).schema).parquet(str(tmp_path / "e"))
    run(live.tumbling_bars(source).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c3")), str(tmp_path / "o3"))
    streamed = {tuple(r) for r in spark.read.parquet(str(tmp_path / "o3")).collect()}
    table = {tuple(r) for r in live.tumbling_bars(events).collect()}
    assert streamed <= table and len(table) - len(streamed) <= 20  # the last bars stay open behind the watermark


def test_numbers_that_cannot_be_read(spark):
    """One bad price leaves out its bar, or is null in a stored answer; nothing else is lost."""
    bar = {"start": 0, "end": 1, "open": "1", "high": "2", "low": "1", "close": "2", "volume": "x", "confirm": True, "timestamp": 1}
    frames = [{"topic": "kline.60.A", "ts": 5, "data": [bar, {**bar, "start": 2, "close": "bad"}, {**bar, "start": 3}]}]
    got = live.closed_bars(spark.createDataFrame([(json.dumps(f),) for f in frames], "value string")).collect()
    assert [(r["start_ms"], r["volume"]) for r in got] == [(0, 0.0), (3, 0.0)]
    payload = json.dumps([["1", "2", "3", "x", "4", "5", "0", "6"], ["late", "2", "3", "1", "4", "5", "0", "6"]])
    rows = exchange.klines(spark.createDataFrame([("A", payload)], "symbol string, payload string"), "b").collect()
    assert [(r["open_time"], r["low"], r["close"]) for r in rows] == [(1, None, 4.0)]
    rates = json.dumps([{"fundingTime": "8", "fundingRate": "0.1"}, {"fundingTime": "9", "fundingRate": "bad"}])
    assert [tuple(r) for r in exchange.points(spark.createDataFrame([("A", rates)], "symbol string, payload string"), "b", "funding").collect()] == [("A", 8, 0.1)]

"""Batches over triggers and restarts, bars out of order, sinks that fail, streamed kline files, archives."""

import random
import time
import warnings
import zipfile

import pytest

from barflow.functions import features as ft
from barflow.sources import files
from barflow.streaming import streams, timed

from .test_scans import BARS, walk


@pytest.fixture(scope="module")
def timers(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    timed.use_timers(spark)
    yield
    spark.conf.set(key, before) if before else spark.conf.unset(key)


def put(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_batches_outlive_triggers_and_restarts(spark, timers, tmp_path):
    source, schema, got = f"{tmp_path}/in", "k string, v long", []

    def start(timeout_ms):
        stream = spark.readStream.schema(schema).parquet(source)
        batches = timed.timed_batches(stream, ["k"], 4, timeout_ms)
        sink = lambda df, epoch: got.extend(map(tuple, df.collect()))
        return batches.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/progress").trigger(processingTime="200 milliseconds").start()

    def until(n, seconds=60):
        end = time.time() + seconds
        while len(got) < n and time.time() < end:
            time.sleep(0.2)

    put(spark, [("a", i) for i in range(6)] + [("b", 9)], schema, source)
    q = start(3_600_000)
    until(4)
    q.stop()
    assert len(got) == 4 and {(k, b) for k, _, b in got} == {("a", 0)}  # the others wait
    put(spark, [("a", i) for i in range(6, 9)], schema, source)
    q = start(3_600_000)
    until(8)
    q.stop()
    assert len(got) == 8 and sorted(v for _, v, _ in got) == list(range(8)) and {b for _, v, b in got[4:]} == {1}
    put(spark, [("a", 100), ("c", 1)], schema, source)
    q = start(1_500)  # a list that begins to fill now waits so long; older ones have their own timers
    until(9)
    q.stop()
    assert [r for r in got[8:] if r[0] == "c"] == [("c", 1, 0)]
    with pytest.raises(ValueError):
        timed.timed_batches(spark.readStream.schema(schema).parquet(source), ["k"], 0, 5)


def test_bars_out_of_order_get_the_features_of_ordered_ones(spark, timers, tmp_path):
    data = walk(40, 3) + walk(25, 4, "y")
    data = [tuple(1.0 if v is None else v for v in r) for r in data]
    shuffled, rng = [], random.Random(2)
    for r in data:  # up to 5 hours late
        shuffled.append((r[3] + rng.randrange(5 * 3600000), r))
    shuffled = [r for _, r in sorted(shuffled, key=lambda x: x[0])]
    for i in range(0, len(shuffled), 9):
        put(spark, shuffled[i : i + 9], BARS, f"{tmp_path}/in")
        time.sleep(0.01)
    last = max(r[3] for r in data) + 1000 * 3600000
    put(spark, [(s, "1h", last, last, 1.0, 1.0, 1.0, 1.0, 1.0) for s in ("x", "y")], BARS, f"{tmp_path}/in")  # what lets the rest go
    specs = [("mean_of", {"source": "sma_3", "period": 2}), ("sma", {"period": 3}), ("rsi", {"period": 3}), ("swing_highlow", {"period": 4})]
    out = timed.ordered_features(streams.stream_bars(spark, f"{tmp_path}/in", 1), specs, "6 hours")
    writer = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/progress")
    streams.replay(writer).awaitTermination()
    got = {(r.symbol, r.close_ts): r for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()}
    built = [ft.spec(k, **o) for k, o in specs]
    want = ft.feature_chain(spark.createDataFrame(data, BARS), built).collect()
    assert len(got) == len(want)
    for r in want:
        mine = got[r.symbol, r.close_ts]
        assert [None if mine[s.id] != mine[s.id] else mine[s.id] for s in built] == pytest.approx([r[s.id] for s in built]), r


def test_a_failing_sink_leaves_no_row_twice(spark, tmp_path):
    put(spark, [(i,) for i in range(5)], "v long", f"{tmp_path}/in")
    put(spark, [(i,) for i in range(5, 9)], "v long", f"{tmp_path}/in")
    first, failed = [], []

    def fails_once(batch, epoch):
        if epoch == 1 and not failed:
            failed.append(epoch)
            batch.limit(1).write.mode("append").parquet(f"{tmp_path}/second/epoch={epoch}")  # half done
            raise RuntimeError("no room")
        streams.to_epochs(f"{tmp_path}/second")(batch, epoch)

    def run():
        stream = spark.readStream.schema("v long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        sinks = [lambda b, e: first.extend(r.v for r in b.collect()), fails_once]
        streams.replay(streams.fan_out(stream, sinks, f"{tmp_path}/progress")).awaitTermination()

    with pytest.raises(Exception, match="no room"):
        run()
    run()
    assert failed == [1] and sorted(first) == list(range(9))
    assert sorted(r.v for r in spark.read.parquet(f"{tmp_path}/second").collect()) == list(range(9))


def test_kline_files_as_a_stream(spark, tmp_path):
    for name, start in (("AAA-1h-2024-01.csv", 0), ("BBB-1h-2024-01.csv", 100)):
        lines = [f"{(start + i) * 3600000},1,2,0.5,1.5,10,{(start + i) * 3600000 + 3599999},0,0,0,0,0" for i in range(4)]
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("open_time,open\n" + "\n".join(lines) + "\n1,2,x\n")
    bars, bad = streams.stream_klines(spark, str(tmp_path / "in"))
    for k, (df, n) in enumerate(((bars, 8), (bad, 4))):
        writer = df.writeStream.format("parquet").option("path", f"{tmp_path}/out{k}").option("checkpointLocation", f"{tmp_path}/p{k}")
        streams.replay(writer).awaitTermination()
        assert spark.read.schema(df.schema).parquet(f"{tmp_path}/out{k}").count() == n
    plain, _ = files.read_klines_csv(spark, str(tmp_path / "in"))
    got = spark.read.schema(bars.schema).parquet(f"{tmp_path}/out0")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect())) and {r.symbol for r in got.collect()} == {"AAA", "BBB"}


def test_archives_warn_of_missing_months(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(files, "LINES", 3)
    for m in ("2024-01", "2024-03"):
        with zipfile.ZipFile(tmp_path / f"AAA-1h-{m}.zip", "w") as z:
            z.writestr("readme.txt", "no bars")
            z.writestr("a.csv", "\r\n".join(f"{i},1,2,0.5,1.5,10,{i + 1},0,0,0,0,0" for i in range(1, 9)) + "\r\nshort,row\r\n")
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        bars, bad = files.read_kline_archives(spark, f"{tmp_path}/*.zip", ["2024-01", "2024-02", "2024-03"])
    assert [str(w.message)[:21] for w in said if "archive" in str(w.message)] == ["no archive of 2024-02"]
    assert bars.count() == 16 and bad.count() == 2 and {(r.symbol, r.timeframe) for r in bars.collect()} == {("AAA", "1h")}

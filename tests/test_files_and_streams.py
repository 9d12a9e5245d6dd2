import json
import random
import zipfile

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from barflow.functions import features as ft
from barflow.operators import backtest, quality, strategy
from barflow.sources import files
from barflow.streaming import streams

from .test_bars import make


def drain(stream, at):
    writer = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/ck")
    streams.replay(writer).awaitTermination(120)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/out")


def walk(n, seed=0):
    rnd, x = random.Random(seed), [100.0]
    for _ in range(n - 1):
        x.append(max(5.0, x[-1] * (1 + rnd.uniform(-0.05, 0.052))))
    return x


@pytest.mark.parametrize("chunk", [3, 10, 64, 1000])
def test_chunks_give_what_the_whole_gives(spark, chunk):
    b = make(spark, walk(150)).unionByName(make(spark, walk(37, 1), "b")).unionByName(make(spark, walk(3, 2), "c"))
    b = b.filter("open_ts % 5 <> 0 or symbol <> 'b'")  # gaps
    specs = [ft.engulfing_candle(), ft.vwap(5), ft.ema(4), ft.sma(7), ft.rsi(6), ft.swing_highlow(4)]
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    whole, parts = ft.feature_chain(b, specs), ft.feature_chain(b, specs, chunk_rows=chunk)
    assert parts.columns == whole.columns and key(parts) == key(whole)
    assert ft.feature_chain(b.limit(0), specs, chunk_rows=chunk).count() == 0


def test_features_look_at_no_later_bar(spark):
    x = walk(60)
    specs = [ft.engulfing_candle(), ft.vwap(5), ft.ema(4), ft.sma(7), ft.rsi(6), ft.swing_highlow(4)]
    whole = [tuple(r) for r in ft.feature_chain(make(spark, x), specs).orderBy("close_ts").collect()]
    assert [tuple(r) for r in ft.feature_chain(make(spark, x[:40]), specs).orderBy("close_ts").collect()] == whole[:40]


def test_dropped_bars_are_counted(spark):
    seen = Observation("dropped")
    b = make(spark, [1, 2, 3]).withColumn("close_ts", F.when(F.col("open_ts") == 0, 0).otherwise(F.col("close_ts")))
    assert quality.drop_malformed(b, seen).count() == 2 and seen.get == {"dropped": 1, "bars": 3}


def test_archives_give_their_first_csv_member(spark, tmp_path):
    row = lambda i: ",".join(map(str, [i * 3600000, 1, 2, 0.5, 1.5, 10, (i + 1) * 3600000 - 1, 0, 0, 0, 0, 0]))
    for month, lines in (("2024-01", [row(0), row(1), "open_time,open"]), ("2024-02", [row(2)]), ("2024-03", [row(3)])):
        with zipfile.ZipFile(tmp_path / f"BTCUSDT-1h-{month}.zip", "w") as z:
            z.writestr("readme.txt", "no bars")
            z.writestr(f"BTCUSDT-1h-{month}.csv", "\n".join(lines))
            z.writestr("other.csv", row(9))
    bars, bad = files.read_kline_archives(spark, str(tmp_path / "*.zip"), ["2024-01", "2024-02", "2024-12"])
    assert sorted(r.open_ts for r in bars.collect()) == [0, 3600000, 7200000] and bad.count() == 1
    assert bars.select("symbol", "timeframe").distinct().collect() == [("BTCUSDT", "1h")]
    with pytest.raises(Exception):
        files.read_kline_archives(spark, str(tmp_path / "*.none"))[0].count()


def test_kline_json(spark):
    body = json.dumps([[0, "1", "2", "0.5", "1.5", "10", 3599999, "x"], [1, 2, 3], [3600000, "oops", "2", "1", "1.5", "10", 7199999]])
    got = files.parse_kline_json(spark.createDataFrame([(body,), (None,), ("no json",)], "body string"), "body", "A", "1h").orderBy("open_ts").collect()
    assert [(r.open_ts, r.open, r.close_ts) for r in got] == [(0, 1.0, 3599999), (3600000, 0.0, 7199999)]


def test_enriched_lines_leave_absent_features_out(spark, tmp_path):
    e = ft.feature_chain(make(spark, [1, 2, 3, 4]), [ft.sma(3)])
    files.write_enriched(e, str(tmp_path / "e"))
    lines = [json.loads(x) for f in (tmp_path / "e").rglob("*.json") for x in f.read_text().splitlines()]
    assert sorted("sma_3" in x for x in lines) == [False, False, True, True]
    back = files.read_enriched(spark, str(tmp_path / "e"))
    assert back.count() == 4 and back.filter("symbol = 'a' and timeframe = '1h'").count() == 4
    assert back.filter("unix_millis(time) <> timestamp").count() == 0


def test_result_tables_name_what_is_missing(spark, tmp_path):
    files.write_samples(spark.createDataFrame([(1, 0.5), (2, None)], "sample_id long, y double"), str(tmp_path / "r"), csv=True)
    assert {(r.sample_id, r.y) for r in files.read_results(spark, str(tmp_path / "r"), ["sample_id", "y"]).collect()} == {(1.0, 0.5), (2.0, None)}
    with pytest.raises(ValueError, match="z"):
        files.read_results(spark, str(tmp_path / "r"), ["sample_id", "z"])
    files.write_analysis({"indices": spark.createDataFrame([("a", "S1", 0.25)], "symbol string, kind string, value double")}, str(tmp_path / "a"))
    assert files.read_analysis(spark, str(tmp_path / "a")).collect() == [("indices", "a/S1", "value", 0.25)]


def test_pairs_tickers_and_indicator_kinds(spark):
    pair = "struct<symbol:string,status:string,quoteAsset:string>"
    info = spark.createDataFrame([([("BTCUSDT", "TRADING", "USDT"), ("ETHUSDT", "BREAK", "USDT"), ("ETHBTC", "TRADING", "BTC")],)], f"symbols array<{pair}>")
    assert [r.symbol for r in files.list_pairs(info, "usdt").collect()] == ["BTCUSDT"]
    assert [r.symbol for r in files.list_pairs(info, search="eth").collect()] == ["ETHBTC"]
    t = spark.createDataFrame([("BTCUSDT", "1.5"), ("ETHBTC", "x")], "symbol string, lastPrice string")
    assert [tuple(r) for r in files.list_tickers(t, "btc").collect()] == [("ETHBTC", None)]
    assert [tuple(r) for r in files.list_tickers(t, symbol="btcusdt").collect()] == [("BTCUSDT", 1.5)]
    kinds = quality.classify_indicators(["close", "sma_20", "MACD_x", "engulfing_candle", "ma_5", "mad", "rsi_14"])
    assert kinds == {"overlay": ["sma_20", "ma_5"], "oscillator": ["MACD_x", "rsi_14"], "candle": ["engulfing_candle"]}
    assert quality.classify_indicators(["sma_20", "rsi_14"], ["rsi_14"])["overlay"] == []


def test_month_range(spark):
    got = [str(r.month) for r in files.month_range(spark, "2023-11-15", "2024-02-01").collect()]
    assert got == ["2023-11-01", "2023-12-01", "2024-01-01", "2024-02-01"]


@pytest.mark.parametrize("seed", range(2))
def test_streamed_signals_equal_batch(spark, tmp_path, seed):
    b = make(spark, walk(120, seed)).unionByName(make(spark, walk(90, seed + 9), "b"))
    for i in range(3):  # three triggers
        b.filter(f"open_ts between {i * 40 * 3600000} and {((i + 1) * 40 - 1) * 3600000}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = drain(streams.stream_signals(streams.stream_bars(spark, str(tmp_path / "in"), 1)), tmp_path)
    want = strategy.buy_the_dip(b).select("symbol", "timeframe", "side", "ts", "source", "metadata.*")
    key = lambda df: sorted(map(tuple, df.select("symbol", "ts", "trend_maturity", "swing_high_count", "swing_low_count").collect()))
    assert key(got) == key(want) and key(want)


def test_late_bars_by_either_mode(spark, tmp_path):
    b = make(spark, [10, 20, 30, 40, 50, 60]).orderBy("close_ts").collect()
    order = [0, 1, 3, 2, 4, 4, 0, 5]  # the third bar is late, the fifth comes twice, the first comes again
    spark.createDataFrame([b[i] for i in order], make(spark, [1]).schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    src = lambda: streams.stream_bars(spark, str(tmp_path / "in"), 10)
    specs = [("sma", {"period": 2})]
    kept = drain(streams.stream_features(src(), specs, keep_late=True), tmp_path / "a").collect()
    assert sorted((r.close, r.sma_2, r.late) for r in kept if not r.late) == [(10.0, None, False), *[(float(10 * i), 10.0 * i - 5, False) for i in range(2, 7)]]
    assert sorted(r.close for r in kept if r.late) == [10.0, 50.0]  # one trigger is put in order: repeats alone are late
    got = drain(streams.stream_features(src(), specs, mode="arrival"), tmp_path / "b").collect()
    window, want = [], []
    for i in order:  # the two newest bars, an equal one before its equals
        at = next((k for k, t in enumerate(window) if t[0] >= b[i].close_ts), len(window))
        window.insert(at, (b[i].close_ts, b[i].close))
        window = window[-2:]
        want.append((b[i].close, sum(c for _, c in window) / 2 if len(window) == 2 else None))
    assert sorted(map(str, ((r.close, r.sma_2) for r in got))) == sorted(map(str, want))
    with pytest.raises(ValueError, match="mode"):
        streams.stream_features(src(), specs, mode="other")


def test_batches_and_fan_out(spark, tmp_path):
    rows = spark.range(25).coalesce(1)
    sizes = {r.batch: r["count"] for r in streams.in_batches(rows, 10).groupBy("batch").count().collect()}
    assert sizes == {0: 10, 1: 10, 2: 5}
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    sinks = [lambda df, _, at=at: df.write.mode("append").parquet(str(tmp_path / at)) for at in ("x", "y")]
    streams.replay(streams.fan_out(streams.in_batches(stream, 10), sinks, str(tmp_path / "ck"))).awaitTermination(60)
    assert [spark.read.parquet(str(tmp_path / at)).count() for at in ("x", "y")] == [25, 25]
    seen = streams.replay(streams.fan_out(stream, [lambda df, _: None], str(tmp_path / "ck2")), "200 milliseconds")
    seen.processAllAvailable()
    seen.stop()


def test_null_prices_end_where_the_returns_lead(spark):
    b = make(spark, [10, 11, 9, 12])
    p = backtest.null_prices(b, backtest.permute_returns(b, 5, seed=2, block=2)).collect()
    for rep in range(5):
        last = max((r for r in p if r.rep == rep), key=lambda r: r.close_ts)
        assert abs(last.close - 12) < 1e-9  # any order of the returns leads to the same end


def test_tables_lie_in_a_shared_folder(spark):
    from types import SimpleNamespace

    from barflow.sources import shared

    def session(master, base):
        return SimpleNamespace(sparkContext=SimpleNamespace(master=master), conf=SimpleNamespace(get=lambda *_: base))

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(session("spark://host:7077", None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(session("local-cluster[2,1,1024]", None))
    assert shared.shared_dir(session("yarn", "hdfs://x/y/")).startswith("hdfs://x/y/barflow-")
    assert shared.shared_dir(session("local[2]", None)).startswith("file:///")
    path = shared.shared_dir(spark)
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    shared.delete_dir(spark, path)
    with pytest.raises(Exception):
        spark.read.parquet(path).count()

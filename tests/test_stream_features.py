import random

from barflow.functions import features as ft
from barflow.streaming import streams

from .test_bars import make


def test_streamed_features_equal_batch(spark, tmp_path):
    rnd = random.Random(3)
    bars = make(spark, [rnd.uniform(1, 50) for _ in range(40)], "a").unionByName(make(spark, [rnd.uniform(1, 50) for _ in range(31)], "b"))
    for k, (lo, hi) in enumerate([(0, 3), (3, 9), (9, 30), (30, 40)]):  # in order, over four batches
        part = bars.filter(f"open_ts >= {lo} * 3600000 and open_ts < {hi} * 3600000")
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        specs = [("sma", {"period": 3}), ("ema", {"period": 4}), ("rsi", {"period": 5}), ("vwap", {"period": 2}), ("engulfing_candle", {})]
        out = streams.stream_features(streams.stream_bars(spark, str(tmp_path / "in"), 10), specs)
        q = streams.replay(out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")))
        q.awaitTermination(60)
        assert q.exception() is None
    want = ft.feature_chain(bars, [ft.spec(kind, **o) for kind, o in specs])
    key = lambda r: (r["symbol"], r["close_ts"])
    got = {key(r): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(got) == 71
    for r in want.collect():
        for c in want.columns[9:]:
            a, b = r[c], got[key(r)][c]
            assert (a is None) == (b is None or b != b), (key(r), c, a, b)
            assert a is None or abs(a - b) < 2e-6, (key(r), c, a, b)

import datetime

from pyspark.sql import functions as F

from panelweave.streaming.bars import stream_bars, stream_rolling_mean


def _drain(spark, df, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name).collect()


def test_bars_and_rolling_means(spark, tmp_path):
    day = lambda n, h=0: datetime.datetime(2024, 1, 1 + n, h)
    trades = [(day(n, h), "A", 10.0 * (n + 1) + h, 1.0 + h) for n in range(6) for h in (1, 2, 3)]
    path = str(tmp_path / "trades")
    spark.createDataFrame(trades, "ts timestamp, name string, price double, size double").write.parquet(path)
    feed = spark.readStream.schema("ts timestamp, name string, price double, size double").parquet(path)
    bars = _drain(spark, stream_bars(feed, time="ts", key="name", price="price", size="size"), "bars_out")
    first = min(bars, key=lambda r: r["date"])
    assert len(bars) >= 5 and (first["open"], first["high"], first["low"], first["close"], first["volume"]) == (11.0, 13.0, 11.0, 13.0, 9.0)
    spark.createDataFrame([(day(n), "A", float(n)) for n in range(8)], "date timestamp, inst string, close double").coalesce(1).write.parquet(str(tmp_path / "b"))
    source = spark.readStream.schema("date timestamp, inst string, close double").parquet(str(tmp_path / "b"))
    got = _drain(spark, stream_rolling_mean(source, 3), "means_out")
    assert sorted(r["mean"] for r in got) == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
    assert spark.table("means_out").agg(F.count("*")).first()[0] == 6

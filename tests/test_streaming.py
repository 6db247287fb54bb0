"""Streaming forms against the batch folds."""

from pyspark.sql import functions as F

from catalune.operators import position as ps
from catalune.streaming import processors


def stream(spark, df, path, name, make):
    df.coalesce(1).write.parquet(path)
    # one batch: with a processing-time timeout, other triggers go on forever
    q = make(spark.readStream.schema(df.schema).parquet(path)).writeStream.format("memory").queryName(name).outputMode("append").trigger(once=True).start()
    try:
        assert q.awaitTermination(60)
    finally:
        q.stop()
    return spark.table(name)


def test_positions(spark, tmp_path):
    rows = [(i % 3, i, i * 50_000, "room" if i % 4 == 0 else "gps", i % 5 != 0, f"g{i}", 1.0, "s") for i in range(60)]
    df = spark.createDataFrame(rows, "key long, event_id long, at long, source string, usable boolean, gallery string, floor double, site string")
    got = {(r.key, r.event_id, r.level) for r in stream(spark, df, str(tmp_path / "p"), "positions", processors.positions).collect()}
    assert got == {(r.key, r.event_id, r.level) for r in ps.fold_positions(df).collect()}


def test_buckets_and_progress(spark, tmp_path):
    rows = [(i % 2, i, i * 7_000, str(i % 6)) for i in range(40)]
    df = spark.createDataFrame(rows, "key long, event_id long, at long, gallery string")
    b = stream(spark, df, str(tmp_path / "b"), "buckets", lambda s: processors.buckets(s.drop("gallery"), 4.0, 2.0))
    assert sorted(map(tuple, b.collect())) == sorted(map(tuple, ps.rate_limited(df.drop("gallery"), 4.0, 2.0).collect()))
    p = stream(spark, df, str(tmp_path / "q"), "progress", lambda s: processors.progress(s, ["0", "2", "4"]))
    assert sorted(map(tuple, p.collect())) == sorted(map(tuple, ps.route_progress(df, ["0", "2", "4"]).collect()))


def test_windows_close_behind_the_watermark(spark, tmp_path):
    df = spark.createDataFrame([(i, f"2024-01-01 {h:02d}:00:00", 1, "view", 1.0) for i, h in enumerate((0, 1, 6, 20))], "event_id long, t string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("t")).drop("t")
    out = stream(spark, df, str(tmp_path / "w"), "windows", lambda s: processors.windowed_counts(s, "6 hours"))
    assert sum(r.n for r in out.collect()) <= 4
    assert sum(r.n for r in processors.windowed_counts(df, "6 hours").collect()) == 4

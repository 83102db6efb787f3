from datetime import datetime, timedelta

from brindle.streaming.windows import date_histogram, sessions


def run(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_windows_and_sessions(spark, tmp_path):
    start = datetime(2024, 1, 1)
    # two files, so that the second batch moves the watermark past the first windows
    for k, minutes in enumerate(([0, 1, 2, 11, 12], [300, 301])):
        spark.createDataFrame([(start + timedelta(minutes=m), "a", float(m)) for m in minutes], "ts timestamp, kind string, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events/part{k}")
    stream = spark.readStream.schema("ts timestamp, kind string, value double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/events")
    rows = run(spark, date_histogram(stream, "ts", "10 minutes", "5 minutes", ("kind",), {"total": "sum(value)"}), "w")
    assert {(r["start"].minute, r["doc_count"], r["total"]) for r in rows} == {(0, 3, 3.0), (10, 2, 23.0)}
    rows = run(spark, sessions(stream, "ts", "5 minutes", "5 minutes", "kind"), "s")
    assert sorted(r["doc_count"] for r in rows) == [2, 3]

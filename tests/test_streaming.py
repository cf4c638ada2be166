from pyspark.sql import functions as F

from linkloom.streaming.metrics import read_events, windowed_counts


def test_stream_equals_table(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    table.write.parquet(str(tmp_path / "in"))
    stream = windowed_counts(read_events(spark, str(tmp_path / "in"), table.schema), late="3650 days")
    run = stream.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).start()
    run.processAllAvailable()
    run.stop()
    got = sorted(map(tuple, spark.table("counts").select("event_type", "start", "n").collect()), key=str)
    want = windowed_counts(table).select("event_type", "start", "n")
    assert got == sorted(map(tuple, want.collect()), key=str) and want.agg(F.sum("n")).first()[0] == table.count()

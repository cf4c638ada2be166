"""Streams into stored tables: repeated and reordered input gives the table of the batch query."""

import datetime as dt
import random

from pyspark.sql import functions as F

from linkloom.sources.keyed import KeyedTable
from linkloom.streaming import upserts
from linkloom.streaming.metrics import read_events

SCHEMA = "page bigint, at bigint, title string"


def files(spark, rows, folder, sizes):
    start = 0
    for n in sizes:
        spark.createDataFrame(rows[start : start + n], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        start += n


def test_newest_row_whatever_the_order(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randrange(20), rng.randrange(50), f"t{i}") for i in range(120)] + [(None, 1, "lost"), (3, None, "unset"), (99, None, "only")]
    best = {}
    for p, at, title in rows:
        if p is not None:
            best[p] = max(best.get(p, (-1, "")), (-1 if at is None else at, title))
    results = []
    for name, order in (("a", rows), ("b", rows[::-1] + rows[:40])):
        files(spark, order, f"{tmp_path}/{name}-in", [30] * (len(order) // 30 + 1))
        table = KeyedTable(spark, f"file://{tmp_path}/{name}", SCHEMA, ["page"], 4)
        stream = read_events(spark, f"{tmp_path}/{name}-in", spark.createDataFrame([], SCHEMA).schema, 1)
        for _ in range(2):  # started again, it finds nothing new
            upserts.latest(stream, table, ["at"], f"{tmp_path}/{name}-state").awaitTermination()
        results.append(sorted((r["page"], -1 if r["at"] is None else r["at"], r["title"]) for r in table.read().collect()))
        assert upserts.merge_newest(table, spark.createDataFrame(rows[:50], SCHEMA), ["at"]) == []  # a batch that comes again writes nothing
    assert results[0] == results[1] == sorted((p, *v) for p, v in best.items())


def test_totals_count_an_event_once(spark, tmp_path):
    day = dt.datetime(2024, 5, 1)
    rows = [(i, i % 5, day + dt.timedelta(minutes=i)) for i in range(200)]
    schema = "event bigint, page bigint, ts timestamp"
    for part in (rows[:80], rows[60:], rows[::3]):
        spark.createDataFrame(part, schema).repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
    table = KeyedTable(spark, f"file://{tmp_path}/t", "page bigint, n bigint, last bigint", ["page"], 2)
    stream = read_events(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, 1)
    upserts.totals(stream, table, {"n": F.count("*"), "last": F.max("event")}, f"{tmp_path}/state", "event", "ts", "100 days").awaitTermination()
    want = [(p, 40, max(i for i, q, _ in rows if q == p)) for p in range(5)]
    assert sorted(tuple(r) for r in table.read().collect()) == want
    spark.createDataFrame([(1000, 3, day)], schema).write.mode("append").parquet(f"{tmp_path}/in")
    upserts.totals(stream, table, {"n": F.count("*"), "last": F.max("event")}, f"{tmp_path}/state", "event", "ts", "100 days").awaitTermination()
    assert [tuple(r) for r in table.read().where("page = 3").collect()] == [(3, 41, 1000)]

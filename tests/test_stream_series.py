"""Lags and rolling windows over a stream against those over the table."""

import random

import pytest
from pyspark.sql import functions as F

from loomspark.operators import temporal
from loomspark.streaming import series


def test_stream_of_disordered_rows_equals_table(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", F.col("user_id") % 9, F.when(F.col("event_id") % 11 > 0, F.col("value")).alias("value")).toDF("event_id", "ts", "user_id", "value")
    rows = [tuple(r) for r in events.orderBy("ts", "event_id").collect()][:400]
    rng = random.Random(2)
    parts = [rows[i : i + 100] for i in range(0, 400, 100)]
    for a, b in zip(parts, parts[1:], strict=False):  # rows near a border come a batch later or earlier
        a[-5:], b[:5] = b[:5], a[-5:]
    schema = events.schema
    flush = (10**6, rows[-1][1].replace(year=rows[-1][1].year + 1), 99, 0.0)
    for i, part in enumerate([*parts, [flush], [(10**6 + 1, flush[1], 99, 0.0)]]):
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(*[f"file://{tmp_path}/in/*"]).drop("part")
    out = series.series_features(stream, "user_id", "ts", "event_id", "value", "2 days", (1, 2), (3,))
    query = out.writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/check").option("path", f"file://{tmp_path}/out").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(300)
    got = {r.event_id: tuple(r)[2:] for r in spark.read.parquet(f"file://{tmp_path}/out").where("event_id < 1000000").collect()}
    table = spark.createDataFrame(rows, schema)
    names = spark.read.parquet(f"file://{tmp_path}/out").columns[2:]
    want = {r.event_id: tuple(r[n] for n in names) for r in temporal.series_features(table, "value", ["ts", "event_id"], ["user_id"], (1, 2), (3,)).collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert all(a == b or a is not None and b is not None and a == pytest.approx(b, abs=1e-9) for a, b in zip(got[k], v, strict=True)), (k, got[k], v)

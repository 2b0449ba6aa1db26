"""Freshness as a stream against the batch result, with late and repeated events and restarts."""

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from priceloom.operators import journal
from priceloom.streaming import freshness as Y

SCHEMA = "key string, ts timestamp, place long, value double"
BEGIN = datetime(2024, 1, 1, tzinfo=timezone.utc)


def arrive(spark, folder, events):
    spark.createDataFrame(events, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def test_late_and_repeated_events_give_the_batch_result(spark, tmp_path):
    rng = random.Random(3)
    made = [(f"k{rng.randint(0, 19)}", BEGIN + timedelta(seconds=rng.randint(0, 20_000)), rng.randint(0, 3), float(n)) for n in range(300)]
    made += made[:40] + [(None, BEGIN, 0, 1.0), ("k1", None, 0, 1.0)]
    rng.shuffle(made)
    folder, out, checkpoint, ttl = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint"), 1800
    for k in range(0, len(made), 90):  # each part by a query of its own, which goes on from the checkpoint
        arrive(spark, folder, made[k : k + 90])
        Y.run(spark, spark.readStream.schema(SCHEMA).parquet(str(folder)), ttl, out, checkpoint, "1 day")
    # A last event moves the watermark to a day before it, and what is older than that by the ttl is stale.
    now = BEGIN + timedelta(seconds=21_000)
    end = ("end", now + timedelta(days=1), 0, 0.0)
    for event in (end, ("end", end[1], 1, 0.0)):
        arrive(spark, folder, [event])
        Y.run(spark, spark.readStream.schema(SCHEMA).parquet(str(folder)), ttl, out, checkpoint, "1 day")
    got = {r.key: (r.ts, r.value, r.fresh) for r in Y.standing(spark.read.parquet(out)).collect()}
    events = spark.createDataFrame(made, SCHEMA).filter("key IS NOT NULL AND ts IS NOT NULL").withColumn("at", F.struct("ts", "place"))
    last = {r.key: (r.ts, r.value) for r in journal.latest(events, ["key"], "at").collect()}
    fresh = {r.key for r in journal.fresh(events.drop("place"), ["key"], "ts", now, ttl).collect()}
    assert {k: v[:2] for k, v in got.items() if k != "end"} == last
    assert {k for k, v in got.items() if v[2] and k != "end"} == fresh
    assert 0 < len(fresh) < len(last)
    steps = [(r.key, r.step) for r in spark.read.parquet(out).collect()]
    assert len(steps) == len(set(steps))

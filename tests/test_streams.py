"""Streams that stop and go on: every batch counts, late rows are held and then worked in, and the cursor never passes a held row."""

from __future__ import annotations

import datetime as dt
import random

from tidewright.streaming import jobs as J

KIND = "product_id string, row_id long, ts timestamp, value double"


def test_upsert_keeps_every_batch(spark, tmp_path):
    schema = J.EVENTS
    at = dt.datetime(2024, 1, 1)
    batches = [[(1, at, 1, "a", 1.0, ""), (2, at, 2, "a", 1.0, "")], [(3, at + dt.timedelta(days=1), 1, "b", 2.0, ""), (4, at, 3, "c", 1.0, "")], [(5, at + dt.timedelta(days=2), 2, "d", 1.0, "")]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/b={k}")
        J.run_once(J.read_events(spark, f"{tmp_path}/in/*", 1), "", f"{tmp_path}/state", apply=J.apply_batches(spark, f"{tmp_path}/out", ["user_id"]))
    got = {(r.user_id, r.event_id, r.event_type) for r in J.last_version(spark, f"{tmp_path}/out").collect()}
    assert got == {(1, 3, "b"), (2, 5, "d"), (3, 4, "c")}


def test_late_rows_are_held_and_refreshed_over_restarts(spark, tmp_path):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng, day, start = random.Random(1), dt.timedelta(days=1), dt.datetime(2024, 1, 1)
    first = [(f"p{i % 4}", i, start + day * (10 + i % 3), float(i)) for i in range(40)]
    second = [(f"p{i % 4}", 100 + i, start + day * rng.randint(0, 5), 1.0) for i in range(12)] + first[:5]
    third = [("p9", 200, start, 5.0), ("p0", 201, start + day * 20, 3.0)]
    told = []
    try:
        for k, rows in enumerate([first, second, third, [(f"p{i}", None, start, 0.0) for i in range(4)]]):
            spark.createDataFrame(rows, KIND).coalesce(1).write.parquet(f"{tmp_path}/in/b={k}")
            stream = J.refresh_states(spark.readStream.schema(KIND).parquet(f"{tmp_path}/in/*"))
            J.run_once(stream, f"{tmp_path}/out", f"{tmp_path}/state")  # a new run each time, which goes on from the last one's state
            told.append(spark.read.schema(J.REFRESHED).parquet(f"{tmp_path}/out").collect())
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    held = [r for r in told[1] if r.kind == "held"]
    assert {r.row_id for r in held} == {100 + i for i in range(12)} and all(r.cursor < min(h.ts for h in held if h.product_id == r.product_id) for r in held)
    whole = {}
    for p, i, _, v in [*first, *second[:12], *third]:
        n, total = whole.get(p, (0, 0.0))
        whole[p] = n + 1, total + v
    last = {}
    for r in told[-1]:
        if r.kind == "refreshed" and r.n >= last.get(r.product_id, (0,))[0]:
            last[r.product_id] = (r.n, r.total)
    assert last == whole
    assert len({r.row_id for r in told[-1] if r.kind == "held"}) == sum(1 for r in told[-1] if r.kind == "held")

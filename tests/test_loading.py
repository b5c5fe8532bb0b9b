"""Loads: pseudonyms, embedded events, and tables that are seen together or not at all."""

from __future__ import annotations

import hashlib
import hmac
import json

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tidewright.operators import loading as L
from tidewright.operators import search as S


@pytest.mark.parametrize("key", [b"k", b"x" * 64, b"long " * 30])
def test_pseudonyms_are_hmacs_and_the_key_is_not_shown(spark, key):
    rows = L.pseudonyms(spark.createDataFrame([("a",), ("é 1",), ("",), (None,)], "id string"), "id", key, digits=64)
    got = {r.id: r.pseudonym for r in rows.collect()}
    assert got == {t: hmac.new(key, t.encode(), hashlib.sha256).hexdigest() for t in ("a", "é 1", "")} | {None: None}
    plan = rows._jdf.queryExecution().toString()
    pad = bytes(x ^ 0x36 for x in key.ljust(8, b"\0")[:8])
    assert key.decode() not in plan.replace("\n", "") or len(key) == 1
    assert pad.hex().upper() not in plan.upper() and repr(pad)[2:-1] not in plan


def test_purchase_events(spark):
    events = [
        {"product_id": " p1 ", "quantity": 2, "price": 3, "purchased_at": "2024-01-01", "channel": "web"}, {"product_id": "p2"}, {"product_id": " "}, {"quantity": 1}, {"product_id": "p3", "quantity": 0}, {"product_id": "p3", "quantity": -1},
        {"product_id": "p3", "quantity": True}, {"product_id": "p3", "quantity": "2"}, {"product_id": "p3", "quantity": 1.5}, {"product_id": 7, "price": "x", "purchased_at": 5, "channel": [1]}, {"product_id": "p4", "quantity": None, "price": 2.5},
    ]
    rows = spark.createDataFrame([(1, [json.dumps(e) for e in events] + ["no json", "[]"]), (2, None), (3, [])], "user_id long, purchase_events array<string>")
    seen = Observation("test")
    got = [tuple(r)[1:] for r in sorted(L.purchase_events(rows, seen).collect(), key=lambda r: r.ord)]
    assert got == [(0, "p1", 2, "2024-01-01", 3.0, "web"), (1, "p2", 1, None, None, None), (9, "7", 1, None, None, None), (10, "p4", 1, None, 2.5, None)]
    assert seen.get == {"kept": 4, "skipped": 9, "nulled": 3}


def test_a_lost_run_leaves_the_old_tables(spark, tmp_path):
    store, keys = L.Store(spark, f"file://{tmp_path}/store"), {"a": "id", "b": "id"}
    first = spark.range(5)
    store.load("one", {"a": first, "b": first}, keys, {"a": "id"})
    broken = spark.range(9).select(F.when(F.col("id") < 5, F.col("id")).otherwise(F.raise_error(F.lit("lost")).cast("long")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        store.load("two", {"a": spark.range(7), "b": broken}, keys)
    assert store.read("a").count() == store.read("b").count() == 5 and len(store.manifests()) == 1
    again = store.load("one", {"a": spark.range(100)}, keys)
    assert again["number"] == 0 and store.read("a").count() == 5
    store.load("two", {"a": spark.range(7)}, keys)
    assert store.read("a").count() == 7 and store.read("b").count() == 5 and store.read("a", 0).count() == 5
    assert [(r.run_id, r["table"], r.rows, r.null_keys, r.newest) for r in store.run_log().collect()] == [("one", "a", 5, 0, "4"), ("one", "b", 5, 0, None), ("two", "a", 7, 0, None)]


def test_contained_is_contains(spark):
    texts, words = ["red bolt and redwood", "", "a", "日本語の本", "aaaa"], ["red", "redw", "redwood", "bolt", "a", "aa", "aaaaa", "本", "の本", " ", "x"]
    frame = spark.createDataFrame
    got = {tuple(r) for r in S.contained(frame([(t,) for t in texts], "text string"), frame([(w,) for w in words], "word string")).collect()}
    assert got == {(t, w) for t in texts for w in words if w in t}


def test_search_with_pins_and_exclusions_equals_each_query_alone(spark):
    import random

    rng = random.Random(4)
    concepts = [(q, "x", f"k{rng.randint(0, 5)}") for q in range(25) for _ in range(3)]
    products = [(f"p{i:02}", "x", f"k{rng.randint(0, 7)}") for i in range(40) for _ in range(3)]
    excluded, pins = [(q, f"p{rng.randint(0, 39):02}") for q in range(25) for _ in range(2)], [(q, f"p{rng.randint(0, 39):02}") for q in range(0, 25, 2)]
    frame, pair = spark.createDataFrame, "query_id long, product_id string"
    got = {tuple(r) for r in S.search(frame(concepts, "query_id long, axis string, key string"), frame(products, "product_id string, axis string, key string"), frame(excluded, pair), frame(pins, pair), 6).select("query_id", "product_id", "hits", "pinned", "rank").collect()}
    want = set()
    for q in range(25):
        asked, mine = {k for x, _, k in concepts if x == q}, {p for x, p in pins if x == q}
        rows = []
        for p in {p for p, *_ in products} | mine:
            hits = len(asked & {k for x, _, k in products if x == p})
            if (hits or p in mine) and (q, p) not in excluded:
                rows.append((-(p in mine), -hits, p))
        want |= {(q, p, -h, -m, i + 1) for i, (m, h, p) in enumerate(sorted(rows)[:6])}
    assert got == want

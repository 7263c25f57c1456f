"""Streams in any order against the batch form: held to the watermark, forgotten, or counted as late."""

import random

import pytest
from pyspark.sql import functions as F

from offerlens.operators import state
from offerlens.streaming import changes, held

SCHEMA = "key long, ts timestamp, seq long, price double, in_stock int"
HOUR = 3600


def landed(spark, folder, files):
    """Each file arrives after the one before it."""
    for k, rows in enumerate(files):
        df = spark.createDataFrame([(key, at, seq, price, stock) for key, at, seq, price, stock in rows], "key long, at long, seq long, price double, in_stock int")
        df.select("key", F.timestamp_seconds("at").alias("ts"), "seq", "price", "in_stock").coalesce(1).write.mode("append").parquet(f"{folder}/f{k}")
    return f"{folder}/f*"


def plain(df):
    return sorted((r["key"], int(r["ts"].timestamp()), r["seq"], r["price"], *([r["kind"]] if "kind" in df.columns else [])) for r in df.collect())


def run(spark, tmp_path, files, operator, gives):
    path = landed(spark, str(tmp_path / "in"), files)
    return held.run_available(spark, path, spark.createDataFrame([], SCHEMA).schema, lambda x: x, str(tmp_path / "out"), operator, gives)


def test_shuffled_rows_give_the_batch_answer(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randrange(5), 10**6 + rng.randrange(40) * HOUR, n, rng.choice([None, 5.0, 5.0004, 6.0, 7.5]), rng.randrange(2)) for n in range(150)]
    arrival = sorted(rows, key=lambda r: r[1] + rng.randrange(6 * HOUR))
    files = [arrival[k : k + 50] for k in range(0, 150, 50)] + [[(-1, 10**9, 0, None, 0)]]
    told, lost = run(spark, tmp_path, files, lambda s: held.price_changes(s.drop("in_stock"), "7 hours"), changes.CHANGED)
    df = spark.createDataFrame(rows, "key long, at long, seq long, price double, in_stock int")
    want = state.price_changes(df, ["key"], ["at", "seq"]).select("key", F.timestamp_seconds("at").alias("ts"), "seq", "price")
    assert lost == 0 and plain(told) == plain(want) and len(plain(told)) > 40


def in_order(rows, target):
    """What rules tell of rows (key, at, seq, price, in_stock), key by key."""
    tell, last, out = held.transition(target, True), {}, []
    for key, at, seq, price, stock in sorted(rows, key=lambda r: r[1:3]):
        kind = tell(last.get(key), price, stock)
        if kind:
            out.append((key, at, seq, price, kind))
        last[key] = (at, price, stock)
    return sorted(out)


def test_transitions_late_rows_and_forgotten_keys(spark, tmp_path):
    day = 24 * HOUR
    first = [(1, day, 1, 9.0, 1), (2, day, 2, 9.0, 0), (3, day, 3, 9.0, 1)]
    second = [(1, 3 * day, 4, 4.0, 1), (2, 3 * day - HOUR, 6, 9.0, 1), (2, 3 * day - 2 * HOUR, 5, None, 0)]
    far = [(1, 40 * day, 7, 4.0, 1), (3, 40 * day, 8, 9.0, 1)]
    late = [(1, 2 * day, 9, 1.0, 1)]
    end = [(-1, 400 * day, 0, None, 0)]
    told, lost = run(spark, tmp_path, [first, second, far, late, end], lambda s: held.transitions(s, "6 hours", target=5.0, forget_days=10), changes.TOLD)
    kinds = plain(told)
    assert kinds == sorted([(1, day, 1, 9.0, "new"), (3, day, 3, 9.0, "new"), (1, 3 * day, 4, 4.0, "drop"), (2, 3 * day - HOUR, 6, 9.0, "back"), (1, 40 * day, 7, 4.0, "new"), (3, 40 * day, 8, 9.0, "new")])
    assert lost == 1
    whole = in_order(first + second, 5.0)
    assert [k for k in kinds if k[1] < 10 * day] == whole


@pytest.mark.parametrize(("last", "row", "kind"), [(None, (5.0, 1), "new"), (None, (None, 1), None), ((0, 5.0, 0), (5.0, 1), "back"), ((0, 9.0, 1), (4.0, 1), "drop"), ((0, None, 1), (4.0, 1), "drop"), ((0, 5.0, 1), (4.0, 1), None), ((0, 9.0, 1), (None, 0), None), ((0, 9.0, None), (9.0, 1), "back")])
def test_kinds(last, row, kind):
    assert held.transition(5.0, True)(last, *row) == kind


def test_slices_of_arrivals_do_not_grow_in_number(spark, monkeypatch):
    """Each slice of the time is taken at once, in as many files as the others, also one of few events."""
    from offerlens.plans import table_queries as tq

    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(tq, "PER_FILE", 40)
    folder, files = tq.arrivals(spark, sf)
    events = tq.views.table(spark, sf, "events")
    assert files == -(-events.count() // (tq.SLICES * 40)) > 1
    assert [len(spark.read.parquet(f"{folder}/{k}").inputFiles()) for k in range(tq.SLICES + 1)] == [files] * tq.SLICES + [1]
    told = tq.QUERIES["stream_change_held"](spark, sf)
    rows = events.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"))
    assert sorted(map(tuple, told.collect())) == sorted(map(tuple, state.price_changes(rows, ["key"], ["ts", "seq"]).select("key", "ts", "seq", "price").collect()))


def test_a_null_key_and_a_large_one_share_a_bucket(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(held, "BUCKETS", 1)
    rows = [(None, 10**6, 1, 5.0, 1), (0, 10**6, 2, 6.0, 1), (2**62 + 1, 10**6, 3, None, 1), (None, 10**6 + 1, 4, 5.0, 1), (0, 10**6 + 1, 5, 7.0, None)]
    told, lost = run(spark, tmp_path, [rows, [(-1, 10**9, 0, None, 0)]], lambda s: held.price_changes(s, "7 hours"), changes.CHANGED)
    assert lost == 0 and sorted((r["seq"], r["key"], r["price"]) for r in told.collect()) == [(1, None, 5.0), (2, 0, 6.0), (5, 0, 7.0)]

"""Landed answers and streams of updates: order, failures, pushed conditions, and going on where a stream was stopped."""

import json

import pytest
from pyspark.sql import functions as F

from offerlens.sources import landed


@pytest.fixture
def answers(tmp_path):
    def put(query, name, *lines):
        at = tmp_path / "landed" / f"query={query}"
        at.mkdir(parents=True, exist_ok=True)
        (at / name).write_bytes(b"\n".join(x if isinstance(x, bytes) else json.dumps(x).encode() for x in lines))

    item = lambda sku, price=None, **more: {"sku": sku, "price": price, **more}
    put(2, "part-1.txt", item("late", 5))
    put(2, "part-0.txt", item("b", 5, title="B é"), item("a"), item("gone", -1), item("dear", 90), item("b", 7, other=1))
    put(0, "part-0.txt", item("x", 1), b'{"sku": "y", "pri')
    put(0, "_SUCCESS", b"")
    put(1, "part-0.txt", b"[1]")
    put(7, "part-0.txt", b"\xff\xfe{")
    put(9, "part-0.txt")
    put(11, "part-0.txt", item("p", "ten"))
    return f"file://{tmp_path}/landed"


def test_answers_of_queries(spark, answers):
    df = landed.registered(spark).read.format("landed").option("path", answers).option("ceiling", "60").load()
    rows = df.orderBy("query", "position").collect()
    assert [(r["query"], r["position"], r["sku"], r["title"], r["price"]) for r in rows if r["error"] is None] == [(2, 0, "b", "B é", 5.0), (2, 1, "a", None, None), (2, 4, "b", None, 7.0), (2, 5, "late", None, 5.0)]
    failed = {r["query"]: r["error"] for r in rows if r["error"] is not None}
    assert set(failed) == {0, 1, 7, 11} and failed[0].startswith("JSONDecodeError") and len(rows) == 8
    assert df.rdd.getNumPartitions() == 6


def test_conditions_reach_the_source(spark, answers):
    df = landed.registered(spark).read.format("landed").option("path", answers).load()
    assert df.filter("query = 2").rdd.getNumPartitions() == 1 and df.filter("query in (2, 9)").rdd.getNumPartitions() == 2
    assert sorted(r["sku"] for r in df.filter("query = 2 and price <= 6").collect()) == ["b", "late"]
    assert df.filter("query = 2 and price is null").count() == 1 and df.filter("query = 3").count() == 0


def updates(spark, folder, numbers):
    rows = spark.createDataFrame([(n, f"text {n}") for n in numbers], "update_id long, text string")
    landed.land_updates(rows.repartition(3), folder)


def polled(spark, folder, out, **options):
    stream = landed.registered(spark).readStream.format("updates").option("path", folder)
    for k, v in options.items():
        stream = stream.option(k, v)
    return stream.load().writeStream.option("checkpointLocation", f"{out}-state")


def test_a_stream_goes_on_after_its_cursor(spark, tmp_path):
    folder, out = f"file://{tmp_path}/updates", f"{tmp_path}/out"
    updates(spark, folder, [n for n in range(100, 400, 3)] + [250, 250])
    told, batches = [], []

    def tell(rows, batch):
        got = sorted(r["update_id"] for r in rows.collect())
        batches.append(got)
        if len(batches) == 2:
            raise RuntimeError("a crash before the poll is done")
        told.extend(got)

    with pytest.raises(Exception, match="crash"):
        polled(spark, folder, out, start=105, most=20).foreachBatch(tell).start().processAllAvailable()
    query = polled(spark, folder, out, start=105, most=20).foreachBatch(tell).start()
    query.processAllAvailable()
    query.stop()
    want = sorted([n for n in range(100, 400, 3) if n > 105] + [250, 250])
    assert told == want and batches[1] == batches[2]  # the poll that was not finished comes again, whole
    assert all(len(b) <= 20 or set(b[19:]) == {b[19]} for b in batches) and [n for b in batches[:2] for n in b] == want[: len(batches[0]) + len(batches[1])]
    more = spark.createDataFrame([(1000, "late"), (7, "old")], "update_id long, text string")
    more.write.mode("append").parquet(folder)
    query = polled(spark, folder, out, start=105, most=20).foreachBatch(tell).start()
    query.processAllAvailable()
    query.stop()
    assert told == [*want, 1000]


def test_polls_are_of_the_least_numbers(spark, tmp_path):
    folder = f"file://{tmp_path}/updates"
    updates(spark, folder, [5, 1, 9, 3, 3, 3, 7, 2, 8])
    spark.createDataFrame([(4, "x"), (0, "y")], "update_id long, text string").write.mode("append").parquet(folder)
    reader = landed.UpdatesReader(folder, "update_id", ["text", "update_id"], -1, 4)
    at, seen = reader.initialOffset(), []
    while True:
        rows, end = reader.read(at)
        if end == at:
            break
        rows = [r[1] for r in rows]
        assert [r[1] for r in reader.readBetweenOffsets(at, end)] == rows
        seen.append(rows)
        at = end
    assert seen == [[0, 1, 2, 3, 3, 3], [4, 5, 7, 8], [9]]
    empty = landed.UpdatesReader(folder, "update_id", ["update_id"], 100, 4)
    assert list(empty.read(empty.initialOffset())[0]) == []


@pytest.mark.parametrize(
    ("html", "ids"),
    [("<input type='hidden' id=\"catid\" name=x value=\"7\"><INPUT type='HIDDEN' id='BrandId' value='9'>", ("7", "9")), ("<input type='hidden' id='catid' value='7'><input id='brandid' value='1'>", None), ("<input type='hidden' id='catid' value='7'><input type='hidden' id='brandid' value=''>", None), ("<input type='hidden' id='catid' value='1'><input type=\"hidden\" id='catid' value='2'><input type='hidden' id='brandid' value='b'>", ("2", "b")), ("", None), (None, None)],
)
def test_ids_of_a_landing_page(spark, html, ids):
    from offerlens.sources import payloads

    r = spark.createDataFrame([(html,)], "html string").select(payloads.listing_ids(F.col("html")).alias("i")).first()["i"]
    assert (r and tuple(r)) == ids


def test_a_batch_of_polls(spark, tmp_path):
    folder, out = f"file://{tmp_path}/updates", f"{tmp_path}/out"
    updates(spark, folder, [n for n in range(100, 1000, 3)] + [250, 250, 5])
    spark.createDataFrame([(251, "x"), (None, "none"), (1, "y")], "update_id long, text string").write.mode("append").parquet(folder)
    one = landed.UpdatesReader(folder, "update_id", ["update_id", "text"], 100, 7)
    many = landed.PollsReader(one, 5)
    at, polls, cursor = many.initialOffset(), [], one.initialOffset()
    while (end := many.latestOffset()) != at:
        parts = many.partitions(at, end)
        assert len(parts) <= 5 and landed.PollsReader(one, 5).partitions(at, end)[-1].upto == parts[-1].upto
        polls.extend(sorted(many.read(p)) for p in parts)
        at = end
    for poll in polls:
        rows, cursor = one.read(cursor)
        assert poll == sorted(rows)
    assert one.read(cursor)[1] == cursor and sum(map(len, polls)) == 299 + 3

    batches = []

    def tell(rows, batch):
        batches.append((rows.rdd.getNumPartitions(), sorted(r["update_id"] for r in rows.collect())))
        if len(batches) == 2:
            raise RuntimeError("a crash before the batch is done")

    with pytest.raises(Exception, match="crash"):
        polled(spark, folder, out, start=100, most=7, polls=5).foreachBatch(tell).start().processAllAvailable()
    for more in ([], [(2000, "late"), (7, "old")]):
        if more:
            spark.createDataFrame(more, "update_id long, text string").write.mode("append").parquet(folder)
        query = polled(spark, folder, out, start=100, most=7, polls=5).foreachBatch(tell).start()
        query.processAllAvailable()
        query.stop()
    assert batches.pop(1) == batches[1] and batches[0][0] == 5 and len(batches) == 10
    assert [n for _, b in batches for n in b] == [n for p in polls for n, _ in p] + [2000]


def test_updates_are_landed_in_small_row_groups(spark, tmp_path):
    import pyarrow.parquet as pq

    landed.land_updates(spark.range(1_600_000).selectExpr("id as update_id", "hash(id) as chat"), f"file://{tmp_path}/updates")
    groups = [g for f in (tmp_path / "updates").glob("*.parquet") for m in [pq.ParquetFile(f).metadata] for g in (m.row_group(k).num_rows for k in range(m.num_row_groups))]
    assert sum(groups) == 1_600_000 and max(groups) < 200_000

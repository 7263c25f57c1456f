"""Queries that answer for all rows, and operators whose work is spread."""

import random

import pytest
from pyspark.sql import functions as F

from offerlens.functions import text
from offerlens.operators import alerts, state
from offerlens.plans import queries, views
from offerlens.sources import payloads

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("slice_rows", [1, 7, 100, 1000])
def test_positions_number_all_rows(spark, slice_rows):
    rng = random.Random(3)
    rows = [(rng.randrange(5), rng.choice("ab\u00e9"), k) for k in range(300)] + [(2, "same", 1000 + k) for k in range(100)]
    df = spark.createDataFrame(rows, "a int, t string, id long").repartition(3)
    got = {r["id"]: r["n"] for r in state.positions(df, [-F.col("a"), F.col("t"), F.col("id")], slice_rows=slice_rows).collect()}
    want = {r[2]: k for k, r in enumerate(sorted(rows, key=lambda r: (-r[0], r[1], r[2])), 1)}
    assert got == want
    assert state.positions(df.limit(0), [F.col("id")]).count() == 0


def test_every_title_and_history_is_answered(spark):
    titles = queries.QUERIES["o_titles_len"](spark, SF).collect()
    assert sorted(r["n"] for r in titles) == list(range(1, views.table(spark, SF, "part").count() + 1))
    assert queries.QUERIES["o_history"](spark, SF).count() == views.history(spark, SF).count()


def test_catalogue_pages_are_bounded_and_whole(spark):
    parts = [("big", k) for k in range(1300)] + [("small", k) for k in range(3)]
    o = spark.createDataFrame([(s, k, 1 + j, 0, 5.0 + j, 1) for s, k in parts for j in range(2)], "source string, product_id long, o1 long, o2 int, price double, in_stock int")
    pages = queries.shop_pages(o).select("source", F.from_json("body", "array<struct<id:long,variants:array<struct<id:long>>>>").alias("b")).collect()
    assert max(len(r["b"]) for r in pages) <= 250
    assert sorted((r["source"], p["id"], len(p["variants"])) for r in pages for p in r["b"]) == sorted((s, k, 2) for s, k in parts)
    assert queries.QUERIES["scan_shopify_catalog"](spark, SF).count() == views.observations(spark, SF).select("source", "product_id").distinct().count()


def test_first_by_kind_cuts_before_rows_meet(spark):
    rows = [(kind, k % 3, k, "s") for kind, n in (("new", 40), ("back", 4), (None, 12)) for k in range(n)]
    first = alerts.first_by_kind(spark.createDataFrame(rows, "kind string, rule_id int, product_id int, source string").repartition(3))
    assert "WindowGroupLimit" in first._jdf.queryExecution().optimizedPlan().toString()
    got = {}
    for r in first.collect():
        got.setdefault((r["kind"], r["more"]), []).append((r["rank"], r["rule_id"], r["product_id"]))
    want = {(kind, more): [(n, *x) for n, x in enumerate(sorted((r[1], r[2]) for r in rows if r[0] == kind)[:10], 1)] for kind, more in (("new", 30), ("back", 0), (None, 2))}
    assert {k: sorted(v) for k, v in got.items()} == want


def test_commands_keep_the_whole_message(spark):
    name, args = "n" * 1500, "word " * 400 + "end"
    parsed = text.command(F.col("c"))
    got = spark.createDataFrame([(f"/{name}@bot {args}",)], "c string").select(parsed[0].alias("name"), parsed[1].alias("args")).first()
    assert (got["name"], got["args"]) == (name, args)
    sent = views.table(spark, SF, "conversations").filter("text is not null").select("conv_id", "turn", F.trim("text").alias("args"))
    assert queries.QUERIES["s_cmd_parse"](spark, SF).select("conv_id", "turn", "args").exceptAll(sent).count() == 0


def test_anchors_read_the_card_around_each_link(spark):
    deep = "<div>" * 7 + "<b>deep</b><a href='/x/p/itmd'>D</a>" + "</div>" * 7
    page = f"""<html><head><title>Shop</title></head><body>
      <div class=c><a href="/car/p/itm1a?x=1"><img src=i>Red <b>car</b></a><div><span>\u20b9499</span> <s>\u20b9 599</s></div></div>
      <div class=c><div><div><a href="/p/ITM2b">Blue car</a></div></div><p>Sold <i>out</i></div>
      <div class=c><p><a href="/p/itm3c">Lone</a><p>\u20b9<p>1,250</div>
      <a href="/help">Help</a>{deep}
      <div class=c>\u20b910 <a href="/p/itm4">Open<a href="/p/itm5">Last"""
    pages = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id int, html string")
    rows = payloads.anchored_offers(pages).orderBy("position").collect()
    assert {r["page_id"] for r in rows} == {1} and {r["title"] for r in rows} == {"Shop"}
    assert [(r["sku"], r["label"], r["price"], r["mrp"], r["in_stock"]) for r in rows] == [
        ("itm1a", "Red car", 499.0, 599.0, 1), ("ITM2b", "Blue car", None, None, 0), ("itm3c", "Lone", 1250.0, None, 1),
        ("itmd", "D", None, None, 1), ("itm4", "Open", 10.0, None, 1), ("itm5", "Last", 10.0, None, 1),
    ]
    assert rows[3]["item"] == "deep"
    assert payloads.anchored_offers(pages, "").count() == 7


def test_anchored_cards_tell_everything(spark):
    page = """<div class=c><a href="/x/p/itm1" title="A car in full, pack of 5"><img src="Placeholder.svg" data-src="//img/a.png 2x" alt="other"></a><div>A car in f...</div><span>4.3</span><span>(1,204)</span><b>\u20b9499</b></div>
      <div class=c><a href="/p/itm2"><img alt="A blue car in full" srcset="http://i/b.png 1x"></a><p>A blue\u2026</p><p>7.5</p><p>5</p><p>\u20b920</p></div>
      <div class=c><p>Plain car</p><a href="/p/itm3" title="x">y</a><p>a</p><p>b</p><p>c</p><p>d</p><p>4</p><p>(9)</p><p>\u20b920</p></div><img src="far.png">"""
    rows = payloads.anchored_offers(spark.createDataFrame([(page,)], "html string")).orderBy("position").collect()
    assert [(r["sku"], r["full_title"], r["price"], r["rating"], r["reviews"], r["image"]) for r in rows] == [
        ("itm1", "A car in full, pack of 5", 499.0, 4.3, 1204, "https://img/a.png"), ("itm2", "A blue car in full", 20.0, 5.0, None, "http://i/b.png"), ("itm3", "Plain car", 20.0, None, None, None),
    ]


def test_positions_split_equal_rows(spark):
    """Half of all rows are equal in every column; they are numbered by several tasks."""
    df = spark.createDataFrame([(1, "same")] * 600 + [(k, "x") for k in range(2, 602)], "a int, n string").repartition(4)
    out = state.positions(df, [F.col("a")], "position", slice_rows=100)
    assert out.columns == ["a", "n", "position"]
    got = sorted((r["position"], r["a"]) for r in out.collect())
    assert [p for p, _ in got] == list(range(1, 1201)) and [a for _, a in got] == [1] * 600 + list(range(2, 602))
    tasks = out.filter("a = 1").select(F.spark_partition_id().alias("t"), F.input_file_name().alias("f")).distinct().count()
    assert tasks > 2

import json

import pytest
from pyspark.sql import functions as F

from offerlens.functions import messages, text
from offerlens.operators import alerts, resolve, state
from offerlens.sources import cards, payloads


def value(spark, column, given):
    return spark.createDataFrame([(given,)], "s string").select(column(F.col("s")).alias("v")).first()[0]


@pytest.mark.parametrize(("given", "want"), [("5-Car Pack of 1:64 Scale", 5), ("Pack of 10", 10), ("Set of 20", 20), ("(5 Monster Trucks)", 5), ("5 Alarm Die Cast Car", 1), ("plain", 1), (None, 1)])
def test_pack_size(spark, given, want):
    assert value(spark, text.pack_size, given) == want


@pytest.mark.parametrize(("given", "want"), [("₹1,299.00", 1299.0), ("₹604", 604.0), ("2,029", 2029.0), ("", None), (None, None)])
def test_price(spark, given, want):
    assert value(spark, text.parse_price, given) == want


def test_brand(spark):
    assert value(spark, text.brand, "Alpha roadster") == "Alpha"
    assert value(spark, text.brand, "x" * 40 + " Alpha") is None
    assert value(spark, text.brand, "Alpha Bravo Delta mix") is None
    assert value(spark, text.brand, "replica Alpha") is None


def test_clean(spark):
    assert value(spark, text.clean, "  ﬁre&amp;ice  one ") == "fire&ice one"


def test_header_safe(spark):
    assert value(spark, text.header_safe, "a\r\nb — é") == "a\\nb ? é"


def test_similarity():
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for k, y in enumerate(b, 1):
                last, row[k] = row[k], last + 1 if x == y else max(row[k], row[k - 1])
        return row[-1]

    for a, b in [("abc", "abc"), ("kitten", "sitting"), ("promo 12", "promo 13"), ("a", "b"), ("xaxbxc", "abc")]:
        assert resolve.similarity(a, b) == pytest.approx(200 * lcs(a, b) / (len(a) + len(b)))


def test_clusters(spark):
    made = [(1, "Alpha roadster red pack of 5"), (2, "Alpha red roadster 5 pack"), (3, "Alpha roadster red"), (4, "Bravo roadster red pack of 5")]
    got = {r["id"]: r["canonical_key"] for r in resolve.clusters(spark.createDataFrame(made, "id int, raw_title string")).collect()}
    assert got[1] == got[2] and len(set(got.values())) == 3


def test_transitions(spark):
    schema = "rule_id int, product_id int, source string, price double, in_stock int, target double, stock_only int"
    mem = "rule_id int, product_id int, source string, price double, in_stock int"
    now = lambda price, stock: spark.createDataFrame([(1, 1, "s", price, stock, 400.0, 1)], schema)
    was = lambda *rows: spark.createDataFrame([(1, 1, "s", *r) for r in rows], mem)
    kind = lambda a, b: alerts.evaluate(a, b).first()["kind"]
    assert kind(now(499.0, 1), was()) == "new"
    assert kind(now(None, 0), was()) is None
    assert kind(now(499.0, 1), was((499.0, 1))) is None
    assert kind(now(499.0, 1), was((499.0, 0))) == "back"
    assert kind(now(350.0, 1), was((499.0, 1))) == "drop"
    assert kind(now(340.0, 1), was((350.0, 1))) is None


def test_price_changes(spark):
    rows = [("a", 1, 5.0), ("a", 2, 5.0005), ("a", 3, None), ("a", 4, 5.0), ("a", 5, 6.0)]
    got = state.price_changes(spark.createDataFrame(rows, "k string, ts int, price double"), ["k"], ["ts"]).collect()
    assert sorted(r["ts"] for r in got) == [1, 4, 5]


def test_rules_are_bounded(spark):
    with pytest.raises(ValueError, match="rules"):
        alerts.bounded(spark.range(alerts.MAX_RULES + 1))


def test_stock_and_price(spark):
    for given, want in [(None, True), ("0", False), ("3", True), ("Unavailable", False), ("yes", True)]:
        assert value(spark, payloads.as_stock, given) is want
    assert value(spark, payloads.as_price, "249900") == 2499.0


def test_service_pages_stop(spark):
    def page(*ids, n=20):
        rows = [{"PId": str(i), "PNm": f"t{i}", "discprice": "5", "MRP": "4", "CrntStock": None} for i in ids]
        return json.dumps({"ProductResponse": json.dumps({"Products": rows})})

    full, other = range(1, 21), range(21, 41)
    rows = [("a", 1, page(*full)), ("a", 2, page(*full)), ("a", 3, page(*other)), ("b", 1, page(*full)), ("b", 2, page(50)), ("b", 3, page(*other)), ("c", 1, "no json"), ("c", 2, page(*full)), ("d", 1, None)]
    got = payloads.service_offers(spark.createDataFrame(rows, "query string, page int, body string"), "s").collect()
    assert {q: sorted(int(r["source_sku"]) for r in got if r["query"] == q) for q in "abcd"} == {"a": list(full), "b": [*full, 50], "c": [], "d": []}
    assert all(r["mrp"] is None and r["in_stock"] == 0 for r in got)


def test_harvest(spark):
    bodies = [None, "", "[", "3", json.dumps({"a": {"name": "n", "id": 1, "x": {"price": 250000}}, "b": [{"title": "gone", "sku": "k", "stock": False}, {"name": "stub", "id": 3}, {"name": "Search results", "id": 4, "price": 1}]})]
    got = payloads.harvested_offers(spark.createDataFrame([(b,) for b in bodies], "body string"), "s").orderBy("source_sku").collect()
    assert [(r["source_sku"], r["price"], r["in_stock"]) for r in got] == [("1", 2500.0, 1), ("k", None, 0)]


def test_cards(spark):
    html = "<p>x</p><div id=c k=7><h2>B</h2><p>one<img src='//i/a b'><br/><a class='tail' title='long one'>B two</a></div><div id=c><b>open"
    df = spark.createDataFrame([(html,), (None,), ("",), ("<div",)], "html string")
    got = df.lateralJoin(cards.ScanCards(F.col("html").outer(), F.lit("id"), F.lit("c"), F.lit("k"))).orderBy("position").collect()
    assert [(r["sku"], r["heading"], r["tail"], r["parts"]) for r in got] == [("7", "B", "B two", ["B", "one", "B two"]), (None, "", "", ["open"])]
    assert got[0]["images"][0] == "//i/a b" and got[0]["titles"][0] == "long one"


def test_grouping_joins_known_products(spark):
    known = spark.createDataFrame([("Alpha", 1, "", "red roadster")], "brand string, pack_size int, numbers string, leader string")
    made = spark.createDataFrame([(1, "Alpha roadsters red"), (2, "Alpha lorry")], "id int, raw_title string")
    got = {r["id"]: r["leader"] for r in resolve.clusters(made, known=known).collect()}
    assert got == {1: "red roadster", 2: "lorry"}


@pytest.mark.parametrize(("given", "want"), [(None, None), ("", None), ("https://cdn.grofers.com/", "https://cdn.grofers.com/"), ("https://o/x", "https://o/x")])
def test_thumbnail(spark, given, want):
    assert value(spark, messages.thumbnail, given) == want

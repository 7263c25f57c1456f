"""Rules by hand values: orders among equals, scales, series of rules, raw titles, failed sources."""

import pytest
from pyspark.sql import functions as F

from offerlens.functions import text
from offerlens.operators import alerts, catalog
from offerlens.sources import payloads

OFFERS = "product_id int, title string, raw_title string, source string, region string, price double, in_stock int, rating double, reviews int, brand string, series string, realism string, pack_size int, is_set int"


def offer(product, source, price, rating=None, reviews=None, title="t", raw=None, series=None, stock=1):
    return (product, title, raw or title, source, "r", price, stock, rating, reviews, "Alpha", series, None, 1, 0)


@pytest.mark.parametrize(("sort", "want"), [("sources", [4, 1, 3, 2]), ("rating", [1, 3, 2, 4])])
def test_ties_go_by_price(spark, sort, want):
    """Unpriced products come first among equals, as an ascending order has nulls."""
    rows = [offer(1, "a", None, 5.0, 1, stock=0), offer(2, "a", 30.0, 4.0, 900), offer(3, "a", 20.0, 4.0, 1), offer(4, "a", 50.0), offer(4, "b", 60.0)]
    page = catalog.page(spark.createDataFrame(rows, OFFERS), catalog.CatalogQuery(sort=sort)).orderBy("position").collect()
    assert [r["product_id"] for r in page] == want


@pytest.mark.parametrize(
    ("title", "scales", "wanted"),
    [("Alpha roadster", [], True), ("Alpha 1:8 roadster", [8], False), ("Alpha 1  :  64", [64], True), ("Alpha 1/18 and 1 /64", [18, 64], True), ("Delta roadster", [], False), ("Delta 1:64", [64], True), ("Alpha 11:64", [], True), ("Alpha 1:643", [643], False), (None, None, False)],
)
def test_scales(spark, title, scales, wanted):
    r = spark.createDataFrame([(title,)], "t string").select(text.scales(F.col("t")).alias("s"), text.wanted(F.col("t")).alias("w")).first()
    assert (r["s"], r["w"]) == (scales, wanted)


def test_hints_reach_keys_and_the_filter(spark):
    df = spark.createDataFrame([("red roadster", "The Alpha shop")], "t string, v string")
    r = df.select(text.canonical_key(F.col("t"), hint=F.col("v")).alias("k"), text.wanted(F.col("t"), hint=F.col("v")).alias("w"), text.wanted(F.col("t")).alias("without")).first()
    assert tuple(r) == ("Alpha|red roadster|p1", True, False)


def test_rules_by_series_and_blank_queries(spark):
    rows = spark.createDataFrame([offer(1, "a", 5.0, title="Red car", series="Promo"), offer(2, "a", 5.0, title="Blue car")], OFFERS)
    fields = "rule_id int, query string, brand string, series string, realism string, pack_min int, pack_max int, sources string, target double, stock_only int, active int"
    rules = spark.createDataFrame([(1, "  ", None, "Promo", None, None, None, None, None, 1, 1), (2, " red ", None, "", None, None, None, " a ,\tb", None, 1, 1), (3, "red", None, "Other", None, None, None, None, None, 1, 1)], fields)
    assert sorted((r["rule_id"], r["product_id"]) for r in alerts.matches(rules, rows).collect()) == [(1, 1), (2, 1)]
    assert alerts.matches(rules.drop("series"), rows).filter("rule_id = 3").count() == 1


def test_text_is_looked_for_in_what_the_seller_wrote(spark):
    rows = spark.createDataFrame([offer(1, "a", 5.0, title="Red car", raw="RED CAR limited"), offer(2, "a", 5.0)], OFFERS)
    assert [r["product_id"] for r in catalog.catalog(rows, catalog.CatalogQuery(text="Limited")).collect()] == [1]
    assert catalog.catalog(rows.drop("raw_title"), catalog.CatalogQuery(text="Limited")).count() == 0


def test_a_failed_source_stores_nothing(spark):
    bodies = [("good", '{"k": 1}'), ("good", '{"k": 2}'), ("bad", '{"k": 3}'), ("bad", "{"), ("null", None), (None, '{"k": 4}')]
    rows, runs = payloads.isolated(spark.createDataFrame(bodies, "source string, body string"), "source", "body", "k int")
    assert sorted((r["source"] or "", r["row"]["k"]) for r in rows.collect()) == [("", 4), ("good", 1), ("good", 2)]
    assert {r["source"]: (r["stored"], r["failed"], r["status"]) for r in runs.collect()} == {"good": (2, 0, "ok"), "bad": (0, 1, "failed"), "null": (0, 1, "failed"), None: (1, 0, "ok")}


@pytest.mark.parametrize(("given", "want"), [("car 5carpack 33", "33"), ("12 pcs of 7 pieces Ages 3+ 99", "99"), ("4 years and up 160/250", "160 250"), ("ages 3 and above 88", "88")])
def test_counts_are_no_models_numbers(spark, given, want):
    got = spark.createDataFrame([(given,)], "t string").select(text.number_words(text.signature(F.col("t"), text.RulePack(noise=("ages", "years", "up"))))).first()[0]
    assert got == want

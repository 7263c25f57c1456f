"""Steps that are dear for a row: dealt over tasks, and made once."""

import pytest
from pyspark.sql import functions as F

from offerlens.operators import resolve
from offerlens.plans import queries, source_queries, views
from offerlens.sources import cards
from offerlens.tables import shared

SF = "/root/testdata/sf0.001"


def test_titles_of_a_small_file_are_dealt_over_tasks(spark):
    assert queries.titles(spark, SF).rdd.getNumPartitions() == shared.partitions(spark) > 1


def test_offers_are_keyed_once(spark):
    rows = queries.titles(spark, SF).withColumnRenamed("t", "raw_title")
    assert "regexp_replace" not in resolve.clusters(rows)._jdf.queryExecution().optimizedPlan().toString()


def test_harvest_by_batches_against_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(cards, "BODIES", 3)
    made = source_queries.made(body=source_queries._HARVEST)(spark, SF).select("body")
    odd = spark.createDataFrame([(b,) for b in (None, "", "{", "3", '[{"id":0,"name":"x"},{"id":7,"name":"y","price":{"value":1}}]')], "body string")
    bodies = made.union(odd)
    got = cards.harvested(bodies)
    assert got.rdd.getNumPartitions() == shared.partitions(spark) > 1
    want = bodies.lateralJoin(cards.HarvestJson(F.col("body").outer())).drop("body")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > made.count()


@pytest.mark.parametrize("name", ["w_latest", "w_change", "up_listing", "j_state", "a_facets_all", "a_facet_brand", "a_facet_price", "a_stats_global", "a_deals"])
def test_many_sightings_are_dealt_by_their_number(spark, monkeypatch, name):
    few = queries.QUERIES[name](spark, SF)
    monkeypatch.setattr(views, "MANY", 0)
    monkeypatch.setattr(views, "SIGHTINGS", 500)
    n = -(-views.table(spark, SF, "lineitem").count() // 500)
    assert views.offers(spark, SF).rdd.getNumPartitions() == views.history(spark, SF).rdd.getNumPartitions() == n > shared.partitions(spark)
    many = queries.QUERIES[name](spark, SF)
    assert many.exceptAll(few).count() == few.exceptAll(many).count() == 0 < few.count()


def test_distinct_products_are_counted_where_they_were_dealt(spark, monkeypatch):
    monkeypatch.setattr(views, "MANY", 0)
    monkeypatch.setattr(views, "SIGHTINGS", 500)
    plan = queries.QUERIES["a_facets_all"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(product_id" in plan and not any("hashpartitioning(facet" in line and "product_id" in line for line in plan.splitlines())

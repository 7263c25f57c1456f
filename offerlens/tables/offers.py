"""Products, listings and price history as tables of one store: keyed upserts of what was seen, and grouping anew.

A listing is what a seller has last said of an offer; a product is what listings with one canonical key have said so far: the longest
title, and of its class and picture what was known first. History has a row where a price appeared or moved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import resolve, state
from . import shared
from .store import Store, Transaction

OFFER = ("source", "source_sku", "region")
#: What an item says, and what listings keep of it beside their key.
ITEM = "source string, source_sku string, region string, raw_title string, brand_hint string, price double, in_stock int, image_url string, ts timestamp_ntz, seq long"
LISTINGS = "source string, source_sku string, region string, product_id long, raw_title string, brand_hint string, price double, in_stock int, image_url string, first_seen timestamp_ntz, scraped_at timestamp_ntz, seq long"
HISTORY = "source string, source_sku string, region string, ts timestamp_ntz, seq long, price double, in_stock int"
PRODUCTS = "id long, canonical_key string, title string, brand string, series string, realism string, pack_size int, is_set int, image_url string, first_seen timestamp_ntz, last_seen timestamp_ntz"
#: Attributes of a product that keep what was known first.
FIRST = ("brand", "series", "realism", "image_url")


def created(t: Transaction, buckets: int = 8) -> Transaction:
    """The three tables, where they are not there yet. Listings and history lie by region and the same bucket of the offer."""
    schema = lambda ddl: t.store.spark.createDataFrame([], ddl).schema
    t.create("listings", schema(LISTINGS), OFFER, ("region",), buckets)
    t.create("history", schema(HISTORY), OFFER, ("region",), buckets)
    t.create("products", schema(PRODUCTS), ("canonical_key",), (), buckets)
    return t


def _names(ddl: str) -> list[str]:
    return [f.split()[0] for f in ddl.split(", ")]


def _sightings(old: DataFrame, items: DataFrame) -> DataFrame:
    """Old listings and new items of the same offers, each with its place in the offer's order and the price before it.

    Both have the number of their part, `_part`, and are gathered by it: one shuffle serves the order, the merge and the writing."""
    was = old.select("_part", *_names(LISTINGS), F.lit(0).alias("fresh"))
    now = items.select("_part", *OFFER, "product_id", "raw_title", "brand_hint", "price", "in_stock", "image_url", F.col("ts").alias("first_seen"), F.col("ts").alias("scraped_at"), "seq", F.lit(1).alias("fresh"))
    w = Window.partitionBy("_part", *OFFER).orderBy("fresh", "scraped_at", "seq")
    rows = was.unionByName(now).repartition("_part")
    return rows.withColumn("nth", F.row_number().over(w)).withColumn("before", F.lag("price").over(w))


def _moved() -> Column:
    return (F.col("nth") == 1) | state.moved(F.col("price"), F.col("before"))


def merged_listings(old: DataFrame, items: DataFrame) -> DataFrame:
    """The last sighting of each offer. A hint once given stays where later sightings give none; first_seen is that of the first one."""
    rows = _sightings(old, items)
    at = F.struct("nth")
    last = F.max_by(F.struct("product_id", "raw_title", "price", "in_stock", "image_url", "scraped_at", "seq"), at).alias("r")
    hint = F.max_by("brand_hint", F.when(F.col("brand_hint").isNotNull(), at)).alias("brand_hint")
    out = rows.groupBy("_part", *OFFER).agg(last, hint, F.min_by("first_seen", at).alias("first_seen"))
    return out.select("_part", *OFFER, "r.product_id", "r.raw_title", "brand_hint", "r.price", "r.in_stock", "r.image_url", "first_seen", "r.scraped_at", "r.seq")


def sink_listings(t: Transaction, items: DataFrame) -> None:
    """items(ITEM, product_id) into listings, and the prices among them that are new or moved into history.

    An offer that is unpriced is kept without a price and makes no history. Items of one offer count in the order of (ts, seq). items are
    read several times, so they are best a table that is written."""
    touched = t.upsert("listings", items, merged_listings, gathered=True)
    seen = t.read("listings", touched)
    seen = items.sparkSession.createDataFrame([], LISTINGS) if seen is None else seen
    placed = t.placed("history", items)
    fresh = _sightings(t.placed("history", seen, items.limit(0)), placed).filter((F.col("fresh") == 1) & _moved() & F.col("price").isNotNull())
    t.append("history", fresh.select("_part", *OFFER, F.col("scraped_at").alias("ts"), "seq", "price", "in_stock"))


def merged_products(old: DataFrame, new: DataFrame) -> DataFrame:
    """Products by canonical key: the longest title (of equal ones the earlier), of class and picture what was known first, ids and pieces as they were."""
    rows = old.select("*", F.lit(0).alias("fresh"), F.lit("").alias("place"))
    now = new.select(*[F.col(c) if c in new.columns else F.lit(None).alias(c) for c in _names(PRODUCTS) if c not in ("first_seen", "last_seen")], F.col("ts").alias("first_seen"), F.col("ts").alias("last_seen"), F.lit(1).alias("fresh"), "place")
    rows = rows.unionByName(now)
    at = F.struct("fresh", "place")
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in FIRST]
    title = F.min_by("title", F.struct((-F.length("title")).alias("n"), at.alias("at"))).alias("title")
    kept = [F.min_by(c, at).alias(c) for c in ("id", "pack_size", "is_set", "first_seen")]
    return rows.groupBy("canonical_key").agg(title, *first, *kept, F.max("last_seen").alias("last_seen")).select(*_names(PRODUCTS))


def numbered(t: Transaction, keys: DataFrame) -> DataFrame:
    """keys(canonical_key) with ids: those of products that are there, and for others numbers after the highest, in the order of keys."""
    old = t.read("products")
    if old is None:
        old = keys.sparkSession.createDataFrame([], PRODUCTS)
    held = old.select("canonical_key", "id")
    top = held.agg(F.max("id")).first()[0] or 0
    new = state.positions(keys.join(shared.large(held), "canonical_key", "left_anti"), [F.col("canonical_key")], "id").withColumn("id", F.col("id") + top)
    return keys.join(shared.large(held), "canonical_key").unionByName(new.select("canonical_key", "id"))


def sink_products(t: Transaction, rows: DataFrame) -> DataFrame:
    """rows(canonical_key, title, brand, series, realism, pack_size, is_set, image_url, ts, place) into products; (canonical_key, id) of theirs.

    place is the order of rows within the batch, as what was known first stays."""
    ids = shared.stored(numbered(t, rows.select("canonical_key").distinct()))
    t.upsert("products", shared.stored(rows.join(shared.large(ids), "canonical_key")), merged_products)
    return ids


def classified(rows: DataFrame, pack: text.RulePack) -> DataFrame:
    """rows with the class of their titles, as products have it."""
    title, hint = F.col("raw_title"), F.col("brand_hint")
    named = text.brand(title, pack, hint=hint)
    return rows.select(
        "*", F.col("raw_title").alias("title"), named.alias("named"), text.series(title, pack).alias("series"), text.realism(title, pack).alias("realism"), text.is_set(title, pack).cast("int").alias("set_of")
    )


def _as_products(rows: DataFrame, ts: Column, place: Column) -> DataFrame:
    return rows.select("canonical_key", "title", F.col("named").alias("brand"), "series", "realism", "pack_size", F.col("set_of").alias("is_set"), "image_url", ts.alias("ts"), place.alias("place"))


def _longest_first() -> Column:
    """Longer titles come first, as they say most; then offers in their order."""
    return F.concat_ws("\1", F.lpad((1_000_000 - F.length("raw_title")).cast("string"), 7, "0"), *OFFER, F.col("seq").cast("string"))


def store_items(store: Store, items: DataFrame, writer: str, batch: int, pack: text.RulePack = text.RulePack(), fantasy: bool = True, threshold: float = 87.0, buckets: int = 8) -> int:
    """A batch of items(ITEM) into the store: filtered, grouped with the products that are there, and written as one version.

    Items that are not wanted are left out. A batch that was stored before changes nothing. The number of the newest version."""
    t = store.begin(writer, batch)
    if t is None:
        return store.version()
    created(t, buckets)
    known = t.read("products")
    if known is not None:
        parts = F.split("canonical_key", r"\|")
        sig = F.element_at(parts, 2)
        known = known.select(F.element_at(parts, 1).alias("brand"), F.substring(F.element_at(parts, 3), F.lit(2), F.lit(9)).cast("int").alias("pack_size"), text.number_words(sig).alias("numbers"), sig.alias("leader"))
    rows = items.filter(text.wanted(F.col("raw_title"), pack, fantasy, F.col("brand_hint")))
    rows = shared.stored(classified(resolve.clusters(rows, "raw_title", pack, threshold, known, "brand_hint"), pack))
    ids = sink_products(t, _as_products(rows, F.col("ts"), _longest_first()))
    sink_listings(t, shared.stored(rows.join(shared.large(ids.withColumnRenamed("id", "product_id")), "canonical_key")))
    return t.commit()


def regroup(store: Store, now: Column, pack: text.RulePack = text.RulePack(), fantasy: bool = True, threshold: float = 87.0) -> int:
    """Products made anew from the listings, by the rules of today, as one version; its number.

    Listings that are not wanted any more go, with the seller's hint taken into account; history stays. Brand, series and realism are
    derived anew; a product whose key is there keeps its id, its pieces, its picture and a title that no listing's is longer than.
    Products without a listing go. A run that fails changes nothing."""
    t = store.begin()
    listings = t.read("listings").filter(text.wanted(F.col("raw_title"), pack, fantasy, F.col("brand_hint")))
    rows = shared.stored(classified(resolve.clusters(listings, "raw_title", pack, threshold, None, "brand_hint"), pack))
    ids = shared.stored(numbered(t, rows.select("canonical_key").distinct()))
    cleared = t.read("products").withColumns({c: F.lit(None).cast("string") for c in ("brand", "series", "realism")}).join(shared.large(ids.select("canonical_key")), "canonical_key", "left_semi")
    made = _as_products(rows, now, _longest_first()).join(shared.large(ids), "canonical_key")
    t.replace("products", merged_products(cleared.select(*_names(PRODUCTS)), made))
    t.replace("listings", shared.stored(rows.drop("product_id").join(shared.large(ids.withColumnRenamed("id", "product_id")), "canonical_key").select(*_names(LISTINGS))))
    return t.commit()

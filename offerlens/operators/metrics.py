"""Statistics, facets, deals, watch lists, price baselines and logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import shared
from .alerts import bounded
from .catalog import MIXED, OTHER, PACK_BANDS, PRICE_BANDS, buyable


#: Parts of a currency unit in which sums are exact.
MICRO = 1_000_000


def mean_price(price: Column) -> Column:
    """The mean of a price to two places, halves up: the sum is a whole number of millionths, in decimals, so no order of rows changes it."""
    total = F.sum(F.round(price * MICRO).cast("decimal(20,0)")).cast("decimal(36,0)")
    cent = F.count(price) * (MICRO // 100)
    return F.when(F.count(price) > 0, F.call_function("div", 2 * total + cent, 2 * cent) / 100.0)


def by_source(offers: DataFrame) -> DataFrame:
    return offers.groupBy("source").agg(
        F.count(F.lit(1)).alias("listings"), F.min("price").alias("lowest"), mean_price(F.col("price")).alias("mean"), F.sum((F.col("in_stock") == 0).cast("long")).alias("sold_out"), F.max("ts").alias("last_seen")
    )


def overall(offers: DataFrame) -> DataFrame:
    """One pass, one row."""
    return offers.agg(
        F.count_distinct("product_id").alias("products"),
        F.count(F.lit(1)).alias("listings"),
        F.count_distinct("source").alias("sources"),
        F.coalesce(F.min(F.when(F.col("in_stock") == 1, F.col("price"))), F.lit(0.0)).alias("cheapest"),
        F.coalesce(F.sum((F.col("in_stock") == 0).cast("long")), F.lit(0)).alias("sold_out"),
        F.coalesce(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("last_scraped"),
    )


def by_region(offers: DataFrame) -> DataFrame:
    return offers.groupBy("region").agg(F.count(F.lit(1)).alias("n"))


def _facet(offers: DataFrame, name: str, value: Column) -> DataFrame:
    return offers.select(value.alias("value"), "product_id").filter("value is not null").groupBy("value").agg(F.count_distinct("product_id").alias("n")).select(F.lit(name).alias("facet"), "value", "n")


def facet(offers: DataFrame, name: str) -> DataFrame:
    """(facet, value, n): distinct products by value; values without any are left out."""
    c = F.col
    values = {
        "brand": F.coalesce(c("brand"), F.lit(OTHER)),
        "series": c("series"),
        "realism": F.coalesce(c("realism"), F.lit(MIXED)),
        "source": c("source"),
    }
    if name in values:
        return _facet(offers, name, values[name])
    bands = {
        "pack": [(k, c("pack_size").between(lo, hi)) for k, (lo, hi) in PACK_BANDS.items()],
        "price": [(k, (c("price") >= lo) & (c("price") < hi)) for k, (lo, hi) in PRICE_BANDS.items()],
        "availability": [("In stock", buyable()), ("Sold out", c("in_stock") == 0)],
    }[name]
    flags = offers.groupBy("product_id").agg(*[F.max(test.cast("int")).alias(f"b{k}") for k, (_, test) in enumerate(bands)])
    sums = flags.agg(*[F.coalesce(F.sum(f"b{k}"), F.lit(0)).cast("long").alias(f"b{k}") for k in range(len(bands))])
    rows = F.explode(F.array(*[F.struct(F.lit(label).alias("value"), F.col(f"b{k}").alias("n")) for k, (label, _) in enumerate(bands)]))
    return sums.select(rows.alias("x")).select(F.lit(name).alias("facet"), "x.value", "x.n").filter("n > 0")


def facets(offers: DataFrame) -> DataFrame:
    """All facets in one pass: each offer gives its value of every facet, and distinct products are counted by facet and value."""
    c = F.col
    label = lambda column, bands, inside: F.coalesce(*[F.when(inside(c(column), lo, hi), k) for k, (lo, hi) in bands.items()])
    values = {
        "brand": F.coalesce(c("brand"), F.lit(OTHER)), "series": c("series"), "realism": F.coalesce(c("realism"), F.lit(MIXED)), "source": c("source"),
        "pack": label("pack_size", PACK_BANDS, lambda x, lo, hi: x.between(lo, hi)), "price": label("price", PRICE_BANDS, lambda x, lo, hi: (x >= lo) & (x < hi)),
        "availability": F.when(buyable(), "In stock").when(c("in_stock") == 0, "Sold out"),
    }
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("facet"), v.alias("value")) for k, v in values.items()]))
    rows = offers.select("product_id", each.alias("x")).select("product_id", "x.facet", "x.value").filter("value is not null")
    return rows.groupBy("facet", "value").agg(F.count_distinct("product_id").alias("n"))


def deals(offers: DataFrame, buyable_only: bool = False) -> DataFrame:
    """Products whose sellers' prices differ."""
    rows = offers.filter(buyable()) if buyable_only else offers
    out = rows.groupBy("product_id", "title").agg(F.min("price").alias("low"), F.max("price").alias("high"), F.count_distinct("source").alias("sources"))
    return out.filter("sources >= 2 and high > low").withColumn("gap", F.round(F.col("high") - F.col("low"), 2))


def watch_best(rules: DataFrame, offers: DataFrame, keep: int = 5) -> DataFrame:
    """For each rule, the products whose title holds its words, with the seller of their best price: the first `keep`.

    rules are few and written by hand; titles are matched once, on products, before offers come in."""
    titles = offers.select("product_id", "title").distinct()
    hits = titles.join(bounded(rules), F.lower("title").contains(F.lower("query")))
    best = offers.groupBy("product_id").agg(F.min("price").alias("best_price"), F.min_by("source", F.when(F.col("price").isNotNull(), F.struct("price", "source"))).alias("best_source"))
    ranked = hits.join(best, "product_id").withColumn("rank", F.row_number().over(Window.partitionBy("rule_id").orderBy(F.col("best_price").asc_nulls_last(), "product_id")))
    hit = F.coalesce((F.col("target") > 0) & (F.col("best_price") <= F.col("target")), F.lit(False))
    return ranked.filter(F.col("rank") <= keep).select("rule_id", "rank", "product_id", "best_price", "best_source", hit.cast("int").alias("hit"))


CLASS = ("brand", "series", "pack_size")


#: Most rows of a table that is sent to all tasks; and prices of one bucket of a class that are sorted in one place.
SENT, FEW = 100_000, 4096
#: Buckets of a price histogram for each doubling of the price, and of one that is refined.
PER_DOUBLING, FINER = 64, 1024


def sent(table: DataFrame) -> DataFrame:
    """table, written once, to be broadcast if it has SENT rows at most; else it is joined by a shuffle."""
    table = shared.stored(table)
    return F.broadcast(table) if table.count() <= SENT else table


def _same_class(rows: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined with table(CLASS, ...) on their class. Only a series may be null here."""
    other = sent(table.select(*[F.col(c).alias(f"_{c}") for c in CLASS], *[c for c in table.columns if c not in CLASS]))
    same = [rows["brand"] == other["_brand"], rows["series"].eqNullSafe(other["_series"]), rows["pack_size"].eqNullSafe(other["_pack_size"])]
    return rows.join(other, same, how).drop(*[f"_{c}" for c in CLASS])


def _boundary(counted: DataFrame, n: Column, rank: Column) -> DataFrame:
    """(CLASS, n, rank, lo, hi, k) of counted(CLASS, bucket, k, lo, hi): the bucket of each class in which its rank lies, and the rank within it.

    A class has as many buckets as a histogram at most, so they are gone through in its row."""
    each = counted.groupBy(*CLASS).agg(n.alias("n"), rank.alias("rank"), F.array_sort(F.collect_list(F.struct("bucket", "k", "lo", "hi"))).alias("buckets"))
    start = F.struct(F.col("rank").alias("left"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(None).cast("long").alias("k"))
    step = lambda s, b: F.when(s["lo"].isNotNull(), s).when(s["left"] < b["k"], F.struct(s["left"].alias("left"), b["lo"].alias("lo"), b["hi"].alias("hi"), b["k"].alias("k"))).otherwise(F.struct((s["left"] - b["k"]).alias("left"), s["lo"].alias("lo"), s["hi"].alias("hi"), s["k"].alias("k")))
    return each.withColumn("at", F.aggregate("buckets", start, step)).select(*CLASS, "n", F.col("at.left").alias("rank"), "at.lo", "at.hi", "at.k")


def class_prices(offers: DataFrame, q: float = 0.1) -> DataFrame:
    """(brand, series, pack_size, n, low): offers that can be bought, and the price at rank floor(n * q) from 0, the last one at most.

    Prices are counted by class and bucket, which tasks do before rows meet; only those of the bucket in which a class's rank lies are
    read again, and sorted if they are few, or counted by finer buckets. So no task holds a class, whatever its share of all offers."""
    rows = shared.stored(offers.filter(buyable() & (F.col("price") > 0) & F.col("brand").isNotNull()).select(*CLASS, "price"))
    hist = rows.groupBy(*CLASS, F.floor(F.log2("price") * PER_DOUBLING).alias("bucket")).agg(F.count(F.lit(1)).alias("k"), F.min("price").alias("lo"), F.max("price").alias("hi"))
    n = F.sum("k")
    state, done = shared.stored(_boundary(hist, n, F.least(F.floor(n * F.lit(q)), n - 1))), []
    while True:
        done.append(state.filter("lo = hi").select(*CLASS, "n", F.col("lo").alias("low")))
        open_ = state.filter("lo < hi")
        inside = _same_class(rows, open_.withColumnRenamed("k", "_k")).filter(F.col("price").between(F.col("lo"), F.col("hi")))
        few = inside.filter(F.col("_k") <= FEW).groupBy(*CLASS).agg(F.max("n").alias("n"), F.element_at(F.array_sort(F.collect_list("price")), (F.max("rank") + 1).cast("int")).alias("low"))
        done.append(few)
        if not open_.filter(F.col("k") > FEW).limit(1).count():
            break
        finer = F.least(F.lit(FINER - 1), F.floor((F.col("price") - F.col("lo")) * FINER / (F.col("hi") - F.col("lo"))))
        many = inside.filter(F.col("_k") > FEW).groupBy(*CLASS, "n", "rank", finer.alias("bucket"))
        state = shared.stored(_boundary(many.agg(F.count(F.lit(1)).alias("k"), F.min("price").alias("lo"), F.max("price").alias("hi")), F.max("n"), F.max("rank")))
    return reduce(DataFrame.union, done)


def with_declared(classes: DataFrame, declared: DataFrame) -> DataFrame:
    """classes with `mrp`: the declared price of brand/series, else of the brand; 0 counts as not declared."""
    exact = declared.select(F.col("name").alias("n1"), F.nullif("mrp", F.lit(0.0)).alias("m1"))
    plain = declared.select(F.col("name").alias("n2"), F.nullif("mrp", F.lit(0.0)).alias("m2"))
    out = classes.join(exact, F.concat_ws("/", "brand", "series") == F.col("n1"), "left").join(plain, F.col("brand") == F.col("n2"), "left")
    return out.withColumn("mrp", F.coalesce("m1", "m2")).drop("n1", "m1", "n2", "m2")


def baselines(offers: DataFrame, declared: DataFrame, least: int = 8) -> DataFrame:
    """(brand, series, pack_size, n, base): declared price by pieces, else the low rank of classes of `least` offers or more."""
    classes = with_declared(class_prices(offers), declared)
    base = F.coalesce(F.col("mrp") * F.greatest("pack_size", F.lit(1)), F.when(F.col("n") >= least, F.col("low")))
    return classes.select(*CLASS, "n", base.alias("base"))


def with_markup(offers: DataFrame, base: DataFrame) -> DataFrame:
    """offers with base and markup: how far a price is above its class's, 0 at least. Offers without a brand have no class and are not joined."""
    base = base.select(*CLASS, "base")
    kind = base.schema["base"].dataType
    joined = _same_class(offers.filter("brand is not null"), base, "left").unionByName(offers.filter("brand is null").withColumn("base", F.lit(None).cast(kind)))
    return joined.withColumn("markup", F.when((F.col("price") > 0) & (F.col("base") > 0), F.greatest(F.lit(0.0), F.col("price") / F.col("base") - 1)))


def send_summary(log: DataFrame, now: Column | None = None, days: int = 7) -> DataFrame:
    """log(id, ts, channel, alerts, ok): totals of the days up to now (the newest row by default), and the newest row."""
    if now is None:
        newest = log.agg(F.max("ts").alias("_now"))  # one row
        log, now = log.join(F.broadcast(newest), F.col("ts") <= F.col("_now")), F.col("_now")
    rows = log.filter(F.col("ts") >= now - F.expr(f"interval {days} days"))
    return rows.agg(
        F.count(F.lit(1)).alias("messages"),
        F.coalesce(F.sum("alerts"), F.lit(0)).cast("long").alias("alerts"),
        F.coalesce(F.sum((F.col("ok") == 0).cast("long")), F.lit(0)).alias("failures"),
        F.max_by("id", F.struct("ts", "id")).alias("newest"),
    )

"""Queries of tables that are written: each makes a store in the shared folder from the driver's tables and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import messages, text
from ..sources import landed
from ..streaming import changes, held, outbox
from ..tables import offers as tables
from ..tables import shared
from ..tables.store import Store
from . import queries as q
from . import views

query, QUERIES = q.query, q.QUERIES

MIDDLE = "2000-01-01"


def _store(s, what: str) -> Store:
    return Store(s, shared.folder(s, what))


def _sightings(s, d):
    """Observations as items; what shops write of an item changes with its seller."""
    o = views.observations(s, d)
    title = F.concat_ws(" ", F.lit("item"), "source_sku", "source")
    return o.select(
        *views.OFFER, "product_id", title.alias("raw_title"), F.when(F.col("o1") % 3 == 0, F.concat(F.lit("v"), F.col("o1").cast("string"))).alias("brand_hint"), "price", "in_stock",
        F.lit(None).cast("string").alias("image_url"), F.col("ts").cast("timestamp_ntz").alias("ts"), (F.col("o1") * 10 + F.col("o2")).alias("seq"),
    )


def _sunk(s, d) -> Store:
    """Sightings in two batches by time, the first of which comes twice, with a run that dies between them."""
    store, rows = _store(s, "sightings"), shared.stored(_sightings(s, d))
    early = F.col("ts") < F.lit(MIDDLE).cast("timestamp_ntz")
    for batch, part in ((0, early), (0, early), (None, ~early), (1, ~early)):
        t = store.begin("sightings", batch if batch is not None else 1)
        if t is not None:
            tables.sink_listings(tables.created(t), rows.filter(part))
            if batch is not None:
                t.commit()
    return store


_SEEN = "+ o as (select *, case when o1 % 3 = 0 then 'v' || o1 end as hint, row_number() over w as n, lag(price) over w as before from observations window w as (partition by source, source_sku, region order by ts, o1 * 10 + o2))"
query("sink_listings", _SEEN + """ select source, source_sku, region, max(product_id) as product_id, arg_max(hint, n) filter (hint is not null) as brand_hint, (list(price order by n))[-1] as price, arg_max(in_stock, n) as in_stock,
  min(ts) as first_seen, max(ts) as scraped_at from o group by all""")(
    lambda s, d: _sunk(s, d).read("listings").select(*views.OFFER, "product_id", "brand_hint", "price", "in_stock", "first_seen", "scraped_at")
)
query("sink_history", _SEEN + """ select source, source_sku, ts, price, in_stock from o
  where price is not null and (n = 1 or before is null or abs(price - before) > 0.001) and region = 'ASIA'""")(
    lambda s, d: _sunk(s, d).read("history", region="ASIA").select("source", "source_sku", "ts", "price", "in_stock")
)


@query("sink_products", """with o as (select p_partkey % 1000 as k, p_partkey, 'key' || p_partkey % 1000 as canonical_key, p_name || ' ' || p_type as title, case when p_brand <> 'Brand#25' then p_brand end as brand,
    case when p_type <> 'STANDARD' then p_type end as series, p_size as pack_size from part)
  select canonical_key, arg_min(title, (-length(title), p_partkey)) as title, arg_min(brand, p_partkey) filter (brand is not null) as brand, arg_min(series, p_partkey) filter (series is not null) as series,
    arg_min(pack_size, p_partkey)::int as pack_size, row_number() over (order by min(p_partkey) >= 600, canonical_key) as id from o group by canonical_key""", "")
def sink_products(s, d):
    """Parts as products in two batches; keys of the second batch come after those of the first in the numbers."""
    store = _store(s, "products")
    rows = views.table(s, d, "part").select(
        F.concat(F.lit("key"), (F.col("p_partkey") % 1000).cast("string")).alias("canonical_key"), F.concat_ws(" ", "p_name", "p_type").alias("title"), F.when(F.col("p_brand") != "Brand#25", F.col("p_brand")).alias("brand"),
        F.when(F.col("p_type") != "STANDARD", F.col("p_type")).alias("series"), F.lit(None).cast("string").alias("realism"), F.col("p_size").cast("int").alias("pack_size"), F.lit(0).alias("is_set"),
        F.lit(None).cast("string").alias("image_url"), F.lit(MIDDLE).cast("timestamp_ntz").alias("ts"), F.lpad(F.col("p_partkey").cast("string"), 20, "0").alias("place"), "p_partkey",
    )
    for batch, part in enumerate((F.col("p_partkey") < 600, F.col("p_partkey") >= 600)):
        t = tables.created(store.begin("parts", batch))
        tables.sink_products(t, rows.filter(part).drop("p_partkey"))
        t.commit()
    return store.read("products").select("canonical_key", "title", "brand", "series", "pack_size", "id")


# ---------------------------------------------------------------- grouping

_SHOP = "case when p_partkey % 3 = 0 then 'the ECHO company' when p_partkey % 3 = 1 then 'Nobody' end"


def items(s, d):
    """An item of each part, as a shop writes it."""
    said = q._said(s, d).withColumnRenamed("t", "raw_title")
    p = views.table(s, d, "part").selectExpr(
        "p_partkey as id", "concat('shop', p_partkey % 7) as source", "cast(p_partkey as string) as source_sku", "concat('R', p_partkey % 5) as region", f"{_SHOP} as brand_hint", "cast(p_retailprice as double) as price",
        "cast(p_size % 3 > 0 as int) as in_stock", "case when p_partkey % 4 > 0 then concat('i/', p_partkey) end as image_url", f"cast('{MIDDLE}' as timestamp_ntz) as ts", "cast(p_partkey as bigint) as seq",
    )
    return said.join(shared.large(p), "id")


_HINTED = f"h as (select b.*, case when {q._PROPER} then case when len(f) = 0 then case when id % 3 = 0 then 'Echo' end else brand end end as told from b)"
_KEPT = q._FITS.replace("(brand is", "(told is").replace("and brand in", "and told in")
GROUPED = f"{q.SCALED}, {_HINTED}, kept as (select * from h where {_KEPT})"


def _grouped(s, d) -> Store:
    """Items of odd parts, then those of even ones, which join the products that are there; the second batch comes twice."""
    store, rows = _store(s, "grouped"), items(s, d)
    for batch, part in ((0, "id % 2 = 1"), (1, "id % 2 = 0"), (1, "id % 2 = 0")):
        tables.store_items(store, rows.filter(part).drop("id"), "items", batch)
    return store


_LISTED = """ select id::varchar as source_sku, 'shop' || id % 7 as source, told as brand, pack as pack_size, p_retailprice::double as price, (p_size % 3 > 0)::int as in_stock
  from kept join part on p_partkey = id"""


def _listed(store: Store):
    p = store.read("products").select(F.col("id").alias("product_id"), "brand", "pack_size")
    return store.read("listings").join(shared.large(p), "product_id").select("source_sku", "source", "brand", "pack_size", "price", "in_stock")


QUERIES["st_group"] = lambda s, d: _grouped(s, d).read("products").select("id", "canonical_key", "title", "brand", "series", "realism", "pack_size", "is_set", "image_url")
query("st_group_listings", _LISTED, GROUPED)(lambda s, d: _listed(_grouped(s, d)))


def _regrouped(s, d, fantasy: bool = True) -> Store:
    """Items filed one by one under keys and classes of older rules, then grouped by the rules of today."""
    store = _store(s, "regrouped")
    t = tables.created(store.begin("items", 0))
    rows = shared.stored(items(s, d)).withColumn("canonical_key", F.when(F.col("id") % 10 == 0, text.canonical_key(F.col("raw_title"), hint=F.col("brand_hint"))).otherwise(F.concat(F.lit("old-"), "source_sku")))
    ids = tables.sink_products(t, rows.select(
        "canonical_key", F.col("raw_title").alias("title"), F.lit("Old").alias("brand"), F.lit("Old").alias("series"), F.lit("Old").alias("realism"), F.lit(1).alias("pack_size"), F.lit(0).alias("is_set"), "image_url", "ts",
        F.lpad("source_sku", 20, "0").alias("place"),
    ))
    tables.sink_listings(t, shared.stored(rows.join(shared.large(ids.withColumnRenamed("id", "product_id")), "canonical_key")))
    t.commit()
    tables.regroup(store, F.lit(MIDDLE).cast("timestamp_ntz"), fantasy=fantasy)
    return store


QUERIES["st_regroup"] = lambda s, d: _regrouped(s, d).read("products").select("id", "canonical_key", "title", "brand", "series", "realism", "pack_size", "is_set", "image_url")


@query("st_regroup_checks", f""" select (select count(*) from kept where {q._REAL}) as listings, (select count(*) from h) as history, (select count(*) from h) as listings_before, 0::bigint as orphans, 0::bigint as empty_products,
  0::bigint as old_classes, (select count(distinct told) from kept where {q._REAL}) as brands, 2::bigint as version""", GROUPED)
def st_regroup_checks(s, d):
    """What holds after a regroup that drops castings without a real car: unwanted listings are gone, history is not, no product is without a listing."""
    store = _regrouped(s, d, fantasy=False)
    products, listings = store.read("products"), store.read("listings")
    linked = listings.select("product_id").distinct()
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    out = one(listings, "listings").crossJoin(one(store.read("history"), "history")).crossJoin(one(store.read("listings", version=1), "listings_before"))  # a row each
    out = out.crossJoin(one(linked.join(shared.large(products), F.col("product_id") == F.col("id"), "left_anti"), "orphans")).crossJoin(one(products.join(shared.large(linked), F.col("product_id") == F.col("id"), "left_anti"), "empty_products"))
    classes = products.agg(F.count(F.when((F.col("brand") == "Old") | (F.col("series") == "Old") | (F.col("realism") == "Old"), 1)).alias("old_classes"), F.count_distinct("brand").alias("brands"))
    return out.crossJoin(classes).withColumn("version", F.lit(store.version()).cast("long"))


# ---------------------------------------------------------------- sources and streams

#: Pages that one query answers with.
PER_QUERY = 50


def answers(s, d) -> str:
    """Pages as the answers of queries, landed; every fifth query's answer breaks off within its last line."""
    p = views.table(s, d, "pages").select(
        F.floor(F.col("page_id") / PER_QUERY).cast("int").alias("query"), F.col("page_id").alias("position"), F.col("page_id").cast("string").alias("sku"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), "url",
        F.when(F.col("page_id") % 3 > 0, (F.col("page_id") % 100).cast("double")).alias("price"),
    )
    whole = F.to_json(F.struct("sku", "title", "url", "price"))
    broken = (F.col("query") % 5 == 3) & (F.col("position") % PER_QUERY == 0)
    line = F.when(broken, F.substring(whole, F.lit(1), F.length(whole) - 3)).otherwise(whole)
    return landed.land_answers(p.select("query", "position", line.alias("line")), shared.folder(s, "answers"))


query("src_contract", f"""with p as (select (page_id // {PER_QUERY})::int as query, page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, case when page_id % 3 > 0 then (page_id % 100)::double end as price,
    row_number() over (partition by page_id // {PER_QUERY} order by page_id) - 1 as position from pages)
  select query, position, page_id::varchar as sku, title, url, price, false as failed from p where query % 5 <> 3 and (price is null or (price > 0 and price <= 60))
  union all select distinct query, null, null, null, null, null, true from p where query % 5 = 3""", "")(
    lambda s, d: landed.registered(s).read.format("landed").option("path", answers(s, d)).option("ceiling", "60").load().withColumn("failed", F.col("error").isNotNull()).drop("error")
)


def stream_offset(s, d):
    """All events after a cursor, in polls of at most 20,000, as many a batch as shuffles have tasks, into a table; the stream is stopped after its first polls and started again."""
    e = views.table(s, d, "events").select(F.col("event_id").alias("update_id"), F.col("user_id").alias("chat"), "event_type")
    path, out = landed.land_updates(e, shared.folder(s, "updates")), shared.folder(s, "stream")
    for _ in range(2):
        stream = landed.registered(s).readStream.format("updates").option("path", path).option("start", "100").option("most", "20000").option("polls", shared.partitions(s)).load()
        told = stream.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").option("path", out).start()
        told.processAllAvailable()
        told.stop()
    return s.read.schema(e.schema).parquet(out)


query("stream_offset", "select event_id as update_id, user_id as chat, event_type from events where event_id > 100", "")(stream_offset)


#: How far rows may be behind the newest one that arrived.
DELAY_HOURS = 48


#: Events of one file of arrivals, about; and the parts of the time in which they arrive, each of which is taken at once.
PER_FILE, SLICES = 1_000_000, 4


def arrivals(s, d) -> tuple[str, int]:
    """Events in files of the order in which they arrive, each up to DELAY_HOURS late; and one row that ends all waiting. The folder, and the files of a slice.

    A slice has as many files as its share of the events needs, and all slices have as many, so a stream that takes that many files at
    once takes slice by slice: the passes over the events, and how often a key is called, do not grow with the events."""
    e = views.table(s, d, "events").select(
        F.col("user_id").cast("long").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("seq"), F.col("value").cast("double").alias("price"), (F.col("event_type") != "error").cast("int").alias("in_stock")
    )
    late = F.unix_timestamp("ts") + F.pmod(F.xxhash64("seq"), F.lit(DELAY_HOURS * 3600 - 1))
    lo, hi, n = e.agg(F.min(F.unix_timestamp("ts")), F.max(F.unix_timestamp("ts")), F.count(F.lit(1))).first()
    files = -(-n // (SLICES * PER_FILE)) or 1
    width = ((hi or 0) - (lo or 0) + DELAY_HOURS * 3600) // SLICES + 1
    folder = shared.folder(s, "arrivals")
    for k in range(SLICES):
        at = f"{folder}/{k}"
        e.filter(F.floor((late - F.lit(lo or 0)) / width) == k).repartition(files).write.parquet(at)
        for _ in range(files - len(s.read.schema(e.schema).parquet(at).inputFiles())):
            e.limit(0).coalesce(1).write.mode("append").parquet(at)  # a slice of few events: the next one must not be taken with it
    end = e.limit(0).unionByName(s.range(1).select(F.lit(-1).cast("long").alias("key"), F.timestamp_seconds(F.lit((hi or 0) + 10**7)).alias("ts"), F.lit(0).cast("long").alias("seq"), F.lit(None).cast("double").alias("price"), F.lit(0).alias("in_stock")))
    end.coalesce(1).write.parquet(f"{folder}/{SLICES}")
    return folder, files


def _held(s, d, operator, gives: str):
    folder, files = arrivals(s, d)
    schema = s.read.parquet(f"{folder}/0").schema
    return held.run_available(s, f"{folder}/*", schema, lambda x: x, shared.folder(s, "held"), operator, gives, files)[0]


query("stream_change_held", q.ORACLES["stream_change"], "")(lambda s, d: _held(s, d, lambda x: held.price_changes(x.drop("in_stock"), f"{DELAY_HOURS} hours"), changes.CHANGED))
query("stream_alerts_held", q.ORACLES["stream_alerts"], "")(lambda s, d: _held(s, d, lambda x: held.transitions(x, f"{DELAY_HOURS} hours", target=50.0), changes.TOLD))


@query("sink_notify", q._MATCH + " select rule_id::varchar as channel, count(*)::bigint as alerts, 'sent' as state, true as delivered_once from ev where kind is not null group by 1")
def sink_notify(s, d):
    """What the rules tell, a channel a rule, through the outbox: queued twice, delivered twice, and read back from where it was delivered."""
    c = F.col
    link = F.concat(F.lit("https://shop.example/"), c("product_id").cast("string"))
    rows = q.evaluated(s, d).filter("kind is not null").select(
        c("rule_id").cast("string").alias("channel"), "product_id", "source", messages.alert_line(c("title"), c("price"), c("source"), c("kind"), c("was_price"), c("target"), link).alias("line"),
        messages.caption(c("title"), c("price"), c("source"), c("kind"), c("was_price"), link).alias("caption"), F.when(c("product_id") % 3 > 0, F.concat(F.lit("i/"), c("product_id").cast("string"))).alias("url"),
    )
    store, folder = _store(s, "outbox"), shared.folder(s, "delivered")
    made = shared.stored(outbox.composed(rows, [c("product_id"), c("source")]))
    for _ in range(2):
        outbox.queue(store, made, "rules", 0)
        outbox.deliver(store, outbox.to_folder(folder))
    queued = store.read("outbox").groupBy("channel").agg(F.sum("alerts").alias("alerts"), F.max("state").alias("state"), F.count(F.lit(1)).alias("queued"), F.max("attempts").alias("attempts"))
    out = s.read.schema("channel string, shape string, body string").json(folder).groupBy("channel").agg(F.count(F.lit(1)).alias("arrived"))
    return queued.join(out, "channel", "left").select("channel", "alerts", "state", ((c("queued") == c("arrived")) & (c("attempts") == 1)).alias("delivered_once"))

"""Queries over the driver's tables, by operator, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import alerts, metrics, resolve, state
from ..operators.catalog import PRICE_BANDS, CatalogQuery, buyable, catalog, ceiling, clamped, filtered, page, with_offers
from ..sources import payloads
from ..streaming import changes
from ..tables import shared
from . import views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
REGION = "ASIA"

PRODUCTS = """products as (
  select p_partkey as id, p_name as title, case when p_brand <> 'Brand#25' then p_brand end as brand, case when p_type <> 'STANDARD' then p_type end as series,
         (p_size % 8 + 1)::int as pack_size, (p_size % 8 + 1 > 1)::int as is_set,
         case when p_size % 8 + 1 > 1 then null when p_partkey % 3 = 0 then 'Fantasy' else 'Realistic' end as realism
  from part)"""
OBSERVATIONS = """observations as (
  select l_partkey as product_id, l_partkey::varchar as source_sku, s_name as source, r_name as region, l_shipdate as ts, l_orderkey as o1, l_linenumber as o2,
         case when not ((l_returnflag = 'R' and l_linestatus = 'F') or (l_returnflag = 'A' and l_linenumber = 7)) then l_extendedprice end as price,
         case when l_returnflag = 'R' then 0 else 1 end as in_stock,
         case when l_linenumber <> 6 then (l_linenumber % 5 + 1)::double end as rating, case when l_linenumber <> 6 then l_quantity::int end as reviews
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""
LISTINGS = """listings as (
  select * exclude (rn) from (select *, row_number() over (partition by source, source_sku, region order by ts desc, o1 desc, o2 desc) as rn from observations) where rn = 1)"""
SEEN = """seen as (
  select * exclude (rn) from (select *, row_number() over (partition by source, source_sku, region order by ts desc, o1 desc, o2 desc) as rn from observations
                              where ts < timestamp '2000-01-01') where rn = 1)"""
HISTORY = """history as (
  select * exclude (n, before) from (select *, row_number() over w as n, lag(price) over w as before from observations window w as (partition by source, source_sku, region order by ts, o1, o2))
  where price is not null and (n = 1 or before is null or abs(price - before) > 0.001))"""
OFFERS = "offers as (select l.*, p.title, p.brand, p.series, p.pack_size, p.is_set, p.realism, p.title || ' by ' || l.source as raw_title from listings l join products p on l.product_id = p.id)"
WITH = f"with {PRODUCTS}, {OBSERVATIONS}, {LISTINGS}, {SEEN}, {HISTORY}, {OFFERS}"


def query(name: str, sql: str | None = None, prefix: str = WITH):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = f"{prefix}{',' if sql.lstrip().startswith('+') else ''} {sql.lstrip().lstrip('+')}" if prefix else sql
        return f

    return add


def offers(spark, sf):
    return views.offers(spark, sf)


# ---------------------------------------------------------------- state

query("w_latest", "select * from listings")(views.listings)
query("w_change", "select * from history")(views.history)
query("up_listing", "select * from listings")(
    lambda s, d: state.upsert(
        views.seen_before(s, d),
        state.latest(views.by_offer(s, d, views.tasks(s, d)).filter(F.col("ts") >= F.lit("2000-01-01").cast("timestamp_ntz")), views.OFFER, ("ts", "o1", "o2")),
        views.OFFER,
    )
)
query("w_first_seen", "select source, source_sku, region, min(ts) as first_seen, max(ts) as last_seen from observations group by all")(lambda s, d: state.seen_span(views.observations(s, d), views.OFFER))


@query("w_first_nonnull", """select product_id, first(rating order by ts, o1, o2, source) filter (rating is not null) as rating, first(price order by ts, o1, o2, source) filter (price is not null) as price,
  arg_min(source, (-length(source), ts, o1, o2, source)) as source from observations group by product_id""")
def w_first_nonnull(s, d):
    return state.merge_entities(views.observations(s, d), ["product_id"], ["ts", "o1", "o2", "source"], ["rating", "price"], title="source")


query("up_product", ORACLES["w_first_nonnull"], "")(w_first_nonnull)
query("w_hint", "select source, source_sku, region, arg_max(price, (ts, o1, o2)) filter (price is not null) as price from observations group by all")(
    lambda s, d: state.newest_known(views.observations(s, d), views.OFFER, "price", ("ts", "o1", "o2"))
)


@query("up_kv", "select user_id as k, arg_max(value, event_id) as v from events group by 1", "")
def up_kv(s, d):
    rows = views.table(s, d, "events").select(F.col("user_id").alias("k"), F.col("value").alias("v"), F.col("event_id").alias("n"))
    return state.latest(rows, ["k"], ["n"]).select("k", "v")


@query("w_last12", "select product_id, source, region, ts, o1, o2, price from (select *, row_number() over (partition by source, source_sku, region order by ts desc, o1 desc, o2 desc) as n from history) where n <= 12")
def w_last12(s, d):
    w = Window.partitionBy(*views.OFFER).orderBy(F.desc("ts"), F.desc("o1"), F.desc("o2"))
    return views.history(s, d).withColumn("n", F.row_number().over(w)).filter("n <= 12").select("product_id", "source", "region", "ts", "o1", "o2", "price")


@query("st_runs", """select event_id as id, user_id as source, ts as started, case when event_type = 'view' then null else ts end as finished,
  case when event_type = 'view' then 'interrupted' else 'ok' end as status from events""", "")
def st_runs(s, d):
    e = views.table(s, d, "events")
    finished = F.when(F.col("event_type") != "view", F.col("ts"))
    return state.runs(e.select(F.col("event_id").alias("id"), F.col("user_id").alias("source"), F.col("ts").alias("started"), finished.alias("finished")))


# ---------------------------------------------------------------- catalogue

CATALOG_SQL = """select product_id, title, brand, series, realism, pack_size, is_set, min(price) as best_price, max(price) as worst_price, count(distinct source) as source_count,
  sum((in_stock = 1 and price is not null)::bigint)::bigint as buyable_count, sum((in_stock = 0)::bigint)::bigint as oos_count, max(rating) as rating, max(reviews) as reviews,
  coalesce(round(max(price) - min(price), 2), 0) as savings from offers {where} group by all"""

_FILTERS = {
    "a_catalog": ({}, "true"),
    "j_catalog": ({"region": "EUROPE"}, "region = 'EUROPE'"),
    "a_savings": ({"region": "AFRICA", "in_stock": True}, "region = 'AFRICA' and in_stock = 1 and price is not null"),
    "f_region": ({"region": REGION}, "region = 'ASIA'"),
    "f_text": ({"text": "WIDGET"}, "(title ilike '%widget%' or raw_title ilike '%widget%')"),
    "f_text_raw": ({"text": "by supplier#000000003"}, "(title ilike '%by supplier#000000003%' or raw_title ilike '%by supplier#000000003%')"),
    "f_in_source": ({"sources": ("Supplier#000000001", "Supplier#000000003")}, "source in ('Supplier#000000001', 'Supplier#000000003')"),
    "f_in_brand": ({"brands": ("Brand#3", "Other")}, "(brand in ('Brand#3') or brand is null)"),
    "f_series": ({"series": "PROMO"}, "series = 'PROMO'"),
    "f_realism": ({"realism": "Mixed"}, "realism is null"),
    "f_realism_named": ({"realism": "Fantasy"}, "realism = 'Fantasy'"),
    "f_pack_bands": ({"packs": ("Single", "4-5 pack", "no such band")}, "(pack_size between 1 and 1 or pack_size between 4 and 5)"),
    "f_price_band": ({"price_band": "25k-50k"}, "price >= 25000 and price < 50000"),
    "f_min": ({"min_price": 40_000.0}, "price >= 40000"),
    "f_max": ({"max_price": 40_000.0}, "(price is null or price <= 40000)"),
    "f_ceiling": ({"max_price": ceiling(60_000.0, 30_000.0)}, "(price is null or price <= 30000)"),
    "f_in_stock": ({"in_stock": True}, "in_stock = 1 and price is not null"),
    "f_oos": ({"sold_out": True}, "in_stock = 0"),
    "f_sets": ({"sets": True}, "is_set = 1"),
}
for _name, (_kw, _where) in _FILTERS.items():
    query(_name, CATALOG_SQL.format(where=f"where {_where}"))(lambda s, d, kw=_kw: catalog(offers(s, d), CatalogQuery(**kw)))
query("p_dynamic_sql", "select * from offers where region = 'ASIA' and (title ilike '%gear%' or raw_title ilike '%gear%') and price >= 10000 and in_stock = 0")(
    lambda s, d: filtered(offers(s, d), CatalogQuery(region=REGION, text="gear", min_price=10_000.0, sold_out=True)).drop("id")
)
query("f_keep", "select source, source_sku, region, price from listings where price is null or (price > 0 and price <= 50000)")(
    lambda s, d: views.listings(s, d).filter(payloads.within(F.col("price"), 50_000.0)).select("source", "source_sku", "region", "price")
)
query("p_offer_cols", "select product_id, source, region, price, in_stock, coalesce(series, title) as image from offers")(
    lambda s, d: offers(s, d).select("product_id", "source", "region", "price", "in_stock", F.coalesce("series", "title").alias("image"))
)

_ORDERS = {
    "price": "(buyable_count = 0), (best_price is null), best_price",
    "price_desc": "(buyable_count = 0), (best_price is null), best_price desc",
    "savings": "(worst_price - best_price) desc nulls last",
    "sources": "source_count desc, best_price asc nulls first",
    "rating": "rating desc nulls last, best_price asc nulls first",
    "title": "title",
    "default": "best_price asc nulls first",
}
for _name, _order in _ORDERS.items():
    _ranked = f"""+ c as ({CATALOG_SQL.format(where="where region = 'ASIA'")}), r as (select *, row_number() over (order by {_order}, product_id) as position from c)
      select *, (select count(*) from c) > 100 as has_more from r where position > 40 and position <= 101"""
    query(f"o_{_name}", _ranked)(lambda s, d, n=_name: page(offers(s, d), CatalogQuery(region=REGION, sort=n, limit=60, offset=40)))
query("o_page", ORACLES["o_price"], "")(QUERIES["o_price"])
query("o_top", f"+ c as ({CATALOG_SQL.format(where='where in_stock = 1 and price is not null')}) select product_id, best_price from c order by best_price, product_id limit 8")(
    lambda s, d: catalog(offers(s, d), CatalogQuery(in_stock=True)).orderBy("best_price", "product_id").limit(8).select("product_id", "best_price")
)


@query("j_offers", f"""+ c as ({CATALOG_SQL.format(where="where region = 'ASIA'")}), r as (select product_id from c order by (buyable_count = 0), (best_price is null), best_price, product_id limit 61)
  select product_id, count(*) as n_offers, string_agg(source || ':' || source_sku, ',' order by price is null, price, source, source_sku, region) as offers
  from offers join r using (product_id) group by product_id""")
def j_offers(s, d):
    o = offers(s, d)
    nested = with_offers(page(o, CatalogQuery(region=REGION)).select("product_id"), o)
    names = F.array_join(F.transform("offers", lambda x: F.concat(x["source"], F.lit(":"), x["source_sku"])), ",")
    return nested.select("product_id", F.size("offers").cast("long").alias("n_offers"), names.alias("offers"))


@query("j_history", "select h.product_id, h.ts, h.price, h.o1, h.o2, l.price as now from history h join listings l using (source, source_sku, region)")
def j_history(s, d):
    now = views.listings(s, d).select(*views.OFFER, F.col("price").alias("now"))
    return views.history(s, d).join(now, list(views.OFFER)).select("product_id", "ts", "price", "o1", "o2", "now")


@query("o_history", "select product_id, source, ts, price, row_number() over (partition by product_id order by ts, o1, o2, source) as n from history")
def o_history(s, d):
    """The history of every product in the order of time."""
    w = Window.partitionBy("product_id").orderBy("ts", "o1", "o2", "source")
    return views.history(s, d).withColumn("n", F.row_number().over(w)).select("product_id", "source", "ts", "price", "n")


query("j_orphans", "select id from products where id not in (select product_id from listings where region = 'ASIA')")(
    lambda s, d: views.products(s, d).join(views.listings(s, d).filter(F.col("region") == REGION), F.col("id") == F.col("product_id"), "left_anti").select("id")
)
query("j_labels", "select source, coalesce(n_name, source) as label, count(*) as n from listings left join (select * from supplier join nation on s_nationkey = n_nationkey where s_suppkey % 2 = 0) on source = s_name group by all")(
    lambda s, d: views.listings(s, d)
    .join(views.table(s, d, "supplier").filter("s_suppkey % 2 = 0").join(views.table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_name", "n_name"), F.col("source") == F.col("s_name"), "left")
    .groupBy("source", F.coalesce("n_name", "source").alias("label")).agg(F.count(F.lit(1)).alias("n"))
)

# ---------------------------------------------------------------- metrics

_MEAN = "case when count(price) > 0 then ((2 * sum(round(price * 1000000)::bigint) + count(price) * 10000) // (2 * count(price) * 10000))::bigint / 100.0::double end"
query("a_stats_source", f"select source, count(*) as listings, min(price) as lowest, {_MEAN} as mean, sum((in_stock = 0)::bigint)::bigint as sold_out, max(ts) as last_seen from listings group by source")(lambda s, d: metrics.by_source(views.listings(s, d)))
query("a_stats_global", """select count(distinct product_id) as products, count(*) as listings, count(distinct source) as sources, coalesce(min(price) filter (in_stock = 1), 0) as cheapest,
  coalesce(sum((in_stock = 0)::bigint), 0)::bigint as sold_out, coalesce(strftime(max(ts), '%Y-%m-%d %H:%M:%S'), '') as last_scraped from offers""")(lambda s, d: metrics.overall(offers(s, d)))
query("a_stats_regions", "select region, count(*) as n from listings group by region")(lambda s, d: metrics.by_region(views.listings(s, d)))

_FACET_SQL = {
    "brand": "select 'brand' as facet, coalesce(brand, 'Other') as value, count(distinct product_id) as n from offers group by 2",
    "series": "select 'series' as facet, series as value, count(distinct product_id) as n from offers where series is not null group by 2",
    "realism": "select 'realism' as facet, coalesce(realism, 'Mixed') as value, count(distinct product_id) as n from offers group by 2",
    "source": "select 'source' as facet, source as value, count(distinct product_id) as n from offers group by 2",
    "pack": "select 'pack' as facet, case when pack_size = 1 then 'Single' when pack_size <= 3 then '2-3 pack' when pack_size <= 5 then '4-5 pack' else '6+ pack' end as value, count(distinct product_id) as n from offers group by 2",
    "price": "select 'price' as facet, case " + " ".join(f"when price >= {lo} and price < {hi} then '{k}'" for k, (lo, hi) in PRICE_BANDS.items()) + " end as value, count(distinct product_id) as n from offers where price >= 0 and price < 100000 group by 2",
    "availability": "select 'availability' as facet, 'In stock' as value, count(distinct product_id) as n from offers where in_stock = 1 and price is not null having n > 0 union all select 'availability', 'Sold out', count(distinct product_id) as n from offers where in_stock = 0 having n > 0",
}
for _name, _sql in _FACET_SQL.items():
    query(f"a_facet_{_name}", _sql)(lambda s, d, n=_name: metrics.facet(offers(s, d), n))
query("a_facets_all", " union all ".join(f"({x})" for x in _FACET_SQL.values()))(lambda s, d: metrics.facets(offers(s, d)))

_DEALS = "select product_id, title, min(price) as low, max(price) as high, count(distinct source) as sources, round(max(price) - min(price), 2) as gap from offers group by all having count(distinct source) >= 2 and max(price) > min(price)"
query("a_deals", _DEALS)(lambda s, d: metrics.deals(offers(s, d)))
query("o_deals_topk", f"{_DEALS} order by gap desc, product_id limit 20")(lambda s, d: metrics.deals(offers(s, d)).orderBy(F.desc("gap"), "product_id").limit(20))

RULE_ROWS = [
    (1, "*", None, None, None, None, None, None, 20_000.0, 1, 1),
    (2, " widget", "Brand#3", None, None, None, None, None, 0.0, 1, 1),
    (3, "*", None, None, "Fantasy", 1, 1, None, None, 1, 1),
    (4, "gear", None, None, None, None, None, None, None, 0, 1),
    (5, "*", None, None, None, None, None, "Supplier#000000001, Supplier#000000002", 30_000.0, 1, 1),
    (6, "bolt", None, None, None, None, None, None, None, 1, 0),
    (7, "*", None, "PROMO", None, 2, None, None, 25_000.0, 1, 1),
]
RULE_SCHEMA = "rule_id int, query string, brand string, series string, realism string, pack_min int, pack_max int, sources string, target double, stock_only int, active int"
_lit = lambda x: "null" if x is None else repr(x)
RULES_SQL = "rules(rule_id, query, brand, series, realism, pack_min, pack_max, sources, target, stock_only, active) as (values " + ", ".join("(" + ", ".join(map(_lit, r)) + ")" for r in RULE_ROWS) + ")"


def rules(s: SparkSession) -> DataFrame:
    return s.createDataFrame(RULE_ROWS, RULE_SCHEMA)


_WATCH = f"""+ {RULES_SQL}, b as (select product_id, min(price) as best_price, arg_min(source, (price, source)) filter (price is not null) as best_source from offers group by 1),
  h as (select distinct rule_id, target, product_id from rules join offers on contains(lower(title), lower(query)) where query <> '*'),
  r as (select *, row_number() over (partition by rule_id order by best_price asc nulls last, product_id) as rank from h join b using (product_id))
  select rule_id, rank, product_id, best_price, best_source, coalesce(target > 0 and best_price <= target, false)::int as hit from r where rank <= 5"""
for _name in ("a_watch_best", "o_watch_top5", "j_watch_like"):
    query(_name, _WATCH)(lambda s, d: metrics.watch_best(rules(s).filter("query <> '*'"), offers(s, d)))

DECLARED = [("Brand#1", 30_000.0), ("Brand#1/PROMO", 45_000.0), ("Brand#2", 0.0)]
_BASE = """+ mrp(name, mrp) as (values ('Brand#1', 30000.0::double), ('Brand#1/PROMO', 45000.0::double), ('Brand#2', 0.0::double)),
  cls as (select brand, series, pack_size, count(*) as n, list_sort(list(price)) as ps from offers where in_stock = 1 and price > 0 and brand is not null group by 1, 2, 3),
  low as (select brand, series, pack_size, n, ps[least(floor(n * 0.1::double)::int, n - 1) + 1] as low from cls),
  dec as (select l.*, coalesce(nullif(e.mrp, 0), nullif(p.mrp, 0)) as mrp from low l left join mrp e on concat_ws('/', l.brand, l.series) = e.name left join mrp p on l.brand = p.name),
  base as (select brand, series, pack_size, n, coalesce(mrp * greatest(pack_size, 1), case when n >= 8 then low end) as base from dec)"""


def declared(s: SparkSession) -> DataFrame:
    return s.createDataFrame(DECLARED, "name string, mrp double")


query("a_percentile", _BASE + " select brand, series, pack_size, n, low from low")(lambda s, d: metrics.class_prices(offers(s, d)))
query("j_mrp", _BASE + " select brand, series, pack_size, n, low, mrp from dec")(lambda s, d: metrics.with_declared(metrics.class_prices(offers(s, d)), declared(s)))
query("a_baseline", _BASE + " select * from base")(lambda s, d: metrics.baselines(offers(s, d), declared(s)))
_MARKUP = _BASE + """ select o.product_id, o.source, o.region, o.price, b.base, case when o.price > 0 and b.base > 0 then greatest(0, o.price / b.base - 1) end as markup
  from offers o left join base b on o.brand is not distinct from b.brand and o.series is not distinct from b.series and o.pack_size is not distinct from b.pack_size"""


def _marked_up(s, d):
    """Offers beside the baselines that come from them: they are written once, and read for both."""
    o = shared.stored(offers(s, d).select("product_id", "source", "region", "price", "in_stock", *metrics.CLASS))
    return metrics.with_markup(o, metrics.baselines(o, declared(s)))


for _name in ("j_baseline", "s_markup"):
    query(_name, _MARKUP)(lambda s, d: _marked_up(s, d).select("product_id", "source", "region", "price", "base", "markup"))


def send_log(s, d):
    return views.table(s, d, "events").select(F.col("event_id").alias("id"), "ts", F.col("event_type").alias("channel"), F.get_json_object("props", "$.k").cast("int").alias("alerts"), (F.col("event_type") != "error").cast("int").alias("ok"))


_LOG = "with log as (select event_id as id, ts, event_type as channel, (props->>'$.k')::int as alerts, (event_type <> 'error')::int as ok from events)"
query("a_send_summary", """select count(*) as messages, coalesce(sum(alerts), 0)::bigint as alerts, coalesce(sum((ok = 0)::bigint), 0)::bigint as failures, arg_max(id, (ts, id)) as newest
  from log where ts >= (select max(ts) from log) - interval 7 day""", _LOG)(lambda s, d: metrics.send_summary(send_log(s, d)))
query("o_recent_sends", "select id, ts, channel, alerts, ok from log order by ts desc, id desc limit 20", _LOG)(lambda s, d: send_log(s, d).orderBy(F.desc("ts"), F.desc("id")).limit(20))
query("a_kinds", "select string_agg(channel || '=' || n, ', ' order by channel) as kinds from (select channel, count(*) as n from log group by 1)", _LOG)(
    lambda s, d: send_log(s, d).groupBy("channel").count().agg(F.array_join(F.array_sort(F.collect_list(F.concat("channel", F.lit("="), F.col("count").cast("string")))), ", ").alias("kinds"))
)
query("a_run_totals", "select o.region, count(distinct source) as sources, count(*) as stored, (select count(*) from history h where h.region = o.region) as changes from observations o group by 1")(
    lambda s, d: views.observations(s, d).groupBy("region").agg(F.count_distinct("source").alias("sources"), F.count(F.lit(1)).alias("stored"))
    .join(views.history(s, d).groupBy("region").agg(F.count(F.lit(1)).alias("changes")), "region")
)
query("a_exists", "select count(*) = 0 as first_run from seen where region = 'NOWHERE'")(lambda s, d: views.seen_before(s, d).filter("region = 'NOWHERE'").agg((F.count(F.lit(1)) == 0).alias("first_run")))
query("a_counts", "select (select count(distinct product_id) from seen) as before, (select count(distinct product_id) from listings) as after")(
    lambda s, d: views.seen_before(s, d).select("product_id", F.lit(0).alias("now")).union(views.listings(s, d).select("product_id", F.lit(1)))
    .agg(F.count_distinct(F.when(F.col("now") == 0, F.col("product_id"))).alias("before"), F.count_distinct(F.when(F.col("now") == 1, F.col("product_id"))).alias("after"))
)

# ---------------------------------------------------------------- alerts

_MATCH = f"""+ {RULES_SQL}, fits as (select r.rule_id, r.target, r.stock_only, o.* from offers o join rules r on r.active = 1
    and (trim(coalesce(r.query, '')) in ('', '*') or contains(lower(o.title), lower(trim(r.query)))) and (coalesce(r.brand, '') = '' or r.brand = o.brand)
    and (coalesce(r.series, '') = '' or r.series = o.series)
    and (coalesce(r.realism, '') = '' or r.realism = o.realism) and (r.pack_min is null or o.pack_size >= r.pack_min) and (r.pack_max is null or o.pack_size <= r.pack_max)
    and (coalesce(r.sources, '') = '' or list_contains(list_transform(string_split(r.sources, ','), lambda x: trim(x)), o.source)) where o.region = 'ASIA'),
  then_ as (select s.*, p.title, p.brand, p.series, p.realism, p.pack_size from seen s join products p on s.product_id = p.id where s.region = 'ASIA'),
  best as (select * exclude (rn) from (select *, row_number() over (partition by rule_id, product_id, source order by in_stock desc, price is null, price, source_sku, region) as rn from fits) where rn = 1),
  mem as (select rule_id, product_id, source, price as was_price, in_stock as was_stock, true as seen from then_ o join rules r on r.active = 1
    and (trim(coalesce(r.query, '')) in ('', '*') or contains(lower(o.title), lower(trim(r.query)))) and (coalesce(r.brand, '') = '' or r.brand = o.brand)
    and (coalesce(r.series, '') = '' or r.series = o.series)
    and (coalesce(r.realism, '') = '' or r.realism = o.realism) and (r.pack_min is null or o.pack_size >= r.pack_min) and (r.pack_max is null or o.pack_size <= r.pack_max)
    and (coalesce(r.sources, '') = '' or list_contains(list_transform(string_split(r.sources, ','), lambda x: trim(x)), o.source))),
  ev as (select b.*, m.was_price, m.was_stock, case
      when m.seen is null and ((in_stock = 1 and price is not null) or coalesce(stock_only, 1) = 0) then 'new'
      when m.seen and in_stock = 1 and price is not null and was_stock = 0 then 'back'
      when m.seen and target > 0 and in_stock = 1 and price is not null and price <= target and (was_price is null or was_price > target) then 'drop' end as kind
    from best b left join mem m using (rule_id, product_id, source))"""


def matched(s, d):
    return alerts.matches(rules(s), offers(s, d).filter(F.col("region") == REGION))


def remembered(s, d):
    """What an earlier run of the rules left: the offers that they matched then."""
    p = views.products(s, d).withColumnRenamed("id", "product_id")
    then = views.seen_before(s, d).filter(F.col("region") == REGION).join(p, "product_id")
    return alerts.best_offers(alerts.matches(rules(s), then)).select("rule_id", "product_id", "source", "price", "in_stock")


def evaluated(s, d):
    return alerts.evaluate(alerts.best_offers(matched(s, d)), remembered(s, d))


for _name in ("f_rule", "j_rules"):
    query(_name, _MATCH + " select rule_id, product_id, source, price from fits")(lambda s, d: matched(s, d).select("rule_id", "product_id", "source", "price"))
query("w_best_offer", _MATCH + " select rule_id, product_id, source, price, in_stock from best")(lambda s, d: alerts.best_offers(matched(s, d)).select("rule_id", "product_id", "source", "price", "in_stock"))
query("j_state", _MATCH + " select rule_id, product_id, source, price, was_price, was_stock from ev")(lambda s, d: evaluated(s, d).select("rule_id", "product_id", "source", "price", "was_price", "was_stock"))
query("st_evaluate", _MATCH + " select rule_id, product_id, source, price, kind from ev where kind is not null")(lambda s, d: evaluated(s, d).filter("kind is not null").select("rule_id", "product_id", "source", "price", "kind"))
query("st_seed", _MATCH + " select rule_id, count(*) as remembered, 0::bigint as told from best group by 1")(
    lambda s, d: alerts.evaluate(alerts.best_offers(matched(s, d)), remembered(s, d).limit(0), seed=True).groupBy("rule_id").agg(F.count(F.lit(1)).alias("remembered"), F.count("kind").alias("told"))
)
query("st_suppress", _MATCH + " select rule_id, product_id, source, kind from ev where kind is not null and source not in ('Supplier#000000001')")(
    lambda s, d: alerts.suppress(evaluated(s, d).filter("kind is not null"), ["Supplier#000000001"], False).select("rule_id", "product_id", "source", "kind")
)
query("up_alert_state", _MATCH + """ select rule_id, product_id, source, price, in_stock from best union all
  select rule_id, product_id, source, was_price, was_stock from mem where not exists (select 1 from best b where b.rule_id = mem.rule_id and b.product_id = mem.product_id and b.source = mem.source)""")(
    lambda s, d: alerts.remember(alerts.best_offers(matched(s, d)), remembered(s, d))
)
_TOP = _MATCH + ", k as (select *, row_number() over (partition by kind order by rule_id, product_id, source) as rank, greatest(count(*) over (partition by kind) - 10, 0) as more from ev where kind is not null)"
query("w_group_top10", _TOP + " select kind, rank, more, rule_id, product_id, source from k where rank <= 10")(
    lambda s, d: alerts.first_by_kind(evaluated(s, d).filter("kind is not null")).select("kind", "rank", "more", "rule_id", "product_id", "source")
)
query("s_digest", _TOP + " select kind, string_agg(rule_id || ' ' || product_id || ' ' || source, chr(10) order by rank) || case when max(more) > 0 then chr(10) || '…and ' || max(more) || ' more' else '' end as digest from k where rank <= 10 group by kind")(
    lambda s, d: alerts.first_by_kind(evaluated(s, d).filter("kind is not null")).withColumn("line", F.concat_ws(" ", F.col("rule_id").cast("string"), F.col("product_id").cast("string"), "source"))
    .groupBy("kind").agg(
        F.concat(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n"),
            F.when(F.max("more") > 0, F.concat(F.lit("\n…and "), F.max("more").cast("string"), F.lit(" more"))).otherwise(""),
        ).alias("digest")
    )
)
query("s_shape", """select user_id, count(*) as n, count(*) filter (event_type = 'click') as pictured, case when count(*) filter (event_type = 'click') = 0 then 'text'
  when count(*) filter (event_type = 'click') = count(*) and count(*) = 1 then 'photo' when count(*) filter (event_type = 'click') = count(*) and count(*) <= 10 then 'album' else 'text+album' end as shape from events group by 1""", "")(
    lambda s, d: views.table(s, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("event_type") == "click", 1)).alias("pictured")).withColumn("shape", alerts.shape(F.col("n"), F.col("pictured")))
)
_SYNC = """with c as (select p_partkey as note, p_brand as brand, p_size::double as target from part where p_partkey % 3 <> 0),
  t as (select p_partkey as note, case when p_partkey % 5 = 0 then 'X' else p_brand end as brand, p_size::double as target, (p_partkey % 7 <> 0)::int as active from part where p_partkey % 4 <> 0)
  select coalesce(c.note, t.note) as note, case when t.note is null then 'insert' when c.note is null then case when t.active = 1 then 'deactivate' else 'keep' end
    when c.brand is distinct from t.brand or c.target is distinct from t.target or t.active <> 1 then 'update' else 'keep' end as action from c full join t on c.note = t.note"""


def st_sync(s, d):
    p = views.table(s, d, "part").select(F.col("p_partkey").alias("note"), F.col("p_brand").alias("brand"), F.col("p_size").cast("double").alias("target"))
    stored = p.filter("note % 4 <> 0").withColumn("brand", F.when(F.col("note") % 5 == 0, "X").otherwise(F.col("brand"))).withColumn("active", (F.col("note") % 7 != 0).cast("int"))
    return state.sync(p.filter("note % 3 <> 0"), stored, "note", ["brand", "target"])


for _name in ("j_sync", "st_sync_rules"):
    query(_name, _SYNC, "")(st_sync)
query("st_cmd_toggle", """with kv as (select user_id, arg_max(value, event_id) as v from events group by 1)
  select c_custkey as id, coalesce(v > 50, c_custkey % 2 = 0) or c_custkey % 10 = 0 as enabled from customer left join kv on c_custkey = user_id""", "")(
    lambda s, d: views.table(s, d, "customer").select(F.col("c_custkey").alias("id")).join(up_kv(s, d), F.col("id") == F.col("k"), "left")
    .select("id", (F.coalesce(F.col("v") > 50, F.col("id") % 2 == 0) | (F.col("id") % 10 == 0)).alias("enabled"))
)
query("st_pause", "select event_id, ts + to_microseconds(round(greatest(0.1, least(336, value)) * 3600000)::bigint * 1000) as until from events", "")(
    lambda s, d: views.table(s, d, "events").select(
        "event_id", F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.round(F.greatest(F.lit(0.1), F.least(F.lit(336.0), F.col("value"))) * 3_600_000).cast("long") * 1000).cast("timestamp_ntz").alias("until")
    )
)
query("st_watch_crud", f"+ {RULES_SQL}, b as (select min(price) as best from offers) select rule_id, coalesce(target > 0 and best <= target, false) as hit from rules, b where active = 1")(
    lambda s, d: alerts.bounded(rules(s).filter("active = 1")).join(offers(s, d).agg(F.min("price").alias("best"))).select("rule_id", F.coalesce((F.col("target") > 0) & (F.col("best") <= F.col("target")), F.lit(False)).alias("hit"))
)

# ---------------------------------------------------------------- titles

TITLES = """with titles as (select p_partkey as id, ['Alpha', 'Bravo Wheels', 'Corgo', 'Delta', 'Unknown'][(p_partkey % 5 + 1)::int] || ' ' || p_name || ' ' || p_type ||
  [' Pack of 5', ', 1:64 Scale', ' No ' || p_size, ' [Assorted] 3-Car Pack'][(p_partkey % 4 + 1)::int] as t from part)"""


def titles(s, d):
    makers = F.array(*[F.lit(x) for x in ("Alpha", "Bravo Wheels", "Corgo", "Delta", "Unknown")])
    tails = F.array(F.lit(" Pack of 5"), F.lit(", 1:64 Scale"), F.concat(F.lit(" No "), F.col("p_size").cast("string")), F.lit(" [Assorted] 3-Car Pack"))
    pick = lambda a, n: F.element_at(a, (F.col("p_partkey") % n + 1).cast("int"))
    p = shared.spread(views.table(s, d, "part").select("p_partkey", "p_name", "p_type", "p_size"), "p_partkey")
    return p.select(F.col("p_partkey").alias("id"), F.concat(pick(makers, 5), F.lit(" "), "p_name", F.lit(" "), "p_type", pick(tails, 4)).alias("t"))


def _pk(t: str) -> str:
    rest = f"regexp_replace({t}, $r${text.RATIO}$r$, ' ', 'g')"
    found = [f"try_cast(regexp_extract({rest}, $r${p}$r$, 1) as int)" for p in text.stated_counts()]
    return f"coalesce({', '.join(f'case when {n} between 1 and 50 then {n} end' for n in found)}, 1)"


def _sig(t: str) -> str:
    s = f"lower(trim(regexp_replace(replace({t}, '&amp;', '&'), '\\s+', ' ', 'g')))"
    for p in (r"\([^)]*\)|\[[^\]]*\]", text.RATIO, *text.count_noise(), "[^a-z0-9]+"):
        s = f"regexp_replace({s}, $r${p}$r$, ' ', 'g')"
    noise = ", ".join(f"'{w}'" for w in text.RulePack().noise)
    return f"coalesce(nullif(array_to_string(list_sort(list_distinct(list_filter(string_split({s}, ' '), lambda w: length(w) > 1 and w not in ({noise}))))[1:12], ' '), ''), 'assorted')"


_BRANDS = text.RulePack().brands
_POS = ", ".join(f"case when regexp_matches(t, $r$(?i)\\b{b}\\b$r$) then struct_pack(pos := length(regexp_extract(t, $r$(?is)^(.*?)\\b{b}\\b$r$, 1)), name := '{b}') end" for b in _BRANDS)
_RULES = text.RulePack()
_PROPER = f"not regexp_matches(lower(t), $r${_RULES.knockoffs}$r$) and not regexp_matches(lower(t), $r${_RULES.accessories}$r$)"
_SURE = f"len(f) between 1 and 2 and list_min(f).pos <= 35 and (list_min(f).name not in ({', '.join(repr(b) for b in _RULES.common)}) or regexp_matches(lower(t), $r${_RULES.vehicles}$r$))"
_BRAND = f"case when {_PROPER} and {_SURE} then list_min(f).name end"
BRANDED = f"{TITLES}, found as (select *, list_filter([{_POS}], lambda x: x is not null) as f from titles), b as (select *, {_BRAND} as brand, {_pk('t')} as pack, {_sig('t')} as sig from found)"
_title = lambda name, sql, col: query(name, f"select id, {sql} as v from b", BRANDED)(lambda s, d: titles(s, d).select("id", col(F.col("t")).alias("v")))
_title("s_pack_size", "pack", text.pack_size)
_title("s_signature", "sig", text.signature)
_title("s_numeric_tokens", "array_to_string(list_filter(string_split(sig, ' '), lambda w: regexp_matches(w, '^[0-9]+$')), ' ')", lambda t: text.number_words(text.signature(t)))
_title("s_series", "case when regexp_matches(lower(t), '\\bpromo\\b') then 'Promo' when regexp_matches(lower(t), '\\beconomy\\b') then 'Economy' when regexp_matches(lower(t), '\\bpremium\\b') then 'Premium' end", text.series)
_SET = "(regexp_matches(lower(t), '\\b(pack|set|gift box)\\b') or pack > 1)"
_title("s_is_set", _SET, text.is_set)
_title("s_realism", f"case when not {_SET} then case when regexp_matches(lower(t), '\\b(gear|bolt|widget)\\b') then 'Realistic' else 'Fantasy' end end", text.realism)
_title("s_detect_brand", "brand", text.brand)
_HINT = "case when id % 3 = 0 then 'the ECHO company' when id % 3 = 1 then 'Nobody' end"
_title("s_detect_brand_hint", f"case when {_PROPER} then case when len(f) = 0 then case when id % 3 = 0 then 'Echo' end else brand end end", lambda t: text.brand(t, hint=F.expr(_HINT)))
_title("s_brand_list", "array_to_string(list_sort(list_transform(f, lambda x: x.name)), ',')", lambda t: F.array_join(F.array_sort(F.filter(F.array(*[F.when(t.rlike(rf"(?i)\b{b}\b"), b) for b in _BRANDS]), lambda x: x.isNotNull())), ","))
_title("s_brand_hint", "coalesce(" + ", ".join(f"case when regexp_matches(t, $r${text.named(b)}$r$) then '{b}' end" for b in _BRANDS) + ")", text.brand_hint)
_title("s_canonical_key", "coalesce(brand, 'Other') || '|' || sig || '|p' || pack", text.canonical_key)
_title("s_canonical_key_hint", f"coalesce(case when {_PROPER} then case when len(f) = 0 then case when id % 3 = 0 then 'Echo' end else brand end end, 'Other') || '|' || sig || '|p' || pack", lambda t: text.canonical_key(t, hint=F.expr(_HINT)))
_title("s_key_parts", "coalesce(brand, 'Other') || '/' || sig", lambda t: F.concat_ws("/", F.split_part(text.canonical_key(t), F.lit("|"), F.lit(1)), F.split_part(text.canonical_key(t), F.lit("|"), F.lit(2))))
_title("s_knockoff", "regexp_matches(lower(t), '\\b(replica|compatible|look-alike)\\b')", lambda t: F.lower(t).rlike(text.RulePack().knockoffs))
for _name, _words in (("s_accessory", text.RulePack().accessories), ("s_context", text.RulePack().vehicles)):
    _title(_name, f"regexp_matches(lower(t), $r${_words}$r$)", lambda t, w=_words: F.lower(t).rlike(w))
# what titles say of their scale: none, the usual one in two ways of writing it, another one, or several
_SAID = ("", " 1 / 64", " 1  :  64", " 1:8", ", 1:24 beside 1:64", " 1:43")
_SCALED = f"{TITLES}, scaled as (select id, t || {list(_SAID)!r}[(id // 4 % 6 + 1)::int] as t from titles)"
SCALED = BRANDED.replace(TITLES, _SCALED, 1).replace("as f from titles)", "as f from scaled)", 1)
_said = lambda s, d: titles(s, d).select("id", F.concat("t", F.element_at(F.array(*[F.lit(x) for x in _SAID]), (F.floor(F.col("id") / 4) % 6 + 1).cast("int"))).alias("t"))
_scale = lambda name, sql, col: query(name, f"select id, {sql} as v from b", SCALED)(lambda s, d: _said(s, d).select("id", col(F.col("t")).alias("v")))
_scale("s_scales", f"array_to_string(regexp_extract_all(t, $r${text.SCALE}$r$, 1), ',')", lambda t: F.array_join(F.transform(text.scales(t), lambda n: n.cast("string")), ","))
_FITS = f"(brand is not null and (len(list_filter(regexp_extract_all(t, $r${text.SCALE}$r$, 1), lambda x: x::int between 55 and 68)) > 0 or (len(regexp_extract_all(t, $r${text.SCALE}$r$, 1)) = 0 and brand in ('Alpha', 'Bravo'))))"
_REAL = f"not (not {_SET} and not regexp_matches(lower(t), '\\b(gear|bolt|widget)\\b'))"
_scale("s_target", _FITS, text.wanted)
for _name in ("s_wanted", "f_wanted"):
    _scale(_name, f"({_FITS} and {_REAL})", lambda t: text.wanted(t, fantasy=False))
query("o_titles_len", "select id, row_number() over (order by length(t) desc, t, id) as n from titles", TITLES)(
    lambda s, d: state.positions(titles(s, d), [-F.length("t"), F.col("t"), F.col("id")]).select("id", "n")
)

DOCS = "with d as (select doc_id, text from documents where text is not null)"
_doc = lambda name, sql, col: query(name, f"select doc_id, {sql} as v from d", DOCS)(lambda s, d: views.table(s, d, "documents").filter("text is not null").select("doc_id", col(F.col("text")).alias("v")))
_doc("s_parse_price", f"try_cast(replace(nullif(regexp_extract(text, $r${text.PRICE}$r$), ''), ',', '') as double)", text.parse_price)
_doc("s_html_escape", "md5(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'))", lambda t: F.md5(text.html_escape(t)))
_doc("s_markdown", "md5(replace(replace(replace('<b>' || text || '</b>', '<b>', '**'), '</b>', '**'), '&amp;', '&'))", lambda t: F.md5(text.markdown(F.concat(F.lit("<b>"), t, F.lit("</b>")))))
_doc("s_header_safe", "regexp_replace(replace(replace(text[1:1400], chr(13), ''), chr(10), '\\n'), '[^\\x{00}-\\x{FF}]', '?', 'g')", text.header_safe)
_doc("oos_phrase", "regexp_matches(lower(text), 'currently unavailable|temporarily out of stock|out of stock|sold out|notify me when available|coming soon|unavailable')", text.sold_out)
_MARKUP_OF = "concat('<i class=\"stars\"><span>', cast(p_size % 50 / 10 as string), ' out of 5 stars</span></i><a aria-label=\"ratings\">(', cast(p_partkey % 500 / 10 as string), case p_partkey % 3 when 0 then 'K' when 1 then ' M' else '' end, ')</a>')"
_marked = lambda s, d: views.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.expr(_MARKUP_OF).alias("html"))
query("html_rating", "select p_partkey as id, ((p_size % 50) / 10)::double as v from part", "")(lambda s, d: _marked(s, d).select("id", text.stars(F.col("html")).alias("v")))
query("html_count_suffix", "select p_partkey as id, round((p_partkey % 500) / 10 * case p_partkey % 3 when 0 then 1000 when 1 then 1000000 else 1 end)::bigint as v from part", "")(
    lambda s, d: _marked(s, d).select("id", text.short_count(F.regexp_extract("html", r"aria-label=.ratings.>([^<]*)<", 1)).alias("v"))
)
QUERIES["s_clean_text"] = lambda s, d: views.table(s, d, "documents").select("doc_id", text.clean(F.col("text")).alias("v"))
query("s_money", "select event_id, case when value is null then 'no price' else 'Rs ' || format('{:,}', round_even(value, 0)::bigint) end as v from events", "")(lambda s, d: views.table(s, d, "events").select("event_id", text.money(F.col("value")).alias("v")))


@query("s_cmd_parse", """select conv_id, turn, lower(split_part(split_part(c, ' ', 1)[2:], '@', 1)) as name, trim(c[length(split_part(c, ' ', 1)) + 1:]) as args
  from (select conv_id, turn, '/Find@bot ' || trim(text) as c from conversations where text is not null)""", "")
def s_cmd_parse(s, d):
    """Name and arguments of each message of conversations, made a command."""
    c = views.table(s, d, "conversations").filter("text is not null").select("conv_id", "turn", F.concat(F.lit("/Find@bot "), F.trim("text")).alias("c"))
    name, args = text.command(F.col("c"))
    return c.select("conv_id", "turn", name.alias("name"), args.alias("args"))


query("s_src_list", r"""select conv_id, turn, array_to_string(list_filter(list_transform(string_split(text, ','), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), '|') as v
  from conversations where text is not null""", "")(
    lambda s, d: views.table(s, d, "conversations").filter("text is not null").select("conv_id", "turn", F.array_join(alerts.source_list(F.col("text")), "|").alias("v"))
)
query("s_url_build", "select id, 'https://shop.example/p/' || url_encode(title) || '/' || id as v from products")(
    lambda s, d: views.products(s, d).select("id", F.concat(F.lit("https://shop.example/p/"), F.replace(F.url_encode("title"), F.lit("+"), F.lit("%20")), F.lit("/"), F.col("id").cast("string")).alias("v"))
)
query("set_union_diff", "select c_custkey as id, array_to_string(list_sort(list_distinct(list_concat(['a', 'b'], [c_mktsegment]))), ',') as both, array_to_string(list_filter([c_mktsegment, 'a'], lambda x: x not in ('a', 'BUILDING')), ',') as unknown from customer", "")(
    lambda s, d: views.table(s, d, "customer").select(
        F.col("c_custkey").alias("id"),
        F.array_join(F.array_sort(F.array_union(F.array(F.lit("a"), F.lit("b")), F.array("c_mktsegment"))), ",").alias("both"),
        F.array_join(F.array_except(F.array(F.col("c_mktsegment"), F.lit("a")), F.array(F.lit("a"), F.lit("BUILDING"))), ",").alias("unknown"),
    )
)

# ---------------------------------------------------------------- sources

query("src_dedupe", "select source, source_sku, query_idx, pos from (select *, row_number() over (partition by source, source_sku order by query_idx, pos) as n from (select source, source_sku, o2 as query_idx, o1 as pos from observations)) where n = 1")(
    lambda s, d: payloads.first_by_sku(views.observations(s, d).select("source", "source_sku", F.col("o2").alias("query_idx"), F.col("o1").alias("pos")))
)
query("json_as_price", "select l_orderkey, l_linenumber, l_extendedprice, case when l_extendedprice * 10 > 100000 then l_extendedprice * 10 / 100 else l_extendedprice * 10 end as v from lineitem", "")(
    lambda s, d: views.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", payloads.as_price(F.col("l_extendedprice") * 10).alias("v"))
)
query("json_as_stock", "select event_id, case when event_type = 'view' then true when event_type = 'click' then event_id % 3 > 0 else event_type <> 'error' end as v from events", "")(
    lambda s, d: views.table(s, d, "events").select(
        "event_id", payloads.as_stock(F.when(F.col("event_type") == "click", (F.col("event_id") % 3).cast("string")).when(F.col("event_type") == "error", "Unavailable").when(F.col("event_type") != "view", F.col("event_type"))).alias("v")
    )
)
query("geo_guard", "select user_id, coalesce(bool_or(abs(lat - 50) <= 0.5 and abs(lon - 50) <= 0.5), false) or count(*) filter (lat is not null and lon is not null) = 0 as near from (select user_id, case when event_type <> 'view' then value end as lat, 50.0::double as lon from events) group by 1", "")(
    lambda s, d: payloads.near_batches(views.table(s, d, "events").select("user_id", F.when(F.col("event_type") != "view", F.col("value")).alias("lat"), F.lit(50.0).alias("lon")), "user_id", 50.0, 50.0)
)


def shop_pages(o: DataFrame, page_rows: int = 250) -> DataFrame:
    """Catalogue pages of at most page_rows parts of one seller, with a variant for each sighting in o.

    A seller's parts are dealt by their hash among groups of some ten pages, and ranked within a group."""
    v = F.struct((F.col("o1") * 10 + F.col("o2")).alias("id"), "price", (F.col("price") * 1.1).alias("compare_at_price"), (F.col("in_stock") == 1).alias("available"))
    p = o.groupBy("source", "product_id").agg(F.collect_list(v).alias("variants"))
    groups = o.groupBy("source").agg(F.greatest(F.lit(1), F.ceil(F.approx_count_distinct("product_id") / (10 * page_rows))).alias("groups"))
    p = p.join(groups, "source").withColumn("dealt", F.pmod(F.xxhash64("product_id"), F.col("groups")))
    rank = F.row_number().over(Window.partitionBy("source", "dealt").orderBy("product_id"))
    one = F.struct(F.col("product_id").alias("id"), F.concat(F.lit("item "), F.col("product_id").cast("string")).alias("title"), "variants")
    return p.withColumn("page", F.floor((rank - 1) / page_rows)).groupBy("source", "dealt", "page").agg(F.to_json(F.collect_list(one)).alias("body"))


@query("scan_shopify_catalog", """select 'shop' as source, source_sku, 'item ' || product_id as title, price, any_stock as in_stock from (select *, max(in_stock) over (partition by source, product_id) as any_stock,
  row_number() over (partition by source, product_id order by in_stock desc, price is null, price, o1 * 10 + o2) as n from observations) where n = 1""")
def scan_shopify_catalog(s, d):
    return payloads.catalog_offers(shop_pages(views.observations(s, d)), "shop").select("source", "source_sku", "title", "price", "in_stock")


def store_payloads(s, d):
    p = views.table(s, d, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"),
        F.struct(F.round(F.col("p_retailprice") * 100).cast("long").cast("string").alias("price"), F.lit("0").alias("regular_price"), F.lit(2).alias("currency_minor_unit")).alias("prices"),
        (F.col("p_size") > 10).alias("is_in_stock"),
        F.array(F.struct(F.lit("Toy Brand").alias("name"), F.array(F.struct(F.col("p_brand").alias("name"))).alias("terms"))).alias("attributes"),
    )
    return p.select(F.to_json(F.array(F.struct("*"))).alias("body"))


query("scan_woo", "select 'store' as source, p_partkey::varchar as source_sku, p_name as title, round(p_retailprice * 100)::bigint::double / 100 as price, (p_size > 10)::int as in_stock, p_brand as brand_hint from part", "")(
    lambda s, d: payloads.store_offers(store_payloads(s, d), "store").select("source", "source_sku", "title", "price", "in_stock", "brand_hint")
)
_NESTED = "'{\"a\":[' || props || ',[{\"b\":' || props || ',\"e\":{}}]],\"c\":' || props || ',\"d\":null}'"
query("json_walk", f"""with t as (select event_id, j.* from (select event_id, ({_NESTED})::json as body from events) e, json_tree(e.body) as j where j.type = 'OBJECT'),
  p as (select event_id, regexp_replace(fullkey, '\\[([0-9]+)\\]', '.\\1', 'g') as path, value from t)
  select event_id, path, (length(path) - length(replace(path, '.', '')))::int as depth, array_to_string(list_sort(json_keys(value)), ',') as keys from p""", "")(
    lambda s, d: payloads.walked(views.table(s, d, "events").select("event_id", F.expr(_NESTED).alias("body")), "body").select("event_id", "path", "depth", F.array_join("keys", ",").alias("keys"))
)
QUERIES["scan_html_anchor"] = lambda s, d: payloads.anchored_offers(views.table(s, d, "pages").select("page_id", "html"), "")  # its pages have no product links; all count
QUERIES["j_fuzzy"] = lambda s, d: resolve.clusters(titles(s, d).withColumnRenamed("t", "raw_title")).select("id", "brand", "pack_size", "sig", "leader", "canonical_key")


@query("o_clamp", "select event_id, greatest(1, least(coalesce(value::int, 200), 200)) as lim, greatest(0, coalesce(user_id - 50, 0)) as off from events", "")
def o_clamp(s, d):
    e = views.table(s, d, "events")
    limit, offset = clamped(F.bround("value").cast("int"), F.col("user_id") - 50)
    return e.select("event_id", limit.alias("lim"), offset.alias("off"))


@query("st_migrate", "select p_partkey as id, p_name as title, null::varchar as hint, 1 as pieces, 0.0::double as rating from part", "")
def st_migrate(s, d):
    old = views.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    return state.migrate(old, {"title": ("string", ""), "hint": ("string", None), "pieces": ("int", 1), "rating": ("double", 0.0)})


_BATCHES = "with b as (select user_id, event_id, case when event_id % 7 = 0 and user_id % 3 = 0 then substring(props, 2) else props end as body from events)"


def _batches(s, d):
    """Landed batches of each source, some of which can't be read."""
    body = F.when((F.col("event_id") % 7 == 0) & (F.col("user_id") % 3 == 0), F.substring("props", F.lit(2), F.length("props"))).otherwise(F.col("props"))
    return views.table(s, d, "events").select(F.col("user_id").alias("source"), "event_id", body.alias("body"))


query("st_isolation", """select user_id as source, case when count(*) filter (not json_valid(body)) > 0 then 0 else count(*) end as stored, count(*) filter (not json_valid(body)) as failed,
  min(body) filter (not json_valid(body)) as error, case when count(*) filter (not json_valid(body)) > 0 then 'failed' else 'ok' end as status from b group by 1""", _BATCHES)(
    lambda s, d: payloads.isolated(_batches(s, d), "source", "body", "k int")[1]
)
query("st_isolation_rows", "select user_id as source, event_id, (body->>'$.k')::int as k from b where user_id not in (select user_id from b where not json_valid(body))", _BATCHES)(
    lambda s, d: payloads.isolated(_batches(s, d), "source", "body", "k int")[0].select("source", "event_id", F.col("row.k").alias("k"))
)


def stream_change(s, d):
    schema = views.table(s, d, "events").schema
    shape = lambda e: e.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"))
    return changes.run_available(s, f"{d}/events*.parquet", schema, shape, changes.state_folder(s))


QUERIES["stream_change"] = stream_change
ORACLES["stream_change"] = """select user_id as key, ts, event_id as seq, value as price from (select *, lag(value) over w as before, row_number() over w as n from events window w as (partition by user_id order by ts, event_id))
  where value is not null and (n = 1 or before is null or abs(value - before) > 0.001)"""


def flagship(s: SparkSession, d: str) -> DataFrame:
    """The first catalogue page of a region, cheapest buyable first, with its offers."""
    o = offers(s, d)
    return with_offers(page(o, CatalogQuery(region=REGION)), o)

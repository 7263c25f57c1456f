"""Queries of the sources, messages and streams that read text: landed pages and feeds are built from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import messages, names, text
from ..operators import alerts
from ..sources import cards, payloads
from ..streaming import changes
from . import queries as q
from . import views

query, QUERIES = q.query, q.QUERIES


def parts(s, d):
    return views.table(s, d, "part")


def made(**columns: str):
    """Parts with further columns, each a SQL expression that Spark and DuckDB read alike."""
    return lambda s, d: parts(s, d).selectExpr("p_partkey as id", *[f"{e} as {c}" for c, e in columns.items()])


_ID = "cast(p_partkey as string)"
_CARD = (
    f"concat('<div data-kind=\"card\" data-id=\"', {_ID}, '\"><a title=\"', p_name, ' in full\"><img src=\"placeholder.png\" data-src=\"//img.example/', {_ID}, '.jpg 2x\" alt=\"x\"></a><h2 aria-label=\"Sponsored Ad - ', "
    "p_name, ' ', p_type, '\">', p_brand, '</h2><a class=\"clamp tail\">', p_name, '</a><br><span class=\"price\">₹', cast(p_size * 10 as string), '</span> <span class=\"was\">₹', cast(p_size * 12 as string), '</span>', "
    "case when p_size % 5 = 0 then '<i>Sold out</i>' else '' end, '</div>')"
)


@query("scan_html_css", """select p_partkey::varchar as sku, p_name || ' ' || p_type as title, (p_size * 10)::double as price, (p_size * 12)::double as mrp,
  'https://img.example/' || p_partkey || '.jpg' as image, (p_size % 5 <> 0)::int as in_stock from part""", "")
def scan_html_css(s, d):
    pages = made(card=_CARD)(s, d).groupBy(F.floor(F.col("id") / 20).alias("page")).agg(F.concat(F.lit("<html><body><h2>Results</h2>"), F.array_join(F.collect_list("card"), ""), F.lit("</body></html>")).alias("html"))
    c = pages.lateralJoin(cards.ScanCards(F.col("html").outer(), F.lit("data-kind"), F.lit("card"), F.lit("data-id")))
    return c.select(
        "sku", cards.merged_title(F.col("heading"), F.col("label"), F.col("tail")).alias("title"), text.parse_price(F.col("price")).alias("price"), text.parse_price(F.col("was")).alias("mrp"),
        cards.first_image(F.col("images")).alias("image"), (~text.sold_out(F.array_join("parts", " "))).cast("int").alias("in_stock"),
    )


query("scan_html_cards", "select p_partkey::varchar as sku, p_name as title, case when p_size % 4 > 0 then p_size::double end as price, (p_size % 4 > 0)::int as in_stock from part", "")(
    lambda s, d: cards.split_cards(
        made(html=f"concat('<ul><li class=\"c\" id=\"', {_ID}, '\"><b>', p_name, '</b>', case when p_size % 4 > 0 then concat('<i>Rs ', cast(p_size as string), '</i>') else '' end, '</li></ul>')")(s, d),
        '<li class="c"', {"sku": r'id="([0-9]+)"', "title": "<b>([^<]*)</b>", "price": r"<i>Rs ([0-9.]+)</i>"},
    )
)
query("html_title_merge", """select p_partkey as id, case when p_partkey % 3 = 0 then p_name || ' ' || p_type when p_partkey % 3 = 1 then p_brand || ' ' || p_name else p_brand || ' ' || p_name end as v from part""", "")(
    lambda s, d: made(
        heading="p_brand", label="case when p_partkey % 3 = 0 then concat('Sponsored Ad - ', p_name, ' ', p_type) else '' end", tail="case when p_partkey % 3 = 1 then concat(lower(p_brand), ' ', p_name) else p_name end"
    )(s, d).select("id", cards.merged_title(F.col("heading"), F.col("label"), F.when(F.col("id") % 3 == 1, F.concat("heading", F.substring("tail", F.length("heading") + 1, F.lit(1000)))).otherwise(F.col("tail"))).alias("v"))
)
query("html_amounts", """select p_partkey as id, case p_partkey % 3 when 0 then 1000.0 + p_size when 1 then p_size end::double as price,
  case p_partkey % 3 when 0 then 2000.5 when 1 then p_size + 5 end::double as mrp from part""", "")(
    lambda s, d: made(parts="""case p_partkey % 3 when 0 then array(concat('now ₹', cast(1000 + p_size as string)), '₹ 12', 'was ₹2,000.50')
      when 1 then array('₹', cast(p_size as string), 'x', '₹', cast(p_size + 5 as string)) else array('no price') end""")(s, d)
    .withColumn("a", cards.amounts(F.col("parts"))).select("id", F.get("a", F.lit(0)).alias("price"), cards.list_price(F.col("a")).alias("mrp"))
)
query("html_image", "select p_partkey as id, case p_partkey % 3 when 0 then 'https://img.example/' || p_partkey when 1 then 'http://b.example/x.png' end as v from part", "")(
    lambda s, d: made(c=f"case p_partkey % 3 when 0 then array('', 'a/Placeholder.svg', concat('//img.example/', {_ID}, ' 2x')) when 1 then array('http://b.example/x.png', 'y') else array('', cast(null as string)) end")(s, d)
    .select("id", cards.first_image(F.col("c")).alias("v"))
)
query("html_full_title", "select p_partkey as id, case when p_partkey % 2 = 0 then p_name || ' ' || p_type else p_name end as v from part", "")(
    lambda s, d: made(t="case when p_partkey % 2 = 0 then concat(p_name, '...') else p_name end", c="array('x', concat(p_name, ' ', p_type))")(s, d).select("id", cards.full_title(F.col("t"), F.col("c")).alias("v"))
)
query("diagnose", """select doc_id, case when regexp_matches(lower(text), 'something went wrong|are you a robot') then 'challenge' when text is null or text = '' or regexp_matches(lower(text), 'select location|set delivery location') then 'no address'
  when doc_id % 2 = 0 then 'no payload' else 'filtered' end as v from documents""", "")(
    lambda s, d: views.table(s, d, "documents").select("doc_id", cards.diagnosis(F.col("text"), F.col("doc_id") % 2).alias("v"))
)

# ---------------------------------------------------------------- JSON

_HARVEST = (
    f"concat('{{\"data\":[{{\"card\":{{\"product\":{{\"id\":', {_ID}, ',\"name\":\"', p_name, '\",\"images\":[{{\"url\":\"x/', {_ID}, '.png\"}}]}},\"variant\":{{\"sellingPrice\":{{\"value\":', cast(p_size * 100 as string), "
    "'},\"mrp\":\"', cast(p_size * 10000 as string), '\",\"inventory\":', cast(p_size % 3 as string), '}}},{\"name\":\"Showing results for x\",\"id\":1,\"price\":5},{\"name\":\"stub\",\"id\":2}]}')"
)
for _name in ("json_harvest", "json_first_nearby"):
    query(_name, """select 'tree' as source, p_partkey::varchar as source_sku, p_name as title, p_size * 100.0::double as price, case when p_size > 10 then p_size * 100.0::double else p_size * 10000.0::double end as mrp,
      (p_size % 3 > 0)::int as in_stock, 'x/' || p_partkey || '.png' as image from part""", "")(lambda s, d: payloads.harvested_offers(made(body=_HARVEST)(s, d), "tree"))
query("json_image", "select p_partkey as id, case p_partkey % 4 when 0 then 'plain.png' when 1 then 'a' || p_partkey when 2 then 'deep' end as v from part", "")(
    lambda s, d: made(j=f"case p_partkey % 4 when 0 then 'plain.png' when 1 then concat('[\"a', {_ID}, '\",\"b\"]') when 2 then '{{\"src\":[{{\"path\":\"deep\"}}]}}' end")(s, d).select("id", cards.picture(F.col("j")).alias("v"))
)


def served_pages(s, d):
    w = Window.partitionBy("query").orderBy("id")
    p = made(query="p_partkey div 100", p=f"named_struct('PId', {_ID}, 'PNm', p_name, 'BNm', p_brand, 'discprice', cast(p_size as string), 'MRP', cast(p_partkey % 60 as string), 'CrntStock', cast(p_size % 3 as string), 'Images', concat(';', {_ID}, '.jpg;b.jpg'))")(s, d)
    p = p.withColumn("page", F.floor((F.row_number().over(w) - 1) / payloads.PAGE_ROWS) + 1).groupBy("query", "page").agg(F.collect_list("p").alias("Products"))
    return p.select("query", "page", F.to_json(F.struct(F.to_json(F.struct("Products")).alias("ProductResponse"))).alias("body"))


for _name in ("scan_json_service", "json_service_map"):
    query(_name, """select p_partkey // 100 as query, 'service' as source, p_partkey::varchar as source_sku, p_name as title, p_size::double as price, case when p_partkey % 60 > p_size then (p_partkey % 60)::double end as mrp,
      (p_size % 3 > 0)::int as in_stock, p_partkey || '.jpg' as image, p_brand as brand_hint from part""", "")(lambda s, d: payloads.service_offers(served_pages(s, d), "service"))
_FIELDS = {"sku": r'id="([0-9]+)"', "title": "<b>([^<]*)</b>", "price": r"<i>Rs ([0-9.]+)</i>"}


def landings(s, d):
    """Where the searches of served_pages landed: two of three on a page with the ids of a listing, the others on cards; every seventh failed."""
    card = f"concat('<ul><li class=\"c\" id=\"', {_ID}, '\"><b>', p_name, '</b>', case when p_size % 4 > 0 then concat('<i>Rs ', cast(p_size as string), '</i>') else '' end, '</li></ul>')"
    c = made(query="p_partkey div 100", card=card)(s, d).groupBy("query").agg(F.array_join(F.array_sort(F.collect_list("card")), "").alias("cards"))
    hidden = F.concat(F.lit("<input type='hidden' id='CatId' value='"), F.col("query").cast("string"), F.lit("'><input id='catid' value='0'><input type='hidden' id='brandid' value='b"), F.col("query").cast("string"), F.lit("'>"))
    return c.select("query", F.when(F.col("query") % 7 == 6, 500).otherwise(200).alias("status"), F.when(F.col("query") % 3 > 0, hidden).otherwise(F.col("cards")).alias("html"))


query("src_resolve", """select p_partkey // 100 as query, 'service' as source, p_partkey::varchar as source_sku, p_name as title, p_size::double as price, case when p_partkey % 60 > p_size then (p_partkey % 60)::double end as mrp,
    (p_size % 3 > 0)::int as in_stock, p_partkey || '.jpg' as image, p_brand as brand_hint from part where p_partkey // 100 % 7 <> 6 and p_partkey // 100 % 3 > 0
  union all select p_partkey // 100, 'service', p_partkey::varchar, p_name, case when p_size % 4 > 0 then p_size::double end, null, (p_size % 4 > 0)::int, null, null from part where p_partkey // 100 % 7 <> 6 and p_partkey // 100 % 3 = 0""", "")(
    lambda s, d: payloads.searched_offers(
        landings(s, d), served_pages(s, d).select(F.col("query").cast("string").alias("catid"), F.concat(F.lit("b"), F.col("query").cast("string")).alias("brandid"), "page", "body"), "service", '<li class="c"', _FIELDS
    )
)
query("scan_shopify_suggest", """select 'shop' as source, case when p_partkey % 3 = 0 and p_partkey <> 0 then p_partkey::varchar when p_partkey % 3 = 1 then 'h-' || p_partkey else p_name[1:60] end as source_sku, p_name as title, p_size::double as price, (p_size + 1)::double as mrp,
  'https://shop.example/p/' || p_partkey as url, 'i' || p_partkey as image, (p_size % 2 = 0)::int as in_stock, p_brand as brand_hint from part""", "")(
    lambda s, d: payloads.suggested_offers(
        made(p=f"""named_struct('id', case when p_partkey % 3 = 0 then {_ID} else '' end, 'handle', case when p_partkey % 3 = 1 then concat('h-', {_ID}) end, 'title', p_name, 'vendor', p_brand, 'url', concat('/p/', {_ID}),
          'price', cast(p_size as string), 'compare_at_price_max', cast(p_size + 1 as string), 'available', p_size % 2 = 0, 'featured_image', named_struct('url', concat('i', {_ID})))""")(s, d)
        .select(F.to_json(F.struct(F.struct(F.struct(F.array("p").alias("products")).alias("results")).alias("resources"))).alias("body")),
        "shop", "https://shop.example",
    )
)
query("src_registry", "select s_suppkey as name, case when s_suppkey % 2 = 0 then s_suppkey::int else 3 end as pages, 40 as delay, true as enabled from supplier where s_suppkey % 5 <> 0", "")(
    lambda s, d: payloads.registry(
        views.table(s, d, "supplier").selectExpr("s_suppkey as name", "case when s_suppkey % 2 = 0 then cast(s_suppkey as int) end as pages", "cast(null as int) as delay", "case when s_suppkey % 5 = 0 then false end as enabled"),
        {"pages": 3, "delay": 40, "enabled": True},
    )
)

PLACES = (("Mumbai", "400001", 18.94, 72.84), ("Navi Mumbai", "400703", 19.03, 73.03), ("Pune", "411001", 18.52, 73.86), ("Delhi", "110001", 28.63, 77.22), ("Bengaluru", "560001", 12.98, 77.6))
_ASKED = ["Mumbai", "  pune ", "560001", "999999", "mUm", "", "nowhere"]
query("region_resolve", f"""with t as (select * from (values {", ".join(f"({k}, {', '.join(map(repr, p))})" for k, p in enumerate(PLACES))}) p(n, label, pincode, lat, lon)),
  a as (select c_custkey as id, trim({_ASKED!r}[(c_custkey % 8 + 1)::int]) as asked from customer)
  select id, label, pincode, lat::double as lat, lon::double as lon, case when label is null and asked <> '' and not regexp_matches(asked, '^[0-9]{{6}}$') then (select string_agg(u.label, ', ' order by n) from t u where contains(lower(u.label), lower(asked))) end as hint
  from a left join t on case when regexp_matches(asked, '^[0-9]{{6}}$') then pincode = asked else lower(label) = lower(asked) end""", "")(
    lambda s, d: views.table(s, d, "customer").select(F.col("c_custkey").alias("id"), payloads.place(F.get(F.array(*[F.lit(x) for x in _ASKED]), (F.col("c_custkey") % 8).cast("int")), PLACES).alias("p")).select("id", "p.*")
)

# ---------------------------------------------------------------- messages

_URLS = "case p_partkey % 5 when 0 then 'https://cdn.shopify.com/a.jpg?v=1' when 1 then 'https://cdn.shopify.com/a.jpg' when 2 then 'https://cdn.grofers.com/x/y.png' when 3 then 'https://cdn.fcglcdn.com/products/438x531/9.webp' else 'https://o.example/z.jpg' end"
query("s_thumb_url", """select p_partkey as id, case p_partkey % 5 when 0 then 'https://cdn.shopify.com/a.jpg?v=1&width=320' when 1 then 'https://cdn.shopify.com/a.jpg?width=320' when 2 then 'https://cdn.grofers.com/cdn-cgi/image/f=auto,w=320,q=60/x/y.png'
  when 3 then 'https://cdn.fcglcdn.com/products/219x265/9.webp' else 'https://o.example/z.jpg' end as v from part""", "")(lambda s, d: made(u=_URLS)(s, d).select("id", messages.thumbnail(F.col("u")).alias("v")))

_rs = lambda c: f"case when {c} is null then 'no price' else 'Rs ' || format('{{:,}}', round_even({c}, 0)::bigint) end"
_WAS = f"case when kind = 'drop' and coalesce(was_price, 0) <> 0 then ' (was ' || {_rs('was_price')} || ')' else '' end"
query("s_alert_line", q._MATCH + f""" select rule_id, product_id, source, '<b>' || title || '</b>' || chr(10) || {_rs('price')} || ' at ' || source || {_WAS}
  || case when kind = 'drop' and target <> 0 and price is not null then chr(10) || 'target ' || {_rs('target')} else '' end || chr(10) || 'https://shop.example/' || product_id as v from ev where kind is not null""")(
    lambda s, d: q.evaluated(s, d).filter("kind is not null").select("rule_id", "product_id", "source", messages.alert_line(*[F.col(c) for c in ("title", "price", "source", "kind", "was_price", "target")], _link()).alias("v"))
)
query("s_caption", q._MATCH + f""" select rule_id, product_id, source, '<b>' || title || '</b>' || chr(10) || {_rs('price')} || ' at ' || source || ' · ' || case kind when 'back' then 'Back in stock' when 'drop' then 'Price drop' else 'New' end || {_WAS}
  || chr(10) || 'https://shop.example/' || product_id as v from ev where kind is not null""")(
    lambda s, d: q.evaluated(s, d).filter("kind is not null").select("rule_id", "product_id", "source", messages.caption(*[F.col(c) for c in ("title", "price", "source", "kind", "was_price")], _link()).alias("v"))
)


def _link():
    return F.concat(F.lit("https://shop.example/"), F.col("product_id").cast("string"))


# ---------------------------------------------------------------- names


def s_brand_table(s, d):
    """The seller that a part's title names, among all suppliers, each with two spellings; every fourth title names two."""
    spelling = F.explode(F.array("s_name", F.replace("s_name", F.lit("#"), F.lit(" no "))))
    table = views.table(s, d, "supplier").select(F.col("s_suppkey").cast("long").alias("place"), F.col("s_name").alias("name"), spelling.alias("spelling"), F.lit(False).alias("inside"))
    n = views.table(s, d, "supplier").agg(F.count(F.lit(1)).alias("n"), F.min("s_suppkey").alias("lo"))
    key = lambda k: F.lpad(((F.col("p_partkey") * k) % F.col("n") + F.col("lo")).cast("string"), 9, "0")
    first = F.concat(F.when(F.col("p_partkey") % 2 == 0, "supplier  NO").otherwise("Supplier#"), key(1))
    title = F.concat("p_name", F.lit(" "), first, F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit(" and Supplier#"), key(7))).otherwise(""))
    titled = parts(s, d).join(F.broadcast(n)).select(F.col("p_partkey").alias("id"), title.alias("t"))  # one row
    found = names.joined(titled, "t", table)
    return found.select("id", names.brand_of(F.col("t"), F.col("found"), latest=200).alias("brand"), F.array_join(names.in_order(F.col("found")), ",").alias("named"))


query("s_brand_table", """with n as (select count(*) as n, min(s_suppkey) as lo from supplier), k as (select p_partkey, p_partkey % n + lo as a, case when p_partkey % 4 = 0 then (p_partkey * 7) % n + lo end as b from part, n)
  select p_partkey as id, x.s_name as brand, case when y.s_suppkey is null or y.s_suppkey = x.s_suppkey then x.s_name when y.s_suppkey < x.s_suppkey then y.s_name || ',' || x.s_name else x.s_name || ',' || y.s_name end as named
  from k join supplier x on x.s_suppkey = a left join supplier y on y.s_suppkey = b""", "")(s_brand_table)

# ---------------------------------------------------------------- state

query("st_offset", "select event_id as update_id, event_id as cursor from events where event_id > 100 order by 1 limit 40", "")(
    lambda s, d: alerts.pending(views.table(s, d, "events").select(F.col("event_id").alias("update_id")), 100).select("update_id", "cursor")
)


@query("stream_alerts", """select user_id as key, ts, event_id as seq, value as price, kind from (select *, case
    when n = 1 then case when can_buy then 'new' end when can_buy and not was_stocked then 'back'
    when can_buy and value <= 50 and (was is null or was > 50) then 'drop' end as kind
  from (select *, event_type <> 'error' and value is not null as can_buy, lag(value) over w as was, lag(event_type <> 'error') over w as was_stocked, row_number() over w as n
        from events window w as (partition by user_id order by ts, event_id))) where kind is not null""", "")
def stream_alerts(s, d):
    e = views.table(s, d, "events").schema
    shape = lambda x: x.select(
        F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"), (F.col("event_type") != "error").cast("int").alias("in_stock")
    )
    return changes.run_available(s, f"{d}/events*.parquet", e, shape, changes.state_folder(s), lambda x: changes.transitions(x, target=50.0), changes.TOLD)

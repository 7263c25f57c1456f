"""Offers from landed payloads: JSON feeds of shops, HTML pages, and trees of unknown shape."""

from __future__ import annotations

import bisect
import json
import re
from collections.abc import Sequence
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, Row, StringType, StructType

from ..functions import text
from . import cards

CATALOG = "struct<id:bigint, title:string, handle:string, vendor:string, variants:array<struct<id:bigint, price:double, compare_at_price:double, available:boolean>>>"
STORE = "struct<id:bigint, name:string, prices:struct<price:string, regular_price:string, currency_minor_unit:int>, is_in_stock:boolean, attributes:array<struct<name:string, terms:array<struct<name:string>>>>>"


def first_by_sku(rows: DataFrame, order: Sequence[str] = ("query_idx", "pos")) -> DataFrame:
    """Of offers with one source and sku, the first in the order of queries."""
    rest = [c for c in rows.columns if c not in ("source", "source_sku")]
    return rows.groupBy("source", "source_sku").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select("source", "source_sku", *[F.col(f"r.{c}").alias(c) for c in rest])


def within(price: Column, cap: float | None) -> Column:
    """Whether an offer is taken: prices unknown, or positive and not above the cap."""
    return price.isNull() | ((price > 0) & (price <= cap if cap else F.lit(True)))


def catalog_offers(payloads: DataFrame, source: str) -> DataFrame:
    """payloads(body): products with variants. The cheapest variant that can be had stands for the product, else the cheapest."""
    p = payloads.select(F.explode(F.from_json("body", f"array<{CATALOG}>")).alias("p")).select("p.*")
    ranked = F.array_sort(F.transform("variants", lambda v: F.struct((~F.coalesce(v["available"], F.lit(False))).alias("gone"), v["price"].isNull().alias("unpriced"), v["price"].alias("price"), v["compare_at_price"].alias("was"), v["id"].alias("id"))))
    v = F.get(ranked, F.lit(0))
    return p.select(
        F.lit(source).alias("source"),
        F.coalesce(F.col("id").cast("string"), "handle", F.substring("title", 1, 60)).alias("source_sku"),
        "title",
        v["price"].alias("price"),
        F.when(v["was"] > v["price"], v["was"]).alias("mrp"),
        F.exists("variants", lambda x: F.coalesce(x["available"], F.lit(False))).cast("int").alias("in_stock"),
        F.col("vendor").alias("brand_hint"),
    )


def store_offers(payloads: DataFrame, source: str) -> DataFrame:
    """payloads(body): prices in minor units, and a brand among the attributes."""
    p = payloads.select(F.explode(F.from_json("body", f"array<{STORE}>")).alias("p")).select("p.*")
    scale = F.pow(F.lit(10.0), F.coalesce("prices.currency_minor_unit", F.lit(2)))
    price, regular = (F.col(f"prices.{c}").try_cast("double") / scale for c in ("price", "regular_price"))
    brand = F.get(F.filter("attributes", lambda a: F.lower(a["name"]).contains("brand")), F.lit(0))
    return p.select(
        F.lit(source).alias("source"), F.col("id").cast("string").alias("source_sku"), F.col("name").alias("title"), price.alias("price"), F.when(regular > price, regular).alias("mrp"),
        F.col("is_in_stock").cast("int").alias("in_stock"), F.get(brand["terms"], F.lit(0))["name"].alias("brand_hint"),
    )


def as_price(v: Column, most: float = 100_000) -> Column:
    """A number, in hundredths where it is too large for a price."""
    return text.once(v.try_cast("double"), lambda n: F.when(n > most, n / 100).otherwise(n))


# What services say of offers that are not in stock.
NOT_IN_STOCK = ("0", "false", "out_of_stock", "unavailable", "no")


def as_stock(v: Column, words=NOT_IN_STOCK) -> Column:
    n = v.try_cast("double")
    return F.when(v.isNull(), True).when(n.isNotNull(), n > 0).otherwise(~F.lower(v).isin(*words))


def isolated(batches: DataFrame, source: str, body: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, runs): the parsed bodies of sources all of whose batches can be read, and by source how many rows are stored and how many
    batches could not be read, with the first bad one.

    A batch that cannot be read fails its source's run: nothing of that source is stored. Other sources, and rows of a null source, are
    judged on their own."""
    parsed = batches.withColumn("_row", F.from_json(body, f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("_row").isNull() | F.col("_row._bad").isNotNull()
    runs = parsed.groupBy(source).agg(F.count(F.lit(1)).alias("_all"), F.count(F.when(bad, 1)).alias("failed"), F.min(F.when(bad, F.coalesce(body, F.lit("")))).alias("error"))
    ok = F.col("failed") == 0
    runs = runs.select(source, F.when(ok, F.col("_all")).otherwise(0).alias("stored"), "failed", "error", F.when(ok, "ok").otherwise("failed").alias("status"))
    failed = runs.filter(~ok).select(F.col(source).alias("_failed"))
    rows = parsed.join(failed, F.col(source).eqNullSafe(F.col("_failed")), "left_anti")
    return rows.select(*batches.columns, F.col("_row").dropFields("_bad").alias("row")), runs


def near_batches(rows: DataFrame, key: str, lat: float, lon: float, box: float = 0.5) -> DataFrame:
    """Batches of rows(key, lat, lon) with a coordinate in the box around a place, or with none at all."""
    inside = (F.abs(F.col("lat") - lat) <= box) & (F.abs(F.col("lon") - lon) <= box)
    return rows.groupBy(key).agg((F.coalesce(F.max(inside), F.lit(False)) | (F.count(F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), 1)) == 0)).alias("near"))


#: How deep objects are looked for.
DEPTH = 14


def walked(rows: DataFrame, body: str, deepest: int = DEPTH) -> DataFrame:
    """The other columns of rows with (path, depth, keys, object) of every object in the JSON text of `body`, at any depth to `deepest`.

    A recursive query over variants, in the JVM: each round opens what the round before found. keys are sorted; of a key that repeats
    the last one counts; null and broken texts have no objects. Other columns of rows may not be named path, depth, keys, object or node."""
    spark, rest = rows.sparkSession, [c for c in rows.columns if c != body]
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # whole tables are walked
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    own, before = ("".join(f"{of}`{c}`, " for c in rest) for of in ("", "walk."))
    return spark.sql(
        f"""with recursive walk as (
              select {own}'$' as path, 0 as depth, try_parse_json(`{body}`) as node from {{rows}}
              union all
              select {before}concat(walk.path, '.', coalesce(e.key, cast(e.pos as string))), walk.depth + 1, e.value
              from walk, lateral variant_explode(walk.node) as e where walk.depth < {int(deepest)})
            select {own}path, depth, array_sort(json_object_keys(to_json(node))) as keys, to_json(node) as object
            from walk where schema_of_variant(node) like 'OBJECT%'""",
        rows=rows,
    )


@F.udtf(returnType=StructType().add("path", StringType()).add("depth", IntegerType()).add("keys", ArrayType(StringType())).add("body", StringType()))
class WalkJson:
    """Every object in a JSON text, at any depth to DEPTH, outer ones first: `walked` in plain Python, which tests hold it against."""

    def eval(self, text: str):
        try:
            tree = json.loads(text) if text else None
        except ValueError:
            return
        todo = [("$", 0, tree)]
        while todo:
            path, depth, node = todo.pop()
            if isinstance(node, dict):
                yield Row(path=path, depth=depth, keys=list(node), body=json.dumps(node))
            if depth < DEPTH and isinstance(node, (dict, list)):
                inner = node.items() if isinstance(node, dict) else enumerate(node)
                todo.extend(reversed([(f"{path}.{k}", depth + 1, v) for k, v in inner]))


# How links to products, ratings and numbers of reviews look.
ITEM_LINK = r"(?i)/p/(itm[0-9a-z]+)"
RATING, REVIEWS = r"^[1-5](\.[0-9])?$", r"^\([0-9,]+\)$"
#: Elements that a start tag ends, if they are the innermost open ones.
_ENDS = {"li": ("li",), "p": ("p",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th")}


class _Anchors(HTMLParser):
    """The tree of a page: for each element its parent, its last descendant and the span of texts in it; its links, closed or not; and
    what pictures and titled links say."""

    def __init__(self):
        super().__init__()
        self.title, self.texts, self.parent, self.span, self.open, self.links = "", [], [None], [[0, None]], [(0, "html")], []
        self.ends, self.pictures, self.named, self.alts = [None], [], [], []

    def handle_starttag(self, tag, attrs):
        if tag == "html":
            return
        if tag == "a" and any(t == "a" for _, t in self.open):
            self.handle_endtag("a")
        while self.open[-1][1] in _ENDS.get(tag, ()):
            self._close()
        node = len(self.parent)
        self.parent.append(self.open[-1][0])
        self.span.append([len(self.texts), None])
        self.ends.append(node)
        said = dict(attrs)
        if tag == "a":
            self.links.append((node, said.get("href") or ""))
            if "title" in said:
                self.named.append((node, said["title"] or ""))
        if tag == "img":
            self.pictures.append((node, [said.get(k) or "" for k in ("src", "data-src", "srcset")]))
            if "alt" in said:
                self.alts.append((node, said["alt"] or ""))
        if tag in cards.VOID:
            self.span[node][1] = len(self.texts)
        else:
            self.open.append((node, tag))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag != "html" and any(t == tag for _, t in self.open):
            while self._close() != tag:
                pass

    def _close(self):
        node, tag = self.open.pop()
        self.span[node][1], self.ends[node] = len(self.texts), len(self.parent) - 1
        return tag

    def handle_data(self, data):
        self.texts.append(data)
        if self.open[-1][1] == "title":
            self.title += data

    def close(self):
        super().close()
        while self.open:
            self._close()

    def within(self, node: int) -> list[str]:
        return self.texts[slice(*self.span[node])]

    def inside(self, node: int, found: list[tuple]) -> list:
        """What was found at elements within a node, in their order; elements are numbered as they begin."""
        lo = bisect.bisect_left(found, node, key=lambda x: x[0])
        return [x for _, x in found[lo : bisect.bisect_right(found, self.ends[node], key=lambda x: x[0])]]

    def card(self, link: int, phrases, known: dict[int, bool], most: int = 6) -> int:
        """The nearest of `most` elements around a link with a rupee sign or a sold-out phrase, else the outermost of them."""
        node = last = self.parent[link]
        for _ in range(most):
            if node is None:
                break
            if node not in known:
                joined = "".join(self.within(node)).lower()
                known[node] = cards.RUPEE in joined or any(p in joined for p in phrases)
            if known[node]:
                return node
            last, node = node, self.parent[node]
        return last


_LINK = StructType().add("title", StringType()).add("position", IntegerType()).add("href", StringType()).add("label", StringType()).add("sku", StringType()).add("parts", ArrayType(StringType()))
_LINK = _LINK.add("images", ArrayType(StringType())).add("titles", ArrayType(StringType()))


@F.udtf(returnType=_LINK)
class ScanAnchors:
    """The links of an HTML page whose path fits a pattern, with the page's title and the texts of the card around each.

    sku is the first group of the pattern. A link ends where the next begins, or the page, if it is not closed before."""

    def eval(self, html: str, fits: str):
        p, known = _Anchors(), {}
        p.feed(html or "")
        p.close()
        position = 0
        for node, href in p.links:
            found = re.search(fits, href.split("?")[0])
            if found is None:
                continue
            card = p.card(node, text.SOLD_OUT, known)
            parts = [t.strip() for t in p.within(card)]
            images = [x for picture in p.inside(card, p.pictures) for x in picture]
            titles = [*p.inside(card, p.named)[:1], *p.inside(card, p.alts)[:1]]
            yield Row(p.title.strip(), position, href, " ".join("".join(p.within(node)).split()), found[1] if found.re.groups else None, [t for t in parts if t], images, titles)
            position += 1


def anchored_offers(pages: DataFrame, fits: str = ITEM_LINK) -> DataFrame:
    """pages(html, ...): links that fit, with the offer that the card around each tells. A card without a price is kept.

    full_title is the card's first text, or where that is cut off by dots, the title of its first titled link or the alternative text of
    its first picture. Rating and reviews stand among the five texts after the first."""
    rest = [c for c in pages.columns if c != "html"]
    found = pages.lateralJoin(ScanAnchors(F.col("html").outer(), F.lit(fits)))
    blob, paid = F.array_join("parts", " "), cards.amounts(F.col("parts"))
    near = F.slice("parts", 2, 5)
    first = lambda like: F.get(F.filter(near, lambda p: p.rlike(like)), F.lit(0))
    rated, counted = first(RATING), first(REVIEWS)
    return found.select(
        *rest, "title", "position", "href", "label", "sku", F.get("parts", F.lit(0)).alias("item"), cards.full_title(F.get("parts", F.lit(0)), F.col("titles")).alias("full_title"), F.get(paid, F.lit(0)).alias("price"),
        cards.list_price(paid).alias("mrp"), rated.cast("double").alias("rating"), F.regexp_replace(counted, "[(),]", "").try_cast("long").alias("reviews"), cards.first_image(F.col("images")).alias("image"),
        (~text.sold_out(blob)).cast("int").alias("in_stock"),
    )


# The fields of a search suggestion, and of a product of the paged service.
SUGGESTED = "struct<id:string, handle:string, title:string, vendor:string, url:string, price:string, compare_at_price_max:string, available:boolean, featured_image:string, image:string>"
SERVED = "struct<PId:string, PNm:string, BNm:string, discprice:string, MRP:string, CrntStock:string, Images:string>"
PAGE_ROWS = 20


def suggested_offers(bodies: DataFrame, source: str, base: str = "") -> DataFrame:
    """bodies(body): answers of a shop's search. Empty fields, and an id of 0, count as missing; links are made absolute."""
    found = F.from_json("body", f"struct<resources:struct<results:struct<products:array<{SUGGESTED}>>>>")["resources"]["results"]["products"]
    p = bodies.select(F.explode(found).alias("p")).select("p.*")
    known = lambda c: F.nullif(F.trim(c), F.lit(""))
    return p.filter(known("title").isNotNull()).select(
        F.lit(source).alias("source"),
        F.coalesce(F.nullif(known("id"), F.lit("0")), known("handle"), F.substring("title", 1, 60)).alias("source_sku"),
        text.clean(F.col("title")).alias("title"),
        text.parse_price(F.col("price")).alias("price"),
        text.parse_price(F.col("compare_at_price_max")).alias("mrp"),
        F.when(F.col("url").startswith("/"), F.concat(F.lit(base), "url")).otherwise(known("url")).alias("url"),
        F.coalesce(cards.picture(F.col("featured_image")), cards.picture(F.col("image"))).alias("image"),
        F.coalesce("available", F.lit(True)).cast("int").alias("in_stock"),
        known("vendor").alias("brand_hint"),
    )


def service_offers(pages: DataFrame, source: str, page_rows: int = PAGE_ROWS) -> DataFrame:
    """pages(query, page, body), gapless from 1: a product list within a JSON text within a JSON object.

    The walk of a query ends with its first page that is empty, short or without an id that is new; of rows with one id, the
    first counts. The list price is kept only above the price; no stated stock is none."""
    inner = F.from_json(F.get_json_object("body", "$.ProductResponse"), f"struct<Products:array<{SERVED}>>")["Products"]
    p = pages.select("query", "page", F.coalesce(inner, F.array()).alias("rows"))
    each = p.select("query", "page", F.posexplode("rows").alias("pos", "p")).filter(F.coalesce(F.col("p.PId"), F.lit("")) != "")
    firsts = each.groupBy("query", F.col("p.PId").alias("source_sku")).agg(F.min_by("p", F.struct("page", "pos")).alias("p"), F.min("page").alias("page"))
    fresh = firsts.groupBy("query", "page").agg(F.count(F.lit(1)).alias("fresh"))
    ends = p.select("query", "page", F.size("rows").alias("n")).join(fresh, ["query", "page"], "left").filter((F.col("n") < page_rows) | F.col("fresh").isNull())
    ends = ends.groupBy("query").agg(F.min("page").alias("last"))
    price, mrp = text.parse_price(F.col("p.discprice")), text.parse_price(F.col("p.MRP"))
    image = F.get(F.filter(F.split("p.Images", ";"), lambda x: x != ""), F.lit(0))
    kept = firsts.join(ends, "query", "left").filter(F.col("last").isNull() | (F.col("page") <= F.col("last")))
    return kept.select(
        "query", F.lit(source).alias("source"), "source_sku", F.col("p.PNm").alias("title"), price.alias("price"), F.when(mrp > price, mrp).alias("mrp"),
        (F.coalesce(text.parse_price(F.col("p.CrntStock")), F.lit(0.0)) > 0).cast("int").alias("in_stock"), image.alias("image"), F.nullif(F.trim("p.BNm"), F.lit("")).alias("brand_hint"),
    )


# How a landing page hides the numbers by which the paged service is asked.
HIDDEN = r"""(?i)<input[^>]*?type=["']hidden["'][^>]*?id=["'](catid|brandid)["'][^>]*?value=["']([^"']*)["']"""


def listing_ids(html: Column, pattern: str = HIDDEN) -> Column:
    """struct(catid, brandid) of a landing page, or null where either is missing or empty; of several values the last counts."""
    names, values = (F.regexp_extract_all(html, F.lit(pattern), F.lit(k)) for k in (1, 2))
    pairs = F.zip_with(names, values, lambda n, v: F.struct(F.lower(n).alias("name"), v.alias("value")))
    last = lambda name: F.nullif(F.try_element_at(F.filter(pairs, lambda x: x["name"] == name), F.lit(-1))["value"], F.lit(""))
    catid, brandid = last("catid"), last("brandid")
    return F.when(catid.isNotNull() & brandid.isNotNull(), F.struct(catid.alias("catid"), brandid.alias("brandid")))


def searched_offers(landings: DataFrame, pages: DataFrame, source: str, mark: str, fields: dict[str, str]) -> DataFrame:
    """Offers of searches by the paged service, or by the cards of the page where they landed.

    landings(query, status, html): where each query landed. One whose page has the ids of a listing is answered by the pages(catid,
    brandid, page, body) of these; another one by its page's cards, cut at `mark`. A query that failed gives nothing. Queries with equal
    ids are each answered. Offers are first of their query by sku, as the service is read."""
    landed = landings.filter("status = 200").withColumn("_ids", listing_ids(F.col("html")))
    ids = landed.filter("_ids is not null").select("query", "_ids.catid", "_ids.brandid")
    served = service_offers(pages.join(ids, ["catid", "brandid"]).select("query", "page", "body"), source)
    shown = landed.filter("_ids is null").select("query", F.posexplode(F.split("html", mark)).alias("at", "c")).filter("at > 0")
    shown = shown.select("query", *[F.nullif(F.regexp_extract("c", p, 1), F.lit("")).alias(f) for f, p in fields.items()])
    price = text.parse_price(F.col("price"))
    shown = shown.select("query", F.lit(source).alias("source"), F.col("sku").alias("source_sku"), "title", price.alias("price"), price.isNotNull().cast("int").alias("in_stock"))
    return served.unionByName(shown, allowMissingColumns=True)


def harvested_offers(bodies: DataFrame, source: str, headings: str = r"^(?i)(showing|search)\s+results|^results\s+for|^did you mean") -> DataFrame:
    """bodies(body): offers in JSON of any shape. Headings are none, nor is an object with neither a price nor a word on stock."""
    rows = cards.harvested(bodies)
    rows = rows.withColumn("title", text.clean(F.col("title"))).filter((F.col("title") != "") & ~F.col("title").rlike(headings))
    price = as_price(cards.amount(F.col("price")))
    return rows.withColumn("price", price).filter(F.col("stock").isNotNull() | F.col("price").isNotNull()).select(
        F.lit(source).alias("source"), F.col("sku").alias("source_sku"), "title", "price", as_price(cards.amount(F.col("mrp"))).alias("mrp"),
        as_stock(F.col("stock")).cast("int").alias("in_stock"), cards.picture(F.col("image")).alias("image"),
    )


def registry(stores: DataFrame, defaults: dict, only: Sequence[str] = ()) -> DataFrame:
    """stores(name, enabled, ...) with defaults where a store states nothing; those that are enabled and asked for."""
    filled = stores.select(*[F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in stores.columns])
    return filled.filter(F.coalesce("enabled", F.lit(True)) & (F.col("name").isin(*only) if only else F.lit(True)))


def place(asked: Column, places: Sequence[tuple[str, str, float, float]]) -> Column:
    """struct(label, pincode, lat, lon, hint) of a city or a six-digit code among places(label, pincode, lat, lon), the first that fits.

    A city that is unknown has a null label, and up to five that contain what was asked as a hint. Null and blank fit none."""
    q = F.trim(asked)
    table = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("pincode"), F.lit(c).alias("lat"), F.lit(d).alias("lon")) for a, b, c, d in places])
    by_code = q.rlike("^[0-9]{6}$")
    found = F.get(F.filter(table, lambda p: F.when(by_code, p["pincode"] == q).otherwise(F.lower(p["label"]) == F.lower(q))), F.lit(0))
    near = F.slice(F.transform(F.filter(table, lambda p: F.lower(p["label"]).contains(F.lower(q))), lambda p: p["label"]), 1, 5)
    hint = F.when(found.isNull() & ~by_code & (q != ""), F.nullif(F.array_join(near, ", "), F.lit("")))
    return F.struct(found["label"].alias("label"), found["pincode"].alias("pincode"), found["lat"].alias("lat"), found["lon"].alias("lon"), hint.alias("hint"))

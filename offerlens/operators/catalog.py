"""The faceted catalogue: filters, one row a product, order, page, and the offers of a page."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: label -> [low, high), by which prices are offered; the top one ends as well.
PRICE_BANDS = {"0-10k": (0, 10_000), "10k-25k": (10_000, 25_000), "25k-50k": (25_000, 50_000), "50k-75k": (50_000, 75_000), "75k-100k": (75_000, 100_000)}
# Label -> [low, high] pieces, as customers see them.
PACK_BANDS = {"Single": (1, 1), "2-3 pack": (2, 3), "4-5 pack": (4, 5), "6+ pack": (6, 99)}
#: Rows of a page at most.
PAGE_ROWS = 200
MIXED, OTHER = "Mixed", "Other"


def buyable() -> Column:
    return (F.col("in_stock") == 1) & F.col("price").isNotNull()


def ceiling(*limits: float | None) -> float | None:
    """The tighter of the limits that are set; 0 counts as not set."""
    return min((x for x in limits if x), default=None)


@dataclass(frozen=True)
class CatalogQuery:
    text: str | None = None
    sources: tuple[str, ...] = ()
    brands: tuple[str, ...] = ()
    series: str | None = None
    realism: str | None = None
    packs: tuple[str, ...] = ()
    price_band: str | None = None
    min_price: float | None = None
    max_price: float | None = None
    in_stock: bool = False
    sold_out: bool = False
    sets: bool = False
    region: str | None = None
    sort: str = "price"
    limit: int = 60
    offset: int = 0
    bands: dict = field(default_factory=lambda: PRICE_BANDS)

    def predicates(self, raw: bool = False) -> list[Column]:
        """raw: whether offers have raw_title, what the seller wrote, which text is looked for in as well."""
        c, out = F.col, []
        if self.region:
            out.append(c("region") == self.region)
        if self.text:
            out.append(reduce(or_, [c(t).ilike(f"%{self.text}%") for t in (["title", "raw_title"] if raw else ["title"])]))
        if self.sources:
            out.append(c("source").isin(*self.sources))
        if self.brands:
            named = [b for b in self.brands if b != OTHER]
            out.append(reduce(or_, ([c("brand").isin(*named)] if named else []) + ([c("brand").isNull()] if OTHER in self.brands else [])))
        if self.series:
            out.append(c("series") == self.series)
        if self.realism:
            out.append(c("realism").isNull() if self.realism == MIXED else c("realism") == self.realism)
        if known := [PACK_BANDS[p] for p in self.packs if p in PACK_BANDS]:
            out.append(reduce(or_, [c("pack_size").between(lo, hi) for lo, hi in known]))
        if self.price_band in self.bands:
            lo, hi = self.bands[self.price_band]
            out.append((c("price") >= lo) & (c("price") < hi))
        if self.min_price is not None:
            out.append(c("price") >= self.min_price)
        if self.max_price is not None:
            out.append(c("price").isNull() | (c("price") <= self.max_price))
        if self.in_stock:
            out.append(buyable())
        if self.sold_out:
            out.append(c("in_stock") == 0)
        if self.sets:
            out.append(c("is_set") == 1)
        return out

    def order(self) -> list[Column]:
        c = F.col
        price = [(c("buyable_count") == 0).asc(), c("best_price").isNull().asc()]
        by = {
            "price": [*price, c("best_price").asc()],
            "price_desc": [*price, c("best_price").desc()],
            "savings": [(c("worst_price") - c("best_price")).desc_nulls_last()],
            "sources": [c("source_count").desc(), c("best_price").asc_nulls_first()],
            "rating": [c("rating").desc_nulls_last(), c("best_price").asc_nulls_first()],
            "title": [c("title").asc()],
        }
        return [*by.get(self.sort, [c("best_price").asc_nulls_first()]), c("product_id").asc()]


def filtered(offers: DataFrame, q: CatalogQuery) -> DataFrame:
    return offers.filter(reduce(and_, q.predicates("raw_title" in offers.columns), F.lit(True)))


def catalog(offers: DataFrame, q: CatalogQuery = CatalogQuery()) -> DataFrame:
    """A row for each product with an offer that passes."""
    can_buy = buyable()
    keys = ["product_id", "title", "brand", "series", "realism", "pack_size", "is_set"]
    out = filtered(offers, q).groupBy(*keys).agg(
        F.min("price").alias("best_price"),
        F.max("price").alias("worst_price"),
        F.count_distinct("source").alias("source_count"),
        F.sum(can_buy.cast("long")).alias("buyable_count"),
        F.sum((F.col("in_stock") == 0).cast("long")).alias("oos_count"),
        F.max("rating").alias("rating"),
        F.max("reviews").alias("reviews"),
    )
    return out.withColumn("savings", F.coalesce(F.round(F.col("worst_price") - F.col("best_price"), 2), F.lit(0.0)))


def clamped(limit: Column, offset: Column) -> tuple[Column, Column]:
    """The limit and offset that a request gets, whatever it asks for; what is not said is a full page from the start."""
    return F.greatest(F.lit(1), F.least(F.coalesce(limit, F.lit(PAGE_ROWS)), F.lit(PAGE_ROWS))), F.greatest(F.lit(0), F.coalesce(offset, F.lit(0)))


def page(offers: DataFrame, q: CatalogQuery) -> DataFrame:
    """The page of q, with one row more if there is another page; `position` counts from 1 over all pages."""
    limit, offset = max(1, min(q.limit, PAGE_ROWS)), max(0, q.offset)
    rows = catalog(offers, q).orderBy(*q.order()).offset(offset).limit(limit + 1)
    return rows.withColumn("has_more", F.count(F.lit(1)).over(_all()) > limit).withColumn("position", F.row_number().over(_all().orderBy(*q.order())) + offset)


def _all():
    from pyspark.sql import Window

    return Window.partitionBy()  # a page, 201 rows at most


def with_offers(rows: DataFrame, offers: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """rows(product_id, ...) with their offers nested, cheapest first and unpriced last; products without any have an empty list."""
    one = F.struct(F.col("price").isNull().alias("unpriced"), "price", "source", "source_sku", "region", "in_stock")
    nested = (scope or offers).join(rows.select("product_id"), "product_id", "left_semi").groupBy("product_id").agg(F.array_sort(F.collect_list(one)).alias("offers"))
    empty = F.array().cast(nested.schema["offers"].dataType)
    return rows.join(nested, "product_id", "left").withColumn("offers", F.coalesce("offers", empty))

"""Rules against offers, and the transitions that are worth telling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .catalog import buyable

#: Rules are written by hand; a table of more is refused, as it would be sent to all tasks.
MAX_RULES = 10_000


def bounded(rules: DataFrame) -> DataFrame:
    """rules, to be broadcast, after a check of their number."""
    if rules.limit(MAX_RULES + 1).count() > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    return F.broadcast(rules)


def source_list(c: Column) -> Column:
    """A comma-separated list as non-empty entries, without the white space around them."""
    return F.filter(F.transform(F.split(c, ","), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def unset(c: Column) -> Column:
    return c.isNull() | (c == "")


def matches(rules: DataFrame, offers: DataFrame) -> DataFrame:
    """Active rules with every offer that they fit; an unset condition fits all, as does the query *. Rules may lack the column series."""
    if "series" not in rules.columns:
        rules = rules.withColumn("series", F.lit(None).cast("string"))
    r = bounded(rules.filter("active = 1")).alias("r")
    names = source_list(F.coalesce(F.col("r.sources"), F.lit("")))
    asked = F.trim("r.query")
    fits = (
        (unset(asked) | (asked == "*") | F.lower("o.title").contains(F.lower(asked)))
        & (unset(F.col("r.brand")) | (F.col("r.brand") == F.col("o.brand")))
        & (unset(F.col("r.series")) | (F.col("r.series") == F.col("o.series")))
        & (unset(F.col("r.realism")) | (F.col("r.realism") == F.col("o.realism")))
        & (F.col("r.pack_min").isNull() | (F.col("o.pack_size") >= F.col("r.pack_min")))
        & (F.col("r.pack_max").isNull() | (F.col("o.pack_size") <= F.col("r.pack_max")))
        & ((F.size(names) == 0) | F.array_contains(names, F.col("o.source")))
    )
    return offers.alias("o").join(r, fits).select("r.rule_id", "r.target", "r.stock_only", "o.*")


def best_offers(matched: DataFrame) -> DataFrame:
    """One offer for each rule, product and source: in stock first, then priced, then cheapest, then by offer."""
    key = ["rule_id", "product_id", "source"]
    order = F.struct((-F.col("in_stock")).alias("a"), F.col("price").isNull().alias("b"), F.col("price"), F.col("source_sku"), F.col("region"))
    rest = [c for c in matched.columns if c not in key]
    return matched.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*key, *[F.col(f"r.{c}").alias(c) for c in rest])


def transition(was_seen: Column, was_stock: Column, was_price: Column) -> Column:
    """new, back or drop, or null, from what was remembered of the offer."""
    can_buy, target = buyable(), F.col("target")
    fresh = ~was_seen & (can_buy | (F.coalesce(F.col("stock_only"), F.lit(1)) == 0))
    back = was_seen & can_buy & (was_stock == 0)
    drop = was_seen & (target > 0) & can_buy & (F.col("price") <= target) & (was_price.isNull() | (was_price > target))
    return F.when(fresh, "new").when(F.coalesce(back, F.lit(False)), "back").when(F.coalesce(drop, F.lit(False)), "drop")


def evaluate(best: DataFrame, remembered: DataFrame, max_markup: float | None = None, seed: bool = False) -> DataFrame:
    """best offers with `kind`: what they have become since remembered(rule_id, product_id, source, price, in_stock).

    An offer too far above its baseline is not told, but will be remembered like any other. A first run (seed) tells nothing."""
    m = remembered.select("rule_id", "product_id", "source", F.col("price").alias("was_price"), F.col("in_stock").alias("was_stock"), F.lit(True).alias("seen"))
    out = best.join(m, ["rule_id", "product_id", "source"], "left")
    kind = transition(F.coalesce("seen", F.lit(False)), F.col("was_stock"), F.col("was_price"))
    if max_markup is not None:
        kind = F.when(F.coalesce(F.col("markup") <= max_markup, F.lit(True)), kind)
    return out.withColumn("kind", F.lit(None).cast("string") if seed else kind).drop("seen")


def remember(best: DataFrame, remembered: DataFrame) -> DataFrame:
    """The state after a run: all that matched now, and what did not match as it was."""
    key = ["rule_id", "product_id", "source"]
    now = best.select(*key, "price", "in_stock")
    return remembered.select(*now.columns).join(now, key, "left_anti").unionByName(now)


def suppress(alerts: DataFrame, muted: list[str], paused: bool) -> DataFrame:
    return alerts.filter(F.lit(not paused) & ~F.col("source").isin(*muted) if muted else F.lit(not paused))


def first_by_kind(alerts: DataFrame, keep: int = 10) -> DataFrame:
    """The first `keep` of each kind, with how many more there are.

    Only the rank is a window, so that each task drops what comes after its first `keep` before rows meet by kind."""
    w = Window.partitionBy("kind").orderBy("rule_id", "product_id", "source")
    first = alerts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)
    counts = alerts.groupBy(F.col("kind").alias("_kind")).agg(F.greatest(F.count(F.lit(1)) - keep, F.lit(0)).alias("more"))
    return first.join(counts, first["kind"].eqNullSafe(counts["_kind"])).drop("_kind")


def shape(n: Column, pictured: Column) -> Column:
    """How a message goes out: text, photo, album, or text with an album."""
    return F.when(pictured == 0, "text").when((pictured == n) & (n == 1), "photo").when((pictured == n) & (n <= 10), "album").otherwise("text+album")


def pending(updates: DataFrame, cursor: int | None, most: int = 40) -> DataFrame:
    """The next updates(update_id, ...) after the cursor, at most `most`, and the cursor once each is answered."""
    later = updates.filter(F.col("update_id") > cursor) if cursor is not None else updates
    return later.orderBy("update_id").limit(most).withColumn("cursor", F.col("update_id"))

"""Current state and change history from observations, and keyed upserts as unions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import shared

#: Prices closer than this are the same.
EPSILON = 0.001
#: About how many rows of an order one task numbers.
SLICE = 50_000


def latest(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key. Spark cuts ranks before the shuffle, so a hot key sends one row a task."""
    w = Window.partitionBy(*key).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def moved(price: Column, before: Column) -> Column:
    """Whether a price differs from the one before: it appeared, went, or moved by more than EPSILON."""
    return (price.isNull() != before.isNull()) | F.coalesce(F.abs(price - before) > EPSILON, F.lit(False))


def price_changes(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows that start or change the price of their key; rows without a price change it, but are no history."""
    w = Window.partitionBy(*key).orderBy(*order)
    marked = rows.withColumn("_n", F.row_number().over(w)).withColumn("_before", F.lag("price").over(w))
    return marked.filter(((F.col("_n") == 1) | moved(F.col("price"), F.col("_before"))) & F.col("price").isNotNull()).drop("_n", "_before")


def seen_span(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def merge_entities(rows: DataFrame, key: Sequence[str], order: Sequence[str], first_known: Sequence[str], title: str = "title") -> DataFrame:
    """One row a key: the earliest known value of each attribute, and the longest title (of equal ones, the earliest)."""
    at = F.struct(*order)
    known = [F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in first_known]
    longest = F.min_by(title, F.struct((-F.length(title)).alias("n"), at.alias("at"))).alias(title)
    return rows.groupBy(*key).agg(longest, *known)


def newest_known(rows: DataFrame, key: Sequence[str], column: str, order: Sequence[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.max_by(column, F.when(F.col(column).isNotNull(), F.struct(*order))).alias(column))


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """old with the rows of new in place of those of equal key; neither is updated in place."""
    same = [old[k].eqNullSafe(new[k]) for k in key]
    return old.join(new, same, "left_anti").unionByName(new, allowMissingColumns=True)


def sync(config: DataFrame, stored: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """What makes stored follow config: an action (insert, update, deactivate, keep) for each key of either.

    An empty config changes nothing."""
    c, s = config.alias("c"), stored.alias("s")
    differs = F.lit(False)
    for name in columns:
        differs = differs | ~F.col(f"c.{name}").eqNullSafe(F.col(f"s.{name}"))
    any_config = config.agg(F.count(F.lit(1)).alias("n_config"))
    action = (
        F.when(F.col(f"s.{key}").isNull(), "insert")
        .when(F.col(f"c.{key}").isNull(), F.when(F.col("s.active") == 1, "deactivate").otherwise("keep"))
        .when(differs | (F.col("s.active") != 1), "update")
        .otherwise("keep")
    )
    both = c.join(s, F.col(f"c.{key}") == F.col(f"s.{key}"), "full_outer").join(any_config)  # one row
    return both.select(F.coalesce(f"c.{key}", f"s.{key}").alias(key), F.when(F.col("n_config") == 0, "keep").otherwise(action).alias("action"))


def migrate(rows: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """rows with the columns that they lack, as name -> (type, default); columns that are there stay as they are, and may be null."""
    have = {c.lower() for c in rows.columns}
    return rows.select(*rows.columns, *[F.lit(default).cast(kind).alias(name) for name, (kind, default) in columns.items() if name.lower() not in have])


def runs(started: DataFrame) -> DataFrame:
    """Runs with a status; those that never finished were interrupted."""
    return started.withColumn("status", F.when(F.col("finished").isNull(), "interrupted").otherwise("ok"))


def positions(rows: DataFrame, order: Sequence[Column], name: str = "n", slice_rows: int = SLICE) -> DataFrame:
    """rows with their position from 1 in an ascending order of all rows.

    Rows are dealt to tasks by range of the order, each task numbers its own, and these numbers are moved by the rows of the tasks before.
    Equal rows may lie in several tasks, as a hash of the row and its place go on with the order, so a key with many rows is split."""
    keys = [*[f"_o{k}" for k in range(len(order))], "_hash", "_place"]
    keyed = rows.select("*", *[c.alias(k) for c, k in zip(order, keys)], F.xxhash64(*rows.columns).alias("_hash"), F.monotonically_increasing_id().alias("_place"))
    slices = max(1, -(-rows.count() // slice_rows))
    # an id has the task above its low 33 bits and the row's number below; both are kept by writing the rows once
    placed = keyed.repartitionByRange(slices, *keys).sortWithinPartitions(*keys).select(*rows.columns, F.monotonically_increasing_id().alias("_at"))
    placed = shared.stored(placed).withColumn("_task", F.shiftright("_at", 33))
    before, counts = [0], placed.groupBy("_task").count().orderBy("_task").collect()  # a row a task
    for r in counts:
        before.append(before[-1] + r["count"])
    moved_by = rows.sparkSession.createDataFrame([(r["_task"], b) for r, b in zip(counts, before)], "_task long, _before long")
    out = placed.join(F.broadcast(moved_by), "_task")
    return out.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).select(*rows.columns, name)

"""The engine's tables, derived from the star schema: products, observations, and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import state
from ..tables import shared

#: What one offer is: a seller's item in a region.
OFFER = ("source", "source_sku", "region")


#: Sightings from which they are dealt by number; about how many one task then has; and parts that a task writes without sorting them in memory.
MANY, SIGHTINGS, WRITTEN = 5_000_000, 250_000, 200


def tasks(spark: SparkSession, sf_dir: str) -> int | None:
    """Over how many tasks sightings are dealt, so that what a task sorts or groups does not grow with them; None where they are few and Spark deals them.

    Counting reads the files' footers. From WRITTEN times SIGHTINGS on, a task's share grows again."""
    n = table(spark, sf_dir, "lineitem").count()
    return max(shared.partitions(spark), min(WRITTEN, -(-n // SIGHTINGS))) if n > MANY else None


def dealt(rows: DataFrame, n: int | None, *columns: str) -> DataFrame:
    return rows.repartition(n, *columns) if n else rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    pack = (F.col("p_size") % 8 + 1).cast("int")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("title"),
        F.when(F.col("p_brand") != "Brand#25", F.col("p_brand")).alias("brand"),
        F.when(F.col("p_type") != "STANDARD", F.col("p_type")).alias("series"),
        pack.alias("pack_size"),
        (pack > 1).cast("int").alias("is_set"),
        F.when(pack == 1, F.when(F.col("p_partkey") % 3 == 0, "Fantasy").otherwise("Realistic")).alias("realism"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sighting of an offer. The price is null where the seller shows none."""
    return _observed(spark, sf_dir, tasks(spark, sf_dir))


def _observed(spark: SparkSession, sf_dir: str, n: int | None) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    sellers = (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("s_suppkey", F.col("s_name").alias("source"), F.col("r_name").alias("region"))
    )
    sellers = sellers.hint("shuffle_hash") if n else sellers  # a task holds its few sellers, and does not sort its sightings
    returned = F.col("l_returnflag") == "R"
    hidden = (returned & (F.col("l_linestatus") == "F")) | ((F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 7))
    rated = F.col("l_linenumber") != 6
    return line.join(sellers, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_partkey").alias("product_id"),
        F.col("l_partkey").cast("string").alias("source_sku"),
        "source",
        "region",
        F.col("l_shipdate").alias("ts"),
        F.col("l_orderkey").alias("o1"),
        F.col("l_linenumber").alias("o2"),
        F.when(~hidden, F.col("l_extendedprice")).alias("price"),
        F.when(returned, 0).otherwise(1).alias("in_stock"),
        F.when(rated, (F.col("l_linenumber") % 5 + 1).cast("double")).alias("rating"),
        F.when(rated, F.col("l_quantity").cast("int")).alias("reviews"),
    )


def by_offer(spark: SparkSession, sf_dir: str, n: int | None) -> DataFrame:
    """Sightings, where they are many, dealt by offer: a task has few of them, but all of one offer, however many, which it sorts with spills."""
    return dealt(_observed(spark, sf_dir, n), n, *OFFER)


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listings(spark, sf_dir, tasks(spark, sf_dir))


def _listings(spark: SparkSession, sf_dir: str, n: int | None) -> DataFrame:
    return state.latest(by_offer(spark, sf_dir, n), OFFER, ("ts", "o1", "o2"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.price_changes(by_offer(spark, sf_dir, tasks(spark, sf_dir)), OFFER, ("ts", "o1", "o2"))


def seen_before(spark: SparkSession, sf_dir: str, until: str = "2000-01-01") -> DataFrame:
    """What was remembered at a point in time."""
    early = by_offer(spark, sf_dir, tasks(spark, sf_dir)).filter(F.col("ts") < F.lit(until).cast("timestamp_ntz"))
    return state.latest(early, OFFER, ("ts", "o1", "o2"))


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current offers with the columns of their products, and the title as the seller writes it. Many are dealt by product, so that what is counted by product needs no other shuffle."""
    p, n = products(spark, sf_dir).withColumnRenamed("id", "product_id"), tasks(spark, sf_dir)
    joined = dealt(_listings(spark, sf_dir, n), n, "product_id").join(shared.large(p) if n else p, "product_id")
    return joined.withColumn("raw_title", F.concat_ws(" by ", "title", "source"))

"""Alerts as messages that are delivered once: an outbox in a store, filled batch by batch and emptied by tasks.

A message has a delivery key, made from what it says and whom it is for. Filling the outbox is a keyed upsert of a numbered batch, so a
batch that comes again adds nothing. Delivery hands each waiting message to a transport in a task of its own and notes how it went; a
message that failed is tried again, and one whose channel is down keeps no other channel's waiting. If a run dies between delivery and
note, the message is handed over again with the same key, by which the transport knows it."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import messages
from ..operators import alerts as rules
from ..tables import shared
from ..tables.store import Conflict, Store

#: Alerts of one message at most, as many as an album has pictures; and attempts.
CHUNK, ATTEMPTS = 10, 5
OUTBOX = "channel string, delivery_key string, shape string, alerts int, body string, pictures array<struct<url:string,caption:string>>, batch long, attempts int, state string, error string"


def composed(told: DataFrame, order: list[Column], chunk: int = CHUNK) -> DataFrame:
    """told(channel, line, caption, url) as messages(channel, delivery_key, shape, alerts, body, pictures) of `chunk` alerts at most, in order.

    The alerts of a channel with many are dealt by hash among groups of some hundred messages, and ordered within them. A body is cut to
    what a message may have; a message whose alerts all have pictures goes out as a photo or an album, without a text of its own."""
    rows = told.withColumn("_order", F.struct(*order))
    sizes = rows.groupBy("channel").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / (100 * chunk))).alias("_groups"))
    rows = rows.join(sizes.withColumnRenamed("channel", "_to"), F.col("channel").eqNullSafe(F.col("_to"))).drop("_to")
    rows = rows.withColumn("_group", F.pmod(F.xxhash64("_order", "line"), F.col("_groups")))
    rows = rows.withColumn("_chunk", F.floor((F.row_number().over(Window.partitionBy("channel", "_group").orderBy("_order", "line")) - 1) / chunk))
    one = F.struct("_order", "line", "url", F.substring("caption", 1, messages.CAPTION).alias("caption"))
    made = rows.groupBy("channel", "_group", "_chunk").agg(F.array_sort(F.collect_list(one)).alias("a"))
    pictured = F.filter("a", lambda x: F.coalesce(x["url"], F.lit("")) != "")
    shape = rules.shape(F.size("a"), F.size(pictured))
    body = F.when(shape.isin("text", "text+album"), F.substring(F.array_join(F.transform("a", lambda x: x["line"]), "\n\n"), 1, messages.MESSAGE)).otherwise("")
    out = made.select("channel", shape.alias("shape"), F.size("a").alias("alerts"), body.alias("body"), F.transform(pictured, lambda x: F.struct(x["url"].alias("url"), x["caption"].alias("caption"))).alias("pictures"))
    return out.withColumn("delivery_key", F.sha2(F.to_json(F.struct("channel", "shape", "body", "pictures")), 256))


def _first(old: DataFrame, new: DataFrame) -> DataFrame:
    """Messages that are there stay as they are; a message that is composed twice is one."""
    fresh = new.dropDuplicates(["channel", "delivery_key"]).join(old.select("delivery_key"), "delivery_key", "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def queue(store: Store, composed_: DataFrame, writer: str, batch: int, buckets: int = 4) -> int:
    """Messages of a numbered batch into the outbox; the version after it. A batch that was queued before changes nothing."""
    t = store.begin(writer, batch)
    if t is None:
        return store.version()
    schema = store.spark.createDataFrame([], OUTBOX).schema
    t.create("outbox", schema, ("channel", "delivery_key"), (), buckets)
    new = composed_.withColumns({"batch": F.lit(batch).cast("long"), "attempts": F.lit(0), "state": F.lit("waiting"), "error": F.lit(None).cast("string")})
    t.upsert("outbox", shared.stored(new.select(*schema.names)), _first)
    return t.commit()


def _attempted(send: Callable):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            errors = []
            for r in pdf.itertuples(index=False):
                try:
                    send(r.channel, r.delivery_key, {"shape": r.shape, "body": r.body, "pictures": [dict(p) if isinstance(p, dict) else p.asDict() for p in r.pictures]})
                    errors.append(None)
                except Exception as e:  # one message that fails keeps no other waiting
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"channel": pdf["channel"], "delivery_key": pdf["delivery_key"], "failure": errors})

    return run


def _noted(old: DataFrame, results: DataFrame) -> DataFrame:
    r = results.select(F.col("delivery_key").alias("_key"), "failure", F.lit(1).alias("tried"))
    rows = old.join(r, F.col("delivery_key") == F.col("_key"), "left")
    tried = F.col("tried").isNotNull()
    return rows.select(
        *[c for c in old.columns if c not in ("attempts", "state", "error")], (F.col("attempts") + F.coalesce("tried", F.lit(0))).alias("attempts"),
        F.when(tried, F.when(F.col("failure").isNull(), "sent").otherwise("failed")).otherwise(F.col("state")).alias("state"), F.when(tried, F.col("failure")).otherwise(F.col("error")).alias("error"),
    ).select(*old.columns)


def deliver(store: Store, send: Callable, attempts: int = ATTEMPTS, again: int = 3) -> int:
    """Hands waiting and failed messages with fewer than `attempts` to send(channel, key, message); the version in which the outcome is noted.

    Outcomes are written before they are noted, so a note that meets another transaction is made again without a second delivery."""
    waiting = store.read("outbox").filter((F.col("state") != "sent") & (F.col("attempts") < attempts))
    results = shared.stored(waiting.repartition("delivery_key").mapInPandas(_attempted(send), "channel string, delivery_key string, failure string"))
    for left in range(again, -1, -1):
        t = store.begin()
        t.upsert("outbox", results, _noted)
        try:
            return t.commit()
        except Conflict:
            if not left:
                raise


def to_folder(folder: str) -> Callable:
    """A transport into a mounted folder that tasks share: a file a delivery, named by its key, so a message that comes again is the same file."""
    if "://" in folder and not folder.startswith("file://"):
        raise ValueError("deliveries go into a mounted folder")
    path = folder.removeprefix("file://").removeprefix("file:")

    def send(channel: str, key: str, message: dict) -> None:
        os.makedirs(path, exist_ok=True)
        part = f"{path}/.{uuid.uuid4().hex}"
        with open(part, "w", encoding="utf-8") as out:
            json.dump({"channel": channel, **message}, out)
        os.replace(part, f"{path}/{key}.json")

    return send


def run_available(stream: DataFrame, store: Store, compose: Callable[[DataFrame], DataFrame], send: Callable, checkpoint: str, writer: str = "alerts") -> None:
    """Each micro-batch of told alerts through compose into the outbox, and what waits there to send."""

    def batch(rows: DataFrame, number: int) -> None:
        queue(store, compose(rows), writer, number)
        deliver(store, send)

    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start().awaitTermination()

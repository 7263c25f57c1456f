"""Price changes and alert transitions of a stream whose rows come in any order, by timers of event time.

Rows of a key are held until the watermark has passed them: then no earlier one can come, and they are told in the order of (ts, seq), so
the answer is that of the batch form however rows were shuffled within the delay. A row later than the delay is not told; Spark counts
it (numRowsDroppedByWatermark, see `late`). What a key was last is kept for `forget` after its last row, and with it the state of keys
that are seen no more goes; without `forget` it stays. Held are the rows of one delay at most. Keys are dealt to BUCKETS buckets, and a
task takes one bucket's held rows and last prices at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.state import EPSILON
from .changes import CHANGED, TOLD

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Keys share the state of a bucket, as a call for each key and micro-batch takes much longer than its few rows.
BUCKETS = 256
#: A row as state holds it, many to a binary value. price and stock are NaN where they are null.
_ROW = np.dtype([("key", "i8"), ("keyless", "?"), ("us", "i8"), ("seq", "i8"), ("price", "f8"), ("stock", "f8")])
CHUNK = 1 << 16
_GIVES = "key long, us long, seq long, price double, kind string"


def moved(last: tuple | None, price: float | None, in_stock: int | None) -> str | None:
    """'moved' where a price appears or moves by more than EPSILON. last: (us, price, in_stock) of the row before, if there is one."""
    if price is None:
        return None
    return "moved" if last is None or last[1] is None or abs(price - last[1]) > EPSILON else None


def transition(target: float | None, stock_only: bool):
    """new, back or drop, as rules tell them."""

    def kind(last: tuple | None, price: float | None, in_stock: int | None) -> str | None:
        can_buy = price is not None and in_stock == 1
        if last is None:
            return "new" if can_buy or not stock_only else None
        if can_buy and last[2] != 1:
            return "back"
        return "drop" if can_buy and target and price <= target and (last[1] is None or last[1] > target) else None

    return kind


def _chunks(rows: np.ndarray) -> list[tuple[bytes]]:
    return [(rows[k : k + CHUNK].tobytes(),) for k in range(0, len(rows), CHUNK)]


def _rows(chunks) -> np.ndarray:
    return np.concatenate([np.zeros(0, _ROW), *(np.frombuffer(c[0], _ROW) for c in chunks)])


class Held(StatefulProcessor):
    """The rows of the keys of one bucket. tell: what (last row, price, in_stock) are worth telling, or None; forget: microseconds after which a key is forgotten."""

    def __init__(self, tell, forget: int | None):
        self.tell, self.forget = tell, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows, self.last = handle.getListState("rows", "chunk binary"), handle.getListState("last", "chunk binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for pdf in rows:
            held = np.zeros(len(pdf), _ROW)
            for c in _ROW.names:
                held[c] = pdf[c].to_numpy()
            new += [held]
        new = np.concatenate(new)
        self.rows.appendList(_chunks(new))
        self._remind(int(new["us"].min()))
        yield from ()

    def _remind(self, us: int) -> None:
        """A timer at the millisecond by which a row is surely passed."""
        self.handle.registerTimer(us // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = _rows(self.rows.get())
        due, rest = held[held["us"] < now], held[held["us"] >= now]
        if not len(due) and self.forget is None:
            return
        before = _rows(self.last.get())
        told = self._told(due, before, now)
        if len(due):
            self.rows.put(_chunks(rest)) if len(rest) else self.rows.clear()
        if len(rest):
            self._remind(int(rest["us"].min()))
        if told:
            pdf = pd.DataFrame(told, columns=["key", "us", "seq", "price", "kind"])
            yield pdf.astype({"key": "Int64"})

    def _told(self, due: np.ndarray, before: np.ndarray, now: int) -> list[tuple]:
        """What is told of rows that are due, key by key in the order of (us, seq); what each key was last is kept, or forgotten."""
        plain = lambda x: None if x != x else x
        last = {r[:2]: (r[2], plain(r[4]), None if r[5] != r[5] else int(r[5])) for r in before.tolist()}
        out = []
        for key, keyless, us, seq, price, stock in due[np.lexsort((due["seq"], due["us"]))].tolist():
            price, stock, of = plain(price), None if stock != stock else int(stock), (key, keyless)
            was = last.get(of)
            if was is not None and self.forget is not None and us - was[0] > self.forget:
                was = None  # whether or not its timer came between
            kind = self.tell(was, price, stock)
            if kind is not None:
                out.append((None if keyless else key, us, seq, price, kind))
            last[of] = (us, price, stock)
        nan = float("nan")
        kept = [(*k, us, 0, nan if p is None else p, nan if s is None else s) for k, (us, p, s) in last.items() if self.forget is None or us + self.forget >= now]
        if kept:
            self.last.put(_chunks(np.array(kept, _ROW)))
            if self.forget is not None:
                self._remind(min(r[2] for r in kept) + self.forget)
        elif len(before):
            self.last.clear()
        return out

    def close(self) -> None:
        pass


def _through(stream: DataFrame, processor: Held, gives: str, delay: str) -> DataFrame:
    c = F.col
    stock = c("in_stock") if "in_stock" in stream.columns else F.lit(1)
    timed = stream.withWatermark("ts", delay).select(
        F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).alias("bucket"), "ts", F.coalesce("key", F.lit(0)).cast("long").alias("key"), c("key").isNull().alias("keyless"), F.unix_micros("ts").alias("us"), c("seq").cast("long").alias("seq"),
        c("price").cast("double").alias("price"), stock.cast("double").alias("stock"),
    )
    told = timed.groupBy("bucket").transformWithStateInPandas(processor, _GIVES, "Append", "EventTime")
    return told.withColumn("ts", F.timestamp_micros("us")).select(*[f.split()[0] for f in gives.split(", ")])


def price_changes(stream: DataFrame, delay: str, forget_days: float | None = None) -> DataFrame:
    """stream(key, ts, seq, price) as its changes, told once the watermark, `delay` behind the newest row, has passed them."""
    return _through(stream, Held(moved, None if forget_days is None else int(forget_days * 86_400_000_000)), CHANGED, delay)


def transitions(stream: DataFrame, delay: str, target: float | None = None, stock_only: bool = True, forget_days: float | None = None) -> DataFrame:
    """stream(key, ts, seq, price, in_stock) as what is worth telling: new, back or drop. A key that was forgotten is new again."""
    return _through(stream, Held(transition(target, stock_only), None if forget_days is None else int(forget_days * 86_400_000_000)), TOLD, delay)


def run_available(spark: SparkSession, path: str, schema, shape, out: str, operator, gives: str, files: int = 1) -> tuple[DataFrame, int]:
    """All that is there now of a folder of Parquet files, some files at a time in the order of arrival, into out; and how many rows came too late."""
    conf = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(conf)
    spark.conf.set(conf, ROCKSDB)  # timers and lists of state need it
    try:
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
        query = operator(shape(rows)).writeStream.format("parquet").option("checkpointLocation", f"{out}-state").option("path", out).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(conf, before)
    return spark.read.schema(gives).parquet(out), late(query)


def late(query) -> int:
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)

"""Price changes in a stream of observations: keyed state holds each offer's last price and time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.state import EPSILON
from ..tables import shared


def state_folder(spark: SparkSession) -> str:
    """A fresh folder for a stream's checkpoint and output, below the shared one."""
    return shared.folder(spark, "stream")


CHANGED = "key long, ts timestamp, seq long, price double"
TOLD = f"{CHANGED}, kind string"


def _changes(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows that start or move a price, in time order within a micro-batch; rows older than the state are late and left out."""
    seen = state.exists
    at, priced, last = state.get if seen else (None, False, 0.0)
    rows, out = pd.concat(list(batches)).sort_values(["ts", "seq"]), []
    for ts, seq, price in rows[["ts", "seq", "price"]].itertuples(index=False):
        if seen and (ts.value, seq) <= tuple(at):
            continue
        has = not pd.isna(price)
        if has and (not seen or not priced or abs(price - last) > EPSILON):
            out.append((key[0], ts, seq, price))
        seen, at, priced, last = True, (ts.value, int(seq)), has, float(price) if has else 0.0
    if seen:
        state.update((list(at), priced, last))
    yield pd.DataFrame(out, columns=["key", "ts", "seq", "price"])


def price_changes(stream: DataFrame) -> DataFrame:
    """stream(key, ts, seq, price) as its changes; equal to the batch form if rows come in order."""
    return stream.groupBy("key").applyInPandasWithState(_changes, CHANGED, "at array<long>, priced boolean, last double", "append", GroupStateTimeout.NoTimeout)


def _transitions(target: float | None, stock_only: bool):
    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Transitions of one rule's offer, in time order within a micro-batch; the state is always brought up to date."""
        seen = state.exists
        at, priced, last, stocked = state.get if seen else (None, False, 0.0, False)
        rows, out = pd.concat(list(batches)).sort_values(["ts", "seq"]), []
        for ts, seq, price, stock in rows[["ts", "seq", "price", "in_stock"]].itertuples(index=False):
            if seen and (ts.value, seq) <= tuple(at):
                continue
            has = not pd.isna(price)
            can_buy, kind = has and stock == 1, None
            if not seen:
                kind = "new" if can_buy or not stock_only else None
            elif can_buy and not stocked:
                kind = "back"
            elif can_buy and target and price <= target and (not priced or last > target):
                kind = "drop"
            if kind:
                out.append((key[0], ts, seq, price, kind))
            seen, at, priced, last, stocked = True, (ts.value, int(seq)), has, float(price) if has else 0.0, stock == 1
        if seen:
            state.update((list(at), priced, last, bool(stocked)))
        yield pd.DataFrame(out, columns=["key", "ts", "seq", "price", "kind"])

    return run


def transitions(stream: DataFrame, target: float | None = None, stock_only: bool = True) -> DataFrame:
    """stream(key, ts, seq, price, in_stock) as what is worth telling: new, back or drop, as in the batch form."""
    return stream.groupBy("key").applyInPandasWithState(
        _transitions(target, stock_only), TOLD, "at array<long>, priced boolean, last double, stocked boolean", "append", GroupStateTimeout.NoTimeout
    )


def run_available(spark: SparkSession, path: str, schema, shape, out: str, operator=price_changes, gives: str = CHANGED) -> DataFrame:
    """All that is there now of a folder of Parquet files, through the stream operator, into out; a checkpoint beside it."""
    rows = spark.readStream.schema(schema).parquet(path)
    query = operator(shape(rows)).writeStream.format("parquet").option("checkpointLocation", f"{out}-state").option("path", out).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(gives).parquet(out)

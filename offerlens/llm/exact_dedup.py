"""Exact deduplication by a tree merge of sorted digest runs.

Every row becomes (digest, verifier, id) in one of `leaves` runs, chosen by a hash of its id and its place, so that null or repeated ids spread. In each binomial round, groups of
`fan_in` runs exchange their rows by (group, digest), are merged in digest order, and keep one row for each verified digest: the
identifier that stays and how many rows it stands for. After the last round one sorted run, dealt over all partitions by digest,
is left. A text that holds a third of all rows is thus at most one row a run after the leaves, and `fan_in` rows a merge.

The answer goes back by (digest, leaf), so the rows of a hot text return to as many tasks as there are leaves."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def _merge_runs(largest: bool):
    """Merges a sorted stream of (run, digest, verifier, keep, rows): neighbours with equal digest and verifier become one."""

    def merged(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if held is not None:
                t = pa.concat_tables([held, t])
            n = t.num_rows
            if not n:
                continue
            new = np.ones(n, bool)
            for name in ("run", "digest", "verifier"):
                c = t.column(name).combine_chunks()
                same = pa.compute.equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
                new[1:] = new[1:] & same if name == "run" else new[1:] & same
            new[1:] = ~new[1:]
            first = np.flatnonzero(new)
            keep = t.column("keep").to_numpy()
            kept = (np.maximum if largest else np.minimum).reduceat(keep, first)
            rows = np.add.reduceat(t.column("rows").to_numpy(), first)
            # with the fields as Spark sends them: counts are not null, and the next batch joins only a table of the same schema
            out = t.take(pa.array(first)).set_column(3, t.schema.field("keep"), pa.array(kept, pa.int64())).set_column(4, t.schema.field("rows"), pa.array(rows, pa.int64()))
            held = out.slice(len(first) - 1)
            yield from out.slice(0, len(first) - 1).combine_chunks().to_batches()
        if held is not None:
            yield from held.combine_chunks().to_batches()

    return merged


def exact_groups(docs: DataFrame, text: Column, doc_id: str = "doc_id", keep: str = "largest", fan_in: int = 8) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), a row for each row of docs.

    text: what is compared, null as empty. keep: 'largest' or 'smallest' id of a group stays. Null ids lose to any other; a
    group of null ids alone has keep_id null and keeps its rows. Rows that repeat both id and text are all kept or all dropped,
    and each counts in group_size. Texts are read whole, however long; other columns are not read, whatever their names. An empty table gives no rows."""
    if keep not in ("largest", "smallest") or fan_in < 2:
        raise ValueError("keep is 'largest' or 'smallest'; fan_in is 2 or more")
    spark = docs.sparkSession
    leaves = common.shuffle_partitions(spark)
    worst = -(2**63) if keep == "largest" else 2**63 - 1
    whole = F.coalesce(text, F.lit(""))
    rows = docs.select(
        F.col(doc_id).cast("long").alias("id"),
        F.sha2(whole.cast("binary"), 256).alias("digest"),
        F.xxhash64(whole, F.octet_length(whole)).alias("verifier"),
    ).withColumn("leaf", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(leaves)).cast("int"))
    rows = common.checkpointed(rows)
    best = F.max if keep == "largest" else F.min
    runs = rows.groupBy(F.col("leaf").alias("run"), "digest", "verifier").agg(
        best(F.coalesce("id", F.lit(worst))).alias("keep"), F.count(F.lit(1)).alias("rows")
    )
    runs = leaf_runs = common.checkpointed(runs)
    left = leaves
    schema = "run int, digest string, verifier long, keep long, rows long"
    while left > 1:
        left = -(-left // fan_in)
        runs = (
            runs.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
            .repartition(leaves, "run", "digest")
            .sortWithinPartitions("run", "digest", "verifier")
            .mapInArrow(_merge_runs(keep == "largest"), schema)
        )
    root = runs.select("digest", "verifier", F.col("keep").alias("keep_id"), F.col("rows").alias("group_size"))
    answers = leaf_runs.select(F.col("run").alias("leaf"), "digest", "verifier").join(root, ["digest", "verifier"])
    best_id = F.when(F.col("keep_id") != worst, F.col("keep_id"))
    return rows.join(answers, ["leaf", "digest", "verifier"]).select(
        F.col("id").alias("doc_id"), best_id.alias("keep_id"), "group_size", F.col("id").eqNullSafe(best_id).alias("kept"), F.col("digest").alias("text_sha256")
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(common.table(spark, sf_dir, "documents"), F.col("text"), keep="largest")


OP10_SQL = """
select doc_id,
       max(doc_id) over (partition by coalesce(text, '')) as keep_id,
       count(*) over (partition by coalesce(text, '')) as group_size,
       doc_id is not distinct from max(doc_id) over (partition by coalesce(text, '')) as kept,
       sha256(coalesce(text, '')) as text_sha256
from documents
"""

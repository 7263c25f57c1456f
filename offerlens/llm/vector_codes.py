"""Vectors as codes: each of 16 parts is named by the nearest of 64 entries, which two rounds of means have moved.

All arithmetic is on whole numbers, floor(256 * x), so distances, means and ties are exact and no order of rows changes them.

The nearest entry is found by exponion search. A part starts at the entry it had in the round before, at squared distance d. Every
entry that is as near lies within 2 * sqrt(d) of that one, so only those of its neighbours whose squared distance is at most 4 * d are
looked at, and the neighbours of each entry are sorted by distance once a round. Of equally near entries the lowest index counts.

Each round is a pass over a written table of the vectors and their codes. A task adds up its parts by entry; Spark adds the sums of
tasks, and only the sums of the entries, 64 times the vector's length, come to the driver. A lost task repeats its part of a pass."""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PARTS, ENTRIES, ROUNDS, STEPS = 16, 64, 2, 256
#: Components below this, once scaled, are computed in 64 bits: squared distances of up to 2**17 components fit. Others are computed in whole numbers of any size.
NARROW = 1 << 22
#: Rows whose parts are searched at once.
BLOCK = 2048
#: Sums travel as digits of 32 bits, the highest one with the sign.
LIMB = 32


class Codebooks:
    """The entries of every part, and the neighbours of each entry by distance."""

    def __init__(self, entries: np.ndarray):
        self.parts, self.size, self.width = entries.shape
        self.entries = entries.reshape(-1, self.width)
        apart = ((entries[:, :, None] - entries[:, None]) ** 2).sum(axis=3)
        order = np.argsort(apart, axis=2, kind="stable")
        self.apart = np.take_along_axis(apart, order, axis=2).reshape(-1, self.size)
        self.neighbour = (order + self.first()[:, None, None]).reshape(-1, self.size)

    def first(self) -> np.ndarray:
        """The number of each part's entry 0 among all entries."""
        return np.arange(self.parts) * self.size

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance), rows by parts, of x (rows, parts, width), beginning at the entries of start (rows, parts)."""
        shape, x = x.shape[:2], x.reshape(-1, self.width)
        at = (start + self.first()).reshape(-1)
        best = at.copy()
        d = ((x - self.entries[at]) ** 2).sum(axis=1)
        least, within = d.copy(), 4 * d
        some = np.arange(len(x))
        for j in range(self.size):
            some = some[self.apart[at[some], j] <= within[some]]
            if not len(some):
                break
            other = self.neighbour[at[some], j]
            far = ((x[some] - self.entries[other]) ** 2).sum(axis=1)
            nearer = (far < least[some]) | ((far == least[some]) & (other < best[some]))
            moved = some[nearer]
            best[moved], least[moved] = other[nearer], far[nearer]
        return best.reshape(shape) - self.first(), least.reshape(shape)


def limbs(value: int) -> list[int]:
    """A whole number as digits of LIMB bits, lowest first; the last one has the sign."""
    out = []
    while not -(1 << LIMB) < value < 1 << LIMB:
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def moved(entries: np.ndarray, sums: dict[int, int], counts: dict[int, int]) -> np.ndarray:
    """The entries after a round: each the floor of its parts' mean, by component; those without parts stay. Sums are by entry * width + component."""
    parts, size, width = entries.shape
    out = entries.reshape(-1, width).copy()
    for entry, n in counts.items():
        out[entry] = [sums.get(entry * width + k, 0) // n for k in range(width)]
    return out.reshape(parts, size, width)


def _whole(x: float) -> int:
    return math.floor(Fraction(x) * STEPS)


def _vectors(col: pa.Array, wide: bool) -> np.ndarray:
    """The components of a batch, rows by parts by width."""
    flat = col.flatten().to_numpy(zero_copy_only=False)
    flat = np.array([_whole(x) for x in flat.tolist()], object) if wide else flat.astype(np.int64)
    return flat.reshape(len(col), PARTS, -1)


_SUMS = [("slot", pa.int32()), ("limb", pa.int32()), ("value", pa.int64())]


def _pass(entries: np.ndarray, wide: bool, first: bool, last: bool):
    """Assigns the parts of all rows of (vec_id, label, parts, code) anew, and adds the parts up by entry unless this pass is the last."""

    def run(batches):
        books = Codebooks(entries)
        sums = np.zeros_like(books.entries)
        counts = np.zeros(len(books.entries), np.int64)
        for whole in batches:
            for lo in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(lo, BLOCK)
                n, x = batch.num_rows, _vectors(batch.column("parts"), wide)
                start = np.zeros((n, PARTS), np.int64) if first else np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(n, PARTS).astype(np.int64)
                code, d = books.nearest(x, start)
                raw = [row.tobytes() for row in code.astype(np.uint8)]
                head = [batch.column("vec_id"), batch.column("label")]
                if last:
                    error = [e if e < 1 << 63 else None for e in d.sum(axis=1).tolist()]
                    cols = [*head, pa.array([r.hex() for r in raw], pa.string()), pa.array(error, pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols, ["vec_id", "label", "code", "error"])
                    continue
                flat = (code + books.first()).reshape(-1)
                order = np.argsort(flat, kind="stable")
                begin = np.flatnonzero(np.diff(flat[order], prepend=-1))
                used = flat[order][begin]
                sums[used] += np.add.reduceat(x.reshape(-1, books.width)[order], begin, axis=0)
                counts[used] += np.diff(np.append(begin, len(order)))
                nulls = [pa.nulls(n, t) for _, t in _SUMS]
                yield pa.RecordBatch.from_arrays([*head, batch.column("parts"), pa.array(raw, pa.binary()), *nulls], ["vec_id", "label", "parts", "code", *(c for c, _ in _SUMS)])
                schema = batch.schema
        if not last and counts.any():
            slots = len(books.entries) * books.width
            rows = [(int(k), 0, int(v)) for k, v in enumerate(counts, slots) if v]
            rows += [(k, limb, v) for k, total in enumerate(sums.reshape(-1).tolist()) for limb, v in enumerate(limbs(total)) if v]
            nulls = [pa.nulls(len(rows), schema.field(c).type) for c in ("vec_id", "label", "parts")]
            cols = [*nulls, pa.nulls(len(rows), pa.binary()), *(pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _SUMS, strict=True))]
            yield pa.RecordBatch.from_arrays(cols, ["vec_id", "label", "parts", "code", *(c for c, _ in _SUMS)])

    return run


def _totals(table: DataFrame, entries: np.ndarray) -> tuple[dict[int, int], dict[int, int]]:
    """(sums by entry and component, counts by entry) of a pass: as many rows as the entries have components, however many rows there are."""
    rows = table.filter("slot is not null").groupBy("slot", "limb").agg(F.sum("value").alias("value")).collect()
    slots, sums, counts = entries.size, {}, {}
    for r in rows:
        if r.slot >= slots:
            counts[r.slot - slots] = r.value
        else:
            sums[r.slot] = sums.get(r.slot, 0) + (r.value << (LIMB * r.limb))
    return sums, counts


def _kept(rows: DataFrame) -> DataFrame:
    """(vec_id, label, vector) of rows whose vector is there and has finite components only."""
    x = F.col("embedding")
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.filter(x.isNotNull() & ~odd).select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.transform(x, lambda c: c.cast("double")).alias("vector"))


def encode(rows: DataFrame) -> tuple[DataFrame, np.ndarray | None]:
    """((vec_id, label, code, error), entries by part) for rows(vec_id, embedding, label).

    Rows whose vector is null, empty, or holds null or non-finite components are left out, and so are those whose vector is not as long as
    that of the row with the smallest vec_id; a length that PARTS doesn't divide is an error. Null ids come last among the first entries,
    and rows of equal id by their vectors; repeated rows are encoded alike. Fewer rows than ENTRIES make fewer entries. Components may
    have any finite size; an error that passes 64 bits is null. Other columns are not read. An empty table gives no rows and no entries."""
    spark = rows.sparkSession
    kept = _kept(rows).filter(F.size("vector") > 0)
    place = F.struct(F.col("vec_id").isNull().alias("a"), F.col("vec_id").alias("b"), F.col("vector").alias("c"))
    largest = F.max(F.array_max(F.transform("vector", lambda c: F.abs(c))))
    facts = kept.agg(F.min_by(F.size("vector"), place).alias("length"), largest.alias("largest")).first()
    label = kept.schema["label"].dataType.simpleString()
    if facts["length"] is None:
        return spark.createDataFrame([], f"vec_id long, label {label}, code string, error long"), None
    if facts["length"] % PARTS:
        raise ValueError(f"vectors of {facts['length']} components do not fall into {PARTS} equal parts")
    wide = facts["largest"] * STEPS >= NARROW
    kept = kept.filter(F.size("vector") == facts["length"])
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES).select("vector").collect()
    vectors = [[_whole(x) for x in r["vector"]] for r in first]
    entries = np.array(vectors, object if wide else np.int64).reshape(len(vectors), PARTS, -1).transpose(1, 0, 2)
    parts = F.col("vector") if wide else F.transform("vector", lambda c: F.floor(c * STEPS).cast("int"))
    table = kept.select("vec_id", "label", parts.alias("parts"), F.lit(None).cast("binary").alias("code"))
    schema = f"vec_id long, label {label}, parts array<{'double' if wide else 'int'}>, code binary, slot int, limb int, value long"
    for k in range(ROUNDS):
        table = common.stored(table.mapInArrow(_pass(entries, wide, k == 0, False), schema))
        entries = moved(entries, *_totals(table, entries))
        table = table.filter("slot is null").select("vec_id", "label", "parts", "code")
    return table.mapInArrow(_pass(entries, wide, False, True), f"vec_id long, label {label}, code string, error long"), entries


def with_label_error(codes: DataFrame) -> DataFrame:
    """codes with label_error: the sum of error over the rows of equal label, nulls together. A label with many rows is dealt over salts."""
    keyed = codes.withColumn("_none", F.col("label").isNull()).withColumn("_label", F.coalesce(F.col("label").cast("string"), F.lit("")))
    whole = F.count("error") == F.count(F.lit(1))
    totals = keyed.groupBy("_none", "_label").agg(
        F.when(whole, F.try_sum(F.col("error").cast("decimal(38,0)")).try_cast("long")).alias("label_error"), F.count(F.lit(1)).alias("_rows")
    )
    totals = common.checkpointed(totals)
    n = totals.agg(F.sum("_rows")).first()[0] or 0
    return common.spread_join(keyed, totals, ["_none", "_label"], "_rows", n, ["vec_id"]).drop("_none", "_label")


def digest(entries: np.ndarray | None) -> str:
    """SHA-256 of the components of all entries by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(str(x) for x in ([] if entries is None else entries.reshape(-1).tolist())).encode()).hexdigest()


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, entries = encode(common.table(spark, sf_dir, "embeddings"))
    out = with_label_error(common.stored(codes))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(entries)).alias("codebooks_sha256"))


def _round_sql(k: int) -> str:
    return f"""
near{k} as (
  select vec_id, part, min({{'d': d, 'entry': entry}}) as m
  from (select c.vec_id, c.part, b.entry, sum((c.x - b.x) * (c.x - b.x)) as d from c join book{k} b using (part, pos) group by all)
  group by all
)"""


def _book_sql(k: int) -> str:
    return f"""
book{k} as (
  select b.part, b.entry, b.pos, coalesce(s.x, b.x) as x
  from book{k - 1} b left join (
    select c.part, m.entry as entry, c.pos, cast(floor(sum(c.x) / count(*)) as bigint) as x
    from c join near{k - 1} using (vec_id, part) group by all
  ) s using (part, entry, pos)
)"""


# sums of a few thousand components below 2**22 are exact in doubles, so the floor of their quotient is too
OP13_SQL = f"""
with v as (
  select vec_id, label, embedding from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda e: e is null or isnan(e) or isinf(e))) = 0
), c as (
  select vec_id, (i - 1) // (len(embedding) // 16) as part, (i - 1) % (len(embedding) // 16) as pos, cast(floor(256 * embedding[i]::double) as bigint) as x
  from v, unnest(range(1, len(embedding) + 1)) as u(i)
), book0 as (
  select part, entry, pos, x from c join (select vec_id, row_number() over (order by vec_id) - 1 as entry from v order by vec_id limit 64) using (vec_id)
),{_round_sql(0)},{_book_sql(1)},{_round_sql(1)},{_book_sql(2)},{_round_sql(2)}, coded as (
  select vec_id, string_agg(printf('%02x', m.entry::bigint), '' order by part) as code, cast(sum(m.d) as bigint) as error from near2 group by vec_id
)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
       (select sha256(string_agg(x::varchar, ',' order by part, entry, pos)) from book2) as codebooks_sha256
from coded join v using (vec_id)
"""

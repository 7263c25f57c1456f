"""Mixing sources to target weights by hash-threshold histograms. DataFrame functions only.

Each source's words are summed by the leading digits of a hash of the id. Running sums along the histogram find the bucket in
which the source's budget ends; only that bucket is summed again by further digits, and so on. A document is taken if its hash
lies below the threshold: no document is sorted, and adding budget only ever adds documents (thresholds are nested)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Hexadecimal digits of the hash that a histogram level adds; four levels have 48 bits.
DIGITS = 3
LEVELS = 4


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def hash_digits(doc_id: Column, text: Column, digits: int = LEVELS * DIGITS) -> Column:
    """Leading hexadecimal digits of the hash of the id (of the text where the id is null)."""
    return F.substring(F.md5(F.coalesce(doc_id.cast("string"), text, F.lit("")).cast("binary")), 1, digits)


def source_targets(sizes: DataFrame, weights: list[int], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size): share of all sizes dealt by weight, none above most times its size.

    Weights repeat over the sources in code point order, null last. With level = budget a unit of weight, the sources capped are
    those whose most * size / weight lies below the level; running sums in that order give the level once."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    capped = sizes.withColumn("w", w).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum(F.col("source_size")).over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    capped = capped.withColumn("level", level).withColumn("free", F.col("cap") / F.col("w") > F.col("level"))
    settled = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("w"), F.col("level").alias("level")))).over(everything)["level"]
    return capped.select("source", "source_size", F.least(F.col("cap"), F.coalesce(settled * F.col("w"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, text: str = "text", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, digits: int = DIGITS, levels: int = LEVELS) -> DataFrame:
    """(doc_id, size, source, h, source_size, target, copies, taken) for each row of docs with columns doc_id, source and text.

    copies: how often the mix takes the document (whole rounds of its source, and once more below the source's threshold);
    taken = copies * size. The threshold lies on the side of the last document that comes nearer to the target, so a source's sum
    misses its target by half of one document at most. Texts null or without words have size 0 and are taken like others of
    their hash. The hash is of the id (of the text where the id is null); rows that repeat an id share their fate. A source of no
    words has target 0 and takes nothing. Texts are read whole, however long; other columns are not read, whatever their names. An empty table gives no rows."""
    h = hash_digits(F.col("doc_id"), F.col(text), levels * digits)
    sized = common.checkpointed(docs.select("doc_id", "source", word_count(F.col(text)).alias("size"), h.alias("h")))
    bucket = lambda k: F.substring("h", 1 + k * digits, digits)
    first = sized.groupBy("source", bucket(0).alias("b")).agg(F.sum("size").alias("n"))
    first = common.checkpointed(first)
    targets = source_targets(first.groupBy("source").agg(F.sum("n").alias("source_size")), list(weights), share, most)
    targets = common.checkpointed(
        targets.withColumn("rounds", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("target") - F.col("rounds") * F.col("source_size"))
    )
    same = F.col("a.source").eqNullSafe(F.col("t.source"))
    level = first.alias("a").join(targets.alias("t"), same).select("a.source", "b", "n", F.col("t.rest").alias("rest"))
    prefix_len, decided = digits, []
    for k in range(levels):
        # rest: what is left of the budget where the parent's bucket begins
        running = Window.partitionBy("source").orderBy("b")
        level = level.withColumn("upto", F.sum("n").over(running)).withColumn("left", F.col("rest") - (F.col("upto") - F.col("n")))
        last = k == levels - 1
        nearer = F.col("upto") - F.col("rest") <= F.col("left")
        level = level.select(
            "source",
            "b",
            "left",
            F.when(F.col("upto") <= F.col("rest"), 1).when((F.col("left") <= 0) | F.lit(last) & ~nearer, 0).when(F.lit(last), 1).cast("int").alias("take"),
        )
        level = common.checkpointed(level)
        decided.append(level.filter("take is not null").select("source", "b", "take"))
        if last:
            break
        edge = level.filter("take is null").select(F.col("source").alias("es"), F.col("b").alias("eb"), F.col("left").alias("rest"))
        inner = sized.join(edge, F.col("source").eqNullSafe(F.col("es")) & (F.substring("h", 1, prefix_len) == F.col("eb")))
        prefix_len += digits
        level = inner.groupBy("source", F.substring("h", 1, prefix_len).alias("b")).agg(F.sum("size").alias("n"), F.min("rest").alias("rest"))
    # every row meets the histogram rows of its own source and bucket, so a hot source is dealt over all buckets
    out = sized.withColumn("b0", bucket(0))
    top = common.checkpointed(
        level_rows(decided, digits, levels)
        .join(targets, F.col("s").eqNullSafe(F.col("source")))
        .select("s", "b", "cuts", "source_size", "target", "rounds")
    )
    joined = out.join(top, F.col("source").eqNullSafe(F.col("s")) & (F.col("b0") == F.col("b")))
    hit = F.coalesce(*[F.try_element_at(F.col("cuts"), F.substring("h", 1, digits * (k + 1))) for k in range(levels)], F.lit(0))
    return joined.select("doc_id", "size", "source", "h", "source_size", "target", (F.col("rounds") + hit).alias("copies"), ((F.col("rounds") + hit) * F.col("size")).alias("taken"))


def level_rows(decided: list[DataFrame], digits: int, levels: int) -> DataFrame:
    """(s, b, cuts): for each source and leading bucket, the decided prefixes in it; one, or at the boundary 16**digits a level at most."""
    both = decided[0]
    for d in decided[1:]:
        both = both.unionByName(d)
    return both.groupBy(F.col("source").alias("s"), F.substring("b", 1, digits).alias("b")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("b"), F.col("take")))).alias("cuts"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5(coalesce(doc_id::varchar, text, ''))[1:12] as h
  from documents),
src as (select source, sum(size)::bigint as source_size from sized group by source),
w as (select *, [3.0, 1.0, 2.0][((row_number() over (order by source asc nulls last) - 1) % 3 + 1)::int]::double as w, 2.0::double * source_size as cap from src),
lv as (
  select *, (sum(source_size) over () * 1.5::double - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0))
          / (sum(w) over () - coalesce(sum(w) over (o rows between unbounded preceding and 1 preceding), 0)) as level
  from w window o as (order by cap / w, source asc nulls last)),
tg as (select source, source_size, least(cap, coalesce((select arg_min(level, cap / w) from lv where cap / w > level) * w, cap)) as target from lv),
rd as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as rounds from tg),
grp as (
  select source, h, sum(sum(size)) over (partition by source order by h) as upto, sum(size) as n from sized group by source, h),
cut as (
  select g.source, g.h, case when upto <= target - rounds * source_size then 1
         when target - rounds * source_size - (upto - n) <= 0 then 0
         when upto - (target - rounds * source_size) <= target - rounds * source_size - (upto - n) then 1 else 0 end as take
  from grp g join rd r on g.source is not distinct from r.source)
select doc_id, size, source_size, target, ((rounds + take) * size)::bigint as taken
from sized s join rd r on s.source is not distinct from r.source
join cut c on s.source is not distinct from c.source and s.h = c.h
"""

"""Entity resolution: offers whose titles say the same are one product.

Titles are compared within blocks of equal brand, pieces and number words only. Within a block, distinct signatures are taken longest
title first; each joins the leader before it that it is most similar to, or becomes one. Leaders are thus the lexicographically first
independent set of the graph of similar signatures, and no task needs to hold a block to find them:
1. Candidates come from a prefix filter. Two signatures with a common subsequence as long as the threshold asks for share a certain number
   of letter groups, so the rarest groups of each, one more than may be missing, must meet. Groups have three letters, and two or one where
   signatures are too short to share one of three for certain. Signatures meet by (block, group); a hot group is dealt over tiles, and
   its pairs of tiles over tasks.
2. Where they meet, a matrix product of letter pairs tells which can be similar; these are compared by their common subsequence. Similar
   pairs are links, and only they leave the task.
3. In rounds, a signature that no open one before it is linked to is a leader, and what is linked to it is closed. Links go with their
   ends, so a round reads only what is open.
4. Each closed signature takes its most similar leader; of equally similar ones, known products first, then the earliest."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..tables import shared

BLOCK = ("brand", "pack_size", "numbers")
#: Letters of a group, from the most telling.
SIZES = (3, 2, 1)
#: Signatures that are compared with as many others at once, and most columns of the matrix of their letter pairs.
TILE, CELLS = 1024, 4096
#: Most letter groups whose numbers go to the driver and back. Signatures of a to z, 0 to 9 and blanks have 37 ** 3 + 37 ** 2 + 37 at most.
GROUPS = 60_000


def similarity(a: str, b: str) -> float:
    """200 * LCS / (len a + len b), by bit-parallel longest common subsequence."""
    if not a or not b:
        return 0.0
    where: dict[str, int] = {}
    for k, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        m = row & where.get(ch, 0)
        row = (row + m) | (row - m)
        row &= full
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


def shared_groups(q: int, both: int, threshold: float) -> int:
    """Groups of q letters that two texts of `both` letters in all share at least, if they are similar.

    With a common subsequence of n letters, one text loses its other letters and gains those of the other text. Each loss breaks q of its
    groups at most, and each gain q - 1."""
    n = math.ceil(threshold * both / 200 - 1e-9)
    return (2 * q - 1) * n - (q - 1) * (both + 1)


@lru_cache(maxsize=None)
def size_for(both: int, threshold: float) -> int:
    """The letters of the groups by which two similar texts of `both` letters in all are found: the most that they share for certain."""
    return next((q for q in SIZES if shared_groups(q, both, threshold) > 0), 0)


@lru_cache(maxsize=None)
def prefixes(length: int, threshold: float) -> tuple[tuple[int, int], ...]:
    """(q, how many of the rarest groups of q letters) that a text of this length is found by, whatever it is similar to."""
    least, most = math.ceil(length * threshold / (200 - threshold) - 1e-9), math.floor(length * (200 - threshold) / threshold + 1e-9)
    need: dict[int, int] = {}
    for both in range(length + max(1, least), length + most + 1):
        q = size_for(both, threshold)
        if q:
            need[q] = min(need.get(q, 1 << 30), shared_groups(q, both, threshold))
    return tuple((q, length - q + 1 - t + 1) for q, t in sorted(need.items()) if length >= q)


def groups(sig: str, q: int) -> list[str]:
    return [sig[k : k + q] for k in range(len(sig) - q + 1)]


def _found_by(rarity: dict[str, int], threshold: float):
    """The groups of each signature's prefixes; a group that occurs again counts as another one."""

    def run(batches):
        for batch in batches:
            at, keys = [], []
            for row, sig in enumerate(batch.column("sig").to_pylist()):
                for q, n in prefixes(len(sig), threshold):
                    seen: dict[str, int] = {}
                    ranked = []
                    for g in groups(sig, q):
                        seen[g] = seen.get(g, 0) + 1
                        ranked.append((rarity.get(g, 0), g, seen[g]))
                    for _, g, k in sorted(ranked)[:n]:
                        at.append(row)
                        keys.append(f"{g}#{k}")
            out = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(keys, pa.string())], [*batch.schema.names, "key"])

    return run


class LetterPairs:
    """The pairs of neighbouring letters of signatures, as features that a matrix product counts in common: one that occurs again is another."""

    def __init__(self, sigs: list[str]):
        size = np.array([len(s) for s in sigs], np.int64)
        code = np.frombuffer("".join(sigs).encode("utf-32-le"), np.uint32).astype(np.int64)
        row = np.repeat(np.arange(len(sigs)), size)
        inside = np.flatnonzero(row[1:] == row[:-1])
        row, pair = row[inside], (code[inside] << 21) + code[inside + 1]
        order = np.lexsort((pair, row))
        row, pair = row[order], pair[order]
        first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (pair[1:] != pair[:-1])])) if len(row) else np.zeros(0, np.int64)
        again = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
        self.feature = np.unique((pair << 8) + np.minimum(again, 255), return_inverse=True)[1] % CELLS  # folded ones only raise a count
        self.start, self.width = np.searchsorted(row, np.arange(len(sigs) + 1)), int(self.feature.max(initial=0)) + 1
        self.row = row

    def matrix(self, lo: int, hi: int) -> np.ndarray:
        a, b = self.start[lo], self.start[hi]
        out = np.bincount((self.row[a:b] - lo) * self.width + self.feature[a:b], minlength=(hi - lo) * self.width)
        return out.reshape(hi - lo, self.width).astype(np.float32)


def _group_links(rows: list[tuple], threshold: float):
    """(row, row before it, score) of the similar ones among rows (sig, n, known, side) in their order; of two sides, only those across."""
    pairs, size = LetterPairs([r[0] for r in rows]), np.array([len(r[0]) for r in rows])
    least = np.array([shared_groups(2, both, threshold) for both in range(2 * int(size.max()) + 1)], np.float32)
    known, side = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    across = side.min() != side.max()
    for lo in range(0, len(rows), TILE):
        hi = min(lo + TILE, len(rows))
        i, own = slice(lo, hi), pairs.matrix(lo, hi)
        for upto in range(0, lo + 1, TILE):
            end = min(upto + TILE, len(rows))
            j, other = slice(upto, end), own if upto == lo else pairs.matrix(upto, end)
            a, b = size[i, None], size[None, j]
            may = own @ other.T >= np.take(least, a + b)
            may &= (200 * a >= threshold * (a + b) - 1e-6) & (200 * b >= threshold * (a + b) - 1e-6) & ~known[i, None]
            if across:
                may &= side[i, None] != side[None, j]
            if lo == upto:
                may = np.tril(may, -1)
            for x, y in zip(*(k.tolist() for k in np.nonzero(may)), strict=True):
                score = similarity(rows[lo + x][0], rows[upto + y][0])
                if score >= threshold:
                    yield rows[lo + x], rows[upto + y], score


def _linked(threshold: float):
    """Links within each group of rows with one `place`, of rows sorted by it."""
    columns = ("place", *BLOCK, "sig", "n", "known", "side")

    def of(group: list[list]) -> list[tuple]:
        if len(group[0]) < 2:
            return []
        block = [c[0] for c in group[1:4]]
        rows = sorted(zip(*group[4:], strict=True), key=lambda r: (not r[2], -r[1], r[0]))
        return [(*block, a[0], b[0], b[1], b[2], score) for a, b, score in _group_links(rows, threshold)]

    def run(batches):
        held = [[] for _ in columns]
        schema = None
        for batch in batches:
            types = [batch.schema.field(c).type for c in (*BLOCK, "sig", "sig", "n", "known")]
            schema = pa.schema(list(zip((*BLOCK, "sig", "other", "n", "known", "score"), [*types, pa.float64()], strict=True)))
            cols = [h + batch.column(c).to_pylist() for h, c in zip(held, columns, strict=True)]
            cuts = [0, *[k for k in range(1, len(cols[0])) if cols[0][k] != cols[0][k - 1]]]
            out = [r for lo, hi in zip(cuts, cuts[1:]) for r in of([c[lo:hi] for c in cols])]
            held = [c[cuts[-1] :] for c in cols]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
        out = of(held)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return run


def _fields(df: DataFrame, **more: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"{k} {v}" for k, v in more.items()])


def links(signatures: DataFrame, threshold: float) -> DataFrame:
    """(block, sig, other, n, known, score): pairs of signatures(block, sig, n, known) with sig similar to other, which comes before it."""
    spark = signatures.sparkSession
    each = F.flatten(F.array(*[F.transform(F.sequence(F.lit(1), F.greatest(F.length("sig") - q + 1, F.lit(1))), lambda k, q=q: F.substring("sig", k, F.lit(q))) for q in SIZES]))
    counts = signatures.select(F.explode(each).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    # the commonest ones alone would do: the order decides how many candidates there are, and not whether all are found
    rarity = {r["g"]: r["n"] for r in counts.orderBy(F.desc("n"), "g").limit(GROUPS).collect()}
    found = shared.stored(signatures.mapInArrow(_found_by(rarity, threshold), _fields(signatures, key="string")))
    sizes = found.groupBy(*BLOCK, "key").agg(F.count(F.lit(1)).alias("rows"))
    share = max(2 * TILE, found.count() // shared.partitions(spark))
    # at most as many groups as there are partitions have more rows than an even share, so their table is small
    hot = sizes.filter(F.col("rows") > share).select(*BLOCK, "key", F.ceil(2 * F.col("rows") / share).cast("int").alias("tiles"))
    dealt = found.join(F.broadcast(hot), [*BLOCK, "key"], "left").withColumn("tile", F.pmod(F.xxhash64("sig", "known"), F.coalesce("tiles", F.lit(1))).cast("int"))
    # a row of a hot group goes to each pair of tiles that its own is in
    pair = F.transform(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1), lambda k: F.struct(F.least("tile", k).alias("a"), F.greatest("tile", k).alias("b")))
    placed = dealt.withColumn("pair", F.explode(pair)).withColumn("side", (F.col("tile") != F.col("pair.a")).cast("int"))
    placed = placed.select(F.concat_ws("\1", *BLOCK, "key", "pair.a", "pair.b").alias("place"), *BLOCK, "sig", "n", "known", "side")
    made = placed.repartition("place").sortWithinPartitions("place").mapInArrow(_linked(threshold), _fields(signatures.select(*BLOCK, "sig", F.col("sig").alias("other"), "n", "known"), score="double"))
    return made.distinct()


def closed(linked: DataFrame) -> DataFrame:
    """(block, sig): signatures of links(block, sig, other, known) that a leader before them is linked to.

    Each round finds the open signatures that no open one before them is linked to, and closes those that these are linked to. What an
    old product is linked to is closed from the start."""
    spark, key = linked.sparkSession, [*BLOCK, "sig"]
    first = linked.filter("known").select(*key).distinct()
    out = [shared.stored(first)]
    rest = linked.filter("not known").select(*key, "other")
    gone = out[0]
    while True:
        as_other = gone.withColumnRenamed("sig", "other")
        rest = shared.stored(rest.join(gone, key, "left_anti").join(as_other, [*BLOCK, "other"], "left_anti"))
        if not rest.limit(1).count():
            break
        blocked = rest.select(*key).distinct().withColumnRenamed("sig", "other")
        leaders = rest.select(*BLOCK, "other").distinct().join(blocked, [*BLOCK, "other"], "left_anti")
        gone = shared.stored(rest.join(leaders, [*BLOCK, "other"], "left_semi").select(*key).distinct())
        out.append(gone)
    whole = out[0]
    for more in out[1:]:
        whole = whole.union(more)
    return whole if len(out) < 20 else spark.read.schema(whole.schema).parquet(*[p for x in out for p in x.inputFiles()])


def leads(signatures: DataFrame, threshold: float = 87.0) -> DataFrame:
    """(block, sig, leader) of the new ones of signatures(block, sig, n, known); n is the length of the longest title of a signature."""
    linked = shared.stored(links(signatures, threshold))
    lost = shared.stored(closed(linked))
    as_other = lost.withColumnRenamed("sig", "other").withColumn("known", F.lit(False))
    to_leaders = linked.join(as_other, [*BLOCK, "other", "known"], "left_anti").join(lost, [*BLOCK, "sig"], "left_semi")
    order = F.struct(-F.col("score"), ~F.col("known"), F.when(F.col("known"), 0).otherwise(-F.col("n")), F.col("other"))
    best = to_leaders.groupBy(*BLOCK, "sig").agg(F.min_by("other", order).alias("leader"))
    new = signatures.filter("not known").select(*BLOCK, "sig")
    return new.join(shared.large(best), [*BLOCK, "sig"], "left").withColumn("leader", F.coalesce("leader", "sig"))


def keyed(offers: DataFrame, title: Column, pack: text.RulePack = text.RulePack(), hint: Column | None = None) -> DataFrame:
    """offers with the brand, pieces, signature and number words of their titles."""
    rows = offers.withColumn("brand", F.coalesce(text.brand(title, pack, hint=hint), F.lit("Other"))).withColumn("pack_size", text.pack_size(title, pack))
    return rows.withColumn("sig", text.signature(title, pack)).withColumn("numbers", text.number_words(F.col("sig")))


def product_key(brand: Column, leader: Column, pieces: Column) -> Column:
    return F.concat_ws("|", brand, leader, F.concat(F.lit("p"), pieces.cast("string")))


def clusters(
    offers: DataFrame, title: str = "raw_title", pack: text.RulePack = text.RulePack(), threshold: float = 87.0, known: DataFrame | None = None, hint: str | None = None
) -> DataFrame:
    """offers with sig, leader and canonical_key. A null title counts as a generic one; titles without a telling word are one product a block.

    known(brand, pack_size, numbers, leader): products of earlier runs, which offers join before they become products of their own.
    hint: the column with the seller's own brand field, for titles that name no brand."""
    t = F.col(title)
    rows = shared.stored(keyed(offers, t, pack, F.col(hint) if hint else None))  # read twice, and dear to make
    sigs = rows.groupBy(*BLOCK, "sig").agg(F.coalesce(F.max(F.length(t)), F.lit(0)).alias("n"), F.lit(False).alias("known"))
    if known is not None:
        sigs = sigs.unionByName(known.select(*BLOCK, F.col("leader").alias("sig")).distinct().select("*", F.lit(0).alias("n"), F.lit(True).alias("known")))
    led = leads(shared.stored(sigs), threshold)
    return rows.join(shared.large(led), [*BLOCK, "sig"]).withColumn("canonical_key", product_key(F.col("brand"), F.col("leader"), F.col("pack_size")))

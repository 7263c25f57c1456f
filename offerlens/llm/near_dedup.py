"""Near-duplicate groups by an LSH forest over MinHash signatures.

Each text is the set of its word shingles; equal sets are one class, and classes are what is compared. A signature of TREES * LEAD
minima gives TREES sorted orders: order t starts with its own LEAD values and goes on with those of the next orders. Classes that
share the LEAD values are a region of the order.
- First pass: in each region, candidates are neighbours in the sorted order (they have the longest common prefixes), the first
  class of the region, and, where a region is dense, the first class of each longer prefix: 8 values, 12, 16, as the region grows.
- Candidates whose signatures agree often enough are confirmed on their full shingle sets, and components are found.
- Second pass: in regions whose classes are still in several components, every pair across components is looked at, in blocks,
  and confirmed where it is read. Pairs within one component can add nothing. So a group of n near copies costs about n
  confirmations and not n squared, no pair is sent on but a link that joins two components, and none that could is left out.
A pair of similarity s shares a region with probability 1 - (1 - s**LEAD)**TREES: 0.99997 at 0.8. Full sets of the classes that
have candidates are sorted hash arrays in the shared folder, which the confirming tasks map into memory."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays, common
from .common import mix64

TREES = 20
LEAD = 4
VALUES = TREES * LEAD
#: Signature values that candidates agree on at least: five deviations below the mean at similarity 0.8.
AGREE = 44
#: Rows of a region that are sorted in one task, and rows of a block in the second pass.
REGION_ROWS = 4096
BLOCK = 256
_MULTIPLIERS = (mix64(np.arange(1, VALUES + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_NO_ID = 2**63 - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(names, index of each row's first name): sorted distinct names of the shingles of every row."""
    names, at = common.words_of(data, offsets)
    n, rows = np.diff(at), len(offsets) - 1
    out, row = [], []
    multipliers = mix64(np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)
    if len(names) >= words:
        s = np.zeros(len(names) - words + 1, np.uint64)
        for k in range(words):
            s += names[k : len(names) - words + 1 + k] * multipliers[k]
        which = np.repeat(np.arange(rows), n)[: len(s)]
        whole = np.arange(len(s)) + words <= at[which + 1]
        out.append(mix64(s[whole]))
        row.append(which[whole])
    for r in np.flatnonzero((n > 0) & (n < words)):
        s = names[at[r] : at[r + 1]]
        out.append(mix64((s * multipliers[: len(s)]).sum(keepdims=True) + np.uint64(len(s))))
        row.append(np.array([r]))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    s, row = np.concatenate(out), np.concatenate(row)
    order = np.lexsort((s, row))
    s, row = s[order], row[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
    return s[new], np.searchsorted(row[new], np.arange(rows + 1))


def class_names(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A name for each row's set, whatever its order; 0 for the empty set."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix64(s ^ np.uint64(0xC2B2AE3D27D4EB4F)), dtype=np.uint64)])
    n = np.diff(at)
    return np.where(n > 0, mix64((sums[at[1:]] - sums[at[:-1]]) + n.astype(np.uint64)), 0).astype(np.uint64).view(np.int64)


def minima(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """VALUES minima for each row; rows without shingles have zeros."""
    out = np.zeros((len(at) - 1, VALUES), np.uint32)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        x, first = (s >> np.uint64(32)).astype(np.uint32), at[full]
        for k in range(VALUES):
            out[full, k] = np.minimum.reduceat(x * _MULTIPLIERS[k], first)
    return out


def _regions(sig: np.ndarray) -> np.ndarray:
    """The name of each row's region in each order."""
    out = np.zeros((len(sig), TREES), np.uint64)
    for t in range(TREES):
        name = np.full(len(sig), np.uint64(t + 1))
        for k in range(LEAD):
            name = mix64(name * np.uint64(0x9E3779B97F4A7C15) + sig[:, t * LEAD + k])
        out[:, t] = name
    return out.view(np.int64)


def _sign(words: int):
    def run(batches):
        for batch in batches:
            ids, hashes, col = batch.column("doc_id"), batch.column("text_hash"), common.text_column(batch)
            for lo, hi, data, offsets in common.byte_blocks(col):
                s, at = shingle_sets(data, offsets, words)
                sig = minima(s, at)
                regions = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * TREES), pa.array(_regions(sig).ravel()))
                sketch = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(np.arange(hi - lo + 1, dtype=np.int32) * VALUES), pa.py_buffer(sig.astype(np.uint8).tobytes())])
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), hashes.slice(lo, hi - lo), pa.array(np.diff(at), pa.int64()), pa.array(class_names(s, at)), sketch, regions], ["doc_id", "text_hash", "n_shingles", "class", "sketch", "regions"])

    return run


def _sketches(col: pa.Array) -> np.ndarray:
    data, offsets = common.raw_bytes(col.cast(pa.large_binary()))
    return data.reshape(len(col), VALUES) if len(col) else np.zeros((0, VALUES), np.uint8)


def _pairs(a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _first_pass(batches):
    """Candidates in rows sorted by region, part and order."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        region, part, c, n, pivot = (batch.column(k).to_numpy() for k in ("region", "part", "class", "n", "pivot"))
        order, lead = _sketches(batch.column("order")), _sketches(batch.column("pivot_order"))
        before = [np.concatenate([h[None], x[:-1]]) for h, x in zip(held or (region[0] - 1, part[0], c[0], order[0]), (region, part, c, order), strict=True)] if held else None
        if before is None:
            before = [np.concatenate([x[:1], x[:-1]]) for x in (region, part, c, order)]
        same = (region == before[0]) & (part == before[1]) & (c != before[2])
        near = same & ((order == before[3]).sum(axis=1) >= AGREE)
        yield _pairs(c[near], before[2][near])
        star = (c != pivot) & ((order == lead).sum(axis=1) >= AGREE)
        yield _pairs(c[star], pivot[star])
        for depth, rows in ((8, 32), (12, 256), (16, 2048)):
            if (n > rows).any():
                new = ~(same & (order[:, :depth] == before[3][:, :depth]).all(axis=1))
                new[0] = True
                first = np.maximum.accumulate(np.where(new, np.arange(len(c)), 0))
                deep = (n > rows) & ~new & ((order == order[first]).sum(axis=1) >= AGREE)
                yield _pairs(c[deep], c[first[deep]])
        held = region[-1], part[-1], c[-1], order[-1]


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Of two sorted sets: whether 100 * |intersection| >= percent * |union|."""
    small, large = (x, y) if len(x) < len(y) else (y, x)
    if len(small) * 100 < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


class _Sets:
    """The stored sets of some classes."""

    def __init__(self, folder: str, shards: int, keys: np.ndarray):
        self.store = arrays.shards(folder, shards, "key", "start", "size")
        keys = keys.view(np.uint64)
        _, self.start, self.size = self.store.lookup(keys, "start", "size")
        self.shard = arrays.shard_of(keys, shards)

    def __getitem__(self, k: int) -> np.ndarray:
        return self.store.get("names", int(self.shard[k]))[self.start[k] : self.start[k] + self.size[k]]


def _second_pass(folder: str, shards: int, percent: int):
    """Links across components in rows sorted by region and pair of blocks (two blocks of BLOCK rows or so).

    Every pair is looked at in the first region that it shares. Links are followed at once, so that only pairs that could still
    join two components are confirmed, and only links that join some are sent on."""

    def links(t: pa.Table, cuts: np.ndarray):
        c, comp, tree, mine, i_, j_ = (t.column(k).to_numpy() for k in ("class", "comp", "tree", "mine", "i", "j"))
        comp, sets = comp.copy(), _Sets(folder, shards, c)
        order = _sketches(t.column("order").combine_chunks())
        regions = t.column("regions").combine_chunks().flatten().to_numpy().reshape(-1, TREES)
        found = []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            for k in range(lo, hi - 1):
                other = np.flatnonzero(comp[k + 1 : hi] != comp[k]) + k + 1
                if i_[k] != j_[k]:
                    other = other[mine[other] != mine[k]]
                large = np.maximum(sets.size[other], sets.size[k])
                other = other[100 * np.minimum(sets.size[other], sets.size[k]) >= percent * large]
                other = other[(order[other] == order[k]).sum(axis=1) >= AGREE]
                other = other[~(regions[other, : tree[k]] == regions[k, : tree[k]]).any(axis=1)]
                for m in other.tolist():
                    if comp[m] != comp[k] and _similar(sets[k], sets[m], percent):
                        found.append((c[k], c[m]))
                        comp[lo:hi][comp[lo:hi] == comp[m]] = comp[k]
        return _pairs(*np.array(found, np.int64).reshape(-1, 2).T)

    def run(batches):
        held = None
        for batch in batches:
            held = pa.concat_tables([*([held] if held is not None else []), pa.Table.from_batches([batch])])
            if not held.num_rows:
                continue
            key = [held.column(k).to_numpy() for k in ("region", "i", "j")]
            cut = np.flatnonzero(np.any([x[1:] != x[:-1] for x in key], axis=0)) + 1
            if len(cut):
                yield links(held.slice(0, int(cut[-1])), np.concatenate([[0], cut]))
                held = held.slice(int(cut[-1]))
        if held is not None and held.num_rows:
            yield links(held, np.array([0, held.num_rows]))

    return run


def _store_wanted(folder: str, shards: int):
    def run(table: pa.Table) -> pa.Table:
        key = table.column("class").to_numpy().view(np.uint64)
        order = np.argsort(key)
        arrays.put(folder, table.column("shard")[0].as_py(), key=key[order], rep=table.column("rep").to_numpy()[order])
        return pa.table({"n": pa.array([len(key)], pa.int64())})

    return run


def _wanted_sets(words: int, folder: str, shards: int):
    """(shard, class, set) of the classes in folder, from the row of their representative."""

    def run(batches):
        wanted = arrays.shards(folder, shards, "key", "rep")
        for batch in batches:
            ids, col = pa.compute.fill_null(batch.column("doc_id"), _NO_ID).to_numpy(), common.text_column(batch)
            for lo, hi, data, offsets in common.byte_blocks(col):
                s, at = shingle_sets(data, offsets, words)
                c = class_names(s, at).view(np.uint64)
                held, rep = wanted.lookup(c, "rep")
                r = np.flatnonzero(held & (rep == ids[lo:hi]))
                sets = [s[at[k] : at[k + 1]].tobytes() for k in r]
                yield pa.RecordBatch.from_arrays([pa.array(arrays.shard_of(c[r], shards), pa.int32()), pa.array(c[r].view(np.int64)), pa.array(sets, pa.binary())], ["shard", "class", "set"])

    return run


def _store_sets(folder: str):
    def run(table: pa.Table) -> pa.Table:
        key = table.column("class").to_numpy().view(np.uint64)
        key, at = np.unique(key, return_index=True)
        sets = table.column("set").combine_chunks().take(pa.array(at))
        data, offsets = common.raw_bytes(sets.cast(pa.large_binary()))
        arrays.put(folder, table.column("shard")[0].as_py(), key=key, start=offsets[:-1] // 8, size=np.diff(offsets) // 8, names=data.view(np.uint64))
        return pa.table({"n": pa.array([len(key)], pa.int64())})

    return run


def _confirm(folder: str, shards: int, percent: int):
    def run(batches):
        for batch in batches:
            a, b = (_Sets(folder, shards, batch.column(side).to_numpy()) for side in ("a", "b"))
            yield batch.filter(pa.array([_similar(a[k], b[k], percent) for k in range(batch.num_rows)], pa.bool_()))

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (a, b): root is the smallest node reachable.

    Alternating large and small stars; each round is a grouped minimum and a join, written to the checkpoint folder."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    e = common.checkpointed(e)
    before = None
    while True:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").filter("u <> v").distinct()
        e = common.checkpointed(e)
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
        before = now


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs(doc_id, text); see near_rows."""
    return near_rows(docs, words, percent).drop("text_hash")


def near_rows(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash) for each row of docs(doc_id, text); xxhash64 of the text tells rows of one id apart.

    Two rows are linked if 100 * |intersection| >= percent * |union| of their sets of `words`-word shingles; texts of fewer words
    are one shingle, and null, empty or wordless texts are linked with nothing. component_id: the smallest doc_id reachable.
    Null ids come last: a group of them alone has component_id null. Rows that repeat id and text share their fate. Texts are read whole, however long; other columns are not read, whatever their names.
    An empty table gives no rows."""
    spark = docs.sparkSession
    rows, parts = docs.select("doc_id", "text"), common.shuffle_partitions(spark)
    shards = common.text_shards(rows)
    hashed = rows.withColumn("text_hash", F.xxhash64("text"))
    signed = common.checkpointed(hashed.mapInArrow(_sign(words), "doc_id long, text_hash long, n_shingles long, class long, sketch binary, regions array<long>"))
    number = F.coalesce("doc_id", F.lit(_NO_ID))
    classes = signed.filter("n_shingles > 0").groupBy("class").agg(F.min(number).alias("rep"), F.min_by(F.struct("sketch", "regions"), number).alias("s"))
    classes = common.checkpointed(classes.select("class", "rep", "s.sketch", "s.regions"))
    light = classes.select("class", F.posexplode("regions").alias("tree", "region"))
    crowded = light.groupBy("region").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("w", F.col("n"))
    order = F.concat(F.expr(f"substring(sketch, tree * {LEAD} + 1, {VALUES})"), F.expr(f"substring(sketch, 1, tree * {LEAD})"))
    members = common.spread_join(light, crowded, ["region"], "w", TREES * classes.count())
    members = members.join(classes.select("class", "sketch"), "class").select("region", "tree", "n", "class", order.alias("order"))
    members = common.checkpointed(members)

    first = members.groupBy("region").agg(F.min(F.struct("order", "class")).alias("p"), F.count(F.lit(1)).alias("w"))
    first = first.select("region", "w", F.col("p.class").alias("pivot"), F.col("p.order").alias("pivot_order"))
    part = F.when(F.col("n") <= REGION_ROWS, 0).otherwise(F.pmod(F.xxhash64("class"), F.ceil(F.col("n") / REGION_ROWS))).cast("int")
    placed = common.spread_join(members, first, ["region"], "w", members.count(), by=["class"])
    sorted_ = placed.withColumn("part", part).repartition(parts, "region", "part").sortWithinPartitions("region", "part", "order", "class")
    candidates = common.checkpointed(sorted_.mapInArrow(_first_pass, "a long, b long").distinct())

    wanted, sets = common.shared_folder(spark, "near-wanted"), common.shared_folder(spark, "near-sets")
    # every class that shares a region may be asked for in the second pass
    asked = members.select("class").distinct().join(classes.select("class", "rep"), "class").mapInArrow(_with_shard(shards), "shard int, class long, rep long")
    common.by_shard(asked, shards).applyInArrow(_store_wanted(wanted, shards), "n long").groupBy().sum().collect()
    full = rows.mapInArrow(_wanted_sets(words, wanted, shards), "shard int, class long, set binary")
    common.by_shard(full, shards).applyInArrow(_store_sets(sets), "n long").groupBy().sum().collect()

    confirm = _confirm(sets, shards, percent)
    links = common.checkpointed(candidates.repartition(parts, "a").mapInArrow(confirm, "a long, b long"))
    roots = components(links)

    # regions of up to three classes have had every pair looked at
    joined = members.filter("n > 3").join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("comp", F.coalesce("root", "class")).drop("root")
    joined = common.checkpointed(joined)
    split = joined.groupBy("region").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("w")).filter("lo <> hi").select("region", "w")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    rest = common.spread_join(joined, split, ["region"], "w", joined.count(), by=["class"]).withColumn("blocks", blocks).withColumn("mine", mine)
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))
    rest = rest.join(classes.select("class", "regions"), "class").select("region", "i", "j", "mine", "tree", "class", "comp", "order", "regions")
    rest = rest.repartition(parts, "region", "i", "j").sortWithinPartitions("region", "i", "j", "class")
    more = common.checkpointed(rest.mapInArrow(_second_pass(sets, shards, percent), "a long, b long"))
    roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))

    grouped = classes.select("class", "rep").join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    smallest = grouped.groupBy("root").agg(F.min("rep").alias("smallest"))
    of_class = grouped.join(smallest, "root").select("class", "smallest")
    best = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.when(F.col("smallest") != _NO_ID, F.col("smallest")))
    out = signed.select("doc_id", "text_hash", "n_shingles", "class").join(of_class, "class", "left").withColumn("component_id", best)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_hash")


def _with_shard(shards: int):
    def run(batches):
        for b in batches:
            shard = arrays.shard_of(b.column("class").to_numpy().view(np.uint64), shards)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), b.column("class"), b.column("rep")], ["shard", "class", "rep"])

    return run


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(common.table(spark, sf_dir, "documents"), words=4)

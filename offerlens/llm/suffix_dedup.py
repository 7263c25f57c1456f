"""Removing passages that repeat across documents, by distributed prefix doubling.

The suffixes that matter start windows of `length` bytes. Names (ranks) of ever longer prefixes are made by doubling: the name of
the first `half` = length - `gap` bytes comes from the text, and the name of all `length` bytes at p is the name of the pair
(rank at p, rank at p + gap). A suffix leaves as soon as its rank is unique to one document.

Not every position goes through Spark: among the gap + 1 half-windows that a window holds, the one with the least name stands for
it. Equal windows have equal least names, so nothing is lost, and neighbouring windows share theirs: a run of them is one entry.
1. Each task sends the sorted distinct least names of its texts, Spark sorts them into ranges, and those of two documents or more
   are kept in sorted arrays (ranks that are not unique).
2. Runs with such a rank send the rank pair (first window, last window, run length), which names all bytes of the run, with the
   smallest document. A run that a smaller document also has is covered whole. Ranks with one run name only need no more.
3. The others send the rank pair of each of their windows, from the smallest document that has the run.
4. A last pass over the texts looks runs and windows up in the sorted arrays, and marks the bytes, each text within one task.
Rounds send names deduplicated in each task: a passage that a third of all documents hold is one entry a task."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays, common
from .common import Fingerprints, mix64, pair64

LENGTH = 50
#: Windows are named by one of gap + 1 parts of length - gap bytes.
GAP = 18
#: Names that a task holds before it sends them on.
HELD = 3_000_000
NO_DOC = -(2**63)


class Runs:
    """The windows of a block of texts, as runs that share their least part name."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, gap: int):
        self.length, self.gap = length, gap
        half = Fingerprints(data).fixed(length - gap)
        self.half = half
        windows = len(data) - length + 1
        lens = np.diff(offsets)
        docs = np.flatnonzero(lens >= length)
        if windows <= 0 or not len(docs):
            self.first = self.last = self.doc = np.zeros(0, np.int64)
            self.key = np.zeros(0, np.uint64)
            return
        least, width = half, 1
        while width * 2 <= gap + 1:
            least, width = np.minimum(least[:-width], least[width:]), width * 2
        if width < gap + 1:
            more = gap + 1 - width
            least = np.minimum(least[:-more], least[more:])
        change = np.ones(windows, bool)
        change[1:] = least[1:] != least[:-1]
        begin, end = offsets[docs], offsets[docs] + lens[docs] - length
        change[begin] = True
        inside = np.zeros(windows + 1, np.int32)
        np.add.at(inside, begin, 1)
        np.add.at(inside, end + 1, -1)
        inside = np.cumsum(inside[:-1]) > 0
        first = np.flatnonzero(change & inside)
        which = np.searchsorted(begin, first, side="right") - 1
        last = np.minimum(np.append(first[1:], windows) - 1, end[which])
        parts = (last - first) // (gap + 1) + 1  # a long run (periodic text) is cut
        if (parts > 1).any():
            k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            first, last, which = np.repeat(first, parts) + k * (gap + 1), np.repeat(last, parts), np.repeat(which, parts)
            last = np.minimum(first + gap, last)
        self.first, self.last, self.doc, self.key = first, last, docs[which], mix64(least[first])

    def window_names(self, at: np.ndarray) -> np.ndarray:
        return pair64(self.half[at], self.half[at + self.gap])

    def names(self, of: np.ndarray) -> np.ndarray:
        """Of whole runs: the first and last window overlap or meet, so their names and distance fix every byte."""
        first, last = self.first[of], self.last[of]
        return mix64(pair64(self.window_names(first), self.window_names(last)) + (last - first).astype(np.uint64))

    def windows(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, index into of) of every window of these runs."""
        n = self.last[of] - self.first[of] + 1
        run = np.repeat(np.arange(len(of)), n)
        return self.first[of][run] + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n), run


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    """Ids as numbers; null ids come before any other."""
    return pa.compute.fill_null(batch.column("doc_id"), NO_DOC).to_numpy(zero_copy_only=False).astype(np.int64)


def _blocks(batches, length: int, gap: int):
    for batch in batches:
        col, ids = common.text_column(batch), _ids(batch)
        for lo, hi, data, offsets in common.byte_blocks(col):
            yield ids[lo:hi], data, offsets, Runs(data, offsets, length, gap)


def _least(names: tuple[np.ndarray, ...], doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct name tuples with their smallest document, and whether a second document has them."""
    order = np.lexsort((doc, *names[::-1]))
    names, doc = tuple(x[order] for x in names), doc[order]
    new = np.ones(len(doc), bool)
    if len(doc):
        new[1:] = np.any([x[1:] != x[:-1] for x in names], axis=0)
    first = np.flatnonzero(new)
    if not len(first):
        return (*names, doc, np.zeros(0, bool))
    return (*(x[first] for x in names), doc[first], np.maximum.reduceat(doc, first) != doc[first])


def _sent(shards: int, names: tuple[np.ndarray, ...], doc: np.ndarray, more: np.ndarray | None = None):
    """One row a shard: sorted columns as bytes. The first name, of which the shard has the leading bits, is sent as differences."""
    cuts = np.searchsorted(arrays.shard_of(names[0], shards), np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(cuts)):
        at = slice(cuts[s], cuts[s + 1])
        yield int(s), [x[at].tobytes() for x in (*names, doc, *([] if more is None else [more]))]


def _rows(sent, width: int):
    rows = list(sent)
    names = ["shard", *(f"c{k}" for k in range(width))]
    cols = [pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[1][k] for r in rows], pa.binary()) for k in range(width))]
    return pa.RecordBatch.from_arrays(cols, names)


def _schema(width: int) -> str:
    return ", ".join(["shard int", *(f"c{k} binary" for k in range(width))])


def _column(table: pa.Table, k: int, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(f"c{k}")])


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys without the low 16 bits, as differences of 32 bits where they fit."""
    high = keys >> np.uint64(16)
    step = np.diff(high, prepend=np.uint64(0))
    wide = step >= 0xFFFFFFFF
    return np.where(wide, 0xFFFFFFFF, step).astype("<u4").tobytes() + high[wide].astype("<u8").tobytes() + np.array([wide.sum()], "<u8").tobytes()


def _unpack_keys(raw: bytes) -> np.ndarray:
    wide = int(np.frombuffer(raw[-8:], "<u8")[0])
    step = np.frombuffer(raw[: len(raw) - 8 - 8 * wide], "<u4").astype(np.uint64)
    full = np.frombuffer(raw[len(raw) - 8 - 8 * wide : -8], "<u8")
    at = np.flatnonzero(step == 0xFFFFFFFF)
    # each wide step restarts the running sum at its full value
    sums = np.cumsum(np.where(step == 0xFFFFFFFF, 0, step), dtype=np.uint64)
    if wide:
        base = np.zeros(len(step), np.uint64)
        base[at] = full - np.concatenate([[np.uint64(0)], full[:-1]]) - (sums[at] - np.concatenate([[np.uint64(0)], sums[at[:-1]]]))
        sums = sums + np.cumsum(base, dtype=np.uint64)
    return sums << np.uint64(16)


def _round1(length: int, gap: int, shards: int):
    def send(held):
        key, doc = (np.concatenate(x) for x in zip(*held, strict=True))
        key, _, more = _least((key & ~np.uint64(0xFFFF),), doc)
        cuts = np.searchsorted(arrays.shard_of(key, shards), np.arange(shards + 1))
        rows = [(int(s), [_pack_keys(key[cuts[s] : cuts[s + 1]]), np.packbits(more[cuts[s] : cuts[s + 1]]).tobytes()]) for s in np.flatnonzero(np.diff(cuts))]
        return _rows(rows, 2)

    def run(batches):
        held, n = [], 0
        for ids, _, _, runs in _blocks(batches, length, gap):
            held.append((runs.key, ids[runs.doc]))
            n += len(runs.key)
            if n > HELD:
                yield send(held)
                held, n = [], 0
        if n:
            yield send(held)

    return run


def _repeated(folder: str):
    """Of one shard of round 1: keys sent twice, or sent once as those of two documents."""

    def run(table: pa.Table) -> pa.Table:
        keys, more = [], []
        for raw, bits in zip(table.column("c0"), table.column("c1"), strict=True):
            k = _unpack_keys(raw.as_py())
            keys.append(k)
            more.append(np.unpackbits(np.frombuffer(bits.as_py(), np.uint8), count=len(k)).astype(bool))
        keys, more = np.concatenate(keys), np.concatenate(more)
        # a task that sent a key in two batches, from one document, only costs a look in round 2
        order = np.argsort(keys, kind="stable")
        keys, more = keys[order], more[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        count = np.diff(np.append(first, len(keys)))
        keep = (count > 1) | np.maximum.reduceat(more, first)
        arrays.put(folder, table.column("shard")[0].as_py(), key=keys[first[keep]])
        return pa.table({"n": pa.array([int(keep.sum())], pa.int64())})

    return run


def _live(runs: Runs, repeated: arrays.Shards) -> np.ndarray:
    return np.flatnonzero(repeated.lookup(runs.key & ~np.uint64(0xFFFF))[0])


def _round2(length: int, gap: int, shards: int, keys: str):
    def send(held):
        key, name, doc = (np.concatenate(x) for x in zip(*held, strict=True))
        key, name, doc, _ = _least((key, name), doc)
        return _rows(_sent(shards, (key, name), doc), 3)

    def run(batches):
        repeated, held, n = arrays.shards(keys, shards, "key"), [], 0
        for ids, _, _, runs in _blocks(batches, length, gap):
            live = _live(runs, repeated)
            held.append((runs.key[live], runs.names(live), ids[runs.doc[live]]))
            n += len(live)
            if n > HELD:
                yield send(held)
                held, n = [], 0
        if n:
            yield send(held)

    return run


def _settle_runs(folder: str, shards: int):
    """Of one shard of round 2: (name, smallest document, whether its key has another name), sent on by name."""

    def run(table: pa.Table) -> pa.Table:
        key, name, doc, _ = _least((_column(table, 0, np.uint64), _column(table, 1, np.uint64)), _column(table, 2, np.int64))
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        open_ = np.repeat(np.diff(np.append(first, len(key))) > 1, np.diff(np.append(first, len(key))))
        order = np.argsort(name, kind="stable")
        return pa.Table.from_batches([_rows(_sent(shards, (name[order],), doc[order], open_[order]), 3)])

    return run


def _store_runs(folder: str):
    def run(table: pa.Table) -> pa.Table:
        name, doc, open_ = _column(table, 0, np.uint64), _column(table, 1, np.int64), _column(table, 2, bool)
        order = np.argsort(name, kind="stable")
        arrays.put(folder, table.column("shard")[0].as_py(), name=name[order], doc=doc[order], open=open_[order])
        return pa.table({"n": pa.array([int(open_.sum())], pa.int64())})

    return run


def _unsettled(ids, runs: Runs, live: np.ndarray, settled: arrays.Shards) -> tuple[np.ndarray, np.ndarray]:
    """Runs that a smaller document has as well, and runs whose windows have to be looked at."""
    _, doc, open_ = settled.lookup(runs.names(live), "doc", "open")
    smaller = doc < ids[runs.doc[live]]
    return live[smaller], live[~smaller & open_.astype(bool)]


def _round3(length: int, gap: int, shards: int, keys: str, names: str):
    def send(held):
        name, doc = (np.concatenate(x) for x in zip(*held, strict=True))
        name, doc, more = _least((name,), doc)
        return _rows(_sent(shards, (name,), doc, more), 3)

    def run(batches):
        repeated, settled = arrays.shards(keys, shards, "key"), arrays.shards(names, shards, "name", "doc", "open")
        held, n = [], 0
        for ids, _, _, runs in _blocks(batches, length, gap):
            _, open_ = _unsettled(ids, runs, _live(runs, repeated), settled)
            at, run_ = runs.windows(open_)
            held.append((runs.window_names(at), ids[runs.doc[open_]][run_]))
            n += len(at)
            if n > HELD:
                yield send(held)
                held, n = [], 0
        if n:
            yield send(held)

    return run


def _store_windows(folder: str):
    """Of one shard of round 3: windows of two documents or more, with the smallest."""

    def run(table: pa.Table) -> pa.Table:
        sent = _column(table, 0, np.uint64), _column(table, 2, bool)
        name, doc, more = _least((sent[0],), _column(table, 1, np.int64))
        more[np.searchsorted(name, sent[0][sent[1]])] = True  # a task had it from two documents
        arrays.put(folder, table.column("shard")[0].as_py(), window=name[more], doc=doc[more])
        return pa.table({"n": pa.array([int(more.sum())], pa.int64())})

    return run


def _cut(length: int, gap: int, shards: int, keys: str, names: str, windows: str):
    def run(batches):
        repeated, settled = arrays.shards(keys, shards, "key"), arrays.shards(names, shards, "name", "doc", "open")
        held = arrays.shards(windows, shards, "window", "doc")
        for batch in batches:
            n_removed, n_spans, spans_, digests = [], [], [], []
            for ids, data, offsets, runs in _blocks([batch], length, gap):
                whole, open_ = _unsettled(ids, runs, _live(runs, repeated), settled)
                at, run_ = runs.windows(open_)
                hit, doc = held.lookup(runs.window_names(at), "doc")
                at = at[hit & (doc < ids[runs.doc[open_]][run_])]
                mark = np.zeros(len(data) + 1, np.int32)
                np.add.at(mark, np.concatenate([runs.first[whole], at]), 1)
                np.add.at(mark, np.concatenate([runs.last[whole], at]) + length, -1)
                gone = np.cumsum(mark[:-1]) > 0
                edge = np.diff(gone.astype(np.int8), prepend=0, append=0)
                for lo, hi in zip(offsets[:-1], offsets[1:], strict=True):
                    cut = gone[lo:hi]
                    k = int(cut.sum())
                    if k:
                        edge = np.flatnonzero(np.diff(cut.astype(np.int8), prepend=0, append=0))
                        spans = edge.reshape(-1, 2).tolist()
                    else:
                        spans = []
                    n_removed.append(k)
                    n_spans.append(len(spans))
                    spans_.append(spans)
                    digests.append(hashlib.sha256(data[lo:hi][~cut].tobytes() if k else data[lo:hi].tobytes()).hexdigest())
            size = pa.compute.cast(pa.compute.binary_length(common.text_column(batch)), pa.int64())
            cols = [batch.column("doc_id"), size, pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string()), pa.array(spans_, pa.list_(pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, gap: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) for each row of docs(doc_id, text).

    spans: maximal runs of UTF-8 bytes, [start, end), covered by `length`-byte strings that also start in a document with a
    smaller doc_id. Null texts are empty; null ids come before all others. Rows of one id are one document to each other and
    remove nothing from each other. Texts under `length` bytes keep everything. Texts are read whole, however long; other columns are not read, whatever their names.
    An empty table gives no rows. Names have 64 bits (round 1: 48, which only ever adds entries to check); equal names are taken as equal strings."""
    gap = max(0, min(GAP, length // 2)) if gap is None else gap
    if not 0 <= gap <= length // 2:
        raise ValueError("gap is at most half of length")
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text")
    shards = common.text_shards(rows)
    keys, names, windows = (common.shared_folder(spark, f"suffix-{x}") for x in ("keys", "runs", "windows"))
    done = lambda df: df.groupBy().sum("n").collect()  # noqa: E731  one number; the arrays are in the shared folder
    done(common.by_shard(rows.mapInArrow(_round1(length, gap, shards), _schema(2)), shards).applyInArrow(_repeated(keys), "n long"))
    named = common.by_shard(rows.mapInArrow(_round2(length, gap, shards, keys), _schema(3)), shards).applyInArrow(_settle_runs(names, shards), _schema(3))
    done(common.by_shard(named, shards).applyInArrow(_store_runs(names), "n long"))
    done(common.by_shard(rows.mapInArrow(_round3(length, gap, shards, keys, names), _schema(3)), shards).applyInArrow(_store_windows(windows), "n long"))
    return rows.mapInArrow(
        _cut(length, gap, shards, keys, names, windows),
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>",
    )


#: Bytes by which positions are ranked at first.
FIRST = 8


def _first_ranks(batches):
    """Every position of every text with FIRST bytes or more to come, and these bytes as a number, which orders like they do."""
    for batch in batches:
        col, ids, row = common.text_column(batch), _ids(batch), batch.column("row").to_numpy()
        for lo, hi, data, offsets in common.byte_blocks(col):
            if len(data) < FIRST:
                continue
            rank = np.zeros(len(data) - FIRST + 1, np.uint64)
            for k in range(FIRST):
                rank = rank << np.uint64(8) | data[k : len(data) - FIRST + 1 + k]
            of = np.repeat(np.arange(hi - lo), np.diff(offsets))[: len(rank)]
            at = np.flatnonzero(np.arange(len(rank)) + FIRST <= offsets[of + 1])
            rank = (rank[at] ^ np.uint64(1 << 63)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(row[lo + of[at]]), pa.array(ids[lo + of[at]]), pa.array(at - offsets[of[at]]), pa.array(rank)], ["row", "doc", "p", "a"])


def _number(batches):
    """Ranks for sorted rows of one range: the number of the range, and the place in it."""
    from pyspark import TaskContext

    at = TaskContext.get().partitionId() << 40
    for batch in batches:
        yield batch.append_column("rank", pa.array(np.arange(at, at + batch.num_rows)))
        at += batch.num_rows


def _whole_texts(length: int):
    def run(batches):
        for batch in batches:
            rows = []
            for doc, raw, starts in zip(batch.column("doc_id").to_pylist(), common.text_column(batch).cast(pa.binary()).to_pylist(), batch.column("starts"), strict=True):
                mark = np.zeros(len(raw) + 1, np.int32)
                at = np.array(starts.as_py() or [], np.int64)
                np.add.at(mark, at, 1)
                np.add.at(mark, at + length, -1)
                gone = np.cumsum(mark[:-1]) > 0
                spans = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).reshape(-1, 2).tolist()
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                rows.append((doc, len(raw), int(gone.sum()), len(spans), hashlib.sha256(kept).hexdigest(), spans))
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return run


def doubled_spans(docs: DataFrame, length: int = LENGTH, sizes: list | None = None) -> DataFrame:
    """What repeated_spans gives, by prefix doubling on every position, with exact ranks and no names.

    Positions are ranked by FIRST bytes, and then by pairs of ranks: that of the position and that of the one `step` further on,
    with step 8, 16, ... and at last what is missing to `length`. Each round Spark groups the pairs, leaves out those of one
    document only, sorts the others by range and numbers them; positions without a partner or a rank leave. sizes, if given, gets
    (bytes ranked, positions, pairs of two documents) of each round. All positions go through the shuffle of every round: many times
    the input, so the query uses repeated_spans (see the README); this one is for tables of which that much may be written."""
    if length < FIRST:
        raise ValueError(f"length is {FIRST} or more")
    rows = common.checkpointed(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()))
    left = rows.mapInArrow(_first_ranks, "row long, doc long, p long, a long").withColumn("b", F.lit(0).cast("long"))
    parts, width = common.shuffle_partitions(docs.sparkSession), FIRST
    while True:
        left = common.stored(left)
        pairs = left.groupBy("a", "b").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count(F.lit(1)).alias("n")).filter("least < most").drop("most")
        ranks = common.stored(pairs.repartitionByRange(parts, "a", "b").sortWithinPartitions("a", "b").mapInArrow(_number, "a long, b long, least long, n long, rank long"))
        total = left.count()
        if sizes is not None:
            sizes.append((width, total, ranks.count()))
        ranked = common.spread_join(left, ranks, ["a", "b"], "n", total, by=["row", "p"]).select("row", "doc", "p", "least", "rank")
        if width == length:
            starts = ranked.filter("least < doc").groupBy("row").agg(F.collect_list("p").alias("starts"))
            return rows.join(starts, "row", "left").select("doc_id", "text", "starts").mapInArrow(
                _whole_texts(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>"
            )
        step = min(width, length - width)
        ranked = common.stored(ranked)
        further = ranked.select("row", (F.col("p") - step).alias("p"), F.col("rank").alias("b"))
        left, width = ranked.select("row", "doc", "p", F.col("rank").alias("a")).join(further, ["row", "p"]).select("row", "doc", "p", "a", "b"), width + step


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(common.table(spark, sf_dir, "documents")).drop("spans")

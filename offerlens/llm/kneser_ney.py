"""Scoring texts with an interpolated modified Kneser-Ney word bigram model.

Counting and scoring are passes over the texts; the model is sorted hash arrays in the shared folder, which workers map into
memory: (u, v) -> count, and word -> its sums. Tokens are the lower-cased words of a text and one end; the context of the first
is a begin mark.
1. Each task sends its distinct bigrams with counts, by ranges of their hash; each range is merged, sorted and stored.
2. A second pass gives the sums of words without a shuffle of bigrams: with c the stored count of a token's bigram, a token adds
   1/c to the number of its contexts, so that each distinct bigram adds 1 in all, and likewise to its context's numbers of
   followers seen once, twice or more. Each task sends the sums of its distinct words.
3. A last pass scores every text: unique words and bigrams of a block are looked up once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays, common
from .common import pair64

BEGIN, END = np.uint64(0x1B873593CC9E2D51), np.uint64(0x85EBCA77C2B2AE63)
#: Entries that a task holds before it sends them on.
HELD = 4_000_000
_SUMS = ("seen", "context", "one", "two", "more", "contexts")


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, token, index of each row's first token) for the rows of a block, ends included."""
    words, at = common.words_of(data, offsets)
    rows = len(offsets) - 1
    first = at + np.arange(rows + 1)
    v = np.empty(len(words) + rows, np.uint64)
    is_end = np.zeros(len(v), bool)
    is_end[first[1:] - 1] = True
    v[is_end], v[~is_end] = END, words
    u = np.concatenate([[BEGIN], v[:-1]])
    u[first[:-1]] = BEGIN
    return u, v, first


def _blocks(batches):
    for batch in batches:
        for _, _, data, offsets in common.byte_blocks(common.text_column(batch)):
            yield _tokens(data, offsets)


def _merge(keys: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], [np.add.reduceat(v[order], first) if len(first) else v for v in values]


def _send(shards: int, keys: np.ndarray, values: list[np.ndarray]) -> pa.RecordBatch:
    cuts = np.searchsorted(arrays.shard_of(keys, shards), np.arange(shards + 1))
    rows = np.flatnonzero(np.diff(cuts))
    cols = [pa.array([x[cuts[s] : cuts[s + 1]].tobytes() for s in rows], pa.binary()) for x in (keys, *values)]
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), *cols], ["shard", *(f"c{k}" for k in range(len(cols)))])


def _gather(table: pa.Table, kinds) -> list[np.ndarray]:
    return [np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(f"c{k}")]) for k, kind in enumerate(kinds)]


def _held(make, shards: int, kinds):
    """Runs make on every block and sends merged (keys, values) each time HELD entries have come together."""

    def run(batches):
        got, n = [], 0

        def out():
            keys = np.concatenate([g[0] for g in got])
            keys, values = _merge(keys, [np.concatenate([g[1][k] for g in got]) for k in range(len(kinds))])
            return _send(shards, keys, [v.astype(kind) for v, kind in zip(values, kinds, strict=True)])

        for block in _blocks(batches):
            got.append(make(*block))
            n += len(got[-1][0])
            if n > HELD:
                yield out()
                got, n = [], 0
        if n:
            yield out()

    return run


def _count_bigrams(u, v, first):
    keys, n = np.unique(pair64(u, v), return_counts=True)
    return keys, [n]


def _store_bigrams(folder: str):
    def run(table: pa.Table) -> pa.Table:
        keys, (n,) = _merge(*(lambda k, c: (k, [c.astype(np.int64)]))(*_gather(table, (np.uint64, np.uint32))))
        arrays.put(folder, table.column("shard")[0].as_py(), key=keys, n=n.astype(np.uint32 if n.max(initial=0) < 1 << 32 else np.int64))
        return pa.table({"types": pa.array([len(keys)], pa.int64()), **{f"n{k}": pa.array([int((n == k).sum())], pa.int64()) for k in (1, 2, 3, 4)}})

    return run


def _word_sums(folder: str, shards: int):
    def make(u, v, first):
        keys, at = np.unique(pair64(u, v), return_inverse=True)
        _, n = arrays.shards(folder, shards, "key", "n").lookup(keys, "n")
        c = n[at].astype(float)
        words, both = np.unique(np.concatenate([u, v]), return_inverse=True)
        ui, vi = both[: len(u)], both[len(u) :]
        add = lambda i, w=None: np.bincount(i, w, minlength=len(words))
        return words, [add(vi), add(ui), add(ui[c == 1]), add(ui[c == 2]), add(ui, np.where(c > 2, 1 / c, 0)), add(vi, 1 / c)]

    return make


# counts are of HELD entries at most; sums of 1/c are whole once all tasks are added, and doubles keep them so
_SUM_KINDS = (np.uint32, np.uint32, np.uint32, np.uint32, np.float64, np.float64)


def _store_words(folder: str):
    def run(table: pa.Table) -> pa.Table:
        keys, *values = _gather(table, (np.uint64, *_SUM_KINDS))
        keys, values = _merge(keys, [v.astype(float) for v in values])
        values[3] /= 2
        seen, context, one, two, more, contexts = (np.rint(v).astype(np.int64) for v in values)
        contexts = np.where(seen > 0, np.maximum(contexts, 1), 0)
        arrays.put(folder, table.column("shard")[0].as_py(), key=keys, seen=seen, context=context, one=one, two=two, more=more, contexts=contexts)
        out = {"tokens": int(seen.sum()), "words": int((seen > 0).sum()), "types": int(contexts.sum())} | {f"n{k}": int((contexts == k).sum()) for k in (1, 2, 3, 4)}
        return pa.table({k: pa.array([v], pa.int64()) for k, v in out.items()})

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """What counts of 0, 1, 2 and 3 or more lose; 1/2 each where the numbers of rare counts are too few to tell."""
    if not all((n1, n2, n3)):
        return np.array([0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    return np.clip([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], [0, 0.05, 0.05, 0.05], [0, 1, 2, 3])


class Model:
    """Where the arrays are, and the few numbers beside them."""

    def __init__(self, bigrams: str, words: str, shards: int, pairs, totals):
        self.bigrams, self.words, self.shards = bigrams, words, shards
        self.tokens, self.vocabulary = int(totals["tokens"] or 0), int(totals["words"] or 0)
        self.types = int(totals["types"] or 0)
        self.discount = discounts(*(int(pairs[f"n{k}"] or 0) for k in (1, 2, 3, 4)))
        rare = [int(totals[f"n{k}"] or 0) for k in (1, 2, 3, 4)]
        self.low_discount = discounts(*rare)
        many = self.vocabulary - rare[0] - rare[1]
        self.left = float(self.low_discount[1:] @ [rare[0], rare[1], many]) / self.types if self.types else 1.0

    def score(self, u, v, first):
        """Per row: base score, log10 probability, tokens, and tokens seen in training."""
        words, both = np.unique(np.concatenate([u, v]), return_inverse=True)
        _, seen, context, one, two, more, contexts = arrays.shards(self.words, self.shards, "key", *_SUMS).lookup(words, *_SUMS)
        keys, at = np.unique(pair64(u, v), return_inverse=True)
        _, n = arrays.shards(self.bigrams, self.shards, "key", "n").lookup(keys, "n")
        n = n[at].astype(np.int64)
        ui, vi = both[: len(u)], both[len(u) :]
        d1, d2, d3 = self.discount[1:]
        low = np.maximum(contexts - self.low_discount[np.minimum(contexts, 3)], 0) / max(self.types, 1) + self.left / (self.vocabulary + 1)
        total = np.maximum(context, 1)
        back = np.where(context > 0, (d1 * one + d2 * two + d3 * more) / total, 1.0)
        p = np.maximum(n - self.discount[np.minimum(n, 3)], 0) / total[ui] + back[ui] * low[vi]
        base = np.log10((seen + 0.5) / (self.tokens + 0.5 * (self.vocabulary + 1)))[vi]
        add = lambda x: np.add.reduceat(x, first[:-1])
        return add(base), add(np.log10(p)), np.diff(first), add((seen[vi] > 0).astype(np.int64))


def train(texts: DataFrame) -> Model:
    """The model of a text column; an empty table gives a model in which every word is unknown."""
    spark = texts.sparkSession
    texts = texts.select("text")
    shards = common.text_shards(texts)
    bigrams, words = common.shared_folder(spark, "bigrams"), common.shared_folder(spark, "words")
    sums = lambda df: df.groupBy().sum().toDF(*df.columns).first()  # noqa: E731  a handful of numbers
    sent = texts.mapInArrow(_held(_count_bigrams, shards, (np.uint32,)), "shard int, c0 binary, c1 binary")
    pairs = sums(common.by_shard(sent, shards).applyInArrow(_store_bigrams(bigrams), "types long, n1 long, n2 long, n3 long, n4 long"))
    sent = texts.mapInArrow(_held(_word_sums(bigrams, shards), shards, _SUM_KINDS), "shard int, " + ", ".join(f"c{k} binary" for k in range(7)))
    totals = sums(common.by_shard(sent, shards).applyInArrow(_store_words(words), "tokens long, words long, types long, n1 long, n2 long, n3 long, n4 long"))
    return Model(bigrams, words, shards, pairs, totals)


def scorer(model: Model):
    kind = pa.struct([("base_score", pa.float64()), ("score", pa.float64()), ("n_tokens", pa.int64()), ("n_known", pa.int64())])

    @F.arrow_udf("base_score double, score double, n_tokens long, n_known long")
    def run(texts: pa.Array) -> pa.Array:
        parts = [model.score(*_tokens(data, offsets)) for _, _, data, offsets in common.byte_blocks(pa.compute.fill_null(texts, ""))]
        cols = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0), np.zeros(0), np.zeros(0, int), np.zeros(0, int)]
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kind, strict=True)], fields=list(kind))

    return run


def score_texts(docs: DataFrame, held_out: Column) -> DataFrame:
    """docs with columns lm (base_score, score, n_tokens, n_known), perplexity and train_tokens, from a model of the texts not held out.

    Columns of these names are replaced, all others stay; repeated rows are scored alike, and counted as often as they occur. Whole
    texts are read, however long. An empty table gives no rows. Null and empty texts are the end token alone. Words that training lacks have the probability of an unknown word. Names have
    64 bits; words of equal names are taken as one."""
    model = train(docs.filter(~held_out))
    scored = docs.withColumn("lm", scorer(model)(F.col("text")))
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("lm.score") / F.col("lm.n_tokens"))).withColumn("train_tokens", F.lit(model.tokens).cast("long"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = common.crc_mod("doc_id", 5) == 1
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_texts(docs, held_out).select(
        "doc_id", held_out.alias("held_out"), *(F.col(f"lm.{c}").alias(c) for c in ("n_tokens", "n_known")), "train_tokens", "lm.base_score", "lm.score", "perplexity"
    )

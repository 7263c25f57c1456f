"""Phrases whose words stand together more often than their parts would, by language.

Identical pieces of text are collapsed into one with a multiplicity, so a passage that many documents share is read once.
1. A first pass names every word and every pair of neighbours by 64 bits. Tasks send distinct names with weights to hash buckets, and
   duckdb, which may spill, sums them by bucket: names that come to `least` are stored as sorted arrays. A weight is sent as `least` at
   most, since a sum needs no more to pass.
2. A second pass looks the names up. A phrase that occurs `least` times has only words and pairs that do, so phrases with any other are
   out; those left are sent as text, by hash bucket, and duckdb counts them exactly. Names only choose what is counted.
3. Every candidate asks for the counts of its parts: one request for each side of each cut, shuffled to where that part's count lies. A
   part that many candidates ask for is dealt over salts.
Longer candidates send their count to the phrases inside them in the same way."""

from __future__ import annotations

import hashlib
import uuid

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import arrays, common
from .common import pair64
from .kneser_ney import _merge
from .suffix_dedup import _pack_keys, _unpack_keys

LEAST, LONGEST, SHARE, KEEP, SCALE = 30, 4, 80, 2000, 2_000_000
#: Bytes of pieces that are named at once, entries that a task holds before it sends them on, and what duckdb may hold in memory.
BLOCK, HELD, MEMORY = 1 << 22, 4_000_000, "400MB"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def pieces(docs: DataFrame) -> DataFrame:
    """(lang, piece, m): the distinct pieces of docs(text, lang), as words with one blank between them, and how often each occurs."""
    parts = F.explode(F.split(F.translate("text", UPPER, LOWER), r"[.,;:!?\x0A-\x0D]"))
    rows = docs.filter("text is not null").select(F.coalesce("lang", F.lit("und")).alias("lang"), parts.alias("piece"))
    words = F.trim(F.regexp_replace("piece", r"[\x20\x09]+", " "))
    return rows.select("lang", words.alias("piece")).filter("piece != ''").groupBy("lang", "piece").agg(F.count(F.lit(1)).alias("m"))


class Block:
    """The words of a run of pieces: where they lie, and names of the word sequences that begin with each."""

    def __init__(self, langs: list[str], data: np.ndarray, offsets: np.ndarray, m: np.ndarray):
        blank = np.flatnonzero(data == 32)
        self.data, self.langs = data, langs
        self.start = np.sort(np.concatenate([offsets[:-1], blank + 1]))
        self.end = np.sort(np.concatenate([blank, offsets[1:]]))
        self.bytes = common.Fingerprints(data)
        self.word = self.bytes.of(self.start, self.end)
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        self.m = m[self.row]
        name = {x: np.uint64(int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little")) for x in set(langs)}
        self.names = {1: pair64(np.array([name[x] for x in langs], np.uint64)[self.row], self.word)}

    def at(self, n: int) -> np.ndarray:
        """The words with which n words of one piece begin."""
        last = len(self.row) - n + 1
        return np.flatnonzero(self.row[:last] == self.row[n - 1 :]) if last > 0 else np.zeros(0, np.int64)

    def named(self, n: int, at: np.ndarray) -> np.ndarray:
        """Names of the n words from each place on."""
        out = self.names[1][at]
        for k in range(1, n):
            out = pair64(out, self.word[at + k])
        return out


def _blocks(batches):
    """Blocks of about BLOCK bytes from batches of (lang, piece, m)."""
    held, size = [], 0

    def out():
        t = pa.Table.from_batches(held).combine_chunks()
        langs, m, col = t.column("lang").to_pylist(), t.column("m").to_numpy(), t.column("piece").chunk(0)
        for lo, hi, data, offsets in common.byte_blocks(col, BLOCK):
            yield Block(langs[lo:hi], data, offsets, m[lo:hi])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.column("piece").nbytes
        if size > BLOCK:
            yield from out()
            held, size = [], 0
    if held:
        yield from out()


def _counted(rows, schema: pa.Schema, query: str, scratch: str | None):
    """The batches of a duckdb query over a stream of batches, `rows`. Where it needs more than MEMORY, it goes on in a folder of its own below scratch."""
    with duckdb.connect(config={"memory_limit": MEMORY, "threads": 1, "preserve_insertion_order": False}) as con:
        con.execute("set temp_directory = ?", [f"{scratch}/duckdb-{uuid.uuid4().hex}" if scratch else ""])
        con.register("rows", pa.RecordBatchReader.from_batches(schema, rows))
        yield from con.sql(query).to_arrow_reader(1 << 16)


def _send_names(buckets: int, least: int):
    """Names of words and pairs with their weights, packed by bucket."""
    kind = np.min_scalar_type(least)

    def out(held):
        keys, (n,) = _merge(np.concatenate([h[0] for h in held]), [np.concatenate([h[1] for h in held])])
        cuts = np.searchsorted(arrays.shard_of(keys, buckets), np.arange(buckets + 1))
        some = np.flatnonzero(np.diff(cuts))
        parts = [(keys[cuts[s] : cuts[s + 1]], np.minimum(n[cuts[s] : cuts[s + 1]], least).astype(kind)) for s in some]
        cols = [pa.array(some, pa.int32()), pa.array([_pack_keys(k) for k, _ in parts], pa.binary()), pa.array([v.tobytes() for _, v in parts], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["bucket", "names", "weights"])

    def run(batches):
        held, n = [], 0
        for b in _blocks(batches):
            for k in (1, 2):
                at = b.at(k)
                keys, (m,) = _merge(b.named(k, at), [b.m[at]])
                held.append((keys, m))
                n += len(keys)
            if n > HELD:
                yield out(held)
                held, n = [], 0
        if held:
            yield out(held)

    return run


def _store_names(folder: str, least: int):
    """Keeps the names of one bucket whose weights come to least."""
    kind, schema = np.min_scalar_type(least), pa.schema([("name", pa.uint64()), ("n", pa.int64())])

    def run(batches):
        bucket = []

        def rows():
            for batch in batches:
                for s, names, weights in zip(*(batch.column(c) for c in ("bucket", "names", "weights")), strict=True):
                    bucket[:] = [s.as_py()]
                    cols = [pa.array(_unpack_keys(names.as_py())), pa.array(np.frombuffer(weights.as_py(), kind).astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(cols, schema=schema)

        query = f"select name from rows group by name having sum(n) >= {least}"
        names = [x.column("name").to_numpy() for x in _counted(rows(), schema, query, arrays._local(folder))]
        if bucket:
            names = np.sort(np.concatenate(names)) if names else np.zeros(0, np.uint64)
            arrays.put(folder, bucket[0], key=names)
            yield pa.RecordBatch.from_arrays([pa.array([len(names)], pa.int64())], ["names"])

    return run


_PHRASES = pa.schema([("bucket", pa.int32()), ("lang", pa.string()), ("phrase", pa.string()), ("k", pa.int32()), ("n", pa.int64())])


def _send_phrases(folder: str, buckets: int, longest: int):
    """The phrases of up to `longest` words without a rare word or pair, with their number in each block."""

    def known(names: np.ndarray) -> np.ndarray:
        some, back = np.unique(names & ~np.uint64(0xFFFF), return_inverse=True)
        return arrays.shards(folder, buckets, "key").lookup(some)[0][back]

    def rows(b: Block):
        frequent = known(b.names[1])
        at = b.at(2)
        at = at[frequent[at] & frequent[at + 1]]
        pair = np.zeros(len(b.word) + 1, bool)
        pair[at[known(b.named(2, at))]] = True
        whole = np.flatnonzero(frequent)
        for n in range(1, longest + 1):
            if n > 1:
                at = b.at(n)
                whole = at[np.logical_and.reduce([pair[at + k] for k in range(n - 1)])]
            if not len(whole):
                continue
            name, text = b.named(n, whole), b.bytes.of(b.start[whole], b.end[whole + n - 1])
            order = np.lexsort((text, name))
            name, text, at_ = name[order], text[order], whole[order]
            first = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (text[1:] != text[:-1])]))
            total, one, raw = np.add.reduceat(b.m[at_], first), at_[first], b.data.tobytes()
            cols = [
                pa.array(arrays.shard_of(name[first], buckets), pa.int32()),
                pa.array([b.langs[r] for r in b.row[one].tolist()], pa.string()),
                pa.array([raw[s:e] for s, e in zip(b.start[one].tolist(), b.end[one + n - 1].tolist(), strict=True)], pa.binary()).cast(pa.string()),
                pa.array(np.full(len(one), n), pa.int32()), pa.array(total, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(cols, schema=_PHRASES)

    def merged(held):
        t = pa.Table.from_batches(held).group_by(["bucket", "lang", "phrase", "k"]).aggregate([("n", "sum")])
        return t.rename_columns(["bucket", "lang", "phrase", "k", "n"]).select(_PHRASES.names).to_batches(max_chunksize=1 << 16)

    def run(batches):
        held, n = [], 0
        for b in _blocks(batches):
            for batch in rows(b):
                held.append(batch)
                n += batch.num_rows
            if n > HELD // 2:
                yield from merged(held)
                held, n = [], 0
        if held:
            yield from merged(held)

    return run


def _count_phrases(folder: str, least: int):
    query = f"select lang, phrase, k, cast(sum(n) as bigint) as a from rows group by lang, phrase, k having sum(n) >= {least}"
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("k", pa.int32()), ("a", pa.int64())])

    def run(batches):
        for batch in _counted(iter(batches), _PHRASES, query, arrays._local(folder)):
            yield batch.cast(schema)

    return run


def counts(bags: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, k, a): the phrases of k = 1 to `longest` words that occur `least` times or more in pieces(lang, piece, m)."""
    spark = bags.sparkSession
    folder, buckets = common.shared_folder(spark, "phrases"), common.text_shards(bags, "piece")
    names = bags.mapInArrow(_send_names(buckets, least), "bucket int, names binary, weights binary")
    names.repartitionById(buckets, F.col("bucket")).mapInArrow(_store_names(folder, least), "names long").agg(F.sum("names")).first()
    rows = bags.mapInArrow(_send_phrases(folder, buckets, longest), "bucket int, lang string, phrase string, k int, n long")
    return common.stored(rows.repartitionById(buckets, F.col("bucket")).mapInArrow(_count_phrases(folder, least), "lang string, phrase string, k int, a long"))


def cuts(found: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates: phrases of two words or more, with the counts of the parts of their lowest cut."""
    words = F.split("phrase", " ")
    some = found.filter("k >= 2").withColumn("j", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    part = F.when(F.col("side") == 0, F.slice(words, 1, F.col("j"))).otherwise(F.slice(words, F.col("j") + 1, F.col("k") - F.col("j")))
    requests = some.select("lang", F.array_join(part, " ").alias("part"), "phrase", "a", "j", "side")
    asked = requests.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("asked"))
    held = found.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")).join(asked, ["lang", "part"])
    total = found.filter("k >= 2").agg(F.sum(2 * (F.col("k") - 1))).first()[0] or 0
    answers = common.spread_join(requests, held, ["lang", "part"], "asked", total, ["phrase", "j", "side"])
    one = lambda j, side: F.max(F.when((F.col("j") == j) & (F.col("side") == side), F.col("f")))
    sides = answers.groupBy("lang", "phrase", "a").agg(*[one(j, side).alias(f"f{j}{side}") for j in range(1, longest) for side in (0, 1)])
    big = lambda c: F.col(c).cast("decimal(20,0)")
    cut = lambda j: F.struct(F.call_function("div", F.lit(SCALE).cast("decimal(8,0)") * big("a"), big(f"f{j}0") + big(f"f{j}1")).alias("score"), F.lit(j).alias("j"), F.col(f"f{j}0").alias("l"), F.col(f"f{j}1").alias("r"))
    lowest = F.array_min(F.filter(F.array(*[cut(j) for j in range(1, longest)]), lambda x: x["score"].isNotNull()))
    return sides.select("lang", "phrase", "a", lowest.alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")


def outer(found: DataFrame, share: int = SHARE) -> DataFrame:
    """(lang, phrase) of candidates inside a longer one that occurs at least share hundredths as often."""
    words, inner = F.split("phrase", " "), F.col("k") - 1
    sizes = found.filter("k >= 3").select("lang", words.alias("words"), "k", "a", F.explode(F.sequence(F.lit(2), inner)).alias("size"))
    starts = sizes.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)))
    longer = starts.groupBy("lang", F.array_join(F.slice("words", F.col("at"), F.col("size")), " ").alias("phrase")).agg(F.max("a").alias("most"))
    of = lambda n, c: F.lit(n).cast("decimal(8,0)") * F.col(c).cast("decimal(20,0)")
    return longer.join(found.select("lang", "phrase", "a"), ["lang", "phrase"]).filter(of(100, "most") >= of(share, "a")).select("lang", "phrase")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, share: int = SHARE, keep: int = KEEP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `keep` phrases of each language of docs(text, lang).

    A null text counts as empty and a null language as 'und'; repeated rows count as often as they lie there. Texts are read whole,
    however long; ties of score and count go by phrase, in the order of its bytes. Other columns are not read, whatever their names.
    An empty table, or one without a phrase that occurs `least` times, gives no rows."""
    bags = common.stored(pieces(docs))
    found = counts(bags, least, longest)
    ranked = cuts(found, longest).join(outer(found, share), ["lang", "phrase"], "left_anti")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    # first within shares of a language, then among the first of all shares: no task sorts a whole language
    salts = common.shuffle_partitions(docs.sparkSession)
    within = F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))
    first = ranked.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(salts))).withColumn("_n", within).filter(F.col("_n") <= keep).drop("_n", "_salt")
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= keep)
    size = F.length("piece") - F.length(F.replace("piece", F.lit(" "), F.lit(""))) + 1
    n = bags.groupBy("lang").agg(F.sum(size * F.col("m")).cast("long").alias("n"))
    return first.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(common.table(spark, sf_dir, "documents"))


OP12_SQL = f"""
with p as (
  select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w
  from (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents)
), g as (
  select lang, array_to_string(w[i : i + k - 1], ' ') as phrase, k, count(*) as a
  from p, unnest(range(1, 5)) as u(k), unnest(range(1, greatest(len(w) - k + 2, 1))) as s(i) group by all having count(*) >= 30
), c as (select lang, phrase, k, a, string_split(phrase, ' ') as w from g where k >= 2
), cut as (
  select c.lang, c.phrase, c.k, c.a, j, x.a as l, y.a as r, cast(2000000::hugeint * c.a // (x.a::hugeint + y.a) as bigint) as score
  from c, unnest(range(1, c.k)) as u(j)
  join g x on x.lang = c.lang and x.phrase = array_to_string(c.w[1:j], ' ')
  join g y on y.lang = c.lang and y.phrase = array_to_string(c.w[j + 1:], ' ')
), low as (
  select * from cut qualify row_number() over (partition by lang, phrase order by score, j) = 1
), inside as (
  select lang, array_to_string(w[i : i + k - 1], ' ') as phrase, max(a) as most
  from (select lang, w, a, k as whole from c), unnest(range(2, whole)) as u(k), unnest(range(1, whole - k + 2)) as s(i) group by all
), kept as (
  select low.* from low left join inside using (lang, phrase) where most is null or 100::hugeint * most < 80::hugeint * low.a
), ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept
), n as (select lang, cast(sum(len(w)) as bigint) as n from p group by lang)
select lang, rank, phrase, a, l, r, n, score from ranked join n using (lang) where rank <= 2000
"""

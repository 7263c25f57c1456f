"""Sessions, shared folders and byte-level helpers that the operators have in common."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these bytes: blank and 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"

M64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a temporary one in local mode, as in tests, and an error on a cluster."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if sc.getCheckpointDir() is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir is not set; on a cluster it names the folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="offerlens-"))
        root = sc.getCheckpointDir()
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def shared_folder(spark: SparkSession, what: str) -> str:
    """A fresh folder below the shared root, which driver and executors see alike."""
    return f"{shared_root(spark)}/{what}-{uuid.uuid4().hex[:12]}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once into the shared checkpoint folder, with its lineage cut."""
    shared_root(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df, written once into the shared folder and read again. Unlike a checkpoint, it passes on none of what the optimiser knows of the
    rows, which in a loop that derives columns from each other grows with every round."""
    folder = shared_folder(df.sparkSession, "stored")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int, by: list[str] | None = None) -> DataFrame:
    """left joined with right on keys, without weight. right has one row a key, and in `weight` how many of left's `total` rows have it.

    A key with more than an even share of the rows, one part in spark.sql.shuffle.partitions, is dealt over as many salts as it
    has shares. There are at most as many such keys as shares, so the table of them is broadcast, and right grows by no more rows.
    by: the columns of left whose hash chooses the salt; all others than keys by default."""
    share = max(1, total // shuffle_partitions(left.sparkSession))
    salts = F.greatest(F.ceil(F.col(weight) / share), F.lit(1))
    hot = right.filter(F.col(weight) > share).select(*keys, salts.alias("_salts"))
    of = F.xxhash64(*(by or [c for c in left.columns if c not in keys]))
    left = left.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.pmod(of, F.coalesce("_salts", F.lit(1)))).drop("_salts")
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop(weight)
    return left.join(right, [*keys, "_salt"]).drop("_salt")


#: Bytes of text whose entries one shard holds, about; and shards at most, as each is a few files.
SHARD_BYTES, SHARDS = 1 << 24, 100_000


def text_shards(docs: DataFrame, text: str = "text") -> int:
    """How many shards the entries of the texts are dealt to: one for SHARD_BYTES of text, so that a task's share does not grow with the table."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return int(min(max(8, -(-size // SHARD_BYTES)), SHARDS))


def by_shard(df: DataFrame, shards: int):
    """df grouped by its column shard, 0 to shards - 1, one shard a task: a hash of the numbers would put several into one."""
    return df.repartitionById(shards, F.col("shard")).groupBy("shard")


def id_text(doc_id: str = "doc_id"):
    return F.col(doc_id).cast("string")


def crc_mod(doc_id: str, m: int):
    """crc32 of the id as text, modulo m (a null id counts as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(id_text(doc_id), F.lit("")).cast("binary")), F.lit(m))


# ---------------------------------------------------------------- bytes


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit words that spreads all bits (a splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def pair64(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One name for an ordered pair of names."""
    return mix64(a * np.uint64(0x9E3779B97F4A7C15) + mix64(b ^ np.uint64(0xD6E8FEB86659FD93)))


_BASE = 0x5851F42D4C957F2D  # odd, so that its powers can be divided out modulo 2**64
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            out = np.full(size, np.uint64(base))
            out[0] = 1
            _powers[k] = np.cumprod(out, dtype=np.uint64)
    return _powers[0], _powers[1]


class Fingerprints:
    """64-bit names of any substring of a byte array, in constant time each."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        power, self.inverse = _power_tables(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * power[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.inverse[start])

    def fixed(self, k: int) -> np.ndarray:
        """Of the k bytes from every position on."""
        n = len(self.sums) - k
        return mix64((self.sums[k:] - self.sums[:-k]) * self.inverse[:n]) if n > 0 else np.zeros(0, np.uint64)


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    col = batch.column(name)
    return pc.fill_null(col, "") if col.null_count else col


def raw_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as its bytes and the offset of each row (one more than rows)."""
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, offsets, data = col.buffers()
    offsets = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_blocks(col: pa.Array, limit: int = 1 << 20):
    """(first row, row after the last, bytes, offsets) of runs of rows with about limit bytes; a longer row stands alone."""
    data, offsets = raw_bytes(col)
    lo, n = 0, len(col)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the lower-cased words of all rows in order, and for each row the index of its first word (one more than rows)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    data = lower_ascii(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = (data != 32) & ((data < 9) | (data > 13))
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    start = inside[:n] & (first[:n] | ~np.concatenate(([False], inside[: n - 1])))
    end = inside[:n] & (first[1:] | ~inside[1:])
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    return Fingerprints(data).of(start, end), np.searchsorted(start, offsets)

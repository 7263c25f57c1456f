"""Nearest neighbours by additive quantisation.

The direction of a vector is the sum of one codeword from each of BOOKS full-dimensional codebooks, fitted one after the other on the
residuals of a bounded sample. Every vector is encoded by beam search, which keeps the BEAM best partial sums, and stored as BOOKS
bytes, its norm, the scale that makes the sum a unit vector, and the cosine of the angle between the sum and itself. A query has a table
of its products with all codewords; scores are sums of table entries, scaled, and the best of each block are scored again on the original
vectors. By the two angles, of a query to a sum and of the sum to its vector, no vector can be nearer than a certain score: those of the
others that may still reach a query's `top` best are scored on the original vectors as well, so that none is missed however the rows lie.

Vectors lie in blocks; blocks of queries meet every block of vectors in one pass each, and only the best of a query go on."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BOOKS, WORDS, BEAM = 8, 256, 4
#: Rows that codebooks are fitted on at most: those of least hash.
FIT_ROWS = 16384
ROUNDS = 6
BLOCK, QUERY_BLOCK = 8192, 512
#: Query blocks whose best rows a task holds at most.
QUERIES_HELD = 256
#: Rows of each block that are scored exactly for a query: at least so many, and at least DEPTH times as many as are asked for.
RERANK, DEPTH = 64, 3
#: What scores in single precision, and products of matrices in double precision, may be off by, relative to the norms.
ROUNDING, FINE = 1e-5, 1e-12
#: Rows of a block that a query may still take by their angles, on average, from which on a product of matrices thins them out first.
MANY = 64


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = ROUNDS) -> np.ndarray:
    """books x words x dimension, by k-means on residuals; deterministic."""
    rest, out = x.astype(np.float64), []
    rng = np.random.default_rng(7)
    for _ in range(books):
        c = rest[rng.choice(len(rest), min(words, len(rest)), replace=False)]
        for _ in range(rounds):
            near = np.argmin((c * c).sum(axis=1) - 2 * rest @ c.T, axis=1)
            n = np.bincount(near, minlength=len(c))
            sums = np.zeros_like(c)
            np.add.at(sums, near, rest)
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        rest = rest - c[np.argmin((c * c).sum(axis=1) - 2 * rest @ c.T, axis=1)]
        out.append(c)
    return np.array(out)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(codes, scales, cosines) of unit vectors: the best of `beam` partial sums after each book, the factor that makes each sum a unit
    vector that points to its own side, and their product with the vector."""
    n, (m, k, _) = len(x), books.shape
    codes, sums, cost = np.zeros((n, 1, 0), np.int64), np.zeros((n, 1, x.shape[1])), np.zeros((n, 1))
    for b in range(m):
        c = books[b]
        # |x - s - c|^2 less |x - s|^2
        more = (c * c).sum(axis=1) - 2 * ((x[:, None, :] - sums) @ c.T)
        total = (cost[:, :, None] + more).reshape(n, -1)
        keep = min(beam, total.shape[1])
        best = np.argpartition(total, keep - 1, axis=1)[:, :keep]
        row = np.arange(n)[:, None]
        cost, parent, word = total[row, best], best // k, best % k
        codes = np.concatenate([codes[row, parent], word[:, :, None]], axis=2)
        sums = sums[row, parent] + c[word]
    win = cost.argmin(axis=1)
    s = sums[np.arange(n), win]
    norm = (s * s).sum(axis=1)
    scales = np.where(norm > 0, 1 / np.sqrt(np.where(norm > 0, norm, 1)), 0.0)
    cosines = (x * s).sum(axis=1) * scales
    sign = np.where(cosines < 0, -1.0, 1.0)
    return codes[np.arange(n), win].astype(np.uint8), scales * sign, np.minimum(cosines * sign, 1.0)


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, norms) of vectors that are not zero, of any size."""
    x = x.astype(np.float64)
    large = np.abs(x).max(axis=1, keepdims=True)
    norm = np.sqrt(((x / large) ** 2).sum(axis=1, keepdims=True))
    return x / large / norm, (large * norm)[:, 0]


def _matrix(col: pa.Array, kind) -> np.ndarray:
    return np.frombuffer(col.as_buffer(), kind)


def _pack_blocks(books: np.ndarray | None):
    """One group of vectors, sorted by id, as one row of bytes; with codes, scales, cosines and norms where books are given."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        ids, row = (table.column(c).to_numpy().astype(np.int64) for c in ("vec_id", "row"))
        x = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        x = x if x.dtype == np.float32 else x.astype(np.float64)  # as they came; products are taken in double precision
        out = {"block": pa.array([table.column("block")[0].as_py()], pa.int64()), "ids": pa.array([ids.tobytes()]), "rows": pa.array([row.tobytes()]), "vectors": pa.array([x.tobytes()])}
        if books is not None:
            way, norms = unit(x)
            made = zip(*(encode(way[k : k + 1024], books) for k in range(0, len(x), 1024)), strict=True)
            out |= {name: pa.array([np.concatenate(part).tobytes()]) for name, part in zip(("codes", "scales", "cosines"), made, strict=True)}
            out |= {"norms": pa.array([norms.tobytes()])}
        return pa.table(out)

    return run


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Of each row, the columns of the k largest entries; of equal ones, the first."""
    k = min(k, scores.shape[1])
    at = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(scores, at, axis=1).min(axis=1)
    for r in np.flatnonzero((scores >= least[:, None]).sum(axis=1) > k):
        above = np.flatnonzero(scores[r] > least[r])
        at[r] = np.concatenate([above, np.flatnonzero(scores[r] == least[r])[: k - len(above)]])
    return at


def _exact(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Scores of the rows of x, in double precision; equal rows have equal scores, wherever they stand."""
    score = np.einsum("...j,...j->...", x, q)
    return score if metric == "ip" else 2 * score - np.einsum("...j,...j->...", x, x) - np.einsum("...j,...j->...", q, q)


def _first(found: np.ndarray, exact: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((found, -exact), axis=-1)[..., :top]
    return np.take_along_axis(found, order, axis=-1), np.take_along_axis(exact, order, axis=-1)


class _Block:
    """One block of vectors, which query blocks meet."""

    def __init__(self, get, books: np.ndarray, metric: str, kind):
        m, k, d = books.shape
        self.books, self.metric, self.k = books.reshape(m * k, d), metric, k
        self.ids, self.rows = _matrix(get["ids"], np.int64), _matrix(get["rows"], np.int64)
        self.x = _matrix(get["vectors"], kind).reshape(-1, d).astype(np.float64)
        self.codes = _matrix(get["codes"], np.uint8).reshape(len(self.ids), m)
        self.scales, self.cosines, self.norms = (_matrix(get[c], np.float64) for c in ("scales", "cosines", "norms"))
        self.sines = np.sqrt(np.maximum(1 - self.cosines**2, 0))

    def scores(self, cosine: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """query x row: what cosines of query and vector make of the measure."""
        cosine = cosine * self.norms * norm[:, None]
        return cosine if self.metric == "ip" else 2 * cosine - self.norms**2 - norm[:, None] ** 2

    def meet(self, q: np.ndarray, qrows: np.ndarray, best: tuple | None, top: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores), query x rank: the best of a query's rows so far (best) and of this block."""
        way, norm = unit(q)
        table = (self.books @ way.T).astype(np.float32)
        near = np.zeros((len(self.ids), len(q)), np.float32)
        for b in range(self.codes.shape[1]):
            near += table[b * self.k + self.codes[:, b].astype(np.int64)]
        near = np.clip(np.ascontiguousarray((near * self.scales[:, None].astype(np.float32)).T), -1, 1)
        at = _best(self.scores(near * self.cosines, norm), max(RERANK, DEPTH * top) + 1)
        exact = np.stack([_exact(self.x[a], v, self.metric) for a, v in zip(at, q, strict=True)])
        exact[self.rows[at] == qrows[:, None]] = -np.inf
        found = self.ids[at]
        if best is not None:
            found, exact = np.concatenate([best[0], found], axis=1), np.concatenate([best[1], exact], axis=1)
        found, exact = _first(found, exact, top)
        least = exact[:, -1] if exact.shape[1] == top else np.full(len(q), -np.inf)
        # cosine of the difference of the two angles, beyond what single precision may lose
        reach = near * self.cosines + np.sqrt(1 - near**2) * self.sines
        reach = self.scores(np.minimum(reach + ROUNDING, 1), norm)
        may = reach + ROUNDING * np.abs(reach) >= least[:, None]
        np.put_along_axis(may, at, False, axis=1)
        may[self.rows == qrows[:, None]] = False
        if may.sum() > MANY * len(q):
            self._narrow(may, q, norm, least, top)
        for r in np.flatnonzero(may.any(axis=1)):
            rows = np.flatnonzero(may[r])
            more = np.concatenate([found[r], self.ids[rows]]), np.concatenate([exact[r], _exact(self.x[rows], q[r], self.metric)])
            found[r], exact[r] = (v[: found.shape[1]] for v in _first(*more, top))
        return found, exact

    def _narrow(self, may: np.ndarray, q: np.ndarray, norm: np.ndarray, least: np.ndarray, top: int) -> None:
        """Leaves of many rows those that a product of matrices finds to reach the best, but for its rounding."""
        rows = np.flatnonzero(may.any(axis=0))
        score, room = q @ self.x[rows].T, FINE * norm[:, None] * self.norms[rows]
        if self.metric == "l2":
            square = self.norms[rows] ** 2
            score, room = 2 * score - square - norm[:, None] ** 2, FINE * (square + norm[:, None] ** 2)
        some = np.where(may[:, rows], score, -np.inf)
        if len(rows) > top:
            least = np.maximum(least, np.partition(some - room, -top, axis=1)[:, -top])
        may[:, rows] = some + room >= least[:, None]


def _scan(books: np.ndarray, top: int, metric: str, kind):
    """Of a stream of vector blocks (q_block -1), each with the query blocks that meet it after it: the best rows of each query.

    A vector block is read once. Of QUERIES_HELD query blocks the best rows so far are held, and then sent on: a query's rows meet again
    where they are ranked."""

    def out(best):
        for qids, found, exact, qrows in best.values():
            asked = [np.repeat(v, found.shape[1]) for v in (qids, qrows)]
            ok = np.isfinite(exact.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(v[ok]) for v in (*asked, found.ravel(), exact.ravel())], ["query_id", "query_row", "vec_id", "score"])

    def run(batches):
        best: dict[int, tuple] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                get = {name: batch.column(name)[r] for name in batch.schema.names}
                if get["q_block"].as_py() < 0:
                    block = _Block(get, books, metric, kind)
                    continue
                qids, qrows = _matrix(get["ids"], np.int64), _matrix(get["rows"], np.int64)
                q = _matrix(get["vectors"], kind).reshape(len(qids), -1).astype(np.float64)
                key = get["q_block"].as_py()
                best[key] = qids, *block.meet(q, qrows, best[key][1:3] if key in best else None, top), qrows
                if len(best) > QUERIES_HELD:
                    yield from out(best)
                    best = {}
        yield from out(best)

    return run


def search(vectors: DataFrame, is_query, top: int = 20, metric: str = "ip", fit_rows: int = FIT_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the `top` nearest found for each query row of vectors(vec_id, embedding).

    metric: 'ip' (largest inner product) or 'l2' (least distance, as a negative score). Vectors null, zero or with null or
    non-finite components, without an id, or of another length than most, take no part. Ties go to the smaller id. Equal vectors
    have equal codes, so ties in the rough scores go to the smaller id as well. A vector's own row alone is no candidate: other rows
    of its id are, and rows that repeat an id are queries of their own. Other columns are not read. With no vectors or no queries:
    no rows. Every vector is encoded and looked at for every query; scored exactly are DEPTH times `top` or RERANK of a block's rows, and
    all others that may be among the best by their angles, so the result is that of brute force. Where rows have no structure that the
    books can learn, these are most of them."""
    spark = vectors.sparkSession
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    ok = vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    ok = ok.filter(~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0))
    sizes = ok.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    ok = ok.filter(F.size("embedding") == sizes["d"])
    kind = np.float32 if ok.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64
    ok = ok.withColumn("asks", is_query)
    rows = ok.count()
    sample = ok.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit_rows).toPandas()
    books = fit(unit(np.stack(sample["embedding"].to_numpy()))[0])
    blocks = -(-rows // BLOCK)
    # rows are told apart by a number that is written down with them, once
    ok = common.checkpointed(ok.withColumn("row", F.monotonically_increasing_id()))
    packed = ok.withColumn("block", F.pmod(F.xxhash64("vec_id", "row"), F.lit(blocks))).select("block", "vec_id", "row", "embedding")
    packed = common.checkpointed(packed.groupBy("block").applyInArrow(_pack_blocks(books), "block long, ids binary, rows binary, vectors binary, codes binary, scales binary, cosines binary, norms binary"))
    asked = ok.filter("asks")
    q_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("row", "vec_id"), F.lit(q_blocks))).select("block", "vec_id", "row", "embedding")
    asked = asked.groupBy("block").applyInArrow(_pack_blocks(None), "block long, ids binary, rows binary, vectors binary")
    asked = common.checkpointed(asked.select(F.col("block").alias("q_block"), "ids", "rows", "vectors"))
    # every block of queries is sent to every block of vectors, which is read once, with its queries after it
    sent = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
    met = packed.withColumn("q_block", F.lit(-1).cast("long")).unionByName(sent, allowMissingColumns=True)
    found = met.repartition("block").sortWithinPartitions("block", "q_block").mapInArrow(_scan(books, top, metric, kind), "query_id long, query_row long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")).cast("int"))
    return ranked.filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)

"""Codes of vectors against a plain search over all entries, in whole numbers of any size."""

import hashlib
import math
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from offerlens.llm import vector_codes


def brute(rows, width):
    """rows of (vec_id, label, vector) -> {vec_id: (code, error, label_error)}, digest; ids are distinct."""
    kept = [(i, lab, [math.floor(Fraction(x) * 256) for x in v]) for i, lab, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    parts = lambda v: [v[p * width : (p + 1) * width] for p in range(16)]
    books = [[parts(v)[p] for _, _, v in kept[:64]] for p in range(16)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign():
        return [[min((far(x, c), k) for k, c in enumerate(books[p])) for p, x in enumerate(parts(v))] for _, _, v in kept]

    for _ in range(2):
        got = assign()
        for p in range(16):
            for k in range(len(books[p])):
                own = [parts(v)[p] for (_, _, v), g in zip(kept, got, strict=True) if g[p][1] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    got = assign()
    out = {i: ("".join(f"{k:02x}" for _, k in g), sum(d for d, _ in g)) for (i, _, _), g in zip(kept, got, strict=True)}
    labels = {}
    for i, lab, _ in kept:
        labels[lab] = labels.get(lab, 0) + out[i][1]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return {i: (*out[i], labels[lab]) for i, lab, _ in kept}, digest


def answers(spark, rows):
    df = spark.createDataFrame([(i, v, lab) for i, lab, v in rows], "vec_id long, embedding array<double>, label int")
    df = df.withColumn("code", F.lit(1)).withColumn("parts", F.lit("x")).withColumn("error", F.lit(0.5)).repartition(3)
    codes, entries = vector_codes.encode(df)
    return vector_codes.with_label_error(codes).collect(), vector_codes.digest(entries)


def made(n, width, scale, seed=2):
    rng = np.random.default_rng(seed)
    vectors = np.round(rng.normal(0, scale, (n, 16 * width)) * 4) / 4 if scale > 1 else rng.normal(0, scale, (n, 16 * width))
    vectors[n // 2 : n // 2 + 20] = vectors[3]  # a group of copies
    rows = [(5 * k + 1, None if k % 4 == 0 else int(k % 3 == 0), v.tolist()) for k, v in enumerate(vectors)]
    rows[7] = (*rows[7][:2], None)
    rows[9] = (*rows[9][:2], [None, *rows[9][2][1:]])
    rows[11] = (*rows[11][:2], [float("nan"), *rows[11][2][1:]])
    rows[13] = (*rows[13][:2], [*rows[13][2][:-1], float("-inf")])
    return rows


@pytest.mark.parametrize(("n", "width", "scale"), [(400, 2, 0.2), (200, 3, 0.003), (150, 1, 2.0), (30, 2, 0.2)])
def test_against_all_entries(spark, n, width, scale):
    rows = made(n, width, scale)
    got, digest = answers(spark, rows)
    want, want_digest = brute(rows, width)
    assert digest == want_digest
    assert {r.vec_id: (r.code, r.error, r.label_error) for r in got} == want and len(got) == len(want)


def test_components_of_any_size(spark):
    rows = [(i, lab, v and [None if x is None else x * 1e5 for x in v]) for i, lab, v in made(90, 1, 0.9)]
    got, digest = answers(spark, rows)
    want, want_digest = brute(rows, 1)
    assert digest == want_digest and {r.vec_id: (r.code, r.error, r.label_error) for r in got} == want
    huge = [(k, 1, [(-1) ** k * 1e300 * (k + 1)] + [0.5] * 15) for k in range(80)]
    got, digest = answers(spark, huge)
    want, want_digest = brute(huge, 1)
    assert digest == want_digest
    for r in got:
        code, error, _ = want[r.vec_id]
        assert r.code == code and r.error == (error if error < 1 << 63 else None)


def test_search_looks_at_few_entries():
    rng = np.random.default_rng(1)
    books = vector_codes.Codebooks(rng.integers(-500, 500, (16, 64, 4)))
    x = books.entries.reshape(16, 64, 4)[:, rng.integers(64, size=300)].transpose(1, 0, 2) + rng.integers(-9, 9, (300, 16, 4))
    start, d = books.nearest(x, rng.integers(64, size=(300, 16)))
    again, e = books.nearest(x, start)
    far = ((x[:, :, None] - books.entries.reshape(1, 16, 64, 4)) ** 2).sum(axis=3)
    assert (start == far.argmin(axis=2)).all() and (d == far.min(axis=2)).all() and (again == start).all() and (d == e).all()
    within = (books.apart[(start + books.first()).reshape(-1)] <= 4 * d.reshape(-1)[:, None]).sum()
    assert within < 3 * start.size


def test_limbs():
    for value in (0, 5, -5, 2**40, -(2**40), 2**63 - 1, -(2**63), 3**300, -(3**300)):
        parts = vector_codes.limbs(value)
        assert sum(v << (32 * k) for k, v in enumerate(parts)) == value and all(-(1 << 32) < v < 1 << 32 for v in parts)


def test_edges(spark):
    got, digest = answers(spark, [])
    assert got == [] and digest == hashlib.sha256(b"").hexdigest()
    assert answers(spark, [(1, 1, None), (2, 1, [])])[0] == []
    with pytest.raises(ValueError, match="equal parts"):
        answers(spark, [(1, 1, [0.5] * 17)])
    same = [(None, None, [0.25] * 16), (4, 1, [0.5] * 16), (4, 1, [0.5] * 16), (6, 1, [0.5] * 32)]
    got, _ = answers(spark, same)
    assert sorted((r.vec_id is None, r.code, r.error, r.label_error) for r in got) == [(False, "00" * 16, 0, 0)] * 2 + [(True, "02" * 16, 0, 0)]


def test_query_against_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    want = con.sql(vector_codes.OP13_SQL).df().sort_values("vec_id").astype({"error": int, "label_error": int})
    got = vector_codes.op13_vector_codes(spark, sf).toPandas().sort_values("vec_id")
    assert list(got.columns) == list(want.columns) and got.to_numpy().tolist() == want.to_numpy().tolist()

"""The low rank of each class's prices against sorting them, with ties, one large class, and refinement forced."""

import math
import random

import pytest

from offerlens.operators import metrics

OFFERS = "brand string, series string, pack_size int, price double, in_stock int, source string"


def made(seed):
    rng = random.Random(seed)
    rows = [("A", None, 1, round(rng.uniform(1, 9) ** 4, 2), 1, "s") for _ in range(900)]
    rows += [(rng.choice("BC"), rng.choice([None, "x", "y"]), rng.randrange(1, 4), rng.choice([5.0, 5.0, 7.25, 1e-300, 1e300, 0.1 + 0.2, 0.3]), rng.choice([0, 1, 1]), "s") for _ in range(300)]
    return rows + [("D", "z", 1, 3.0, 1, "s"), ("A", None, 1, None, 1, "s"), ("A", None, 1, -4.0, 1, "s"), ("A", None, 1, 0.0, 1, "s"), (None, None, 1, 5.0, 1, "s"), ("E", None, 1, 5.0, 0, "s")]


@pytest.mark.parametrize(("seed", "q", "few", "finer"), [(1, 0.1, 4096, 1024), (2, 0.1, 1, 2), (3, 0.5, 3, 7), (4, 1.0, 1, 5), (5, 0.0, 2, 3)])
def test_ranks(spark, monkeypatch, seed, q, few, finer):
    monkeypatch.setattr(metrics, "FEW", few)
    monkeypatch.setattr(metrics, "FINER", finer)
    monkeypatch.setattr(metrics, "PER_DOUBLING", 1 if finer < 10 else 64)
    rows, classes = made(seed), {}
    for b, s, p, price, stock, _ in rows:
        if b and stock and price and price > 0:
            classes.setdefault((b, s, p), []).append(price)
    want = {k: (len(v), sorted(v)[min(math.floor(len(v) * q), len(v) - 1)]) for k, v in classes.items()}
    got = metrics.class_prices(spark.createDataFrame(rows, OFFERS).repartition(3), q).collect()
    assert {(r["brand"], r["series"], r["pack_size"]): (r["n"], r["low"]) for r in got} == want and len(got) == len(want)


def test_no_window_and_no_offers(spark):
    df = spark.createDataFrame(made(6), OFFERS)
    plan = metrics.class_prices(df)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    assert metrics.class_prices(df.limit(0)).collect() == []


def test_markup_of_unbranded_and_large_tables(spark, monkeypatch):
    df = spark.createDataFrame([("A", None, 1, 30.0, 1, "s"), ("A", "x", 1, 5.0, 1, "s"), (None, None, 1, 5.0, 1, "s"), ("B", None, 1, None, 1, "s")], OFFERS)
    base = spark.createDataFrame([("A", None, 1, 9, 20.0), ("A", "x", 1, 9, 10.0), ("B", None, 1, 9, None)], "brand string, series string, pack_size int, n long, base double")
    for most in (100, 1):
        monkeypatch.setattr(metrics, "SENT", most)
        got = sorted((r["brand"] or "", r["series"] or "", r["base"], r["markup"]) for r in metrics.with_markup(df, base).collect())
        assert got == [("", "", None, None), ("A", "", 20.0, 0.5), ("A", "x", 10.0, 0.0), ("B", "", None, None)]

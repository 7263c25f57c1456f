"""Entity resolution against one signature after the other, as shops' titles come."""

import random

import pytest
from pyspark.sql import functions as F

from offerlens.functions import text
from offerlens.operators import resolve


def in_turn(rows, threshold, known=()):
    """rows (block, sig, n) -> leader of each (block, sig): longest first, each joins its most similar leader or becomes one."""
    leaders, out = {}, {}
    for block, sig in sorted(known):
        leaders.setdefault(block, []).append(sig)
    for block, sig, _ in sorted(rows, key=lambda r: (-r[2], r[1])):
        best, at = threshold, None
        for lead in leaders.setdefault(block, []):
            s = resolve.similarity(sig, lead)
            if s > best or (at is None and s >= threshold):
                best, at = s, lead
        if at is None:
            leaders[block].append(sig)
            at = sig
        out[block, sig] = at
    return out


def made(n, seed, letters="abcde", words=12):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 8))) for _ in range(words)]
    rows = {}
    for _ in range(n):
        sig = " ".join(sorted({rng.choice(vocabulary) for _ in range(rng.randrange(1, 6))}))
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(sig) + 1)
            sig = sig[:k] + rng.choice(["", *letters]) + sig[k + rng.randrange(2) :]
        if sig:
            rows[rng.choice(["A", "B"]), sig] = rng.randrange(20, 26)
    return [(b, s, n) for (b, s), n in rows.items()]


@pytest.mark.parametrize(("n", "seed", "letters", "words", "threshold"), [(300, 1, "abcde", 12, 87.0), (300, 2, "ab", 6, 87.0), (250, 3, "abcdefghij", 30, 75.0), (200, 4, "a", 3, 87.0), (200, 5, "abcdefgh", 9, 95.0)])
def test_leaders_are_those_found_in_turn(spark, monkeypatch, n, seed, letters, words, threshold):
    if seed % 2:
        monkeypatch.setattr(resolve, "TILE", 7)
    rows = made(n, seed, letters, words)
    sigs = spark.createDataFrame([(b, 1, "", s, m, False) for b, s, m in rows], "brand string, pack_size int, numbers string, sig string, n int, known boolean").repartition(3)
    got = {(r["brand"], r["sig"]): r["leader"] for r in resolve.leads(sigs, threshold).collect()}
    assert got == in_turn(rows, threshold)


def test_known_products_come_first(spark):
    rows = made(150, 6)
    old = sorted({(b, s[1:]) for b, s, _ in rows[::3] if len(s) > 1} | {(b, s) for b, s, _ in rows[::7]})
    fields = "brand string, pack_size int, numbers string, sig string, n int, known boolean"
    sigs = spark.createDataFrame([(b, 1, "", s, m, False) for b, s, m in rows] + [(b, 1, "", s, 0, True) for b, s in old], fields)
    got = {(r["brand"], r["sig"]): r["leader"] for r in resolve.leads(sigs).collect()}
    assert got == in_turn(rows, 87.0, old)
    assert any(got[b, s] != s and (b, got[b, s]) in old for b, s in got)


def test_prefixes_lose_no_similar_pair():
    """Texts that are similar share a group of the size for their lengths, in prefixes of any order of groups."""
    rng, hits = random.Random(9), 0
    for _ in range(30_000):
        a = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 30)))
        b = list(a)
        for _ in range(rng.randrange(7)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(2)] = rng.choice(["", "a", "b", "e"])
        b = "".join(b)
        threshold = rng.choice([75.0, 87.0, 90.0, 95.0])
        if not b or resolve.similarity(a, b) < threshold:
            continue
        hits += 1
        salt, q = rng.random(), resolve.size_for(len(a) + len(b), threshold)
        prefix = []
        for s in (a, b):
            seen, ranked = {}, []
            for g in resolve.groups(s, q):
                seen[g] = seen.get(g, 0) + 1
                ranked.append((hash((salt, g, seen[g])), g, seen[g]))
            prefix.append({x[1:] for x in sorted(ranked)[: dict(resolve.prefixes(len(s), threshold))[q]]})
        assert prefix[0] & prefix[1], (a, b, threshold)
    assert hits > 5000


def test_chains_take_rounds(spark):
    """Each is similar to its neighbours alone: every other one leads."""
    base = "abcdefghijklmnopqrstuvwxyz0123456789"
    chain = [("0" * k + base)[:36] for k in range(0, 36, 3)]
    rows = [("A", s, 100 - k) for k, s in enumerate(chain)]
    sigs = spark.createDataFrame([(b, 1, "", s, m, False) for b, s, m in rows], "brand string, pack_size int, numbers string, sig string, n int, known boolean")
    got = {(r["brand"], r["sig"]): r["leader"] for r in resolve.leads(sigs).collect()}
    assert got == in_turn(rows, 87.0) and 2 < len(set(got.values())) < len(chain)


def test_clusters_of_odd_rows(spark):
    titles = [(1, "Alpha roadster red"), (2, None), (3, ""), (4, "Alpha"), (5, "Alpha roadster red"), (6, "roadster red")]
    df = spark.createDataFrame(titles, "id int, raw_title string").withColumn("vendor", F.when(F.col("id") == 6, "The ALPHA shop, alphabet street")).withColumn("n", F.lit(1)).withColumn("key", F.lit("x"))
    got = {r["id"]: r["canonical_key"] for r in resolve.clusters(df, hint="vendor").collect()}
    assert got == {1: "Alpha|red roadster|p1", 2: "Other|assorted|p1", 3: "Other|assorted|p1", 4: "Alpha|assorted|p1", 5: "Alpha|red roadster|p1", 6: "Alpha|red roadster|p1"}
    assert resolve.clusters(df.limit(0)).collect() == []


def test_the_sellers_field_is_read_like_a_title(spark):
    hint = lambda s: spark.createDataFrame([(s,)], "s string").select(text.brand_hint(F.col("s"))).first()[0]
    assert [hint(s) for s in ("Alphabet shop", "the ALPHA shop", None, "", "Delta and Bravo")] == [None, "Alpha", None, None, "Bravo"]

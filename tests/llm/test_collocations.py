"""Collocations against a plain count of every phrase."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from offerlens.llm import collocations


def brute(rows, least, longest, share, keep):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    out, lost = {}, set()
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    for (lang, w), a in candidates.items():
        score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]], w))
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                inner = lang, w[i : i + size]
                if 100 * a >= share * f[inner]:
                    lost.add(inner)
    rows = []
    for lang, found in out.items():
        kept = [x for x in sorted(found) if (lang, x[5]) not in lost]
        rows += [(lang, rank, p.decode(), -a, left, right, n[lang], -s) for rank, (s, a, p, left, right, _) in enumerate(kept[:keep], 1)]
    return sorted(rows)


def made(seed=5):
    rng = np.random.default_rng(seed)
    words = [*"abcdefgh", "Été", "ñu", "new", "york", "city"]
    texts = []
    for _ in range(220):
        text = " ".join(rng.choice(words, rng.integers(1, 40)))
        texts.append(text.replace("d", rng.choice([".", "d", ",", "d\t", "\n", "\x0b", " "])))
    texts += ["shared passage of words, new york city hall. " * 12] * 9 + [None, "", " \t ", ".,;", "one", "x " * 3000 + "y", "New York"]
    return [(t, ["en", "fr", None, "und"][int(rng.integers(4))] if k % 3 else "en") for k, t in enumerate(texts)]


ROWS = made()


@pytest.mark.parametrize(("least", "longest", "share", "keep"), [(30, 4, 80, 2000), (4, 4, 80, 25), (5, 3, 50, 2000)])
def test_against_counts(spark, least, longest, share, keep):
    df = spark.createDataFrame(ROWS, "text string, lang string").withColumn("phrase", F.lit(1)).withColumn("n", F.lit("x")).withColumn("m", F.lit(2)).repartition(3)
    got = collocations.collocations(df, least, longest, share, keep).collect()
    want = brute(ROWS, least, longest, share, keep)
    assert sorted(map(tuple, got)) == want and want
    assert dict(collocations.collocations(df.limit(0)).dtypes)["score"] == "bigint" and collocations.collocations(df.limit(0)).collect() == []


def test_tasks_that_send_often(spark, monkeypatch):
    """Small blocks and buckets give the same rows."""
    monkeypatch.setattr(collocations, "BLOCK", 200)
    monkeypatch.setattr(collocations, "HELD", 50)
    bags = [(lang, p, m) for (lang, p), m in Counter((lang or "und", p) for t, lang in ROWS for p in re.split("[.,;:!?\x0a-\x0d]", (t or "").lower()) if p.split()).items()]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([x[0] for x in bags]), pa.array([" ".join(x[1].split()) for x in bags]), pa.array([x[2] for x in bags])], ["lang", "piece", "m"])
    sent = list(collocations._send_names(3, 30)(iter([batch])))
    assert len(sent) > 3 and {s.as_py() for b in sent for s in b.column("bucket")} == {0, 1, 2}


def test_arithmetic_beyond_64_bits(spark):
    big = 2**62
    found = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big + 5), ("en", "a b", 2, big - 7)], "lang string, phrase string, k int, a long")
    (r,) = collocations.cuts(found).collect()
    assert (r.l, r.r, r.score) == (big, big + 5, 2_000_000 * (big - 7) // (2 * big + 5))


def test_duckdb_spills_into_the_shared_folder(tmp_path, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(collocations, "MEMORY", "40MB")
    schema = pa.schema([("name", pa.uint64()), ("n", pa.int64())])
    names = (pa.RecordBatch.from_arrays([pa.array(np.arange(k * 100_000, (k + 1) * 100_000, dtype=np.uint64)), pa.array(np.ones(100_000, np.int64))], schema=schema) for k in range(30))
    out = collocations._counted(names, schema, "select name, sum(n) as n from rows group by name", str(tmp_path))
    assert sum(b.num_rows for b in out) == 3_000_000


def test_query_against_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(map(tuple, con.sql(collocations.OP12_SQL).fetchall()))
    got = collocations.op12_collocations(spark, sf)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == want and want

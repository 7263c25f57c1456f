"""The versioned store, and products and listings in it against one item after the other."""

import random

import pytest
from pyspark.sql import functions as F

from offerlens.functions import text
from offerlens.operators import resolve
from offerlens.tables import offers as tables
from offerlens.tables.store import Conflict, Store

ROWS = "k int, region string, v int"


def newest(old, new):
    return old.join(new.select("k", "region"), ["k", "region"], "left_anti").unionByName(new)


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    t = s.begin("w", 0)
    t.create("t", spark.createDataFrame([], ROWS).schema, ("k", "region"), ("region",), 4)
    t.upsert("t", spark.createDataFrame([(k, "ab"[k % 2], k) for k in range(40)], ROWS), newest)
    assert t.commit() == 1
    return s


def rows(df):
    return sorted(tuple(r) for r in df.select("k", "region", "v").collect())


def test_a_batch_counts_once(spark, store):
    before = rows(store.read("t"))
    assert store.begin("w", 0) is None and store.begin("other", 0) is not None
    t = store.begin("w", 1)
    t.upsert("t", spark.createDataFrame([(1, "b", 100), (77, None, 7)], ROWS), newest)
    assert rows(store.read("t")) == before  # nothing shows before the commit
    assert t.commit() == 2 and store.begin("w", 1) is None
    assert rows(store.read("t")) == sorted([r for r in before if r[0] != 1] + [(1, "b", 100)] + [(77, None, 7)], key=lambda r: (r[0], r[1] or "", r[2]))
    assert rows(store.read("t", version=1)) == before  # readers of a version keep it
    assert rows(store.read("t", region="a")) == [(k, "a", k) for k in range(0, 40, 2)] and [r[0] for r in rows(store.read("t").filter("region is null"))] == [77]


def test_untouched_parts_keep_their_files(spark, store):
    before = store.manifest()["tables"]["t"]["parts"]
    t = store.begin("w", 1)
    touched = t.upsert("t", spark.createDataFrame([(1, "b", 100)], ROWS), newest)
    t.commit()
    after = store.manifest()["tables"]["t"]["parts"]
    assert len(touched) == 1 and {int(p) for p in before if before[p] != after[p]} == touched and before.keys() == after.keys()
    assert len([f for f in store.read("t", region="b").inputFiles()]) < len(store.read("t").inputFiles())


def test_two_writers_and_one_that_dies(spark, store):
    one, two, dead = store.begin("a", 0), store.begin("b", 0), store.begin("c", 0)
    for t, v in ((one, 1), (two, 2), (dead, 3)):
        t.upsert("t", spark.createDataFrame([(5, "b", 1000 + v)], ROWS), newest)
    assert two.commit() == 2
    with pytest.raises(Conflict):
        one.commit()
    assert store.version() == 2 and (5, "b", 1002) in rows(store.read("t")) and not [n for n in store.files.names(f"{store.root}/versions") if n.startswith(".") and not n.endswith(".crc")]
    again = store.begin("a", 0)
    again.append("t", spark.createDataFrame([(5, "b", 1)], ROWS))
    again.replace("t", spark.createDataFrame([], ROWS))
    assert again.commit() == 3 and rows(store.read("t")) == []


def test_partitions_are_columns_of_the_key(spark, store):
    with pytest.raises(ValueError, match="key"):
        store.begin().create("x", spark.createDataFrame([], ROWS).schema, ("k",), ("region",))


def now():
    return F.lit("2020-01-01").cast("timestamp_ntz")


def item(k, title, price=5.0, hint=None, source="s", image=None, ts=1):
    return (source, f"sku{k}", f"r{k % 2}", title, hint, price, 1, image, ts, k)


def as_items(spark, given):
    df = spark.createDataFrame(given, tables.ITEM.replace("ts timestamp_ntz", "ts int"))
    return df.withColumn("ts", (F.lit("2020-01-01").cast("timestamp") + F.make_interval(days=F.col("ts"))).cast("timestamp_ntz"))


def test_regroup_keeps_listings(spark, tmp_path):
    """Titles of one five-pack that were filed apart share a product again; listings and history stay."""
    titles = ["Alpha Basic Car 5-Pack, Red, Set of 5 / 1:64", "ALPHA basic 5 car pack (red, Pack of 5) red", "Alpha basic red 5 Car Pack", "Alpha monster truck dark", "Nobody's car"]
    store = Store(spark, f"{tmp_path}/s")
    t = tables.created(store.begin("seed", 0))
    rows = as_items(spark, [item(k, x, image="first.png" if k == 2 else None) for k, x in enumerate(titles)]).withColumn("canonical_key", F.concat(F.lit("seed-"), "source_sku"))
    ids = tables.sink_products(t, rows.select("canonical_key", F.col("raw_title").alias("title"), F.lit("X").alias("brand"), F.lit("X").alias("series"), F.lit("X").alias("realism"), F.lit(1).alias("pack_size"), F.lit(0).alias("is_set"), "image_url", "ts", F.col("source_sku").alias("place")))
    tables.sink_listings(t, rows.join(ids.withColumnRenamed("id", "product_id"), "canonical_key"))
    t.commit()
    tables.regroup(store, now())
    products, listings = {r["id"]: r for r in store.read("products").collect()}, {r["source_sku"]: r for r in store.read("listings").collect()}
    assert set(listings) == {"sku0", "sku1", "sku2", "sku3"} and store.read("history").count() == 5 and store.read("listings", version=1).count() == 5
    assert len({listings[f"sku{k}"]["product_id"] for k in range(3)}) == 1 and len(products) == 2 and {r["product_id"] for r in listings.values()} == set(products)
    five = products[listings["sku0"]["product_id"]]
    assert (five["brand"], five["series"], five["title"], five["pack_size"], five["is_set"], five["image_url"]) == ("Alpha", None, titles[0], 5, 1, "first.png") and min(products) > 5
    version = store.version()
    tables.regroup(store, now())
    assert {r["id"] for r in store.read("products").collect()} == set(products) and store.version() == version + 1


def one_by_one(facts, products, threshold=87.0, clear=False):
    """Items with their facts, longest title first, into products by key; each item's key."""
    known, keys, top = {} if clear else {k: p["sig"] for k, p in products.items()}, {}, max([p["id"] for p in products.values()], default=0)
    if clear:
        for p in products.values():
            p |= {"brand": None, "series": None, "realism": None}
    order, fresh = sorted(facts, key=lambda f: (-len(f["raw_title"]), f["source"], f["source_sku"])), []
    # leaders are taken by the longest title of a signature, so that equal signatures come together
    longest = {}
    for f in facts:
        block = f["brand"], f["pack_size"], f["numbers"], f["sig"]
        longest[block] = max(longest.get(block, 0), len(f["raw_title"]))
    lead = {}
    for (brand, size, numbers, sig), _ in sorted(longest.items(), key=lambda x: (-x[1], x[0][3])):
        best, at = threshold, None
        old = sorted((s, k) for k, s in known.items() if k not in fresh)
        for s, k in [*old, *[(known[k], k) for k in fresh]]:
            if k.startswith(f"{brand}|") and k.endswith(f"|p{size}") and " ".join(w for w in s.split() if w.isdigit()) == numbers:
                score = resolve.similarity(sig, s)
                if score > best or (at is None and score >= threshold):
                    best, at = score, k
        if at is None:
            at = f"{brand}|{sig}|p{size}"
            known[at] = sig
            fresh.append(at)
        lead[brand, size, numbers, sig] = at
    new = sorted({k for k in lead.values() if k not in products})
    for f in order:
        key = keys[f["source_sku"]] = lead[f["brand"], f["pack_size"], f["numbers"], f["sig"]]
        p = products.setdefault(key, {"id": top + 1 + new.index(key) if key in new else None, "title": f["raw_title"], "brand": None, "series": None, "realism": None, "image_url": None, "pack_size": f["pack_size"], "sig": key.split("|")[1]})
        p["title"] = f["raw_title"] if len(f["raw_title"]) > len(p["title"]) else p["title"]
        for c, v in (("brand", f["named"]), ("series", f["series"]), ("realism", f["realism"]), ("image_url", f["image_url"])):
            p[c] = v if p[c] is None else p[c]
    return keys


def test_batches_and_regroup_against_one_by_one(spark, tmp_path):
    rng = random.Random(8)
    words = ["red", "redd", "roadster", "roadsters", "gear", "promo", "blue", "7", "12", "lorry", "economy"]
    given = []
    for k in range(90):
        title = " ".join([rng.choice(["Alpha", "Bravo", "Delta 1:64", "Nobody", "Delta"]), *rng.sample(words, rng.randrange(1, 6)), rng.choice(["", "pack of 5", "3 pcs"])])
        given.append(item(k, title.strip(), hint=rng.choice([None, "Alpha shop"]), image=rng.choice([None, f"i{k}"])))
    rows = as_items(spark, given)
    t, hint = F.col("raw_title"), F.col("brand_hint")
    facts = [r.asDict() for r in tables.classified(resolve.keyed(rows, t, hint=hint), text.RulePack()).withColumn("wanted", text.wanted(t, hint=hint)).collect()]
    store, model, keys = Store(spark, f"{tmp_path}/s"), {}, {}
    for batch in (0, 1):
        part = rows.filter(F.col("seq") % 2 == batch)
        tables.store_items(store, part, "items", batch, buckets=3)
        tables.store_items(store, part, "items", batch, buckets=3)
        keys |= one_by_one([f for f in facts if f["wanted"] and f["seq"] % 2 == batch], model)
    seen = lambda: ({r["canonical_key"]: tuple(r[c] for c in ("id", "title", "brand", "series", "realism", "image_url", "pack_size")) for r in store.read("products").collect()})
    want = lambda: {k: tuple(p[c] for c in ("id", "title", "brand", "series", "realism", "image_url", "pack_size")) for k, p in model.items()}
    linked = lambda: {r["source_sku"]: r["canonical_key"] for r in store.read("listings").join(store.read("products").withColumnRenamed("id", "product_id"), "product_id").collect()}
    assert store.version() == 2 and seen() == want() and linked() == keys and len(model) < len(keys) < 90
    tables.regroup(store, now())
    keys = one_by_one([f for f in facts if f["wanted"]], model, clear=True)
    model = {k: p for k, p in model.items() if k in set(keys.values())}
    assert seen() == want() and linked() == keys and store.read("history").count() == len(keys)


def _planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_merge_shuffles_its_rows_once(spark, tmp_path):
    """The order of sightings, the merge and the writing go by one shuffle, by part; rows of a part that the table lacks are refused."""
    from offerlens.tables import offers
    from offerlens.tables.store import Store

    t = offers.created(Store(spark, str(tmp_path)).begin("w", 0))
    rows = spark.createDataFrame([("s", "1", "R", "t", None, 1.0, 1, None, None, 1, 5)], offers.ITEM + ", product_id long")
    items = t.placed("listings", rows)
    old = t.placed("listings", spark.createDataFrame([], offers.LISTINGS), rows.limit(0))
    assert _planned(offers.merged_listings(old, items)).count("Exchange hashpartitioning") == 1
    other = rows.withColumn("region", F.lit("elsewhere"))
    assert [r["_part"] for r in t.placed("listings", other, rows.limit(0)).collect()] == [-1]


def test_product_numbers_are_not_sent_through_the_driver(spark, tmp_path):
    from offerlens.tables import offers
    from offerlens.tables.store import Store

    store = Store(spark, str(tmp_path))
    t = offers.created(store.begin("w", 0))
    row = spark.createDataFrame([("k", "t", "0")], "canonical_key string, title string, place string").withColumn("ts", F.lit("2000-01-01").cast("timestamp_ntz"))
    offers.sink_products(t, row)
    t.commit()
    keys = spark.createDataFrame([("k",), ("l",)], "canonical_key string")
    told = offers.numbered(offers.created(store.begin("w", 1)), keys)
    assert _planned(told).count("BroadcastHashJoin") <= 1  # the table of tasks' first numbers, a row a task
    assert sorted(tuple(r) for r in told.collect()) == [("k", 1), ("l", 2)]

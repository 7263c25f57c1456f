"""Objects in JSON of any shape: the recursive query against a plain walk."""

import json
import random

from pyspark.sql import functions as F

from offerlens.sources import payloads


def made(rng, depth):
    kind = rng.randrange(6 if depth < 18 else 3)
    if kind < 2:
        return rng.choice([None, True, 5, "text", "é \" \\", ""])
    if kind == 2:
        return [] if rng.randrange(2) else {}
    if kind == 3:
        return [made(rng, depth + 1) for _ in range(rng.randrange(1, 4))]
    return {rng.choice(["a", "b", "name", "x y", "0", "é"]): made(rng, depth + 1) for _ in range(rng.randrange(1, 4))}


def test_walk_against_plain_python(spark):
    rng = random.Random(2)
    deep = {"end": 1}
    for k in range(20):
        deep = {f"k{k}": deep} if k % 2 else [deep]
    bodies = [json.dumps(made(rng, 0)) for _ in range(150)] + [None, "", "{", "3", "[]", "{}", json.dumps(deep), json.dumps(deep)[:-1]]
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, body string").withColumn("e", F.lit("x")).withColumn("value", F.lit(1)).repartition(3)
    got = sorted((r["id"], r["path"], r["depth"], r["keys"], json.dumps(json.loads(r["object"]), sort_keys=True)) for r in payloads.walked(df, "body").collect())
    plain = df.select("id", "body").lateralJoin(payloads.WalkJson(F.col("body").outer())).select("id", "path", "depth", "keys", df["body"].alias("text"), "*")
    want = sorted((r[0], r[1], r[2], sorted(r[3]), json.dumps(json.loads(r[-1]), sort_keys=True)) for r in plain.collect())
    assert got == want and max(r[2] for r in got) == payloads.DEPTH and len(got) > 150
    assert payloads.walked(df.limit(0), "body").collect() == []


def test_the_last_of_a_repeated_key_counts(spark):
    df = spark.createDataFrame([(1, '{"a":{"x":1},"a":{"y":{}}}')], "id int, body string")
    assert [(r["path"], r["keys"]) for r in payloads.walked(df, "body").orderBy("depth").collect()] == [("$", ["a"]), ("$.a", ["y"]), ("$.a.y", [])]

"""Names of many spellings against one regular expression a name."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from offerlens.functions import text
from offerlens.functions import names as table_of_names
from offerlens.functions.names import Matcher, Name, brand, found, joined, listed, wanted


def pattern(n):
    one = "|".join(r"\s*".join(re.escape(w) for w in s.split()) for s in sorted(n.all(), key=len, reverse=True))
    return re.compile(one if n.inside else rf"(?<![A-Za-z0-9_])(?:{one})(?![A-Za-z0-9_])", re.IGNORECASE)


def test_matches_are_those_of_expressions():
    rng = random.Random(4)
    names = [Name("Two Words", ("two words", "two word")), Name("Ab", ("ab",)), Name("Abc", ("ab c", "abc")), Name("In", ("inn",), inside=True), Name("X1", ("x 1", "ex one")), Name("A b", ("a b a b",))]
    m, parts = Matcher(names), ["two", "words", "word", "ab", "c", "inn", "x", "1", "a", "b", "-", "_", "é", "TWO", "Ab", "ex", "one"]
    for _ in range(6000):
        title = "".join(rng.choice(parts) + rng.choice(["", " ", "  ", "\t"]) for _ in range(rng.randrange(9)))
        want = sorted((x.start(), k) for k, n in enumerate(names) if (x := pattern(n).search(title)))
        assert m.find(title) == want, title


TABLE = (Name("Alpha", ("alpha", "al pha", "alfa"), native=True), Name("Bravo", ("bravo",)), Name("Match", ("match",), native=True, common=True), Name("Zed", ("z e d",), inside=True))


@pytest.mark.parametrize(
    ("title", "hint", "names", "named", "fits"),
    [("Red ALFA roadster", None, ["Alpha"], "Alpha", True), ("Bravo car 1:64", None, ["Bravo"], "Bravo", True), ("Bravo car", None, ["Bravo"], "Bravo", False), ("big match of safety", None, ["Match"], None, False), ("match car", None, ["Match"], "Match", True),
     ("bravo al  pha", None, ["Alpha", "Bravo"], "Bravo", False), ("alfa bravo match car", None, ["Alpha", "Bravo", "Match"], None, False), ("x" * 36 + " alpha", None, ["Alpha"], None, False), ("plain", "the Alfa and Bravo shop", [], "Alpha", True), ("plain", "nobody", [], None, False),
     ("replica alpha", "Alpha", ["Alpha"], None, False), ("razed", None, ["Zed"], "Zed", False), (None, "Bravo", [], "Bravo", False), ("", None, [], None, False)],
)
def test_brands_of_a_table(spark, title, hint, names, named, fits):
    t, h = F.col("t"), F.col("h")
    df = spark.createDataFrame([(title, hint)], "t string, h string")
    r = df.select(listed(t, TABLE).alias("l"), brand(t, TABLE, hint=h).alias("b"), wanted(t, TABLE, hint=h).alias("w"), found(t, TABLE).alias("f")).first()
    assert (r["l"], r["b"], r["w"] or False) == (names, named, fits) and [x["at"] for x in r["f"]] == sorted(x["at"] for x in r["f"])


def test_ten_thousand_names_cost_no_more(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    few, many = [Name(word()) for _ in range(20)], [Name(f"{word()} {word()}") for _ in range(10_000)]
    titles = [" ".join(word() for _ in range(8)) for _ in range(4000)]

    def took(names):
        m, best = Matcher(names), 9.0
        for _ in range(3):
            began = time.perf_counter()
            for t in titles:
                m.find(t)
            best = min(best, time.perf_counter() - began)
        return best

    assert took(many) < 3 * took(few)


def test_tables_are_checked():
    with pytest.raises(ValueError, match="spellings"):
        Matcher([Name(f"n{k}") for k in range(100_001)])
    with pytest.raises(ValueError, match="letter"):
        Matcher([Name("x", (" ",))])
    assert Matcher([]).find("x") == [] and text.RulePack().brands


def test_a_join_finds_what_the_automaton_finds(spark):
    rng = random.Random(6)
    names = [*TABLE, Name("Two Words", ("two words", "two word")), Name("Ab", ("ab",)), Name("Abc", ("ab c", "abc")), Name("In", ("inn",), inside=True), Name("A b", ("a b a b",)), Name("again", ("ab",))]
    parts = ["two", "words", "word", "ab", "c", "inn", "zed", "alfa", "a", "b", "-", "_", "é", "TWO", "Ab", "match", "#"]
    titles = [(k, "".join(rng.choice(parts) + rng.choice(["", " ", "  ", "\t"]) for _ in range(rng.randrange(9)))) for k in range(400)] + [(400, None), (401, ""), (400, "ab ab")]
    rows = spark.createDataFrame(titles, "k int, t string")
    table = spark.createDataFrame([(k, n.name, s, n.inside) for k, n in enumerate(names) for s in n.all()], "place long, name string, spelling string, inside boolean")
    told = lambda df: sorted((r["k"], r["t"] or "", [tuple(x) for x in r["found"]]) for r in df.collect())
    assert told(joined(rows, "t", table)) == told(rows.withColumn("found", found(F.col("t"), names)))


def test_more_suppliers_than_a_sent_table_holds(spark, tmp_path, monkeypatch):
    """The query takes a table of suppliers of any size: the limit of tables that go to all tasks is none of its own."""
    from offerlens.plans import source_queries

    monkeypatch.setattr(table_of_names, "MOST", 10)
    spark.createDataFrame([(k, f"Supplier#{k:09d}") for k in range(1, 41)], "s_suppkey long, s_name string").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame([(k, f"thing {k}") for k in range(100)], "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    got = {r["id"]: (r["brand"], r["named"]) for r in source_queries.s_brand_table(spark, str(tmp_path)).collect()}
    first, second = lambda k: k % 40 + 1, lambda k: k * 7 % 40 + 1
    for k in range(100):
        both = sorted({first(k), second(k)} if k % 4 == 0 else {first(k)})
        assert got[k] == (f"Supplier#{first(k):09d}", ",".join(f"Supplier#{x:09d}" for x in both))

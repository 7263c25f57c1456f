"""URL filter: explicit rules, and for the rest a tree of path templates judged by labelled purity. DataFrame functions only.

Per host, urls are a tree of path segments. Segments are first reduced to their shape (runs of digits become #), so that a table
of distinct (host, shape) with counts stands for all urls. Going down level by level, a segment that too few urls of its parent
share becomes the wildcard *; among the segments that stay, those whose labelled share cannot be told from the pool of their
siblings (a two-proportion z test) are merged into +. Below a node of fewer than `support` urls all segments are *, so the tree goes
as deep as that many urls agree, and no further.

Purity is the share of rejected labels, smoothed towards the node above: (rejected + prior * purity above) / (labelled + prior); above
a host stands the share over all hosts. A template at the threshold or over it is rejected if it has `evidence` labels of its own:
what stands above it smooths its purity, but is no ground to reject it, as where rules only ever block, the only labels are bad ones.

Tables are joined by node; the few nodes that hold more than an even share of the rows are salted (`common.spread_join`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: (verdict, host, path) of the query's rules.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

#: Labels that a template must have itself to be rejected.
EVIDENCE = 5


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls; rules are a small parameter, so this is one expression."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def _purity(above, prior: float) -> Column:
    return (F.col("rejected") + prior * above) / (F.col("labelled") + prior)


SUMS = ("n", "rejected", "labelled")


def path_templates(shapes: DataFrame, share: float = 0.02, support: int = 5, z: float = 2.0, prior: float = 2.0) -> DataFrame:
    """(host, shape, n, rejected, labelled, template, above) for shapes (host, shape, n, rejected, labelled); above: the purity of the node over the template."""
    total, rejected, labelled = shapes.agg(F.count(F.lit(1)), F.sum("rejected"), F.sum("labelled")).first()  # three numbers
    prior_ = F.lit(((rejected or 0) + 1) / ((labelled or 0) + 2))
    sums = lambda: [F.sum(c).alias(c) for c in SUMS]
    hosts = shapes.groupBy("host").agg(*sums(), F.count(F.lit(1)).alias("m"))
    hosts = hosts.select("host", "m", F.col("n").alias("node_n"), _purity(prior_, prior).alias("node_p"), prior_.alias("above"))
    segs = F.filter(F.split("shape", "/"), lambda s: s != "")
    tree = shapes.withColumn("segs", segs).withColumn("template", F.lit(""))
    tree = common.stored(common.spread_join(tree, hosts, ["host"], "m", total))
    ended, k = [], 0
    while True:
        deeper = (F.size("segs") > k) & (F.col("node_n") >= support)
        rest = F.size("segs") - k
        done = tree.filter(~deeper)
        done = done.withColumn("template", F.concat("template", F.repeat(F.lit("/*"), rest))).withColumn("above", F.when(rest > 0, F.col("node_p")).otherwise(F.col("above")))
        ended.append(done.select("host", "shape", *SUMS, "template", "above"))
        tree = tree.filter(deeper).withColumn("seg", F.get("segs", F.lit(k)))
        if tree.isEmpty():
            out = ended[0]
            for e in ended[1:]:
                out = out.unionByName(e)
            return out
        nodes = tree.groupBy("host", "template", "seg").agg(*sums(), F.count(F.lit(1)).alias("m"), F.max("node_n").alias("node_n"), F.max("node_p").alias("node_p"))
        nodes = common.stored(nodes.withColumn("stays", F.col("n") >= F.greatest(F.lit(support), share * F.col("node_n"))))
        # siblings that stay are at most 1 / share
        siblings = Window.partitionBy("host", "template")
        stay = nodes.filter("stays").withColumn("p", (F.col("rejected") + 1) / (F.col("labelled") + 2))
        stay = stay.withColumn("pool", F.sum("labelled").over(siblings) + 2).withColumn("q", (F.sum("rejected").over(siblings) + 1) / F.col("pool"))
        apart = F.sqrt(F.col("q") * (1 - F.col("q")) * (1 / (F.col("labelled") + 2) + 1 / F.col("pool")))
        alike = (F.count(F.lit(1)).over(siblings) > 1) & (F.col("labelled") > 0) & (F.abs(F.col("p") - F.col("q")) <= z * apart)
        named = stay.withColumn("name", F.when(alike, F.lit("+")).otherwise(F.col("seg"))).select(*nodes.columns, "name")
        named = named.unionByName(nodes.filter("not stays").withColumn("name", F.lit("*")))
        named = common.stored(named.withColumn("into", F.concat("template", F.lit("/"), "name")))
        merged = named.groupBy("host", "into").agg(*sums(), F.count(F.lit(1)).alias("k"), F.max("node_p").alias("over"))
        merged = merged.select("host", "into", "k", F.col("n").alias("new_n"), _purity(F.col("over"), prior).alias("new_p"), "over")
        named = common.spread_join(named.select("host", "template", "seg", "m", "into"), merged, ["host", "into"], "k", total)
        tree = common.spread_join(tree.drop("node_n", "node_p", "above"), named, ["host", "template", "seg"], "m", total)
        tree = tree.select("host", "shape", *SUMS, "segs", F.col("into").alias("template"), F.col("new_n").alias("node_n"), F.col("new_p").alias("node_p"), F.col("over").alias("above"))
        tree, k = common.stored(tree), k + 1


def judge_urls(pages: DataFrame, url: str = "url", rules=RULES, label: Column | None = None, threshold: float = 0.9, prior: float = 2.0, evidence: int = EVIDENCE, **tree) -> DataFrame:
    """pages(page_id, url) as (page_id, host, path, rule, template, purity, labelled, verdict); a row for each row.

    label: 1 for urls known to be bad, 0 for good, null else; the verdict of the rules by default. A null url, or one without
    '://', has an empty host and path and forms a template with its like. Paths of any length and depth are read whole. Rows that
    repeat a page_id or url are judged alike, each as a row; other columns of pages are not read, whatever their names. An empty
    table gives no rows."""
    host, path = host_of(F.col(url)), path_of(F.col(url))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), *([] if label is None else [label.alias("label")]))
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", name).withColumn("ruled", verdict)
    if label is None:
        rows = rows.withColumn("label", (F.col("ruled") == "block").cast("int"))
    rows = rows.withColumn("shape", F.regexp_replace("path", r"[0-9]+", "#"))
    shapes = rows.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("rejected"), F.count("label").alias("labelled"))
    shapes = common.stored(path_templates(common.stored(shapes), prior=prior, **tree))
    verdicts = shapes.groupBy("host", "template").agg(*[F.sum(c).alias(c) for c in SUMS[1:]], F.min("above").alias("above"), F.count(F.lit(1)).alias("m"))
    verdicts = verdicts.select("host", "template", "m", "labelled", _purity(F.col("above"), prior).alias("purity"))
    total = shapes.agg(F.count(F.lit(1)), F.sum("n")).first()  # two numbers
    known = common.spread_join(shapes.select("host", "shape", "n", "template"), verdicts, ["host", "template"], "m", total[0])
    by_tree = F.when((F.col("purity") >= threshold) & (F.col("labelled") >= evidence), "block").otherwise("allow")
    rows = common.spread_join(rows, known.select("host", "shape", "n", "template", "purity", "labelled"), ["host", "shape"], "n", total[1] or 0, by=["page_id", "path"])
    return rows.select("page_id", "host", "path", "rule", "template", "purity", "labelled", F.coalesce("ruled", by_tree).alias("verdict"))


def held_out(pages: DataFrame, fifth: int = 0, url: str = "url", rules=RULES, **how) -> DataFrame:
    """(bad, verdict, n): how the tree judges urls whose labels it was not shown, those of one fifth of all urls by their hash. Labels are the rules'."""
    _, ruled = rule_for(host_of(F.col(url)), path_of(F.col(url)), rules)
    labelled = pages.select("page_id", url, (ruled == "block").cast("int").alias("bad"), (F.pmod(F.xxhash64(url), F.lit(5)) == fifth).alias("hidden"))
    judged = judge_urls(labelled, url, (), F.when(~F.col("hidden"), F.col("bad")), **how).select(F.col("page_id").alias("_id"), "verdict")
    same = labelled.filter("hidden and bad is not null").join(judged, F.col("page_id") == F.col("_id"))
    return same.groupBy("bad", "verdict").agg(F.count(F.lit(1)).alias("n"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(common.table(spark, sf_dir, "pages"))

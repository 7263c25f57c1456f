import corpus_pipeline
from pyspark.sql import functions as F

from offerlens.llm import exact_dedup, language, mixing, near_dedup

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if name == "exact_dedup":
            assert docs.select("text").distinct().count() == docs.count()
        if name == "near_dedup":
            assert near_dedup.near_groups(docs).filter("not kept").count() == 0
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.filter("piece = 0").count() == docs.count()


def test_stages_over_tasks_of_many_batches(spark, tmp_path):
    """Larger tables have tasks of more than one Arrow batch: what the stages keep does not depend on where batches end."""
    kept = {}
    for rows in ("10000", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        try:
            docs = spark.read.parquet(f"{SF}/documents.parquet")
            for name, stage in corpus_pipeline.STAGES:
                stage(spark, docs, SF).write.parquet(str(tmp_path / rows / name))
                docs = spark.read.parquet(str(tmp_path / rows / name))
                columns = ["doc_id", "piece", "start", "length", "ids_crc32"] if name == "packing" else docs.columns
                kept.setdefault(name, []).append(sorted(map(str, docs.select(columns).collect())))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(usual == small and usual for usual, small in kept.values())


def test_language_stage_keeps_texts_with_letters(spark):
    rows = [(1, "some plain words", "en", "s", 16), (2, "1234", None, "s", 4), (3, None, None, "s", 0), (4, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, SF).collect()] == [1]
    assert language.UNKNOWN == "und"


def test_language_stage_keeps_clean_texts_where_no_language_is_stated(spark):
    rows = [(1, "some plain words", None), (2, "1234", None), (3, None, None), (4, "", None), (5, "\u00e9t\u00e9", None)]
    for more in ([], [(6, None, "en")]):
        docs = spark.createDataFrame(rows + more, "doc_id long, text string, lang string")
        assert sorted(r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, SF).collect()) == [1, 5]


def test_stages_tell_rows_of_one_id_apart(spark):
    """Null and repeated ids, repeated rows and columns named like those inside: no other text goes with a copy."""
    long = [" ".join(f"word{(k * 7 + j) % 97}x{k}" for j in range(60)) for k in range(4)]
    rows = [(None, long[0]), (None, long[1]), (9, long[0]), (5, long[2]), (5, long[3]), (8, long[3]), (4, long[2] + " more"), (4, long[1] + " tail"), (7, None), (7, "")]
    docs = spark.createDataFrame([(*r, "en", "s" if k % 2 else None, 0, "c") for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, copies string")
    docs = docs.withColumn("language", F.lit("l")).withColumn("gone", F.lit("g")).withColumn("mixed", F.lit("m")).withColumn("copy", F.lit("k"))
    named = corpus_pipeline.identify_language(spark, docs, SF)
    assert named.columns == docs.columns and named.count() == 8
    exact = corpus_pipeline.drop_exact(spark, docs, SF)
    left = lambda df: sorted(((r["doc_id"] or 0, r["text"] or "") for r in df.collect()))
    assert exact.columns == docs.columns
    assert left(exact) == sorted([(0, long[1]), (9, long[0]), (5, long[2]), (8, long[3]), (4, long[2] + " more"), (4, long[1] + " tail"), (7, "")])
    near = corpus_pipeline.drop_near(spark, exact, SF)
    assert near.columns == docs.columns
    assert left(near) == sorted([(9, long[0]), (8, long[3]), (4, long[2] + " more"), (4, long[1] + " tail"), (7, "")])
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    assert mixed.columns == docs.columns
    want = {}
    for r in mixing.mix(docs).collect():
        want[r["doc_id"], r["size"]] = want.get((r["doc_id"], r["size"]), 0) + r["copies"]
    got = {}
    for r in mixed.select("doc_id", mixing.word_count(F.col("text")).alias("size")).collect():
        got[r["doc_id"], r["size"]] = got.get((r["doc_id"], r["size"]), 0) + 1
    assert got == {k: v for k, v in want.items() if v}
    assert exact_dedup.exact_groups(docs, F.col("text")).count() == len(rows)


def test_rows_that_repeat_id_and_text_stay_once(spark):
    text = " ".join(f"word{k}" for k in range(60))
    rows = [(1, text)] * 3 + [(2, text + " end")] + [(None, "alone")] * 2 + [(3, None)] * 2 + [(4, "other words")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("digest", F.lit("d")).withColumn("after", F.lit(9)).repartition(4)
    left = lambda df: sorted(((r["doc_id"] or 0, r["text"] or "") for r in df.collect()))
    assert left(corpus_pipeline.drop_exact(spark, docs, SF)) == sorted([(1, text), (2, text + " end"), (0, "alone"), (3, ""), (4, "other words")])
    assert left(corpus_pipeline.drop_near(spark, docs, SF)) == sorted([(1, text), (0, "alone"), (3, ""), (4, "other words")])


def test_language_stage_states_what_it_finds(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = docs.withColumn("stated", F.col("lang")).withColumn("lang", F.when(F.col("doc_id") % 4 > 0, F.col("lang")))
    kept = corpus_pipeline.identify_language(spark, some, SF)
    assert kept.columns == some.columns and kept.filter("lang is null").count() == 0
    found = kept.filter("doc_id % 4 = 0 and stated is not null").select((F.col("lang") == F.col("stated")).cast("int").alias("same")).agg(F.avg("same")).first()[0]
    assert found > 0.95
    assert corpus_pipeline.identify_language(spark, some, SF, least=2.0).count() == 0


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0

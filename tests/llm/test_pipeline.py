"""The stages on the small tables: columns, what each decides, and the whole run."""

import duckdb
from pyspark.sql import functions as F

from tessera.llm import decontamination, queries, set_join


def test_chat_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, sf)
        found = con.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(tuple(r[n] for n in names) for r in df.collect()) == sorted(found.fetchall())


def test_stages(spark, sf):
    import corpus_pipeline
    from tessera.llm.common import Scratch

    scratch, docs = Scratch(spark), spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = scratch.write(stage(spark, before, sf), name)
        if name != "packing":
            assert after.columns == columns
            assert after.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
        if name == "line_dedup":
            assert after.filter("n_chars <> length(text)").count() == 0
        if name == "ngram_jaccard_join":
            assert set_join.components_by_jaccard(after).filter("doc_id <> component_id").count() == 0
        if name == "benchmark_decontamination":
            assert decontamination.overlaps(after, spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0
            packed_of = after
        before = after
    assert before.select("doc_id").distinct().count() == packed_of.count()
    assert before.groupBy("doc_id").agg(F.sum("length").alias("s"), F.max("doc_tokens").alias("t")).filter("s <> t").count() == 0


def test_one_document_of_each_group_of_near_copies_stays(spark):
    import corpus_pipeline

    text = lambda c: " ".join(f"{c}{k}" for k in range(60))
    rows = [(7, text("a"), "x"), (7, text("b"), "x"), (7, text("a") + " end", "x"), (8, text("b") + " end", "x"), (None, text("c"), "x"), (None, text("c") + " end", "x")]
    rows += [(None, text("d"), "x"), (9, text("d"), "y"), (9, text("d"), "z"), (None, text("e"), "x"), (None, "", "x"), (5, None, "x"), (5, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    found = sorted((str(r["doc_id"]), (r["text"] or "-")[:1], r["source"]) for r in kept.collect())
    assert found == sorted([("7", "a", "x"), ("7", "b", "x"), ("None", "c", "x"), ("9", "d", "y"), ("None", "e", "x"), ("None", "-", "x"), ("5", "-", "x")])

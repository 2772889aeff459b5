import corpus_pipeline
from pyspark.sql import functions as F

from stallwise.llm import packing, quality, simhash, toxicity
from stallwise.llm.common import saved
from stallwise.llm.queries import QUERIES
from tests.llm.helpers import DOCS, LABELS, awkward, docs, words

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, docs, SF)
        if at < 4:
            assert after.columns == docs.columns and after.schema == docs.schema
            after = after.cache()
            kept[name] = {r["doc_id"] for r in after.select("doc_id").collect()}
        docs = after
    toxic, good, single, mixed = kept.values()
    labels, table = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/documents.parquet")
    assert toxic == {r["doc_id"] for r in toxicity.report(table, labels).filter("predicted = 0").collect()}
    left = table.filter(F.col("doc_id").isin(list(toxic)))
    assert good == {r["doc_id"] for r in quality.report(left, labels).filter("kept").collect()}
    left = left.filter(F.col("doc_id").isin(list(good)))
    assert single == {r["doc_id"] for r in simhash.report(left).filter("doc_id = component_id").collect()}
    assert mixed <= single and {r["doc_id"] for r in docs.collect()} == mixed


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    full = rows.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert full and all(r["n"] == r["end"] <= packing.CAPACITY for r in full)


def test_one_query_an_operator():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{n}" for n in range(1, 14)] + ["pipeline"]


def stored(spark, path, rows, labels):
    rows.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_awkward_rows_pass_every_stage(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows and further columns with names of the stages' own."""
    plain = [" ".join(words(60, seed, 3, 9)) for seed in range(40)]
    given = awkward(spark).unionByName(docs(spark, *plain, extra=[(5, plain[5], "en", "a", 1)] * 3))
    given = given.withColumns({"rank": F.lit(1), "_label": F.lit("x"), "copies": F.lit(None).cast("int"), "row": F.col("n_chars")})
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(8, 30)] + [(None, 1, 1), (9, None, None), (9, 1, 0)], LABELS)
    sf, rows = stored(spark, tmp_path, given, labels), given
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, rows, sf)
        if at < 4:
            assert after.schema.names == given.schema.names
            rows = saved(after, "awkward-stage")
    pieces = after.collect()
    assert {r["doc_id"] for r in pieces} <= {r["doc_id"] for r in given.select("doc_id").collect()}
    assert corpus_pipeline.run(spark, sf).count() == len(pieces)


def test_empty_tables_pass_every_stage(spark, tmp_path):
    sf = stored(spark, tmp_path, spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS))
    rows = corpus_pipeline.run(spark, sf)
    assert rows.collect() == [] and rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_a_table_without_labels_keeps_what_the_base_rules_keep(spark, tmp_path):
    texts = [" ".join(words(60, seed, 3, 9)) for seed in range(6)] + ["too short"]
    sf = stored(spark, tmp_path, docs(spark, *texts), spark.createDataFrame([], LABELS))
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, corpus_pipeline.keep_good(spark, corpus_pipeline.drop_toxic(
        spark, spark.read.parquet(f"{sf}/documents.parquet"), sf), sf), sf).collect()}
    assert 6 not in kept

import corpus_pipeline
from tests.llm.common import DOCS, documents, words


def test_stages_in_order_return_the_columns_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, rows = [], docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        names.append(name)
        if name != "packing":
            assert out.columns == docs.columns
            assert out.count() > 0.5 * rows
            docs = out
        else:
            assert out.count() > 0 and out.columns == ["doc_id", "piece", "first_char", "n_chars", "bin_id"]
    assert names == ["quality", "line dedup", "near duplicates", "mixing", "packing"]


def test_run_is_the_stages_one_after_another(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    a, b = (sorted((x.doc_id, x.piece, x.n_chars) for x in d.collect()) for d in (docs, corpus_pipeline.run(spark, sf_dir)))
    assert a == b and a


def test_stages_take_odd_rows_and_empty_tables(spark, sf_dir):
    text = "\n".join(" ".join(words(k, 12)) for k in range(20))
    rows = [(1, text), (2, text), (2, text), (None, text), (3, None), (4, ""), (5, " "), (6, " ".join(words(99, 30_000)), None)]
    for docs in (documents(spark, rows), spark.createDataFrame([], DOCS)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs.withColumn("keep", docs["doc_id"]).withColumn("copies", docs["text"]), sf_dir)
            assert name == "packing" or out.columns == docs.columns
            out.collect()


def test_clean_documents_stay(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept = corpus_pipeline.quality_stage(spark, docs, "/root/testdata/sf0.01").select("doc_id")
    clean = labels.where("quality = 1").select("doc_id")
    assert clean.join(kept, "doc_id", "left_anti").count() <= 0.01 * clean.count()

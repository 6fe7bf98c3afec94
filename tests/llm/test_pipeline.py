import corpus_pipeline
from pagewright.llm import simhash


def test_stages_keep_columns_and_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf_dir).cache()
        if name == "simhash near-dedup":
            groups = {r["component_id"] for r in simhash.near_duplicates(before).collect()}
            assert {r["doc_id"] for r in docs.collect()} == groups and docs.count() == len(groups)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns and docs.count() > 0
    assert docs.columns[:2] == ["doc_id", "n_tokens"]


def test_odd_rows(spark, sf_dir, odd_docs, empty_docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd_docs, sf_dir)
        assert out.columns == odd_docs.columns, name
        out.count()
        assert stage(spark, empty_docs, sf_dir).count() == 0, name
    kept = corpus_pipeline.near_duplicates_out(spark, odd_docs, sf_dir).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["0", "3", "5", "6", "7", "8", "None"]


def test_one_row_of_each_component_stays(spark, sf_dir):
    a, b, c = ("one two three four five six seven eight", "another text that has nothing of the first one in it", "and a third one about quite other matters than those")
    near = a.upper()  # another text of the same fingerprint
    rows = [(1, a), (None, a), (None, near), (5, b), (5, b), (5, a), (7, near), (4, c), (5, c), (None, "none has this one"), (None, "NONE has this one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r["doc_id"], r["text"].lower()) for r in corpus_pipeline.near_duplicates_out(spark, docs, sf_dir).collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (5, b), (4, c), (None, "none has this one")], key=str)


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0 and corpus_pipeline.ORACLE_SQL is None

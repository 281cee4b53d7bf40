import corpus_pipeline as C
from pyspark.sql import functions as F
from tests.llm.data import no_documents, odd_documents

from topicpulse.llm import langid, minhash, toxicity

SF = "/root/testdata/sf0.01"


def test_stages_in_order():
    assert [n for n, _ in C.STAGES] == ["language_id", "toxicity", "near_duplicates", "packing"]


def test_each_stage_keeps_what_its_operator_keeps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    extra = spark.createDataFrame([(-1, "12345 678 !!", None, None, None), (-2, None, "en", "s", 0)],
                                  docs.schema)
    docs = docs.unionByName(extra).withColumn("score", F.lit("mine"))
    first = C.language(spark, docs, SF)
    assert first.columns == docs.columns
    judged = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    kept = {r["doc_id"] for r in first.collect()}
    assert kept == {d for d, r in judged.items()
                    if r["lang_pred"] != "und" and r["score_"] >= C.MIN_LANGUAGE_SCORE}
    assert not kept & {-1, -2} and len(kept) > 0.99 * docs.count()
    second = C.toxic(spark, first, SF)
    model = toxicity.learn(first, labels)
    scores = {r["doc_id"]: r["score_"] for r in toxicity.score(first, model).collect()}
    assert {r["doc_id"] for r in second.collect()} == {d for d, s in scores.items() if s < 0.7}
    third = C.near_duplicates(spark, second, SF)
    assert third.columns == docs.columns
    assert {r["doc_id"] for r in third.collect()} == {
        r["doc_id"] for r in minhash.near_duplicates(second).filter("kept").collect()}
    fourth = C.pack(spark, third, SF)
    assert fourth.select("doc_id").distinct().count() == third.count()


def test_empty_table(spark):
    docs = no_documents(spark)
    for _, stage in C.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_odd_rows_stage_by_stage(spark):
    """Nulls, ties, repeated rows and a very long text, given to each stage alone."""
    docs = odd_documents(spark)

    def ids(df):
        return sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=str)

    first = C.language(spark, docs, SF)
    assert first.columns == docs.columns
    assert not {3, 4, 5, 6} & set(ids(first)) and first.filter("text IS NULL").count() == 0
    second = C.toxic(spark, docs, SF)
    assert second.columns == docs.columns
    assert ids(second).count(1) in (0, 2)      # repeated rows are judged alike
    third = C.near_duplicates(spark, docs, SF)
    assert third.columns == docs.columns
    # one row of equal texts stays, and every row without words
    assert ids(third) == sorted([None, 1, 3, 4, 5, 6, 7, 8, 10, 11], key=str)
    fourth = C.pack(spark, docs, SF)
    assert fourth.filter("piece = 0").count() == docs.count()

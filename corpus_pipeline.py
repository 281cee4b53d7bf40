"""The corpus pipeline: stages that each apply one operator of ``topicpulse.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame.  Its rows are
written as Parquet under ``spark.checkpoint.dir`` and read again as the next
stage's ``docs``, so each stage works on all that its predecessor kept and a
lost executor never reaches back past the last written table.  All stages but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicpulse.llm import langid, minhash, packing, toxicity
from topicpulse.llm.common import free_name, materialize
from topicpulse.llm.queries import vocabulary
from topicpulse.sources.tables import read_table

#: A document whose language is this uncertain is rejected: with several
#: languages learned, no one of them then has even a third of its bytes.
MIN_LANGUAGE_SCORE = 1 / 3
#: A document at or above this toxicity is rejected.
MAX_TOXICITY = 0.7
SEQUENCE = 2048


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: texts without a recognisable language go.

    So do null texts and texts without a letter.  Repeated rows are judged
    alike, each on its own; very long texts are read whole; without any
    labelled text every language is unknown; an empty table stays empty.
    """
    lang, score = langid.result_names(docs)
    return langid.identify(docs).filter((F.col(lang) != langid.UNKNOWN)
                                        & (F.col(score) >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: toxic texts go.

    Null and empty texts get the score of a text without matches.  Equal texts
    get equal scores, so of repeated rows all stay or none; very long texts are
    read whole; without labels of both classes all texts have one score, the
    share of toxic labels; an empty table stays empty.
    """
    model = toxicity.learn(docs, read_table(spark, sf_dir, "labels"))
    score = free_name(docs.columns, "score")
    return toxicity.score(docs, model).filter(F.col(score) < MAX_TOXICITY).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: one document of each group of near copies stays.

    It is the one with the least doc_id (null last, ties by text digest); of
    repeated rows one stays.  Texts that are null or have no words are no copies
    of each other and all stay; very long texts are compared whole; an empty
    table stays empty.
    """
    return minhash.deduplicate(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: what is left, packed into sequences.

    A null or empty text is one piece, the closing id; repeated rows are
    documents of their own; a text longer than a sequence is cut into pieces;
    an empty table gives an empty result.
    """
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.tiktoken"), SEQUENCE)


STAGES = [
    ("language_id", language),
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("packing", pack),
]

#: No SQL: the stages train models and run iterative algorithms.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs

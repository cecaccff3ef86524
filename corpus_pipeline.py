"""A training-data pipeline over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of ``documents``, and further columns that ``docs`` has, whatever
their names (those from __fl_ on are reserved). An empty table gives an empty one at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm import bpe, jaccard, lines, mixing, quality
from factorloom.llm.common import materialize


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled ones that are not held out, accepts.

    Null and empty texts have the score of the classifier's constant alone, and go or stay by it; null ids are scored
    like others but have no label; repeated rows and equal scores are decided alike; long texts are scored whole.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(spark, quality.training_rows(docs, labels))
    scored = quality.score(spark, docs, model, keep=docs.columns, names=("__fl_score", "__fl_good"))
    return scored.filter("__fl_good = 1").select(*docs.columns)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of templates that recur across documents are left in the first document only; n_chars is counted anew.

    No row goes. Null texts stay null (with n_chars null), empty ones empty; rows of one id count as one document, rows
    of a null id as none, and these keep no first copy; of documents that tie the smallest id is the first.
    """
    out = lines.dedup(spark, docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates.

    Null, empty and blank texts link with nothing and stay; of repeated rows of one id one stays; rows of a null id all
    stay; long texts are compared by all their shingles.
    """
    found = materialize(spark, jaccard.classes(spark, docs), "classes")
    return jaccard.representatives(docs, found)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights, in the order of the mix; a document stands as often as it is taken.

    Texts without words (null, empty, blank) are taken no times; a null source is one of its own; rows of a null or a
    repeated id are rows like others, each at most three times; equal rows stand for each other; ties are broken by md5.
    """
    return mixing.mix(spark, docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, with digests of the ids and of the decoded text.

    Null counts as empty; an empty text has no ids; null ids stay null; repeated rows come out repeated; long texts are
    encoded whole; other columns are dropped.
    """
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True, with_text=False)


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", fresh_lines),
    ("n-gram Jaccard join", one_of_each),
    ("mixing sources", mixed),
    ("BPE encoding", encoded),
]

ORACLE_SQL = None  # neither the classifier nor the encoder can be said in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""A training corpus from raw documents, in five stages; each works on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns the columns of ``documents`` (the last adds its
own); its result is written as Parquet and read back as the next stage's ``docs``.

Cases, in every stage: no rows give no rows; null and empty texts are texts without words (one
empty line); texts of any length are worked on whole; columns besides the known ones pass through,
but names that begin with two underscores, and those that the operators add, are reserved. What a
stage does with null ids and rows that repeat an id is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentide.llm import queries
from tokentide.llm.decontaminate import ADDED, find_contamination, remove_contamination
from tokentide.llm.linededup import dedup_lines
from tokentide.llm.mixing import mix
from tokentide.llm.ranking import CUT, learn, score_documents
from tokentide.llm.scratch import written
from tokentide.llm.simhash import keep_one, near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns as query op8 does, from the labels that are not held out.

    Every row is judged by its own text, whatever its id.
    """
    model = learn(docs, queries.learnt_labels(spark, sf_dir))
    return score_documents(docs, model).filter(F.col("score") >= CUT).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents hold stay in one; ``n_chars`` follows the text, and a null text becomes an empty one.

    Rows with a null id keep their lines; rows that repeat an id are one document and treated alike.
    """
    return dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays, the one with the smallest id.

    Rows with a null id stay; of rows that repeat the id that stays one is kept.
    """
    return keep_one(docs, near_duplicates(docs)).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go; every row is judged by its own text. Items with a null id count."""
    found = find_contamination(docs, queries.table(spark, sf_dir, "benchmark"), null_items=True)
    return remove_contamination(found, added=[c for c in ADDED if c not in docs.columns]).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources meet equal target weights; ``copy``, ``rate`` and ``shuffle_key`` are added.

    A null source is a source of its own. Rows with one id, null ids among them, are drawn alike.
    """
    return mix(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mixing", mixing)]

#: The classifier and the SimHash stage have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs

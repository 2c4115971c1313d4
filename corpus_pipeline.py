"""Corpus preparation: quality filter, near-duplicate removal, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept;
all but the last return the columns of ``documents``.  ``run`` writes each stage's rows
to the shared folder, reads them again for the next, and deletes them once the next
stage's rows are written; the last such table stays, as the result reads it.

Defined cases are those of the operators.  Rows with a null doc_id pass the filter by
their text and are never duplicates of others.  ``n_chars`` is counted anew where a
text changes; a text that loses every byte stays as an empty document, so that the
packing stage has a row for each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import neardup, packing, quality, suffixes
from gristmill.llm.common import delete_path, shared_path, table, written
from gristmill.llm.queries import vocabulary

#: A text is kept if its probability of being good reaches this.
KEEP = 0.3


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled rows, doesn't reject."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score_documents(docs, model, "__quality").filter(F.col("__quality") >= KEEP).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each group of near duplicates."""
    return neardup.keep_firsts(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings that documents of smaller ids have."""
    return suffixes.cleaned(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, by sequence."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality classifier", quality_filter),
    ("near-duplicate removal", near_duplicates),
    ("repeated passages", repeated_passages),
    ("best-fit packing", packing_stage),
]

#: SQL can express none of the learned filter, XXH64 fingerprints and byte-pair tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name.replace(" ", "-"))
        docs = written(spark, stage(spark, docs, sf_dir), path=path)
        if held:
            delete_path(spark, held)
        held = path
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: documents in, packed sequences out.

Each stage calls one operator of wardspan.llm on all rows that the stage before
it kept, and all but the last return the columns of documents. Stages whose texts
go to Python bound the session's Arrow batches.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspan.llm import exact, langid, minhash, packing, pii
from wardspan.llm.base import bounded_batches, by_ids, cut, documents, free_name

#: A text with a smaller share of known n-grams is in no known language.
LEAST_LANGUAGE_SCORE = 0.1
#: Near duplicates: shingles of so many words, and at least so many hundredths alike.
SHINGLE_WORDS, NEAR_PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter or in no known language; a missing lang is filled in.

    Null and empty texts have no letter and go. Repeated rows are judged one by
    one and stay as often as they occur. Where nothing can be learned, as in an
    empty table or one without labels, every text with a letter stays.
    """
    bounded_batches(spark)
    model, told = langid.fit(docs), free_name(docs)
    if not model.languages:
        return docs.filter(langid.has_letter("text"))
    found = docs.withColumn(told, langid.language_of(model, spark)("text"))
    kept = found.filter(F.col(f"{told}.lang_pred") != "und").filter(F.col(f"{told}.score") >= LEAST_LANGUAGE_SCORE)
    return kept.withColumn("lang", F.coalesce("lang", f"{told}.lang_pred")).drop(told)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of texts that are equal without white space.

    Null and empty texts are equal; of repeated rows one stays. An empty table
    gives none.
    """
    return exact.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates.

    Texts without words have none and stay. Rows of one id are one document: all
    of them stay or go. An empty table gives none.
    """
    bounded_batches(spark)
    groups = minhash.near_groups(docs, SHINGLE_WORDS, NEAR_PERCENT)
    return by_ids(docs, groups.filter(~F.col("kept")).select("doc_id").distinct(), "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in the texts, and counts n_chars anew.

    Every row stays, repeated ones too; a null text stays null, an empty one
    empty. An empty table gives none.
    """
    bounded_batches(spark)
    return docs.withColumn("text", pii.mask_pii("text")).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences.

    Null and empty texts are their end token; repeated rows are packed as often
    as they occur. An empty table gives no sequences.
    """
    bounded_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", language),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("personal_data", personal_data),
    ("sequences", sequences),
]

#: No stage but the second can be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over all documents; lineage is cut between stages."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs

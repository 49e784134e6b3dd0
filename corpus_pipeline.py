"""A training-corpus pipeline over ``documents``: each stage is written as Parquet and read back by the next.

1. language ID: documents whose language cannot be determined with confidence go;
2. quality classifier: documents below the quality threshold go;
3. near-duplicates on five-word shingles by SimHash and MinHash, verified: the smallest doc_id of each group stays;
4. mixing of sources to target weights: documents appear as often as the mix takes them whole;
5. SentencePiece encoding, with the decoded text compared to the original.

Stages 1 to 4 return the columns they were given, whatever their names. SQL cannot express the trained stages, so
``ORACLE_SQL`` is None; tests hold each stage and the result against plain versions of their own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import langid, mixing, pieces, quality, similar
from corpusloom.llm.common import plain_names, scope, shared_folder

#: Least probability of the predicted language, and least quality score.
LANGUAGE_SCORE, QUALITY_SCORE = 0.5, 0.3
#: Five-word shingles; documents link where their sets have this similarity.
SHINGLE, SIMILARITY = 5, 0.8


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is one of those learned from the documents' own labels."""
    named = plain_names(docs, "text")
    found = langid.identify_languages(named, docs.select("doc_id", "text", "lang"))
    kept = found.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("lang_score") >= LANGUAGE_SCORE))
    return kept.select(*named.columns).toDF(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the quality classifier, trained on the labelled ones, accepts; all of them without labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    named = plain_names(docs, "text")
    scored = quality.classify_quality(named, labels, threshold=QUALITY_SCORE, training=docs.select("doc_id", "text"))
    return scored.filter("quality_pred = 1").select(*named.columns).toDF(*docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: the one with the smallest doc_id."""
    return similar.one_of_each(docs, SHINGLE, SIMILARITY)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out whole documents so that sources come near their target weights."""
    return mixing.mixed_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids_crc32, round_trip) of every document of the mix."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.digests(docs.select("doc_id", "lang", "source", "text"), path).drop("text")


STAGES = [
    ("language_id", language_stage),
    ("quality_classifier", quality_stage),
    ("simhash_dedup", dedup_stage),
    ("source_mixing", mixing_stage),
    ("sentencepiece", encoding_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; returns the last stage's rows, read back from Parquet."""
    folder = shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        with scope(spark):  # what a stage staged on its way goes when its output is written
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}

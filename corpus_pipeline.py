"""From raw documents to token ids: filter, deduplicate, redact, mix, encode."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouch.llm import mixing, near_copies, pieces, pii, toxicity
from vouch.llm.common import prefixed, read
from vouch.operators.lineage import shared_folder


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier flags by their language's threshold go."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score(prefixed(docs), model, "k_text", "k_lang")
    return scored.where("NOT flagged").select(*[F.col(f"`k_{c}`").alias(c) for c in docs.columns])


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five-word shingles, Jaccard similarity 0.8 or
    more, met by balls of fingerprints) stays, that of the smallest doc_id."""
    return near_copies.one_of_each(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: none, one or two rows."""
    return mixing.mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their piece ids, counts, and whether decoding gives the text back."""
    return pieces.encode(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", keep_one_of_each),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

#: The trained classifier and the fingerprints have no form in SQL; tests/llm/test_pipeline.py
#: compares run() with a version in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again,
    so that a lost executor repeats one stage at most."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        place = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return docs

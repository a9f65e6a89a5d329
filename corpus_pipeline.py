"""Corpus pipeline: from documents to packed training sequences.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet
and read again as the next stage's documents. All stages but the last return the columns they
were given. Rows are told apart by a number of their own, never by ``doc_id``, so rows without
an id and repeated rows go through like all others. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyguard.llm.packing import pack
from tallyguard.llm.personal import find_candidates, mask_personal_data, train_on
from tallyguard.llm.simhash import near_duplicates
from tallyguard.llm.suffixes import benchmark_overlap
from tallyguard.llm.tokens import default_tokenizer
from tallyguard.llm.toxicity import train, without_toxic
from tallyguard.session import written

# The contract of the near-duplicate stage: words of a shingle, and differing bits of a link.
SHINGLE = 3
BITS = 2


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a row number, stored so that it stays the same, and the name of its
    column, which no other column has."""
    row = "__row"
    while row.lower() in (c.lower() for c in docs.columns):
        row += "_"
    return written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def _without(docs: DataFrame, row: str, rows: DataFrame) -> DataFrame:
    """The documents but those whose row numbers are in ``doc_id`` of the other table."""
    return docs.join(rows.select(F.col("doc_id").alias(row)), row, "left_anti").drop(row)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half. Null texts count as empty."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return without_toxic(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, in reading order, of every component of near-duplicates: fingerprints of
    three-word shingles that differ in at most two bits. Null texts, empty texts and texts without
    words have one fingerprint, zero, so one of them stays."""
    numbered, row = _numbered(docs)
    found = near_duplicates(numbered, id_col=row, distance=BITS, size=SHINGLE)
    return _without(numbered, row, found.where("doc_id <> component_id"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth are hit by benchmark windows. Null texts have
    no words, so they stay."""
    numbered, row = _numbered(docs)
    found = benchmark_overlap(numbered, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=row)
    return _without(numbered, row, found.where("contaminated"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets, and ``n_chars`` to match.
    A null text stays null and keeps its count."""
    masked = mask_personal_data(docs, train_on(find_candidates(docs)))
    if "n_chars" not in docs.columns:
        return masked
    counted = F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return masked.withColumn("n_chars", counted)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in full sequences. A null text is an empty one: its end id."""
    return pack(docs, default_tokenizer(), end_id=1)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

# Learned models and token ids are beyond SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs

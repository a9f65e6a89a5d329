"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyguard.llm import collocations, licenses, repeats, warc, zone_maps
from tallyguard.llm.packing import pack
from tallyguard.llm.pages import extract
from tallyguard.llm.personal import personal_data
from tallyguard.llm.simhash import near_duplicates
from tallyguard.llm.suffixes import benchmark_overlap
from tallyguard.llm.token_files import read_token_files, write_token_files
from tallyguard.llm.tokens import default_tokenizer
from tallyguard.llm.topk import exact_top_k
from tallyguard.llm.toxicity import score, train

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(builder: Callable[[SparkSession, str], DataFrame]):
    QUERIES[builder.__name__] = builder
    return builder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses named in every document."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


ORACLES["op1_license_scan"] = licenses.oracle()


@query
def op2_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document, or place in the document, has."""
    return repeats.repeats(_table(spark, sf_dir, "documents")).drop("place", "kept_doc_id")


ORACLES["op2_repeated_lines"] = repeats.oracle()


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in full sequences of at most 2048 tokens."""
    return pack(_table(spark, sf_dir, "documents"), default_tokenizer(), end_id=1)


@query
def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(_table(spark, sf_dir, "pages"))


@query
def op5_benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that a benchmark window hits."""
    return benchmark_overlap(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query
def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return personal_data(_table(spark, sf_dir, "documents"))


@query
def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best rows for every hundredth vector."""
    vectors = _table(spark, sf_dir, "embeddings")
    return exact_top_k(vectors, vectors.where("vec_id % 100 = 0"))


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return near_duplicates(_table(spark, sf_dir, "documents"))


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = _table(spark, sf_dir, "documents")
    return score(docs, train(docs, _table(spark, sf_dir, "labels")))


@query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as read back from the token files."""
    folder, manifest = write_token_files(_table(spark, sf_dir, "documents"), default_tokenizer(), end_id=2)
    return read_token_files(folder, manifest)


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of two and three words of every language."""
    return collocations.collocations(_table(spark, sf_dir, "documents"))


ORACLES["op11_collocations"] = collocations.oracle()


@query
def op12_zone_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector after five rounds from 40 starting vectors."""
    return zone_maps.cluster_vectors(_table(spark, sf_dir, "embeddings"))


ORACLES["op12_zone_clusters"] = zone_maps.oracle()


@query
def op13_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all pages as read back from the archives."""
    folder, index = warc.write_archives(_table(spark, sf_dir, "pages"))
    return warc.read_archives(folder, index).drop("url")


ORACLES["op13_warc_bundles"] = warc.oracle()

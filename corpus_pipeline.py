"""A corpus pipeline of five operators, each stage written as Parquet and read again.

Language ID drops what no learned language explains, exact dedup keeps the newest of equal texts, SimHash near-dedup one
document of each group of texts that share four fifths of their 5-word shingles (wide links, see golay_simhash), mixing repeats and leaves out documents by their source's rate, BPE encodes what is left.
Nulls, empty texts, repeated rows and empty tables pass through as each operator defines it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strataloom.llm import boundary_bpe, common, cuckoo_dedup, golay_simhash, mixing, ppm_langid
from strataloom.llm.queries import bpe_digests


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ppm_langid.recognised(docs, ppm_langid.train(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cuckoo_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return golay_simhash.without_near_copies(docs, wide=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.emitted(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids themselves for every row of the mix."""
    out = boundary_bpe.encoded(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", *bpe_digests(), "ids")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]
#: Automata, filters, components and trees have no plain SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.saved(stage(spark, docs, sf_dir), name)
    return docs

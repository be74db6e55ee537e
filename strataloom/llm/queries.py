"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boundary_bpe, common, cuckoo_dedup, deleted_interpolation, golay_simhash, imatch, merkle_manifest, mixing, ppm_langid, secret_dfa, token_orc, vector_packing, whitening, winnowing


def op1_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deleted_interpolation.scores(common.documents(spark, sf_dir))


def op2_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.shared_path(spark, "tokens.orc")
    token_orc.write_tokens(common.documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_orc.checksums(spark, path)


def op3_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vector_packing.shard_documents(common.documents(spark, sf_dir), shards=24)
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return out.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown, "tokens")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixed(common.documents(spark, sf_dir).select("doc_id", "text", "source"))
    return out.select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.col("mix.copies")).alias("taken"))


def op5_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = imatch.compared(common.documents(spark, sf_dir))
    return out.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cuckoo_dedup.exact_dedup(common.documents(spark, sf_dir))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op7_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = golay_simhash.near_dedup(common.documents(spark, sf_dir))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = boundary_bpe.encoded(common.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", *bpe_digests())


def bpe_digests():
    written = F.array_join(F.transform("ids", lambda x: x.cast("string")), " ")
    return F.size("ids").cast("long").alias("n_tokens"), F.sha2(written.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")


def op9_secret_dfa(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_dfa.secret_spans(common.documents(spark, sf_dir))
    base = [r.name for r in secret_dfa.BASE_RULES]

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    own = F.filter("spans", lambda s: s["kind"].isin(base))
    return out.select("doc_id", *map(count, base), F.sha2(listed(own).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op10_ppm_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text", "lang")
    found = docs.select("doc_id", ppm_langid.language_column(spark, ppm_langid.train(docs)).alias("found"))
    held_out = common.crc_remainder("doc_id", ppm_langid.FOLDS) == ppm_langid.HELD_OUT
    return found.select("doc_id", held_out.alias("held_out"), F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"), F.col("found.bits").alias("bits_per_byte"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = merkle_manifest.manifest(common.documents(spark, sf_dir))
    digest = lambda c, name: F.lower(F.hex(c)).alias(name)
    return out.select(F.col("id").alias("doc_id"), digest("leaf", "leaf"), digest("subroot", "subroot"), digest("root", "root"), digest("siblings", "proof_sha256"), digest("shown_root", "folded_root"), (F.col("shown_root") == F.col("root")).alias("verified"))


def op12_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = winnowing.decontaminated(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    items = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_deleted_interpolation, op2_token_orc, op3_vector_packing, op4_mix_sources, op5_imatch, op6_exact_dedup, op7_simhash_golay, op8_boundary_bpe, op9_secret_dfa, op10_ppm_langid, op11_merkle_manifest, op12_winnowing, op13_whitening)}


def oracle_sql() -> dict[str, str]:
    from . import sql

    return sql.oracle_sql()

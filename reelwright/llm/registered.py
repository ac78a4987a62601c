"""The registered queries of this subpackage, with production parameters, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelwright.llm import (
    audit, decontaminate, fixity, importance, language, mixing, packing, records, repeats, simhash, topk, toxicity, urls,
)
from reelwright.session import small_batches

TOKENIZER = "word_bpe_49k.json"
END_ID = 1


def tokenizer_path(name: str = TOKENIZER) -> str:
    """The place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(fold: int, of: int) -> Column:
    """True if the CRC-32 of the doc_id as text leaves this remainder; false for null ids."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % of == fold, F.lit(False))


def op1_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixity.audited_pages(_table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    lexicon = toxicity.fit(docs.where(~held_out(1, 3)), _table(spark, sf_dir, "labels"))
    return toxicity.toxicity(docs, lexicon, keep=[F.col("doc_id"), held_out(1, 3).alias("held_out")])


def op3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.encoded(_table(spark, sf_dir, "documents"), tokenizer_path(), END_ID).select(
        "doc_id", "start", "n_tokens", "ids_crc32")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.fit(docs.where(~held_out(2, 4)))
    return language.identify(docs, model, keep=[F.col("doc_id"), held_out(2, 4).alias("held_out")])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"), urls.rules_table(spark))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicate_classes(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(_table(spark, sf_dir, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"])
    return found.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"), F.octet_length("kept").cast("long").alias("n_kept"),
                        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels")
    return audit.report(audit.counters(spark, f"{sf_dir}/documents.parquet", labels))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.packed(_table(spark, sf_dir, "documents"), tokenizer_path(), END_ID))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q for q in (
        op1_warc_fixity, op2_toxicity, op3_records, op4_language, op5_mixing, op6_url_rules, op7_simhash, op8_top_k,
        op9_repeats, op10_decontamination, op11_filter_audit, op12_importance, op13_packing,
    )
}
SQL: dict[str, str] = {
    "op1_warc_fixity": fixity.FIXITY_SQL,
    "op6_url_rules": urls.JUDGE_SQL,
    "op8_top_k": topk.TOPK_SQL,
    "op10_decontamination": decontaminate.LEAKS_SQL,
    "op11_filter_audit": audit.AUDIT_SQL,
    "op12_importance": importance.IMPORTANCE_SQL,
}

"""One query for each operator, over the whole of its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dielens.llm import (
    bpe_automaton,
    decontaminate,
    fertility,
    hard_negatives,
    merkle,
    minhash,
    packing,
    recompression,
    secret_scans,
    suffix_dedup,
    token_counts,
    token_files,
    toxicity,
)
from dielens.llm.registry import ORACLES, QUERIES, documents, query
from dielens.session import scratch_folder

__all__ = ["ORACLES", "QUERIES"]


@query("op4_token_files")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_folder(spark, "token-files")
    token_files.write_tokens(documents(spark, sf), path)
    return token_files.read_tokens(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


@query("op5_token_counts")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf))


@query("op8_bpe_automaton")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    tokens = bpe_automaton.decode(bpe_automaton.encode(documents(spark, sf)))
    listed = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return tokens.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op9_secret_scans", secret_scans.oracle())
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scans.report(secret_scans.scan(documents(spark, sf)))


@query("op3_decontaminate", decontaminate.ORACLE)
def op3(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.find_matches(documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))
    return decontaminate.judged(found).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        decontaminate.items_digest().alias("items_sha256"),
        "contaminated",
    )


@query("op7_fertility")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return fertility.judge(fertility.measure(documents(spark, sf)))


@query("op6_toxicity")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    return toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet")))


@query("op2_minhash")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf))


@query("op1_suffix_dedup")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    found = suffix_dedup.dedup(documents(spark, sf))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op10_recompression")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return recompression.dedup(documents(spark, sf)).select(
        "doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256")
    )


@query("op11_packing")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(documents(spark, sf)).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query("op12_merkle", merkle.oracle())
def op12(spark: SparkSession, sf: str) -> DataFrame:
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    tampered = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = merkle.proofs(merkle.leaves(documents(spark, sf), {"text": tampered}))
    return found.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest().alias("proof_sha256"), merkle.folded("seen").alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


@query("op13_hard_negatives", hard_negatives.ORACLE)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").withColumn("label", moved)
    return hard_negatives.mine(rows, F.col("vec_id") % 50 == 0)

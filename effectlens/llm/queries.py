"""The operators of this subpackage as registered queries: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from effectlens.llm import conversations, lines, lm, mil, neardup, pii, quality, runs, shards, tokenfiles
from effectlens.llm.bpe import encode_documents
from effectlens.llm.decontaminate import contaminated
from effectlens.llm.langid import fit, fold, identify
from effectlens.llm.shared import stored
from effectlens.sources.scratch import scratch


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_digests(coded: DataFrame) -> DataFrame:
    """Counts and digests of encoded documents."""
    return coded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality.ledger(documents(spark, sf_dir))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~quality.passes("base")).alias("base_failed"), quality.passes("v1").alias("kept"), "failed_bits")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(encode_documents(documents(spark, sf_dir), tokenizer_path()))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score(documents(spark, sf_dir))
    return scored.select("doc_id", "n_words", "n_seen", F.round("score", 4).alias("score"), F.round("mean_score", 6).alias("mean_score"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    scored = mil.judge(docs, mil.fit(docs, labels, ~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "passages")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(documents(spark, sf_dir))
    many = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    private = F.size(F.filter("spans", lambda s: s["kind"] != "term")).cast("long").alias("n_private")
    return found.select("doc_id", *[many(k) for k in pii.KINDS], private, F.sha2(F.encode(pii.as_text(F.col("base")), "UTF-8"), 256).alias("base_sha256"), pii.as_text(F.col("spans")).alias("spans"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(documents(spark, sf_dir))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    found = identify(docs, fit(docs.filter(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "phrase_rate", "foreign")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(runs.planted(documents(spark, sf_dir))).withColumn("top", runs.greatest(F.col("runs")))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    sha256 = lambda text: F.sha2(F.encode(text, "UTF-8"), 256)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "top.start",
        "top.length",
        "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        sha256(F.array_join(listed, "")).alias("runs_sha256"),
        sha256(F.col("collapsed")).alias("collapsed_sha256"),
    )


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    tokenfiles.write_tokens(documents(spark, sf_dir), path, tokenizer_path(), end_id=1)
    return tokenfiles.checksums(tokenfiles.read_tokens(spark, path)).withColumnRenamed("id", "doc_id")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    original = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = conversations.damaged(original)
    found = stored(conversations.parse(rows), "audits")
    hashed = conversations.digests(conversations.repair(rows, found.select("conv", "audit")))
    either = lambda c: F.col(c).eqNullSafe(F.col("conv"))
    counted = original.select("conv_id").distinct().join(found, either("conv_id"), "left").drop("conv")
    out = counted.join(hashed, either("conv_id"), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in conversations.FOUND[:-1]]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_bpe": op2_bpe,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_decontamination": op4_decontamination,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_minhash": op6_minhash,
    "op7_pii": op7_pii,
    "op8_sharding": op8_sharding,
    "op9_line_dedup": op9_line_dedup,
    "op10_language_id": op10_language_id,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_token_files": op12_token_files,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLES: dict[str, str] = {
    "op1_quality_rules": quality.ORACLE,
    "op3_lm_scoring": lm.ORACLE,
    "op6_minhash": neardup.ORACLE,
    "op8_sharding": shards.ORACLE,
    "op9_line_dedup": lines.ORACLE,
    "op11_periodic_runs": runs.ORACLE,
    "op13_conversation_repair": conversations.ORACLE,
}

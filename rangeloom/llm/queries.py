"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.llm import bytebpe, embeddings, lines, lm, neardup, packing, pii, quality, secrets, spans, sql, telephony

ORACLES: dict[str, str] = {"op2_minhash": sql.MINHASH, "op6_embeddings": sql.EMBEDDINGS}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def pack_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction data: all three limits bind, as only the assistant's turns bear loss."""
    pieces = packing.pack_conversations(_table(spark, sf_dir, "conversations"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    docs = docs.select("doc_id", "text", (fold == 1).alias("held_out"))
    model = lm.fit(docs.filter(~F.col("held_out")))
    scored = lm.score(docs, model, carry=("doc_id", "held_out"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op7_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = telephony.store_texts(_table(spark, sf_dir, "documents"))
    read = telephony.decode_media(stored, carry=("doc_id", "n_bytes"))
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        F.octet_length("pcm").cast("long").alias("pcm_bytes"),
        F.sha2("pcm", 256).alias("pcm_sha256"),
    )


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bytebpe.encode_documents(_table(spark, sf_dir, "documents"), ranks, pattern).select(
        "doc_id",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
    )
    decoded = bytebpe.decode_documents(encoded, ranks, pattern, carry=("n_tokens", "ids_sha256"))
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), words=3, percent=85)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_kept", F.sha2("text", 256).alias("text_sha256"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind_no"] < len(secrets.BASE))
    return found.select(
        "doc_id",
        *(count(k) for k in secrets.BASE),
        F.sha2(F.array_join(spans.keys(base), ","), 256).alias("base_sha256"),
        F.array_join(spans.keys(F.col("spans")), ",").alias("spans"),
    )


def _quality_fold():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def quality_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> quality.AttentionModel:
    """The production model: labels of the folds that aren't held out."""
    return quality.fit(docs, _table(spark, sf_dir, "labels").filter(~_quality_fold()))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality_model(spark, sf_dir, docs)
    scored = quality.score(docs.select("doc_id", "text", _quality_fold().alias("held_out")), model, carry=("doc_id", "held_out"))
    return scored.select("doc_id", "held_out", F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    return found.select(
        "doc_id",
        *(count(k) for k in pii.BASE),
        F.sha2(F.array_join(spans.keys(base), ","), 256).alias("base_sha256"),
        F.array_join(spans.keys(F.col("spans")), ",").alias("spans"),
        F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


QUERIES = {
    "op1_packing": op1_packing,
    "op2_minhash": op2_minhash,
    "op3_line_dedup": op3_line_dedup,
    "op4_secrets": op4_secrets,
    "op5_language_model": op5_language_model,
    "op6_embeddings": op6_embeddings,
    "op7_telephony": op7_telephony,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_quality": op9_quality,
    "op10_pii": op10_pii,
    "pack_conversations": pack_conversations,
}

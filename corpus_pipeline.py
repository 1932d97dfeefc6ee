"""From raw documents to packed training sequences, one operator a stage.

Each stage takes all rows that the one before it kept. Between stages the rows
are written and read again: by the caller of ``STAGES``, or by ``run`` in the
shared scratch folder.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.llm import lines, neardup, packing, pii, quality
from rangeloom.llm.common import materialize, release, shrink_executors
from rangeloom.llm.queries import quality_model

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _begin(spark: SparkSession) -> None:
    """Let go of what earlier stages hold on the driver and the executors."""
    release(spark)
    shrink_executors(spark)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    _begin(spark)
    scored = quality.score(docs, quality_model(spark, sf_dir, docs), carry=COLUMNS)
    return scored.filter("quality_score >= 0.3").select(*COLUMNS)


def _with_text(df: DataFrame) -> DataFrame:
    """A stage's texts with the other columns of its rows, and their new lengths."""
    return df.select("row.doc_id", "text", "row.lang", "row.source", F.length("text").cast("long").alias("n_chars"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go, and documents of such lines alone."""
    _begin(spark)
    out = lines.dedup_lines(docs, carry=COLUMNS)
    return _with_text(out.filter("n_full > 0 or n_kept = n_lines"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicate documents the one of the least id stays."""
    _begin(spark)
    gone = neardup.near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct()
    gone, _ = materialize(gone, "gone")
    side = F.broadcast(gone) if gone.count() <= neardup.BROADCAST_IDS else gone
    return docs.join(side, "doc_id", "left_anti").select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    _begin(spark)
    return _with_text(pii.redact(docs, carry=COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2048, a row a piece."""
    _begin(spark)
    pieces = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("minhash near-dedup", drop_copies),
    ("personal data", redact_personal_data),
    ("packing", pack),
]
# The classifier and the tokenizer are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""BED files: tab-separated, starts counted from 0, ends exclusive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.model import RangeSet
from rangeloom.operators.derived import numbered

SCHEMA = "seqname string, start0 long, end long, name string, score double, strand string"


def read_bed(spark: SparkSession, path: str) -> RangeSet:
    """Ranges of BED files of three to six columns, numbered by place."""
    raw = spark.read.schema(SCHEMA).option("sep", "\t").option("comment", "#").csv(path)
    strand = F.when(F.col("strand").isin("+", "-"), F.col("strand")).otherwise("*")
    rows = raw.filter("start0 is not null and end is not null").select("seqname", (F.col("start0") + 1).alias("start"), "end", strand.alias("strand"), "name", "score")
    keyed = rows.withColumn("_key", F.struct("seqname", "start", "end", "strand", "name", "score"))
    return RangeSet.of_genomic(numbered(keyed, "_key", "range_id").drop("_key"))


def write_bed(ranges: RangeSet, path: str, *, name: str | None = None, score: str | None = None) -> None:
    """Write ranges as six-column BED files, sorted by place."""
    df: DataFrame = ranges.df.orderBy("seqname", "start", "end")
    df.select(
        "seqname", (F.col("start") - 1).alias("start0"), "end", (F.col(f"`{name}`") if name else F.col("range_id")).cast("string").alias("name"),
        (F.col(f"`{score}`") if score else F.lit(0)).alias("score"), "strand",
    ).write.mode("overwrite").option("sep", "\t").csv(path)

"""A subject set made ready for repeated queries, in memory or on disk."""

from __future__ import annotations

import json
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rangeloom.model import CORE, RangeSet, Stats, flag, word
from rangeloom.plans import binning
from rangeloom.session import default_threads

BLOCK = 2048
FORMAT = 3
ROWS_PER_BUCKET = 1_000_000
_LAYOUT = ("low", "high", "level", "bin", "cell", "own")


class SubjectIndex:
    """Ranges laid out by bin for repeated queries, with the figures that plans need.

    ``ranges`` carries the layout: rows by (sequence, cell), hashed into a
    fixed number of partitions and sorted there, so that a query set alone is
    exchanged for a join with it.
    """

    def __init__(self, ranges: RangeSet, size_mb: float | None = None, kept: DataFrame | None = None):
        self.ranges, self.size_mb, self.kept = ranges, size_mb, kept

    def __repr__(self) -> str:
        s = self.ranges.stats
        return f"SubjectIndex({'genomic' if self.ranges.genomic else 'plain'}, {s.n} ranges, {s.seqs} partitions)"

    def unpersist(self) -> None:
        if self.kept is not None:
            self.kept.unpersist()


def _grid(ranges: RangeSet) -> binning.Grid:
    """A grid for a subject set alone, with levels for queries of any length."""
    s = ranges.stats
    width = 4 * s.width_95
    return binning.Grid.of(width, max(s.width_max, s.high - s.low + 1))


def _laid_out(ranges: RangeSet, grid: binning.Grid, rows: DataFrame) -> RangeSet:
    """The same ranges with their layout. Rows are at home; queries that are longer than
    the ranges of a level have those of finer levels lifted when they are asked."""
    home = binning.unpacked(rows)
    first = F.col("bin") == F.floor(F.col("low") / grid.wide(F.col("level")))
    out = ranges.derive(home.filter(first).select(*(F.col(f"`{c}`") for c in ranges.df.columns)))
    out.__dict__["stats"] = ranges.stats
    out.binned = (grid, home)
    return out


def build_index(subject: RangeSet) -> SubjectIndex:
    """Lay a subject set out by bin over the cluster and keep it (memory, then disk)."""
    if not isinstance(subject, RangeSet):
        raise TypeError("subject must be a RangeSet")
    subject.check_circular("subject")
    grid = _grid(subject)
    n = max(default_threads(subject.df.sparkSession), -(-subject.stats.n // ROWS_PER_BUCKET))
    rows = binning.by_bin(subject, grid).repartition(n, *binning.HOME).sortWithinPartitions(*binning.HOME).persist(StorageLevel.MEMORY_AND_DISK)
    rows.count()
    return SubjectIndex(_laid_out(subject, grid, rows), kept=rows)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def save_index(index: SubjectIndex, path: str, *, compress: bool = True) -> str:
    """Write an index to a new or replaced folder whose parent exists."""
    if not isinstance(index, SubjectIndex):
        raise TypeError("index must be a SubjectIndex")
    word("path", path)
    flag("compress", compress)
    rs, spark = index.ranges, index.ranges.df.sparkSession
    fs, p = _fs(spark, path)
    if p.getParent() is not None and not fs.exists(p.getParent()):
        raise FileNotFoundError(f"the folder of {path} does not exist")
    grid = rs.binned[0] if hasattr(rs, "binned") else _grid(rs)
    every = binning.by_bin(rs, grid)
    n = max(default_threads(spark), -(-rs.stats.n // ROWS_PER_BUCKET))
    fs.delete(p, True)
    name = f"rangeloom_{uuid.uuid4().hex}"
    rows = every.repartition(n, *binning.HOME).write.format("parquet").bucketBy(n, *binning.HOME).sortBy(*binning.HOME)
    rows.option("compression", "zstd" if compress else "uncompressed").option("path", f"{path}/ranges").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay
    if rs.seqinfo is not None:
        rs.seqinfo.write.mode("overwrite").parquet(f"{path}/seqinfo")
    meta = {"format": FORMAT, "genomic": rs.genomic, "seqinfo": rs.seqinfo is not None, "stats": rs.stats.__dict__, "grid": [grid.width, grid.levels], "buckets": n}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    return path


def load_index(spark: SparkSession, path: str) -> SubjectIndex:
    """Read an index; one written without figures gets them anew."""
    word("path", path)
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(f"{path} does not exist")
    try:
        meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
        df = spark.read.parquet(f"{path}/ranges")
    except Exception as e:
        raise ValueError(f"{path} is not a saved index") from e
    missing = [c for c in CORE if c not in df.columns]
    if missing or meta.get("format", FORMAT) > FORMAT:
        raise ValueError(f"{path} is not a saved index of this version" + f"; it lacks {', '.join(missing)}" * bool(missing))
    seqinfo = spark.read.parquet(f"{path}/seqinfo") if meta.get("seqinfo") else None
    plain = df.drop(*(c for c in _LAYOUT if c in df.columns and meta.get("grid")))
    if meta.get("grid"):
        place = f"{'`, `'.join(binning.HOME)}"
        name = f"rangeloom_{uuid.uuid4().hex}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        where = path.replace("'", "\\'")
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{place}`) SORTED BY (`{place}`) INTO {meta['buckets']} BUCKETS LOCATION '{where}/ranges'")
        df = spark.table(name)
        if "own" in df.columns:  # format 2 had rows lifted to coarser levels too
            df = df.filter("own")
        df = df.drop(*(c for c in _LAYOUT if c != "cell"))
    rs = RangeSet(plain if meta["genomic"] else plain.drop("seqname", "strand"), meta["genomic"], seqinfo)
    if meta.get("stats"):
        figures = meta["stats"] | {"sizes": tuple(meta["stats"]["sizes"]) if meta["stats"].get("sizes") is not None else None}
        rs.__dict__["stats"] = Stats(**figures)
    if meta.get("grid"):
        rs = _laid_out(rs, binning.Grid(*meta["grid"]), df)
    return SubjectIndex(rs, fs.getContentSummary(p).getLength() / 2**20)


def index_stats(index: SubjectIndex) -> DataFrame:
    """One row: ranges, partitions (sequences), blocks, mean partition, size."""
    per = index.ranges.df.groupBy("seqname").agg(F.count("*").alias("n"))
    size = F.lit(float(index.size_mb)) if index.size_mb is not None else F.sum("n") * 40 / 2**20
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("subject_n"),
        F.count("*").alias("partition_n"),
        F.coalesce(F.sum(F.ceil(F.col("n") / BLOCK)), F.lit(0)).cast("long").alias("block_n"),
        F.count("*").alias("seqlevel_n"),
        F.coalesce(F.avg("n"), F.lit(0.0)).alias("mean_partition_size"),
        F.coalesce(size.cast("double"), F.lit(0.0)).alias("index_size_mb"),
    )


def index_partitions(index: SubjectIndex) -> DataFrame:
    """A row a sequence, in the order of names: its rows and its blocks."""
    per = index.ranges.df.groupBy("seqname").agg(F.count("*").alias("n_ranges")).withColumn("n_blocks", F.ceil(F.col("n_ranges") / BLOCK))
    upto = Window.orderBy("seqname")  # a row a sequence
    return per.select(
        F.row_number().over(upto).cast("long").alias("seq_id"),
        "seqname",
        (F.sum("n_ranges").over(upto) - F.col("n_ranges") + 1).alias("partition_start"),
        F.sum("n_ranges").over(upto).alias("partition_end"),
        "n_ranges",
        (F.sum("n_blocks").over(upto) - F.col("n_blocks") + 1).alias("block_start"),
        F.sum("n_blocks").over(upto).alias("block_end"),
        "n_blocks",
    )

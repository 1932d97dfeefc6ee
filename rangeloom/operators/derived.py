"""Clusters and sliding windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rangeloom.functions.predicate import Match
from rangeloom.model import RangeSet, checked, number
from rangeloom.operators.overlap import count_overlaps, prepare, self_overlaps, subject_ranges
from rangeloom.plans.binning import BROADCAST_ROWS
from rangeloom.plans.components import components, ensure_checkpoint_dir
from rangeloom.plans.ordered import Running, chunk_width, scan


def islands(df: DataFrame, keys: list[str], min_gap: int, width: int | None) -> DataFrame:
    """``df`` with ``island``: numbered by ``keys``, a new one where a range begins
    ``min_gap`` or more positions after all before it have ended."""
    order = [F.col("start"), F.col("end"), F.col("range_id")] if "range_id" in df.columns else [F.col("start"), F.col("end")]
    df = scan(df, keys, order, [Running("_reach", F.col("end"), "max_before")], "start", width)
    new = F.when(F.col("start") - F.col("_reach") - 1 >= min_gap, 1).otherwise(0)
    return scan(df, keys, order, [Running("island", new, "sum")], "start", width).drop("_reach")


@checked
def cluster_overlaps(ranges: RangeSet, *, threads: int | None = None, deterministic: bool = False, **match) -> DataFrame:
    """``(range_id, cluster_id, cluster_size)``: components of the overlap graph.

    Clusters are numbered by their least range id. Where overlap alone decides, a
    cluster is an island of the axis; otherwise edges are made between lower and
    higher ids and joined by star contraction.
    """
    m = Match(**match)
    prepare(ranges, ranges)
    s = ranges.stats
    if m.type == "any" and m.min_overlap <= 1 and (m.ignore_strand or not ranges.genomic) and not s.has_empty and not (m.max_gap >= 0 and m.min_overlap):
        rows = islands(ranges.bare(), ["seqname"], m.max_gap + 1, chunk_width([ranges]))
        least = rows.groupBy("seqname", "island").agg(F.min("range_id").alias("component"))
        rows = rows.join(least, ["seqname", "island"]).select("range_id", "component")
    else:
        found = components(self_overlaps(ranges, **match).toDF("a", "b")).withColumnRenamed("id", "range_id")
        rows = ranges.df.select("range_id").join(found, "range_id", "left").select("range_id", F.coalesce("component", "range_id").alias("component"))
    sizes = rows.groupBy("component").agg(F.count("*").alias("cluster_size"))
    return rows.join(numbered(sizes, "component", "cluster_id"), "component").select("range_id", "cluster_id", "cluster_size")


def numbered(df: DataFrame, by: str, name: str) -> DataFrame:
    """``df`` (one row a value of ``by``) with dense numbers from 1 in its order.

    Rows are sorted over all tasks and numbered within each; the tasks' sizes,
    one row each, give what to add.
    """
    placed = df.orderBy(by).withColumn("_part", F.spark_partition_id())
    ensure_checkpoint_dir(df.sparkSession)
    placed = placed.checkpoint()  # the numbers of the tasks must not change between the two uses
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(by))
    return placed.join(F.broadcast(sizes), "_part").withColumn(name, (within + F.col("_base")).cast("long")).drop("_part", "_base")


@checked
def window_count_overlaps(query: RangeSet, subject, *, window_width: int, step_width: int | None = None, threads: int | None = None, deterministic: bool = False, **match) -> DataFrame:
    """Counts of subjects in sliding windows over the span of the queries.

    Windows of a sequence begin at its least start, then every ``step_width``, up
    to its greatest end; they aren't clipped. ``window_id`` runs over sequences in
    the order of their names. With ``type`` the window is the query.
    """
    window_width = number("window_width", window_width, 1)
    step = number("step_width", window_width if step_width is None else step_width, 1)
    prepare(query, subject)
    spans = query.df.groupBy("seqname").agg(F.min("start").alias("lo"), F.max("end").alias("hi")).filter("lo <= hi")
    spans = spans.withColumn("n", F.floor((F.col("hi") - F.col("lo")) / step) + 1)
    # One row a sequence: how many windows the sequences before it have.
    before = Window.orderBy("seqname").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    rows = spans.select("seqname", "lo", "base", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    start = F.col("lo") + F.col("k") * step
    windows = rows.select((F.col("base") + F.col("k") + 1).alias("range_id"), "seqname", start.alias("start"), (start + window_width - 1).alias("end"), F.lit("*").alias("strand"))
    made = query.derive(windows)
    made.seqinfo = None
    counts = count_overlaps(made, subject_ranges(subject), **match)
    rows = made.df.hint("merge") if made.stats.n > BROADCAST_ROWS else made.df  # more than its source, which the planner goes by
    out = rows.join(counts, rows["range_id"] == counts["query_id"])
    return out.select(F.col("range_id").alias("window_id"), *(["seqname"] if query.genomic else []), "start", "end", "overlap_count")

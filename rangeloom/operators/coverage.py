"""How many ranges cover each position, in runs and in tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.model import RangeSet, checked, number, word
from rangeloom.plans.ordered import Running, chunk_width, scan, spread

METHODS = ("auto", "sort", "hash")


def _lengths(x: RangeSet, shifted: DataFrame, width: int | None) -> DataFrame:
    """``(seqname, length)``: the given width, else the sequence's, else the last end."""
    reach = shifted.groupBy("seqname").agg(F.max("end").alias("reach"))
    if x.seqinfo is not None:
        reach = x.seqinfo.select("seqname", F.col("seqlength").cast("long").alias("known")).join(reach, "seqname", "full_outer")
    else:
        reach = reach.withColumn("known", F.lit(None).cast("long"))
    length = F.lit(width).cast("long") if width is not None else F.coalesce("known", "reach")
    return reach.select("seqname", length.alias("length")).filter("length > 0")


def _clipped(x: RangeSet, shift: int, width: int | None, weight) -> tuple[DataFrame, DataFrame]:
    """Shifted ranges with their weights, cut to 1 and the length; the lengths."""
    if isinstance(weight, str):
        if weight not in x.meta:
            raise ValueError(f"weight {weight!r} isn't a metadata column")
        value = F.col(f"`{weight}`").cast("double")
    else:
        if isinstance(weight, bool) or not isinstance(weight, (int, float)):
            raise ValueError("weight must be a number or the name of a metadata column")
        value = F.lit(weight).cast("long") if isinstance(weight, int) else F.lit(float(weight))
    shift = number("shift", shift, -(1 << 62))
    rows = x.df.select("seqname", (F.col("start") + shift).alias("start"), (F.col("end") + shift).alias("end"), value.alias("value"))
    width = None if width is None else number("width", width, 0)
    lengths = _lengths(x, rows, width).filter("seqname is not null")
    if width is None and x.seqinfo is not None:
        rows = rows.join(lengths, "seqname")
    else:  # one length for all, or the last end, which cuts nothing off
        rows = rows.filter("seqname is not null").withColumn("length", F.col("end") if width is None else F.lit(width).cast("long"))
    rows = rows.select("seqname", F.greatest("start", F.lit(1)).alias("start"), F.least("end", "length").alias("end"), "value").filter("start <= end")
    return rows, lengths


def _runs(x: RangeSet, shift: int, width: int | None, weight) -> DataFrame:
    rows, lengths = _clipped(x, shift, width, weight)
    zero = F.lit(0).cast(rows.schema["value"].dataType)
    # A point stays if the depth changes there or the sequence begins or ends.
    rows = rows.withColumn("edge", F.lit(False)).union(lengths.select("seqname", F.lit(1).cast("long"), "length", zero, F.lit(True)))
    wide = chunk_width([x], 2)
    if not wide:
        rows = spread(rows, ["seqname"], [x])
    ends = F.array(F.struct(F.col("start").alias("pos"), F.col("value").alias("step")), F.struct((F.col("end") + 1).alias("pos"), (-F.col("value")).alias("step")))
    events = rows.select("seqname", "edge", F.explode(ends).alias("e"))
    points = events.groupBy("seqname", "e.pos").agg(F.sum("e.step").alias("step"), F.max("edge").alias("edge")).filter("step <> 0 or edge")
    specs = [Running("value", F.col("step"), "sum_before"), Running("at", F.col("pos"), "previous")]
    out = scan(points, ["seqname"], [F.col("pos")], specs, "pos", wide).filter("at is not null")
    return out.select("seqname", F.col("at").alias("start"), (F.col("pos") - 1).alias("end"), "value")


@checked
def coverage(x: RangeSet, *, shift: int = 0, width: int | None = None, weight=1, method: str = "auto", threads: int | None = None) -> DataFrame:
    """Runs of equal depth from position 1 to the length, a row a run.

    ``weight`` is a number or a metadata column. Positions outside are cut off.
    ``method`` is accepted and changes nothing.
    """
    word("method", method, METHODS)
    runs = _runs(x, shift, width, weight)
    return runs if x.genomic else runs.drop("seqname")


@checked
def tile_coverage(x: RangeSet, *, tile_width: int, step_width: int | None = None, shift: int = 0, width: int | None = None, weight=1, method: str = "auto",
                  threads: int | None = None) -> DataFrame:
    """Sum of the depths in each tile; tiles begin at 1 and are cut at the length.

    The depths before a position add up to the sum of depth times distance from
    boundary to boundary; its values at a tile's two ends give the tile's sum.
    """
    word("method", method, METHODS)
    tile = number("tile_width", tile_width, 1)
    step = number("step_width", tile if step_width is None else step_width, 1)
    rows, lengths = _clipped(x, shift, width, weight)
    tiles = lengths.select("seqname", "length", F.explode(F.sequence(F.lit(1).cast("long"), F.col("length"), F.lit(step).cast("long"))).alias("start"))
    tiles = tiles.select("seqname", "start", F.least(F.col("start") + tile - 1, F.col("length")).alias("end"))
    zero = F.lit(0).cast(rows.schema["value"].dataType)

    def event(df: DataFrame, at, value, sign: int) -> DataFrame:
        own = F.struct("start", "end") if sign else F.lit(None).cast("struct<start:bigint,end:bigint>")
        return df.select("seqname", at.alias("pos"), F.lit(abs(sign)).alias("probe"), value.alias("step"), F.lit(sign).alias("sign"), own.alias("tile"))

    after = F.col("end") + 1
    events = event(rows, F.col("start"), F.col("value"), 0).union(event(rows, after, -F.col("value"), 0)).union(event(tiles, F.col("start"), zero, -1)).union(event(tiles, after, zero, 1))
    order, width_ = [F.col("pos"), F.col("probe")], chunk_width([x], 4)
    found = scan(events, ["seqname"], order, [Running("depth", F.col("step"), "sum_before"), Running("at", F.col("pos"), "previous")], "pos", width_)
    more = F.coalesce(F.col("depth") * (F.col("pos") - F.col("at")), zero)
    found = scan(found.select("*", more.alias("more")), ["seqname"], order, [Running("area", F.col("more"), "sum")], "pos", width_).filter("probe = 1")
    area = F.col("area") * F.col("sign")
    out = found.groupBy("seqname", "tile.start", "tile.end").agg(F.sum(area).cast("double").alias("coverage_sum"))
    return out if x.genomic else out.drop("seqname")

"""Interval set algebra: what positions are covered, by one set or by two."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.functions.predicate import Match
from rangeloom.model import RangeSet, flag, number, same_kind, strand_column
from rangeloom.operators.derived import islands
from rangeloom.plans import binning
from rangeloom.plans.ordered import Running, chunk_width, scan, spread

KEYS = ["seqname", "strand"]


def _shape(df: DataFrame, genomic: bool, *extra: str) -> DataFrame:
    return df.select(*(["seqname"] if genomic else []), "start", "end", *(["strand"] if genomic else []), *extra)


def _width(*sets: RangeSet) -> int | None:
    return chunk_width(list(sets), 2)


def _rows(x: RangeSet, ignore_strand: bool) -> DataFrame:
    return x.bare().withColumn("strand", strand_column(ignore_strand))


def merge(x: RangeSet, rows: DataFrame, min_gap: int, width: int | None, revmap: bool = False) -> DataFrame:
    found = islands(rows if width else spread(rows, KEYS, [x]), KEYS, min_gap, width)
    ids = [F.sort_array(F.collect_list("range_id")).alias("revmap")] if revmap else []
    return found.groupBy(*KEYS, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), *ids).drop("island")


def reduce_ranges(x: RangeSet, *, ignore_strand: bool = False, min_gap_width: int = 1, with_revmap: bool = False) -> DataFrame:
    """Ranges merged where fewer than ``min_gap_width`` positions lie between them,
    by sequence and strand; ``revmap`` has the ids merged."""
    flag("ignore_strand", ignore_strand)
    flag("with_revmap", with_revmap)
    out = merge(x, _rows(x, ignore_strand), number("min_gap_width", min_gap_width, 0), _width(x), with_revmap)
    return _shape(out, x.genomic, *(["revmap"] if with_revmap else []))


def _points(sets: list[tuple[RangeSet, DataFrame, str]], keys: list[str], width: int | None) -> DataFrame:
    """By position, how much the depth of each set changes there (``d_<set>``)."""
    rows = None
    for k, (_, df, _) in enumerate(sets):
        df = df.filter("end >= start").select(*keys, "start", "end", F.lit(k).alias("of"))
        rows = df if rows is None else rows.union(df)
    if not width:
        rows = spread(rows, keys, [x for x, _, _ in sets])
    ends = F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("step")), F.struct((F.col("end") + 1).alias("pos"), F.lit(-1).alias("step")))
    steps = rows.select(*keys, "of", F.explode(ends).alias("e"))
    return steps.groupBy(*keys, "e.pos").agg(*(F.sum(F.when(F.col("of") == k, F.col("e.step")).otherwise(0)).alias(f"d_{n}") for k, (_, _, n) in enumerate(sets)))


def depths(sets: list[tuple[RangeSet, DataFrame, str]], keys: list[str], width: int | None) -> DataFrame:
    """Pieces between neighbouring boundaries with the depth of each set, a column
    a set. Empty ranges cover nothing."""
    names = [n for _, _, n in sets]
    points = _points(sets, keys, width)
    specs = [*(Running(n, F.col(f"d_{n}"), "sum_before") for n in names), Running("at", F.col("pos"), "previous")]
    out = scan(points, keys, [F.col("pos")], specs, "pos", width).filter("at is not null")
    return out.select(*keys, F.col("at").alias("start"), (F.col("pos") - 1).alias("end"), *names)


def disjoin(x: RangeSet, *, ignore_strand: bool = False, with_revmap: bool = False) -> DataFrame:
    """The pieces into which the ranges' boundaries cut what they cover."""
    flag("ignore_strand", ignore_strand)
    flag("with_revmap", with_revmap)
    pieces = depths([(x, _rows(x, ignore_strand), "depth")], KEYS, _width(x)).filter("depth > 0").select(*KEYS, "start", "end")
    if not with_revmap:
        return _shape(pieces, x.genomic)
    whole = x if not ignore_strand else x.derive(_rows(x, True))
    # A piece is known by its start; it overlaps exactly the ranges that hold it.
    named = x.derive(pieces.withColumn("range_id", F.xxhash64(*KEYS, "start")))
    strand = F.col("q_strand") == F.col("s_strand")
    held = binning.pairs(named, whole, Match(), extra=strand).groupBy("q_seqname", "q_strand", "q_start", "q_end").agg(F.sort_array(F.collect_list("s_range_id")).alias("revmap"))
    held = held.select(F.col("q_seqname").alias("seqname"), F.col("q_strand").alias("strand"), F.col("q_start").alias("start"), F.col("q_end").alias("end"), "revmap")
    return _shape(held, x.genomic, "revmap")


def gaps(x: RangeSet, *, start: int | None = None, end: int | None = None, ignore_strand: bool = False) -> DataFrame:
    """What the ranges leave uncovered.

    Between ranges always; before and after them within ``start`` and ``end``,
    and for sequences whose length is known within 1 and that length, there also
    for strands without ranges unless strand is ignored.
    """
    flag("ignore_strand", ignore_strand)
    lo = F.lit(None if start is None else number("start", start, -(1 << 62))).cast("long")
    hi = F.lit(None if end is None else number("end", end, -(1 << 62))).cast("long")
    covered = merge(x, _rows(x, ignore_strand).filter("end >= start"), 1, _width(x))
    if x.genomic and x.seqinfo is not None:
        strands = F.array(F.lit("*")) if ignore_strand else F.array(*(F.lit(s) for s in ("+", "-", "*")))
        known = x.seqinfo.filter("seqlength is not null").select("seqname", F.explode(strands).alias("strand"), F.col("seqlength").cast("long").alias("length"))
        bounds = known.select(*KEYS, F.coalesce(lo, F.lit(1)).alias("lo"), F.coalesce(hi, F.col("length")).alias("hi"))
        bounds = bounds.unionByName(covered.select(*KEYS).distinct().join(known.select(*KEYS), KEYS, "left_anti").select(*KEYS, lo.alias("lo"), hi.alias("hi")))
    elif x.genomic:
        bounds = covered.select(*KEYS).distinct().select(*KEYS, lo.alias("lo"), hi.alias("hi"))
    else:
        one = x.df.sparkSession.range(1).select(F.lit("range").alias("seqname"), F.lit("*").alias("strand"))
        bounds = one.select(*KEYS, lo.alias("lo"), hi.alias("hi"))
    # A bound is an empty range just outside it, so that the flanks are gaps too.
    fences = bounds.select(*KEYS, F.explode(F.array(F.struct(F.col("lo").alias("start"), (F.col("lo") - 1).alias("end")), F.struct((F.col("hi") + 1).alias("start"), F.col("hi").alias("end")))).alias("f"))
    fences = fences.select(*KEYS, "f.start", "f.end").filter("start is not null")
    rows = covered.select(*KEYS, "start", "end").union(fences).join(bounds, KEYS)
    out = scan(rows, KEYS, [F.col("start"), F.col("end")], [Running("reach", F.col("end"), "max_before")], "start", _width(x))
    a, b = F.greatest(F.col("reach") + 1, F.col("lo")), F.least(F.col("start") - 1, F.col("hi"))
    return _shape(out.filter("reach is not null").select(*KEYS, a.alias("start"), b.alias("end")).filter("start <= end"), x.genomic)


def _combine(x: RangeSet, y: RangeSet, ignore_strand: bool, keep: str) -> DataFrame:
    """The stretches where ``keep`` holds of the depths of both sets: it is looked
    at where it changes, so neighbouring pieces need no merging."""
    flag("ignore_strand", ignore_strand)
    same_kind(x, y)
    width = _width(x, y)
    points = _points([(x, _rows(x, ignore_strand), "in_x"), (y, _rows(y, ignore_strand), "in_y")], KEYS, width)
    order = [F.col("pos")]
    depth = scan(points, KEYS, order, [Running(n, F.col(f"d_{n}"), "sum") for n in ("in_x", "in_y")], "pos", width)
    kept = scan(depth.select(*KEYS, "pos", F.expr(keep).cast("int").alias("kept")), KEYS, order, [Running("was", F.col("kept"), "previous")], "pos", width)
    turns = kept.filter("kept != coalesce(was, 0)").select(*KEYS, "pos", "kept")
    out = scan(turns, KEYS, order, [Running("since", F.col("pos"), "previous")], "pos", width).filter("kept = 0")
    return _shape(out.select(*KEYS, F.col("since").alias("start"), (F.col("pos") - 1).alias("end")), x.genomic)


def range_union(x: RangeSet, y: RangeSet, *, ignore_strand: bool = False) -> DataFrame:
    """What either set covers, in merged ranges by sequence and strand."""
    return _combine(x, y, ignore_strand, "in_x > 0 or in_y > 0")


def range_intersect(x: RangeSet, y: RangeSet, *, ignore_strand: bool = False) -> DataFrame:
    """What both sets cover."""
    return _combine(x, y, ignore_strand, "in_x > 0 and in_y > 0")


def range_setdiff(x: RangeSet, y: RangeSet, *, ignore_strand: bool = False) -> DataFrame:
    """What ``x`` covers and ``y`` doesn't."""
    return _combine(x, y, ignore_strand, "in_x > 0 and in_y = 0")

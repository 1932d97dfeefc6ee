"""Nearest, preceding and following ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeloom.functions.predicate import Match
from rangeloom.model import RangeSet, checked, flag
from rangeloom.operators import overlap
from rangeloom.operators.overlap import hits, prepare
from rangeloom.plans.binning import BROADCAST_ROWS
from rangeloom.plans.ordered import Running, chunk_width, scan


def _crowded(x: RangeSet) -> bool:
    """Whether many ranges must begin (and many end) at the same positions."""
    s = x.stats
    return s.n > 4 * s.seqs * (s.high - s.low + 1)


def _sides(query: RangeSet, subject: RangeSet, ignore_strand: bool) -> DataFrame:
    """Per query: for each strand class the nearest subject after it and before it,
    as ``struct(distance, id)``; a tie goes to the least id."""
    stranded = query.genomic and not ignore_strand
    classes = {"plus": F.col("strand") != "-", "minus": F.col("strand") != "+"} if stranded else {"plus": F.lit(True)}
    wide = chunk_width([query, subject])
    crowded = _crowded(subject)

    def along(q_at: str, s_at: str, name: str, kind: str) -> DataFrame:
        # A query stands after the subjects of its position when it looks on, and
        # before them when it looks back: only what is strictly beyond counts.
        q_rank, s_rank = (1, 0) if kind == "next" else (0, 1)
        tie = F.col("range_id") if kind == "next" else -F.col("range_id")
        q = query.bare().select("seqname", F.col(q_at).alias("pos"), F.lit(q_rank).alias("rank"), F.lit(0).cast("long").alias("tie"), "strand", "range_id", F.lit(True).alias("is_query"))
        s = subject.bare().select("seqname", s_at, "strand", "range_id")
        if crowded:  # the least id of a position is the only one that can be chosen
            s = s.groupBy("seqname", s_at, "strand").agg(F.min("range_id").alias("range_id"))
        s = s.select("seqname", F.col(s_at).alias("pos"), F.lit(s_rank).alias("rank"), tie.alias("tie"), "strand", "range_id", F.lit(False).alias("is_query"))
        here = F.struct(F.col("pos").alias("at"), F.col("range_id").alias("id"))
        specs = [Running(f"{name}_{c}", F.when(~F.col("is_query") & test, here), kind) for c, test in classes.items()]
        out = scan(q.union(s), ["seqname"], [F.col("pos"), F.col("rank"), F.col("tie")], specs, "pos", wide).filter("is_query")
        gap = lambda c: F.abs(F.col(f"{name}_{c}.at") - F.col("pos")) - 1
        found = (F.when(F.col(f"{name}_{c}").isNotNull(), F.struct(gap(c).alias("distance"), F.col(f"{name}_{c}.id").alias("id"))).alias(f"{name}_{c}") for c in classes)
        return out.select("range_id", "strand", *found)

    after, before = along("end", "start", "after", "next"), along("start", "end", "before", "last").drop("strand")
    return after.join(before, "range_id")


def _blocks(low: Column, high: Column, levels: int) -> Column:
    """The dyadic blocks ``(level, block)`` that make up a stretch, two a level at most."""
    out = []
    for k in range(levels):
        first, last = F.shiftright(low + ((1 << k) - 1), k), F.shiftright(high + 1, k) - 1
        for block, outer in ((first, 1), (last, 0)):
            out.append(F.when((first <= last) & (block.bitwiseAND(F.lit(1)) == outer), F.struct(F.lit(k).alias("level"), block.alias("block"))))
    return F.array_compact(F.array(*out))


def _points(at: Column, levels: int) -> Column:
    """The blocks of every level that hold a position."""
    return F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright(at, k).alias("block")) for k in range(levels)))


def least_touching(query: RangeSet, subject: RangeSet, ignore_strand: bool) -> DataFrame:
    """``(query_id, touching)``: the least id of the subjects that a query overlaps or
    touches, without pairs, for ranges that aren't empty.

    Either the subject begins within the query, or the query within the subject. Both
    are looked up in the least ids of dyadic blocks, so that a range costs rows by the
    logarithm of its width, however many it touches.
    """
    own = F.lit("*") if ignore_strand or not query.genomic else F.col("strand")
    s = subject.df.groupBy("seqname", "start", "end", own.alias("strand")).agg(F.min("range_id").alias("id"))
    meets = F.when(F.col("strand") == "*", F.array(F.lit("*"), F.lit("+"), F.lit("-"))).otherwise(F.array(F.lit("*"), F.col("strand")))
    s = s.withColumn("strand", F.explode(F.array(F.lit("*")) if ignore_strand or not query.genomic else meets))
    low, high = F.col("start") - 1, F.col("end") + 1
    q = query.df.filter((low <= subject.stats.high) & (high >= subject.stats.low)).select("range_id", "seqname", own.alias("strand"), low.alias("low"), high.alias("high"))
    q_levels, s_levels = (query.stats.width_max + 2).bit_length(), subject.stats.width_max.bit_length()
    place = ["seqname", "strand", "kind", "level", "block"]

    def table(df: DataFrame, kind: int, blocks: Column) -> DataFrame:
        return df.select("seqname", "strand", "id", F.lit(kind).alias("kind"), F.explode(blocks).alias("b")).select("seqname", "strand", "kind", "b.level", "b.block", "id")

    begins = table(s.groupBy("seqname", "strand", "start").agg(F.min("id").alias("id")), 0, _points(F.col("start"), q_levels))
    holds = table(s, 1, _blocks(F.col("start"), F.col("end"), s_levels))
    least = begins.union(holds).groupBy(*place).agg(F.min("id").alias("touching"))
    asked = q.withColumnRenamed("range_id", "id")
    asked = table(asked, 0, _blocks(F.col("low"), F.col("high"), q_levels)).union(table(asked, 1, _points(F.col("low"), s_levels)))
    # Exploded rows look few to the planner: a large side must not be broadcast.
    asked = asked.hint("merge") if min(query.stats.n, subject.stats.n) > BROADCAST_ROWS else asked
    return asked.join(least, place).groupBy(F.col("id").alias("query_id")).agg(F.min("touching").alias("touching"))


def _by_strand(plus: Column, minus: Column, both: Column, stranded: bool) -> Column:
    if not stranded:
        return plus
    return F.when(F.col("strand") == "+", plus).when(F.col("strand") == "-", minus).otherwise(both)


def _one_way(query: RangeSet, subject, ignore_strand: bool, ahead: bool) -> DataFrame:
    flag("ignore_strand", ignore_strand)
    subject = prepare(query, subject)
    stranded = query.genomic and not ignore_strand
    sides = _sides(query, subject, ignore_strand)
    plus = F.col("after_plus" if ahead else "before_plus")
    minus = F.col("before_minus" if ahead else "after_minus") if stranded else plus
    best = _by_strand(plus, minus, F.least(plus, minus) if stranded else plus, stranded)
    return sides.select(F.col("range_id").alias("query_id"), best["id"].alias("subject_id"))


@checked
def precede(query: RangeSet, subject, *, ignore_strand: bool = False, threads: int | None = None) -> DataFrame:
    """``(query_id, subject_id)``: the nearest subject that the query comes before.

    On ``-`` the direction is reversed; a ``*`` query looks both ways, forward to
    ``+`` and ``*`` subjects and backward to ``-`` and ``*`` ones. Null where there
    is none.
    """
    return _one_way(query, subject, ignore_strand, True)


@checked
def follow(query: RangeSet, subject, *, ignore_strand: bool = False, threads: int | None = None) -> DataFrame:
    """``(query_id, subject_id)``: the nearest subject that the query comes after."""
    return _one_way(query, subject, ignore_strand, False)


@checked
def distance_to_nearest(query: RangeSet, subject, *, ignore_strand: bool = False, threads: int | None = None) -> DataFrame:
    """``(query_id, subject_id, distance)`` of queries with any compatible subject.

    The distance is the number of positions between the two, 0 where they overlap
    or touch; a tie goes to the least subject id.
    """
    flag("ignore_strand", ignore_strand)
    subject = prepare(query, subject)
    stranded = query.genomic and not ignore_strand
    sides = _sides(query, subject, ignore_strand)
    plus, minus = (F.least(F.col(f"after_{c}"), F.col(f"before_{c}")) if c == "plus" or stranded else None for c in ("plus", "minus"))
    beside = _by_strand(plus, minus, F.least(plus, minus) if stranded else plus, stranded)
    if overlap.dense(query, subject) and not query.stats.has_empty and not subject.stats.has_empty:
        touching = least_touching(query, subject, not stranded)
    else:
        touching = hits(query, subject, Match(max_gap=0, ignore_strand=not stranded)).groupBy("query_id").agg(F.min("subject_id").alias("touching"))
    out = sides.select(F.col("range_id").alias("query_id"), beside.alias("beside")).join(touching, "query_id", "left")
    nearest = F.least(F.when(F.col("touching").isNotNull(), F.struct(F.lit(0).cast("long").alias("distance"), F.col("touching").alias("id"))), F.col("beside"))
    return out.select("query_id", nearest["id"].alias("subject_id"), nearest["distance"].alias("distance")).filter("subject_id is not null")


nearest = distance_to_nearest

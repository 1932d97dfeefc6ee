"""Finding, counting and joining overlapping ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeloom.functions.predicate import Match
from rangeloom.model import RangeSet, checked, flag, same_kind, word
from rangeloom.plans import binning
from rangeloom.plans.ordered import Running, chunk_width, scan, spread
from rangeloom.sources.index import SubjectIndex

SELECT = ("all", "first", "last", "arbitrary")
DENSE = 8  # expected matches a range from which counting without pairs pays


def subject_ranges(subject: RangeSet | SubjectIndex) -> RangeSet:
    return subject.ranges if isinstance(subject, SubjectIndex) else subject


def prepare(query: RangeSet, subject: RangeSet | SubjectIndex) -> RangeSet:
    if not isinstance(query, RangeSet):
        raise TypeError("query must be a RangeSet")
    if not isinstance(subject, (RangeSet, SubjectIndex)):
        raise TypeError("subject must be a RangeSet or a SubjectIndex")
    subject_set = subject_ranges(subject)
    same_kind(query, subject_set)
    query.check_circular("query")
    subject_set.check_circular("subject")
    return subject_set


def hits(query: RangeSet, subject: RangeSet, m: Match) -> DataFrame:
    found = binning.pairs(query, subject, m)
    return found.select(F.col("q_range_id").alias("query_id"), F.col("s_range_id").alias("subject_id"))


@checked
def find_overlaps(query: RangeSet, subject: RangeSet | SubjectIndex, *, select: str = "all", deterministic: bool = False, threads: int | None = None, **match) -> DataFrame:
    """``(query_id, subject_id)`` of all matches, or with ``select`` one row a query.

    ``first`` and ``arbitrary`` take the least subject id, ``last`` the greatest;
    null where nothing matches. ``deterministic`` sorts the result. ``threads`` is
    accepted and leaves parallelism to the cluster.
    """
    word("select", select, SELECT)
    subject = prepare(query, subject)
    found = hits(query, subject, Match(**match))
    if select != "all":
        pick = (F.max if select == "last" else F.min)("subject_id").alias("subject_id")
        best = found.groupBy("query_id").agg(pick)
        found = query.df.select(F.col("range_id").alias("query_id")).join(best, "query_id", "left")
    return found.orderBy("query_id", "subject_id") if deterministic else found


def rank_counts(query: RangeSet, subject: RangeSet, m: Match, groups: dict[str, Column] | None = None) -> DataFrame:
    """``query_id`` of every query and its count of ``any`` matches without pairs, for
    ranges that aren't empty: ``n``, or a column for each of ``groups``, which are
    conditions on subjects.

    A subject matches unless it begins too late or ends too early, and can't do
    both: the count is a difference of two running counts along the axis, of the
    begins (lane 0) up to the query's latest and of the ends (lane 1) before its first.
    """
    groups = {"n": F.lit(True)} if groups is None else groups
    names = list(groups)
    need = max(m.min_overlap, 1 if m.max_gap < 0 else 0)
    shift = need - 1 if need else -(m.max_gap + 1)
    wide_enough = F.col("end") - F.col("start") + 1 >= need
    marks = F.lit(None).cast("array<boolean>")
    q = query.df.select("seqname", "strand", (F.col("start") + shift).alias("start"), (F.col("end") - shift).alias("end"), F.col("range_id").alias("id"), wide_enough.alias("fits"), marks.alias("of"))
    s = subject.df.filter(wide_enough).select("seqname", "strand", "start", "end", F.lit(None).cast("long").alias("id"), F.lit(False).alias("fits"), F.array(*(F.coalesce(g, F.lit(False)) for g in groups.values())).alias("of"))
    rows, wide = q.union(s), chunk_width([query, subject], 2)
    if not wide:
        rows = spread(rows, ["seqname"], [query, subject])
    probe = F.col("id").isNotNull()
    event = lambda lane, at, rank: F.struct(F.lit(lane).alias("lane"), at.alias("pos"), rank.alias("rank"))
    begins = event(0, F.when(probe, F.col("end")).otherwise(F.col("start")), F.when(probe, 2).otherwise(1))
    ends = event(1, F.when(probe, F.col("start")).otherwise(F.col("end")), F.when(probe, 0).otherwise(1))
    events = rows.withColumn("e", F.explode(F.array(begins, ends))).select("seqname", "strand", "id", "fits", "of", "e.lane", "e.pos", "e.rank")
    classes = {"all": F.lit(True)} if m.ignore_strand or not query.genomic else {"all": F.lit(True), "plus": F.col("strand") != "-", "minus": F.col("strand") != "+"}
    specs = [Running(f"{c}_{k}", F.when(test & F.col("of")[k], 1).otherwise(0), "sum") for c, test in classes.items() for k in range(len(names))]
    run = scan(events, ["seqname", "lane"], [F.col("pos"), F.col("rank")], specs, "pos", wide).filter("id is not null")

    def of_class(k: int) -> Column:
        if len(classes) == 1:
            return F.col(f"all_{k}")
        return F.when(F.col("strand") == "+", F.col(f"plus_{k}")).when(F.col("strand") == "-", F.col(f"minus_{k}")).otherwise(F.col(f"all_{k}"))

    sign = F.when(~F.coalesce("fits", F.lit(False)) | F.col("seqname").isNull(), 0).when(F.col("lane") == 0, 1).otherwise(-1)
    counts = run.groupBy("seqname", "id").agg(*(F.sum(sign * of_class(k)).alias(f"_n{k}") for k in range(len(names))))
    return counts.select(F.col("id").alias("query_id"), *(F.col(f"_n{k}").alias(n) for k, n in enumerate(names)))


def countable(query: RangeSet, subject: RangeSet, m: Match, share: float = 1.0) -> bool:
    """Whether matches can be counted without pairs, and that pays, from a ``share`` of
    the usual density on."""
    return m.type == "any" and not query.stats.has_empty and not subject.stats.has_empty and dense(query, subject, share)


def dense(query: RangeSet, subject: RangeSet, share: float = 1.0) -> bool:
    """Whether ranges spread evenly would make many matches a range."""
    q, s = query.stats, subject.stats
    span = max(1, max(q.high, s.high) - min(q.low, s.low))
    return q.n * s.n / max(q.seqs, s.seqs) * min(1.0, (q.width_95 + s.width_95) / span) >= share * DENSE * (q.n + s.n)


@checked
def count_overlaps(query: RangeSet, subject: RangeSet | SubjectIndex, *, threads: int | None = None, deterministic: bool = False, **match) -> DataFrame:
    """``(query_id, overlap_count)`` of every query, 0 where nothing matches."""
    subject = prepare(query, subject)
    m = Match(**match)
    if countable(query, subject, m):
        return rank_counts(query, subject, m).select("query_id", F.col("n").cast("long").alias("overlap_count"))
    counts = hits(query, subject, m).groupBy("query_id").agg(F.count("*").alias("n"))
    out = query.df.select(F.col("range_id").alias("query_id")).join(counts, "query_id", "left")
    return out.select("query_id", F.coalesce("n", F.lit(0)).cast("long").alias("overlap_count"))


def overlaps_any(query: RangeSet, subject: RangeSet | SubjectIndex, **options) -> DataFrame:
    """``(query_id, overlaps_any)`` of every query."""
    return count_overlaps(query, subject, **options).select("query_id", (F.col("overlap_count") > 0).alias("overlaps_any"))


def _prefixed(rs: RangeSet, prefix: str, taken: list[str]) -> tuple[DataFrame, list[str]]:
    names = [prefix + c for c in rs.columns()]
    clash = sorted({n for n in names if n in taken or names.count(n) > 1})
    if clash:
        raise ValueError(f"the prefix {prefix!r} makes column names that are taken: {', '.join(clash)}")
    return rs.frame().select("range_id", *(F.col(f"`{c}`").alias(prefix + c) for c in rs.columns())), names


@checked
def overlap_join(query: RangeSet, subject: RangeSet, *, join: str = "inner", query_prefix: str = "query_", subject_prefix: str = "subject_", threads: int | None = None,
                 deterministic: bool = False, **match) -> DataFrame:
    """Matches with the prefixed columns of both sides; ``left`` keeps every query."""
    word("join", join, ("inner", "left"))
    subject = prepare(query, subject)
    q, q_names = _prefixed(query, query_prefix, ["query_id", "subject_id"])
    s, s_names = _prefixed(subject, subject_prefix, ["query_id", "subject_id", *q_names])
    # Pairs carry the columns of both sides: no join back by ids, of which one may be in very many pairs.
    found = binning.pairs(query, subject, Match(**match), tuple(query.meta), tuple(subject.meta))
    for p in "qs":
        found = found.withColumn(f"{p}_width", F.col(f"{p}_end") - F.col(f"{p}_start") + 1)
    sides = ((p, c, name) for p, rs, names in (("q", query, q_names), ("s", subject, s_names)) for c, name in zip(rs.columns(), names))
    found = found.select(F.col("q_range_id").alias("query_id"), F.col("s_range_id").alias("subject_id"), *(F.col(f"`{p}_{c}`").alias(name) for p, c, name in sides))
    out = found
    if join == "left":
        alone = q.withColumnRenamed("range_id", "query_id").join(found.select("query_id").distinct(), "query_id", "left_anti")
        out = found.unionByName(alone, allowMissingColumns=True)
    out = out.select("query_id", "subject_id", *(F.col(f"`{c}`") for c in (*q_names, *s_names)))
    return out.orderBy("query_id", "subject_id") if deterministic else out


def inner_overlap_join(query: RangeSet, subject: RangeSet, **options) -> DataFrame:
    return overlap_join(query, subject, join="inner", **options)


def left_overlap_join(query: RangeSet, subject: RangeSet, **options) -> DataFrame:
    return overlap_join(query, subject, join="left", **options)


def _counted(query: RangeSet, subject, prefix: str, some: bool, options: dict) -> DataFrame:
    q, names = _prefixed(query, prefix, ["query_id", "overlap_count"])
    counts = count_overlaps(query, subject, **options).filter("overlap_count > 0" if some else "overlap_count = 0")
    return counts.join(q.withColumnRenamed("range_id", "query_id"), "query_id").select("query_id", "overlap_count", *(F.col(f"`{c}`") for c in names))


def semi_overlap_join(query: RangeSet, subject: RangeSet | SubjectIndex, *, query_prefix: str = "query_", **options) -> DataFrame:
    """Queries with a match, and how many they have."""
    return _counted(query, subject, query_prefix, True, options)


def anti_overlap_join(query: RangeSet, subject: RangeSet | SubjectIndex, *, query_prefix: str = "query_", **options) -> DataFrame:
    """Queries without a match."""
    return _counted(query, subject, query_prefix, False, options)


@checked
def self_overlaps(ranges: RangeSet, *, drop_self: bool = True, drop_redundant: bool = True, deterministic: bool = False, threads: int | None = None, **match) -> DataFrame:
    """Matches within one set: each pair once unless ``drop_redundant`` is off."""
    flag("drop_self", drop_self)
    flag("drop_redundant", drop_redundant)
    prepare(ranges, ranges)
    a, b = F.col("q_range_id"), F.col("s_range_id")
    extra = a < b if drop_redundant else a != b if drop_self else None
    found = binning.pairs(ranges, ranges, Match(**match), extra=extra).select(a.alias("query_id"), b.alias("subject_id"))
    return found.orderBy("query_id", "subject_id") if deterministic else found

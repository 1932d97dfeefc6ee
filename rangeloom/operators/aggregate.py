"""Aggregates over the subjects that each query matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeloom.functions.predicate import Match
from rangeloom.model import RangeSet, checked, flag, word
from rangeloom.operators.overlap import count_overlaps, countable, prepare, rank_counts
from rangeloom.plans import binning

FUNCTIONS = ("count", "sum", "mean", "min", "max")
NULL_GROUP = "<NA>"
RANKED_GROUPS = 16  # groups up to which dense sets are counted without pairs


def _column(subject: RangeSet, name: str, what: str) -> str:
    word(what, name)
    if name not in subject.meta:
        raise ValueError(f"{what} {name!r} isn't a metadata column of subject")
    return name


def group_counts(query: RangeSet, subject: RangeSet, group_col: str, *, include_na_group: bool = False, **match) -> DataFrame:
    """``(query_id, group, overlap_count)`` of the groups that a query matches."""
    subject = prepare(query, subject)
    _column(subject, group_col, "group_col")
    flag("include_na_group", include_na_group)
    found = binning.pairs(query, subject, Match(**match), s_meta=(group_col,))
    group = F.col(f"`s_{group_col}`").cast("string")
    found = found.select(F.col("q_range_id").alias("query_id"), (F.coalesce(group, F.lit(NULL_GROUP)) if include_na_group else group).alias("group"))
    return found.filter("group is not null").groupBy("query_id", "group").agg(F.count("*").alias("overlap_count"))


@checked
def count_overlaps_by_group(query: RangeSet, subject: RangeSet, group_col: str, *, include_na_group: bool = False, max_groups: int = 10_000, threads: int | None = None,
                            deterministic: bool = False, **match) -> DataFrame:
    """A column of counts for every group in the whole subject, a row a query.

    Groups are in binary order; ranges without a group count under ``<NA>`` if
    asked for. More than ``max_groups`` groups are an error: use
    :func:`group_counts`, the long form, then.
    """
    counts = group_counts(query, subject, group_col, include_na_group=include_na_group, **match)
    subject = prepare(query, subject)
    groups = subject.df.select(F.col(f"`{group_col}`").cast("string").alias("g")).distinct().limit(max_groups + 1).collect()
    if len(groups) > max_groups:
        raise ValueError(f"more than {max_groups} groups; use group_counts")
    levels = sorted({NULL_GROUP if g is None else g for g in (r.g for r in groups) if g is not None or include_na_group}, key=lambda g: g.encode())
    out = query.df.select(F.col("range_id").alias("query_id"))
    if not levels:
        return out
    m = Match(**match)
    if len(levels) <= RANKED_GROUPS and countable(query, subject, m, 0.25):  # pairs would be shuffled twice more, by group and by query
        name = F.col(f"`{group_col}`").cast("string")
        name = F.coalesce(name, F.lit(NULL_GROUP)) if include_na_group else name
        return rank_counts(query, subject, m, {g: name == g for g in levels})
    wide = counts.groupBy("query_id").pivot("group", levels).agg(F.sum("overlap_count"))
    return out.join(wide, "query_id", "left").select("query_id", *(F.coalesce(F.col(f"`{g.replace('`', '``')}`"), F.lit(0)).alias(g) for g in levels))


@checked
def overlap_aggregate(query: RangeSet, subject: RangeSet, *, value_col: str | None = None, fun: str = "count", na_rm: bool = True, threads: int | None = None,
                      deterministic: bool = False, **match) -> DataFrame:
    """``(query_id, value)``: one number a query over the subjects it matches.

    ``count`` is 0 without a match; the others are null without a match, without
    a value that isn't missing, and with ``na_rm`` off if any value is missing.
    NaN and what is no number are missing.
    """
    word("fun", fun, FUNCTIONS)
    flag("na_rm", na_rm)
    if fun == "count":
        return count_overlaps(query, subject, **match).select("query_id", F.col("overlap_count").cast("double").alias("value"))
    subject = prepare(query, subject)
    _column(subject, value_col, "value_col")
    number = F.col(f"`s_{value_col}`").try_cast("double")
    found = binning.pairs(query, subject, Match(**match), s_meta=(value_col,)).select(F.col("q_range_id").alias("query_id"), F.nanvl(number, F.lit(None).cast("double")).alias("x"))
    made: Column = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}[fun]("x")
    values = found.groupBy("query_id").agg((made if na_rm else F.when(F.count("x") == F.count("*"), made)).alias("value"))
    return query.df.select(F.col("range_id").alias("query_id")).join(values, "query_id", "left")

"""Interval analytics on Spark DataFrames."""

from rangeloom.functions.predicate import Match
from rangeloom.model import RangeSet
from rangeloom.operators.aggregate import count_overlaps_by_group, group_counts, overlap_aggregate
from rangeloom.operators.algebra import disjoin, gaps, range_intersect, range_setdiff, range_union, reduce_ranges
from rangeloom.operators.coverage import coverage, tile_coverage
from rangeloom.operators.derived import cluster_overlaps, window_count_overlaps
from rangeloom.operators.nearest import distance_to_nearest, follow, nearest, precede
from rangeloom.operators.overlap import (
    anti_overlap_join,
    count_overlaps,
    find_overlaps,
    inner_overlap_join,
    left_overlap_join,
    overlap_join,
    overlaps_any,
    self_overlaps,
    semi_overlap_join,
)
from rangeloom.session import default_threads
from rangeloom.sources.bed import read_bed, write_bed
from rangeloom.sources.index import SubjectIndex, build_index, index_partitions, index_stats, load_index, save_index
from rangeloom.streaming import OverlapIterator, stream_overlaps

__all__ = [
    "Match", "OverlapIterator", "RangeSet", "SubjectIndex", "anti_overlap_join", "build_index", "cluster_overlaps", "count_overlaps", "count_overlaps_by_group",
    "coverage", "default_threads", "disjoin", "distance_to_nearest", "find_overlaps", "follow", "gaps", "group_counts", "index_partitions", "index_stats",
    "inner_overlap_join", "left_overlap_join", "load_index", "nearest", "overlap_aggregate", "overlap_join", "overlaps_any", "precede", "range_intersect",
    "range_setdiff", "range_union", "read_bed", "reduce_ranges", "save_index", "self_overlaps", "semi_overlap_join", "stream_overlaps", "tile_coverage",
    "window_count_overlaps", "write_bed",
]

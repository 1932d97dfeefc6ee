"""Overlaps of a stream of queries with a fixed subject set."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from rangeloom.functions.predicate import Match
from rangeloom.model import RangeSet
from rangeloom.operators.overlap import hits, prepare
from rangeloom.sources.index import SubjectIndex


def stream_overlaps(stream: DataFrame, index: SubjectIndex, sink: Callable[[DataFrame, int], None], **match) -> DataStreamWriter:
    """A writer that hands each micro-batch's matches to ``sink(matches, epoch)``.

    The join keeps no state, so no watermark is needed; a batch that is run again
    after a failure comes with its epoch, by which a sink can write it once.
    """
    m, genomic = Match(**match), index.ranges.genomic

    def batch(df: DataFrame, epoch: int) -> None:
        query = RangeSet(df, genomic)
        prepare(query, index)
        sink(hits(query, index.ranges, m), epoch)

    return stream.writeStream.foreachBatch(batch)

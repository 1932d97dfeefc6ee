"""Overlaps of one chunk of queries after another."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.functions.predicate import Match
from rangeloom.model import RangeSet, flag, number
from rangeloom.operators.derived import numbered
from rangeloom.operators.overlap import hits, prepare


class OverlapIterator:
    """Chunks of ``chunk_size`` queries in the order of their ids; each chunk's
    matches are a DataFrame with the queries' own ids."""

    def __init__(self, query: RangeSet, subject, *, chunk_size: int = 50_000, deterministic: bool = True, threads: int | None = None, **match):
        self.chunk_size, self.match = number("chunk_size", chunk_size, 1), Match(**match)
        self.deterministic = flag("deterministic", deterministic)
        self.subject = prepare(query, subject)
        self.query = query
        self._rows = numbered(query.bare(), "range_id", "_at").persist(StorageLevel.MEMORY_AND_DISK)
        self.query_n = self._rows.count()
        self.position = 1

    def __repr__(self) -> str:
        return f"OverlapIterator({self.query_n} queries, chunks of {self.chunk_size}, {max(0, self.query_n - self.position + 1)} left)"

    def has_next(self) -> bool:
        return self.position <= self.query_n

    def _found(self, low: int, high: int) -> DataFrame:
        part = self.query.derive(self._rows.filter(F.col("_at").between(low, high)).drop("_at"))
        part.__dict__["stats"] = self.query.stats  # the plan of the whole set fits its chunks
        found = hits(part, self.subject, self.match)
        return found.orderBy("query_id", "subject_id") if self.deterministic else found

    def next(self) -> DataFrame:
        """Matches of the next chunk; no rows when all are done."""
        low, self.position = self.position, min(self.position + self.chunk_size, self.query_n + 1)
        return self._found(low, self.position - 1)

    def reset(self) -> "OverlapIterator":
        self.position = 1
        return self

    def collect(self) -> DataFrame:
        """Matches of all the queries that are left."""
        low, self.position = self.position, self.query_n + 1
        return self._found(low, self.query_n)

    def __iter__(self):
        while self.has_next():
            yield self.next()

"""Running values along an axis, shared out over coordinate chunks.

A window over a whole sequence runs in one task. Where a table is long, rows are
cut into chunks of coordinates instead: windows run within a chunk, one row a
chunk is carried along the sequence, and the two are combined.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rangeloom.plans.components import ensure_checkpoint_dir
from rangeloom.session import default_threads

ROWS_PER_CHUNK = 500_000
ROWS_PER_TASK = 250_000


@dataclass(frozen=True)
class Running:
    """``kind``: ``sum`` or ``last`` up to and with a row; ``sum_before``,
    ``max_before``, ``previous`` of the rows before it; ``next`` of the rows after
    it. ``last``, ``previous`` and ``next`` skip nulls."""

    name: str
    value: Column
    kind: str


def chunk_width(sets: list, rows_a_range: int = 1) -> int | None:
    """Coordinates a chunk for events of some sets of ranges, or None where one
    window a sequence will do, since no sequence is long."""
    stats = [x.stats for x in sets]
    most = rows_a_range * sum(s.n if s.most is None else s.most for s in stats)
    low, high = min(s.low for s in stats), max(s.high for s in stats)
    chunks = most // ROWS_PER_CHUNK
    return max(1, (high - low) // chunks + 1) if chunks > 1 else None


def spread(df: DataFrame, keys: list[str], sets: list) -> DataFrame:
    """``df`` exchanged by ``keys`` ahead of all that is done by them: into more tasks
    than a shuffle makes where the sets are large, so that a task's rows don't grow
    with the input. Aggregates and scans by these keys need no exchange after it."""
    n = -(-sum(x.stats.n for x in sets) // ROWS_PER_TASK)
    return df.repartition(n, *keys) if n > default_threads(df.sparkSession) else df.repartition(*keys)


def scan(df: DataFrame, keys: list[str], order: list[Column], specs: list[Running], position: str, width: int | None) -> DataFrame:
    """``df`` with the running values, by ``keys`` in ``order``, whose first
    element must be the ascending ``position``."""
    df = df.select("*", *(s.value.alias(f"_v{k}") for k, s in enumerate(specs)))
    by = list(keys)
    if width:
        ensure_checkpoint_dir(df.sparkSession)
        # Read twice below, and by the scans after this one: made once.
        df = df.withColumn("_chunk", F.floor(F.col(position) / width)).checkpoint()
        by.append("_chunk")
    local = Window.partitionBy(*by).orderBy(*order)
    up_to = local.rowsBetween(Window.unboundedPreceding, 0)
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    # Looking on is looking back in the opposite order: a frame that ends with the
    # partition would be gone through anew for every row.
    after = Window.partitionBy(*by).orderBy(*(c.desc() for c in order)).rowsBetween(Window.unboundedPreceding, -1)

    def within(k: int, kind: str) -> Column:
        v = F.col(f"_v{k}")
        return {
            "sum": lambda: F.sum(v).over(up_to),
            "sum_before": lambda: F.sum(v).over(before),
            "max_before": lambda: F.max(v).over(before),
            "last": lambda: F.last(v, ignorenulls=True).over(up_to),
            "previous": lambda: F.last(v, ignorenulls=True).over(before),
            "next": lambda: F.last(v, ignorenulls=True).over(after),
        }[kind]()

    out = df.select("*", *(within(k, s.kind).alias(f"_r{k}") for k, s in enumerate(specs)))
    if not width:
        return _finish(out, df, specs, lambda k, s: F.coalesce(F.col(f"_r{k}"), F.lit(0)) if s.kind.startswith("sum") else F.col(f"_r{k}"))
    whole = local.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # One row a chunk: its totals, and its first and last values.
    ends = {
        "sum": lambda v: F.sum(v).over(whole), "sum_before": lambda v: F.sum(v).over(whole), "max_before": lambda v: F.max(v).over(whole),
        "last": lambda v: F.last(v, ignorenulls=True).over(whole), "previous": lambda v: F.last(v, ignorenulls=True).over(whole), "next": lambda v: F.first(v, ignorenulls=True).over(whole),
    }
    tops = df.select(*by, F.row_number().over(local).alias("_n"), *(ends[s.kind](F.col(f"_v{k}")).alias(f"_t{k}") for k, s in enumerate(specs)))
    tops = tops.filter("_n = 1").drop("_n")
    along = Window.partitionBy(*keys).orderBy("_chunk")
    past = along.rowsBetween(Window.unboundedPreceding, -1)
    future = Window.partitionBy(*keys).orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    carry = {
        "sum": lambda v: F.sum(v).over(past), "sum_before": lambda v: F.sum(v).over(past), "max_before": lambda v: F.max(v).over(past),
        "last": lambda v: F.last(v, ignorenulls=True).over(past), "previous": lambda v: F.last(v, ignorenulls=True).over(past), "next": lambda v: F.last(v, ignorenulls=True).over(future),
    }
    tops = tops.select(*by, *(carry[s.kind](F.col(f"_t{k}")).alias(f"_c{k}") for k, s in enumerate(specs)))
    out = out.join(tops, by)

    def merged(k: int, s: Running) -> Column:
        r, c = F.col(f"_r{k}"), F.col(f"_c{k}")
        if s.kind.startswith("sum"):
            return F.coalesce(r, F.lit(0)) + F.coalesce(c, F.lit(0))
        return F.greatest(r, c) if s.kind == "max_before" else F.coalesce(r, c)

    return _finish(out, df, specs, merged)


def _finish(out: DataFrame, df: DataFrame, specs: list[Running], value) -> DataFrame:
    plain = [c for c in df.columns if c != "_chunk" and not c.startswith("_v")]
    return out.select(*plain, *(value(k, s).alias(s.name) for k, s in enumerate(specs)))

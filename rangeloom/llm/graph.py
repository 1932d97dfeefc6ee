"""Connected components of an edge table, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.llm.common import delete_path, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """``(id, component)`` of every id on an edge between different ids.

    ``component`` is the least id reachable. Distributed union-find by alternating
    star contraction: every node hooks its larger neighbours to its least one,
    then its smaller ones and itself, until no edge changes; the rounds needed
    grow with the logarithm of the longest chain. Minima are combined before the
    shuffle, and each round's edges are written to the shared scratch folder.
    Loops and nulls are ignored; an empty table gives no rows.
    """
    spark = edges.sparkSession
    now, path = materialize(
        edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges"
    )
    last = _state(now)
    for _ in range(max_rounds):
        if not last[0]:
            break
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).union(now.select("v", "u"))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.filter("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following, new_path = materialize(small.union(low).distinct(), "edges")
        state = _state(following)
        delete_path(spark, path)
        now, path = following, new_path
        if state == last:
            break
        last = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # Every edge now joins a node to its component's least id.
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
    return tuple(r)

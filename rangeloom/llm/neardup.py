"""Near-duplicate documents by HyperMinHash sketches.

1. Every text becomes its set of word shingles and a sketch: least hash per
   bucket, stored as leading-zero count and mantissa bits. Equal sets become one
   class, represented by its least id, before anything is compared.
2. Bands of registers are hashed; representatives that share a band meet in a
   bucket. A bucket's members are compared with its least member only.
3. Where a bucket still holds more than one component, its members are compared
   in blocks: only pairs of different components whose collision-corrected
   estimate leaves the threshold within five standard deviations go on.
4. Both kinds of pairs are confirmed on the full sets; confirmed links form the
   components.

So pairs within a group are never listed as such: members of one component are
not compared again. Bands are chosen so that a pair at the threshold meets in no
bucket with a chance of less than one in a million.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.llm import hyperminhash as hmh
from rangeloom.llm.common import materialize, text_or_empty
from rangeloom.llm.graph import connected_components
from rangeloom.llm.shingles import jaccard_at_least, shingle_sets

BROADCAST_IDS = 1_000_000
BLOCK = 512
BLOCK_BYTES = 16 << 20


def plan_bands(percent: int, miss: float = 1e-6) -> tuple[int, int]:
    """``(bands, rows)``: the widest bands that lose a pair at the threshold less
    often than ``miss``."""
    t = percent / 100
    for rows in range(16, 0, -1):
        bands = hmh.BUCKETS // rows
        if (1 - t**rows) ** bands < miss:
            return bands, rows
    raise ValueError("the threshold is too low for the sketch")


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))


def sketch(df: DataFrame, words: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, fp, regs)``; ``fp`` identifies the set, ``regs`` is
    its sketch (null for a text without words; ``fp`` also without an id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for b in (x.slice(at, 1024) for x in batches for at in range(0, x.num_rows, 1024)):
            sets = shingle_sets(b.column(1), words)
            known = b.column(0).is_valid().to_pylist()
            fp = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) and k else None for s, k in zip(sets, known)]
            regs = [hmh.registers(s).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(fp, pa.binary()), pa.array(regs, pa.binary())],
                names=["doc_id", "n_shingles", "fp", "regs"],
            )

    return _texts(df, id_col, text_col).mapInArrow(run, "doc_id long, n_shingles long, fp binary, regs binary")


def _bands(reps: DataFrame, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for b in batches:
            if b.num_rows:
                regs = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, hmh.BUCKETS)
                keys = hmh.band_keys(regs, bands, rows).view(np.int64)
                ids = np.repeat(b.column(0).to_numpy(zero_copy_only=False), bands)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], names=["key", "rep"])

    return reps.select("rep", "regs").mapInArrow(run, "key long, rep long")


def _sets(df: DataFrame, ids: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """Shingle sets of some documents. Their ids are broadcast up to
    ``BROADCAST_IDS`` (8 MB); beyond it both sides are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                values = pa.array([s.tobytes() for s in shingle_sets(part.column(1), words)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), values], names=["id", "set"])

    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return _texts(df, id_col, text_col).join(side, "doc_id", "left_semi").mapInArrow(run, "id long, set binary")


def _confirm_stars(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` that reach the threshold on their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [
                jaccard_at_least(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent)
                for x, y in zip(b.column(2), b.column(3))
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    right = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    both = right.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _plausible(members: DataFrame, labels: DataFrame, reps: DataFrame, percent: int, bands: int, rows: int) -> DataFrame:
    """Pairs ``(a, b)`` of different components in a bucket, by their estimates.

    Buckets within one component are left out. Larger ones are split by a hash
    into blocks of about ``BLOCK`` members, and pairs of blocks are compared.
    """
    t = percent / 100
    cut = t - 5 * (t * (1 - t) / hmh.BUCKETS) ** 0.5
    member = F.struct("rep", "label", "regs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")

        def block(values: list[dict]) -> tuple[np.ndarray, ...]:
            regs = np.frombuffer(b"".join(v["regs"] for v in values), np.uint16).reshape(-1, hmh.BUCKETS)
            return np.array([v["rep"] for v in values]), np.array([v["label"] for v in values]), regs, hmh.band_keys(regs, bands, rows)

        for b in batches:
            left, right = [], []
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                p, q = block(row["p"]), block(row["q"])
                key = np.uint64(row["key"] & (1 << 64) - 1)
                for x in range(len(p[0])):
                    j = np.flatnonzero((p[1][x] != q[1]) & ((p[0][x] < q[0]) if row["same"] else True))
                    j = j[hmh.estimate(p[2][x], q[2][j]) >= cut]
                    # A pair that shares several bands is passed on by the first.
                    first = (p[3][x] == q[3][j]).argmax(axis=1) if len(j) else j
                    j = j[p[3][x][first] == key]
                    left.append(np.minimum(p[0][x], q[0][j]))
                    right.append(np.maximum(p[0][x], q[0][j]))
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])

    labelled = members.join(labels, members["rep"] == labels["id"], "left").select("key", "rep", F.coalesce("component", "rep").alias("label"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).filter("lo != hi")
    rows_in = labelled.join(mixed.select("key", "n"), "key").join(reps.select("rep", "regs"), "rep")
    rows_in = rows_in.withColumn("block", F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / BLOCK)))
    blocks = rows_in.groupBy("key", "block").agg(F.collect_list(member).alias("p"))
    other = blocks.select("key", F.col("block").alias("block2"), F.col("p").alias("q"))
    tiles = blocks.join(other, "key").filter("block <= block2").select("key", "p", "q", (F.col("block") == F.col("block2")).alias("same"))
    return tiles.mapInArrow(run, "a long, b long")


def _confirm_in_tiles(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that connect what the pairs that reach the threshold connect.

    Pairs are gathered by the component they form among themselves, each split
    into blocks of about ``BLOCK_BYTES`` of sets, so that a set is sent to as few
    tasks as there are blocks and not once a pair.
    """
    cluster = connected_components(pairs).withColumnRenamed("component", "cluster")
    sized = sets.join(cluster, "id").select("id", "cluster", "set")
    blocks = sized.groupBy("cluster").agg(F.ceil(F.sum(F.octet_length("set").cast("long")) / BLOCK_BYTES).alias("n"))
    place, _ = materialize(
        cluster.join(blocks, "cluster").select("id", "cluster", F.pmod(F.xxhash64("id"), F.greatest("n", F.lit(1))).alias("block")), "blocks"
    )
    tiles = (
        pairs.join(place.select(F.col("id").alias("a"), "cluster", F.col("block").alias("p")), "a")
        .join(place.select(F.col("id").alias("b"), F.col("block").alias("q")), "b")
        .select("a", "b", "cluster", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"))
    )
    tiles, _ = materialize(tiles, "tiles")
    wanted = tiles.select(F.col("cluster").alias("cluster"), F.col("p").alias("tp"), F.col("q").alias("tq"), F.explode(F.array_distinct(F.array("p", "q"))).alias("block")).distinct()
    content = place.join(wanted, ["cluster", "block"]).join(sets, "id").select("cluster", "tp", "tq", "id", "set")

    def run(listed: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        have = {i: np.frombuffer(s, np.uint64) for i, s in zip(held["id"], held["set"])}
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        out = []
        for a, b in zip(listed["a"], listed["b"]):
            ra, rb = root(a), root(b)
            if ra != rb and jaccard_at_least(have[a], have[b], percent):
                up[max(ra, rb)] = min(ra, rb)
                out.append((a, b))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return tiles.groupBy("cluster", "p", "q").cogroup(content.groupBy("cluster", "tp", "tq")).applyInPandas(run, "a long, b long")


def near_duplicates(df: DataFrame, *, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, a row a row of ``df``.

    Documents are linked when ``100 * intersection >= percent * union`` of their
    sets of ``words``-word shingles (A-Z in lower case). ``component_id`` is the
    least id reachable over links, ``kept`` whether that is the document itself.
    A text of fewer words is one shingle; a null, empty or blank text has none and
    is linked with nothing. Rows of equal id are one document, repeated. A row
    whose id is null is linked with nothing, its component is null, and it is kept.
    """
    bands, rows = plan_bands(percent)
    sk, _ = materialize(sketch(df, words, id_col=id_col, text_col=text_col), "sketches")
    reps, _ = materialize(
        sk.filter("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.any_value("regs").alias("regs")), "classes"
    )
    keyed = _bands(reps, bands, rows)
    buckets = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("pivot")).filter("n > 1")
    members, _ = materialize(keyed.join(buckets.select("key", "pivot"), "key"), "members")
    stars, _ = materialize(members.filter("rep != pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct(), "stars")
    ids = members.select(F.col("rep").alias("doc_id")).distinct()
    sets, _ = materialize(_sets(df, ids, words, id_col, text_col), "sets")
    links, _ = materialize(_confirm_stars(stars, sets, percent), "links")
    rest, _ = materialize(_plausible(members, connected_components(links), reps, percent, bands, rows).join(stars, ["a", "b"], "left_anti"), "pairs")
    if not rest.isEmpty():
        more, _ = materialize(_confirm_in_tiles(rest, sets, percent), "links")
        links = links.union(more)
    # Rows that share a set share its class; so do rows that share an id.
    components = connected_components(links)
    classes = reps.join(components, reps["rep"] == components["id"], "left").select("fp", F.coalesce("component", "rep").alias("component"))
    return sk.join(classes, "fp", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )

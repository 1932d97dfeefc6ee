"""Range tables: closed integer intervals, optionally on named, stranded sequences."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, wraps

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CORE = ("range_id", "seqname", "start", "end", "strand")
STRANDS = ("+", "-", "*")
_PLAIN = "range"


@dataclass(frozen=True)
class Stats:
    """A few numbers that plans are chosen by."""

    n: int
    low: int
    high: int
    width_95: int
    width_max: int
    has_empty: bool
    seqs: int = 1
    most: int | None = None  # rows of the fullest sequence; None if unknown
    sizes: tuple[int, ...] | None = None  # bit lengths of the widths; None if unknown


class RangeSet:
    """A DataFrame of ranges with a unique ``range_id``, and what is known of it.

    ``genomic`` sets have ``seqname`` and ``strand``; plain ones lie on a single
    axis without strand. Any other columns are metadata. ``seqinfo`` (genomic
    only) has ``seqname, seqlength, is_circular``, a row a sequence.
    """

    def __init__(self, df: DataFrame, genomic: bool, seqinfo: DataFrame | None = None):
        need = CORE if genomic else ("range_id", "start", "end")
        if not isinstance(df, DataFrame):
            raise TypeError("ranges have to come as one DataFrame; anything else is not currently supported")
        missing = [c for c in need if c not in df.columns]
        if missing:
            raise ValueError(f"a {'genomic' if genomic else 'plain'} range table needs the columns {', '.join(missing)}")
        clash = [] if genomic else [c for c in ("seqname", "strand") if c in df.columns]
        if clash:
            raise ValueError(f"a plain range table can't have the columns {', '.join(clash)}; use RangeSet.of_genomic")
        self.genomic, self.seqinfo = genomic, seqinfo
        self.meta = [c for c in df.columns if c not in need]
        numbers = [F.col(c).cast("long").alias(c) for c in ("range_id", "start", "end")]
        place = [F.col("seqname").cast("string").alias("seqname"), F.col("strand").cast("string").alias("strand")] if genomic else [F.lit(_PLAIN).alias("seqname"), F.lit("*").alias("strand")]
        self.df = df.select(numbers[0], place[0], numbers[1], numbers[2], place[1], *(F.col(f"`{c}`") for c in self.meta))

    @classmethod
    def of_plain(cls, df: DataFrame) -> "RangeSet":
        return cls(df, False)

    @classmethod
    def of_genomic(cls, df: DataFrame, seqinfo: DataFrame | None = None) -> "RangeSet":
        return cls(df, True, seqinfo)

    def derive(self, df: DataFrame) -> "RangeSet":
        """The same kind of set over other rows (core columns, any metadata)."""
        return RangeSet(df if self.genomic else df.drop("seqname", "strand"), self.genomic, self.seqinfo)

    def bare(self) -> DataFrame:
        return self.df.select(*CORE)

    def columns(self) -> list[str]:
        """Columns of the set as a data frame: place, width, metadata."""
        return (["seqname"] if self.genomic else []) + ["start", "end", "width"] + (["strand"] if self.genomic else []) + self.meta

    def frame(self) -> DataFrame:
        return self.df.withColumn("width", F.col("end") - F.col("start") + 1).select("range_id", *(F.col(f"`{c}`") for c in self.columns()))

    @cached_property
    def stats(self) -> Stats:
        width = F.greatest(F.col("end") - F.col("start") + 1, F.lit(0))
        bits = F.length(F.bin(width)).cast("int")  # ranges by the bit length of their width
        per = self.df.select("seqname", "start", "end", width.alias("w"), bits.alias("bits")).groupBy("seqname", "bits")
        per = per.agg(F.count("*").alias("n"), F.min("start").alias("low"), F.max("end").alias("high"), F.max("w").alias("w"), F.max(F.col("w") == 0).alias("empty"))
        per = per.withColumn("of_seq", F.sum("n").over(Window.partitionBy("seqname")))
        rows = per.groupBy("bits").agg(
            F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("w").alias("w"), F.max("empty").alias("empty"), F.max("of_seq").alias("most"),
            F.sum(F.col("n") / F.col("of_seq")).alias("seqs"),
        ).collect()
        rows.sort(key=lambda r: r["bits"])  # a row a bit length
        n = sum(r["n"] for r in rows)
        before, usual = 0, 1
        for r in rows:
            usual = r["w"] if before < 0.95 * n else usual
            before += r["n"]
        return Stats(
            n, min((r["low"] for r in rows), default=0), max((r["high"] for r in rows), default=0), max(1, usual), max([1, *(r["w"] for r in rows)]), any(r["empty"] for r in rows),
            max(1, round(sum(r["seqs"] for r in rows))), max((r["most"] for r in rows), default=0), tuple(r["bits"] for r in rows),
        )

    def check_circular(self, what: str) -> None:
        """Circular sequences can't be used; ones that no range lies on may be listed."""
        if self.seqinfo is not None and "is_circular" in self.seqinfo.columns:
            used = self.seqinfo.filter("is_circular").join(self.df.select("seqname").distinct(), "seqname", "left_semi")
            if not used.isEmpty():
                raise ValueError(f"{what} lies on circular sequences, which are not currently supported")


def same_kind(query: RangeSet, subject: RangeSet) -> None:
    if query.genomic != subject.genomic:
        raise ValueError("query and subject must both be plain or both be genomic")


def side(rs: RangeSet, prefix: str, *extra: str) -> DataFrame:
    """Core columns under a prefix, so that two sets can be joined."""
    return rs.df.select(*(F.col(f"`{c}`").alias(prefix + c) for c in (*CORE, *extra)))


def number(name: str, value, least: int) -> int:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        raise ValueError(f"{name} has to be one finite numeric value")
    if int(value) < least:
        raise ValueError(f"{name} needs a value >= {least}")
    return int(value)


def flag(name: str, value) -> bool:
    if not isinstance(value, bool):
        raise ValueError(f"{name} has to be one logical value")
    return value


def word(name: str, value, choices: tuple[str, ...] | None = None) -> str:
    if not isinstance(value, str) or not value:
        raise ValueError(f"{name} has to be one non-empty character value")
    if choices and value not in choices:
        raise ValueError(f"{name} must be one of {', '.join(choices)}")
    return value


def strand_column(ignore: bool) -> Column:
    return F.lit("*") if ignore else F.col("strand")


def checked(operator: Callable) -> Callable:
    """An operator that looks at ``threads`` and ``deterministic`` before it begins."""

    @wraps(operator)
    def run(*args, **options):
        if options.get("threads") is not None:
            number("threads", options["threads"], 1)
        if "deterministic" in options:
            flag("deterministic", options["deterministic"])
        return operator(*args, **options)

    return run

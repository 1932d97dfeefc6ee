"""Positions of regular-expression matches, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def running_sums(sizes: Column) -> Column:
    """Sum of the elements before each element (array<bigint>).

    Sums of blocks of about sqrt(n) elements are kept, so that n sums take
    n * sqrt(n) additions and no array is copied.
    """
    width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(sizes))).cast("int"))
    zero, add = F.lit(0).cast("bigint"), lambda a, b: a + b

    def within(pair: Column) -> Column:
        values, w = pair["v"], pair["w"]
        blocks = F.transform(F.sequence(F.lit(0), w), lambda b: F.aggregate(F.slice(values, b * w + 1, w), zero, add))
        return F.transform(
            F.array(F.struct(values.alias("v"), w.alias("w"), blocks.alias("b"))),
            lambda x: F.transform(
                x["v"],
                lambda _, i: F.aggregate(F.slice(x["b"], F.lit(1), F.floor(i / x["w"]).cast("int")), zero, add)
                + F.aggregate(F.slice(x["v"], F.floor(i / x["w"]).cast("int") * x["w"] + 1, i % x["w"]), zero, add),
            ),
        )[0]

    # The one-element arrays bind their value to a name, so it is computed once.
    return F.transform(F.array(F.struct(sizes.alias("v"), width.alias("w"))), within)[0]


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches (array<string>)."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def positions(text: Column, pattern: str, found: Column) -> Column:
    """``array<struct<start,end,text>>`` of the matches ``found`` in ``text``.

    Offsets count code points from 0, the end exclusive. What ``split`` leaves
    between the matches gives the distances; it runs only where there is a match.
    """
    empty = F.expr("cast(array() as array<struct<start:bigint,end:bigint,text:string>>)")
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("bigint"))

    def build(pair: Column) -> Column:
        m, g = pair["m"], pair["g"]
        steps = F.zip_with(g, m, lambda a, b: F.coalesce(a, F.lit(0)).cast("bigint") + F.coalesce(F.length(b), F.lit(0)).cast("bigint"))
        return F.transform(
            F.array(F.struct(m.alias("m"), g.alias("g"), running_sums(steps).alias("at"))),
            lambda x: F.transform(
                x["m"],
                lambda t, i: F.struct(
                    (x["at"][i] + x["g"][i]).alias("start"),
                    (x["at"][i] + x["g"][i] + F.length(t)).alias("end"),
                    t.alias("text"),
                ),
            ),
        )[0]

    return F.when(F.size(found) > 0, F.transform(F.array(F.struct(found.alias("m"), gaps.alias("g"))), build)[0]).otherwise(empty)


def keys(spans: Column, kind: str | None = None) -> Column:
    """``kind:start:end`` of each span."""
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind) if kind else s["kind"], s["start"].cast("string"), s["end"].cast("string")))


def replace(text: Column, spans: Column, tag) -> Column:
    """``text`` with each span replaced by ``tag(span)``.

    ``spans`` are sorted by start; one that begins before the end of the span
    before it is merged with it, under the first one's tag.
    """
    empty = F.expr("cast(array() as array<string>)")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("out"))

    def step(acc: Column, s: Column) -> Column:
        before = F.when(s["start"] >= acc["at"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")))
        added = F.when(s["start"] >= acc["at"], F.array(before, tag(s))).otherwise(empty)
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], added).alias("out"))

    def done(acc: Column) -> Column:
        rest = F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))
        return F.concat(F.array_join(acc["out"], ""), rest)

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, done)).otherwise(text)

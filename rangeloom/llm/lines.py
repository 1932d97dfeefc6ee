"""Fuzzy line deduplication with built-in functions only.

A line's shingles are its runs of ``SHINGLE`` UTF-16 units (a shorter line is one
shingle). Exact copies share a class, known by two 64-bit hashes.

*Signature.* Each shingle draws a bucket and a priority from its hash; a line's
minimum in each of ``MINIMA`` buckets is the least priority drawn there, so two
lines agree in a bucket about as often as their similarity. Lines of few shingles
draw again and again, with later draws ranked after all earlier ones; lines of many
keep low priorities only, for the others can't be minima. Either way a line makes
about ``DRAWS`` rows, whatever its script, its length or its separators, and no
shingle is left out for where it stands. Lines of far fewer distinct shingles than
positions (``-----``) are found by their empty buckets and drawn for once more from
their distinct shingles.

*Candidates.* The minima form groups of six, a row each; a band is three of a group,
and no minimum is in two bands. A pair of similarity 0.8 shares none of the ten bands
in about 0.1 % of cases, one of 0.85 in 0.01 %. Every member of a bucket is proposed
with one of them, its pivot, then in buckets of three or more the members of
different components with one another, in blocks. Sketches (a byte a minimum) drop
proposals that agree in fewer than ``AGREE`` of the minima, which costs a pair at 0.8
its link in 0.03 % of cases.

*Verification.* Bit sets of the shingles' hashes rule out pairs for certain. Exact
Jaccard similarity of the whole shingle sets confirms the rest, and distributed
union-find keeps one line a component. Of the pairs that could link the same two
components the likeliest is tested first; the others only if the two are still apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeloom.llm.common import delete_path, materialize, release, text_or_empty
from rangeloom.llm.graph import connected_components

SHINGLE, GROUPS, SIZE, BAND = 8, 5, 6, 3
MINIMA = GROUPS * SIZE
DRAWS = 3 * MINIMA
AT_ONCE = 2  # so many groups' bands are exchanged at a time, so that one part's files are on disk
FILLED, AGREE = 23, 16
BLOCK = 512
BROADCAST_ROWS = 500_000
SIFT_WORDS = 1 << 19  # of 64 bits
HOT = 10_000  # classes of more than one in so many lines are few enough to broadcast
_PRIORITY = 24  # bits
_FULL = r"[^\t\r\x20]"
_NODE = ["h1", "h2"]
_MINIMA = [f"m{k}" for k in range(SIZE)]  # of a group
PARTS, WORDS = 4, 8  # of a bit set, and of each part
_SKETCH = [f"s{k}" for k in range(GROUPS)]


def _lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, no, line)``; blank lines are left out."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    return lines.filter(F.col("line").rlike(_FULL))


def _hashed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, no, h1, h2, line)``: lines with the hashes of their class."""
    return _lines(df, id_col, text_col).select("doc_id", "no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), "line").alias("h2"), "line")


def _small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it is no longer than ``BROADCAST_ROWS``."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _sift(rows: DataFrame, some: DataFrame, key: str) -> DataFrame:
    """``rows`` without most of those whose ``key``, a hash, isn't in ``some``.

    A bit for each key of ``some``, in a table of bounded size, is broadcast."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(key).bitwiseAND(F.lit(63)).cast("int"))
    word = F.shiftright(key, 6).bitwiseAND(F.lit(SIFT_WORDS - 1))
    words = some.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    return rows.withColumn("word", word).join(F.broadcast(words), "word").filter(F.col("bits").bitwiseAND(bit) != 0).drop("word", "bits")


def _among(rows: DataFrame, some: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with a table that few of them match. If that is too long to be
    broadcast, the rows are sifted (by the first key) before they are exchanged."""
    if some.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(some), on, how)
    return _sift(rows, some, on[0]).join(some, on, how)


def _once() -> Column:
    """A column that is never negative. A filter that reads it isn't moved before its
    projection, whose expressions would else be evaluated again for each use there."""
    return F.spark_partition_id().alias("once")


def _last(units: Column) -> Column:
    """Where the last shingle begins."""
    return F.greatest(F.lit(0), F.floor(F.octet_length(units) / 2).cast("int") - SHINGLE)


def _set(line: Column) -> Column:
    """The hashes of a line's distinct shingles."""
    starts = lambda u: F.sequence(F.lit(1), _last(u) * 2 + 1, F.lit(2))
    return F.array_distinct(F.transform(F.array(F.encode(line, "UTF-16BE")), lambda u: F.transform(starts(u), lambda i: F.xxhash64(F.substr(u, i, F.lit(2 * SHINGLE)))))[0])


def _shingle_hash(units: Column, start: Column) -> Column:
    return F.xxhash64(F.substr(units, start * 2 + 1, F.lit(2 * SHINGLE)))


def _minima(df: DataFrame, hash_at) -> DataFrame:
    """``(h1, h2, g, m0, ..., m5)``, a row for each class and group of minima, of rows
    ``(h1, h2, n, ...)`` with ``n`` hashes each, the one at a place given by
    ``hash_at``. A missing minimum is -1."""
    n, whole = F.col("n"), F.lit(1 << _PRIORITY)
    rounds = F.ceil(F.lit(float(DRAWS)) / n).cast("int")
    bound = F.when(n > DRAWS, (F.lit(float(DRAWS << _PRIORITY)) / n).cast("long")).otherwise(whole)
    rows = df.select("*", bound.alias("bound"), F.explode(F.sequence(F.lit(0), rounds - 1)).alias("again"))
    # After a class's first round comes a row without a value for each group, so that none is lost.
    placed = rows.select("*", F.explode(F.sequence(F.lit(0), n + F.when(F.col("again") == 0, GROUPS - 1).otherwise(-1))).alias("i"))
    own = placed.select(*_NODE, "n", "bound", "i", "again", hash_at(F.col("i")).alias("own"))
    hashed = own.select(*_NODE, "n", "bound", "i", "again", F.when(F.col("again") == 0, F.col("own")).otherwise(F.xxhash64("own", "again")).alias("h"), _once())
    low = F.col("h").bitwiseAND(F.lit((1 << _PRIORITY) - 1))
    drawn = hashed.filter(((low < F.col("bound")) | (F.col("i") >= n)) & (F.col("once") >= 0))
    bucket = F.when(F.col("i") < n, F.pmod(F.shiftright("h", 40), F.lit(MINIMA)).cast("int")).otherwise((F.col("i") - n) * SIZE)
    drawn = drawn.select(*_NODE, bucket.alias("bucket"), F.when(F.col("i") < n, (F.col("again") * whole + low).cast("int")).alias("rank"))
    drawn = drawn.select(*_NODE, F.expr(f"cast(bucket div {SIZE} as int)").alias("g"), F.expr(f"bucket % {SIZE}").alias("at"), "rank")
    made = drawn.groupBy(*_NODE, "g").agg(*(F.min(F.when(F.col("at") == k, F.col("rank"))).alias(m) for k, m in enumerate(_MINIMA)))
    return made.select(*_NODE, "g", *(F.coalesce(m, F.lit(-1)).alias(m) for m in _MINIMA))


def _empty(minima: list[str]) -> Column:
    """How many of the minima are missing."""
    return sum(((F.col(m) < 0).cast("int") for m in minima[1:]), (F.col(minima[0]) < 0).cast("int"))


def _bands() -> list[Column]:
    """The keys of a group's bands; 0 if two or more of a band's minima are missing."""
    parts = [_MINIMA[k : k + BAND] for k in range(0, SIZE, BAND)]
    return [F.when(_empty(p) < 2, F.xxhash64("g", F.lit(k), *p)).otherwise(F.lit(0).cast("long")) for k, p in enumerate(parts)]


def _word() -> Column:
    """A group's minima in a byte each."""
    out = F.lit(0).cast("long")
    for m in _MINIMA:
        out = F.shiftleft(out, 8).bitwiseOR(F.xxhash64(m).bitwiseAND(F.lit(255)))
    return out


def _agree(a: str, b: str) -> Column:
    """In how many bytes two sketches (columns under prefixes) agree."""
    low, out = F.lit(0x7F7F7F7F7F7F7F7F), F.lit(MINIMA - 8 * len(_SKETCH))  # unused bytes always agree
    for s in _SKETCH:
        x = F.col(a + s).bitwiseXOR(F.col(b + s))
        # No carry leaves its byte (the highest is unused); a byte's top bit stays clear if the byte is 0.
        differs = (x.bitwiseAND(low) + low).bitwiseOR(x).bitwiseOR(low)
        out = out + F.bit_count(F.bitwise_not(differs))
    return out


def _classes(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``(h1, h2, g, m0, ...)`` of every class of lines and group of minima, and
    ``(doc_id, no, h1, h2)`` of every line."""
    spark = df.sparkSession
    lines = _hashed(df, id_col, text_col)
    units = lines.select(*_NODE, F.encode("line", "UTF-16BE").alias("u"))
    found, _ = materialize(_minima(units.select("*", (_last(F.col("u")) + 1).alias("n")), lambda i: _shingle_hash(F.col("u"), i)), "minima")
    release(spark)
    # Too many empty buckets: shingles repeat within the line, or there are fewer than it draws for.
    empty = found.select(*_NODE, _empty(_MINIMA).alias("empty")).filter("empty > 0").groupBy(*_NODE).agg(F.sum("empty").alias("empty"))
    again, _ = materialize(empty.filter(F.col("empty") > MINIMA - FILLED).select(*_NODE, F.lit(True).alias("again")), "again")
    again = _small(again)
    places, _ = materialize(lines.join(again, _NODE, "left").select("doc_id", "no", *_NODE, F.when(F.col("again"), F.col("line")).alias("line")), "lines")
    texts = places.filter("line is not null").select(*_NODE, "line").distinct()
    sets = texts.select(*_NODE, _set(F.col("line")).alias("set")).withColumn("n", F.size("set"))
    redone, _ = materialize(_minima(sets, lambda i: F.get("set", i)), "minima")
    classes = found.join(again, _NODE, "left_anti").union(redone)
    return classes, places.select("doc_id", "no", *_NODE)


def _members(classes: DataFrame) -> DataFrame:
    """``(key, code, pivot, n)`` of the classes in each bucket of ``n``, two or more."""
    out = None
    for first in range(0, GROUPS, AT_ONCE):
        groups = classes.filter(F.col("g").between(first, first + AT_ONCE - 1))
        keyed = groups.select(F.col("h1").alias("code"), F.explode(F.array(*_bands())).alias("key")).filter("key != 0")
        shared = keyed.groupBy("key").agg(F.max("code").alias("pivot"), F.min("code").alias("other"), F.count("*").alias("n")).filter("pivot != other").select("key", "pivot", "n")
        shared, path = materialize(shared, "shared")
        release(classes.sparkSession)
        part, _ = materialize(_among(keyed, shared, ["key"]), "members")
        delete_path(classes.sparkSession, path)
        out = part if out is None else out.union(part)
    return out


def _across(members: DataFrame, labels: DataFrame, sketches: DataFrame) -> DataFrame:
    """Likely pairs ``(p, q, lo, hi)`` of members of one bucket that have different
    labels, the lesser ``lo`` and the greater ``hi``.

    A bucket is cut into blocks by a hash of its members; each pair of blocks is
    a join key of its own, so a large bucket is shared out over the tasks, and
    pairs that the sketches rule out never leave the join.
    """
    # The one pair of a bucket of two is its pivot's.
    labelled, _ = materialize(members.filter("n > 2").select("key", "code").join(_small(labels), "code"), "labelled")
    mixed = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).filter("lo != hi")
    rows = labelled.join(mixed.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "key").join(_small(sketches), "code")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("code"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.col("block"), F.col("blocks") - 1))
    a = rows.select("key", F.col("block").alias("i"), other.alias("j"), F.col("code").alias("p"), F.col("label").alias("p_label"), *(F.col(s).alias(f"p_{s}") for s in _SKETCH))
    other = F.explode(F.sequence(F.lit(0), F.col("block")))
    b = rows.select("key", other.alias("i"), F.col("block").alias("j"), F.col("code").alias("q"), F.col("label").alias("q_label"), *(F.col(s).alias(f"q_{s}") for s in _SKETCH))
    pair = ((F.col("i") < F.col("j")) | (F.col("p") > F.col("q"))) & (F.col("p") != F.col("q")) & (F.col("p_label") != F.col("q_label")) & (_agree("p_", "q_") >= AGREE)
    return a.join(b, ["key", "i", "j"]).filter(pair).select(F.greatest("p", "q").alias("p"), F.least("p", "q").alias("q"), F.least("p_label", "q_label").alias("lo"), F.greatest("p_label", "q_label").alias("hi")).distinct()


def _likely(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs of codes whose sketches agree often enough."""
    p = sketches.select(F.col("code").alias("p"), *(F.col(s).alias(f"p_{s}") for s in _SKETCH))
    q = sketches.select(F.col("code").alias("q"), *(F.col(s).alias(f"q_{s}") for s in _SKETCH))
    return pairs.join(_small(p), "p").join(_small(q), "q").filter(_agree("p_", "q_") >= AGREE).select("p", "q").distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    """The codes of pairs."""
    return pairs.select(F.col("p").alias("code")).union(pairs.select("q")).distinct()


def _bit_sets(lines: DataFrame) -> DataFrame:
    """``(code, n, bits, ones)`` of candidate lines: how many shingles they have (repeated
    ones counted), bits of the shingles' hashes in words, and how many bits are set."""
    units = lines.select("code", F.encode("line", "UTF-16BE").alias("u"))
    at = units.select("code", "u", F.explode(F.sequence(F.lit(0), _last(F.col("u")))).alias("i"))
    hashes = at.select("code", _shingle_hash(F.col("u"), F.col("i")).alias("h"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int"))
    word = F.shiftright("h", 6).bitwiseAND(F.lit(WORDS - 1))
    part = F.shiftright("h", 32).bitwiseAND(F.lit(PARTS - 1))
    each = [f"b{k}" for k in range(WORDS)]
    parts = hashes.groupBy("code", part.alias("part")).agg(F.count("*").alias("n"), *(F.bit_or(F.when(word == k, bit)).alias(b) for k, b in enumerate(each)))
    made = parts.groupBy("code").agg(F.sum("n").alias("n"), *(F.max(F.when(F.col("part") == k, F.col(b))).alias(f"{b}_{k}") for k in range(PARTS) for b in each))
    made = made.select("code", "n", F.array(*(F.coalesce(f"{b}_{k}", F.lit(0).cast("long")) for k in range(PARTS) for b in each)).alias("bits"))
    return made.select("*", _total(F.transform("bits", F.bit_count)).alias("ones"))


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0), lambda a, b: a + b)


def _possible(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The pairs of codes that their bit sets don't rule out, with ``most``, a bound of
    their similarity.

    With a and b shingles that only the one or only the other has, the similarity
    is (|A| - a) / (|A| + b); a bit that only one line has is a shingle that only it
    has, and the number of positions is an upper bound of |A|. So no pair that
    reaches the threshold is lost.
    """
    x = bits.select(F.col("code").alias("p"), "n", F.col("bits").alias("x"), F.col("ones").alias("x_ones"))
    y = bits.select(F.col("code").alias("q"), F.col("bits").alias("y"), F.col("ones").alias("y_ones"))
    shared = _total(F.zip_with("x", "y", lambda v, w: F.bit_count(v.bitwiseAND(w))))
    both = pairs.join(x, "p").join(y, "q").select(*pairs.columns, "n", "x_ones", "y_ones", shared.alias("shared"), _once()).filter("once >= 0")
    both = both.select(*pairs.columns, (F.col("n") - F.col("x_ones") + F.col("shared")).alias("left"), (F.col("n") + F.col("y_ones") - F.col("shared")).alias("of"))
    return both.filter(100 * F.col("left") >= percent * F.col("of")).select(*pairs.columns, (F.col("left") / F.col("of")).alias("most"))


def _confirm(pairs: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """Of pairs of codes, the pairs ``(a, b)`` of nodes that reach the threshold, with
    the pairs' other columns."""
    more = [c for c in pairs.columns if c not in ("p", "q")]
    a = lines.select(F.struct(*_NODE).alias("a"), F.col("code").alias("p"), F.col("line").alias("x"))
    b = lines.select(F.struct(*_NODE).alias("b"), F.col("code").alias("q"), F.col("line").alias("y"))
    # Sets, then counts, then the test: each step is kept from being repeated in the next.
    sets = pairs.join(a, "p").join(b, "q").select("a", "b", *more, _set(F.col("x")).alias("s"), _set(F.col("y")).alias("t"), _once()).filter("once >= 0")
    both = sets.select("a", "b", *more, (F.size("s") + F.size("t")).alias("sum"), F.size(F.array_intersect("s", "t")).alias("both"), _once())
    return both.filter((100 * F.col("both") >= percent * (F.col("sum") - F.col("both"))) & (F.col("once") >= 0)).select("a", "b", *more)


def _confirm_across(pairs: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """Links ``(a, b)`` that join all components ``lo`` and ``hi`` that ``pairs``
    ``(p, q, lo, hi, most)`` can join: the likeliest pair of each two is tested, then
    all pairs of those that it leaves apart."""
    best = pairs.groupBy("lo", "hi").agg(F.max(F.struct("most", "p", "q")).alias("best")).select("lo", "hi", "best.p", "best.q")
    best, _ = materialize(best, "best")
    links, _ = materialize(_confirm(best, lines, percent), "links")
    ends = links.select(F.col("lo").alias("label"), F.col("hi").alias("other")).union(links.select("hi", "lo"))
    joined, _ = materialize(ends.groupBy("label").agg(F.min("other").alias("other")).select("label", F.least("label", "other").alias("now")), "joined")
    rest = pairs.select("p", "q", "lo", "hi").join(_small(best.select("p", "q")), ["p", "q"], "left_anti").join(_small(links.select("lo", "hi").distinct()), ["lo", "hi"], "left_anti")
    for end in ("lo", "hi"):
        rest = rest.join(_small(joined.select(F.col("label").alias(end), F.col("now").alias(f"{end}_now"))), end, "left")
    rest = rest.filter(F.coalesce("lo_now", "lo") != F.coalesce("hi_now", "hi")).select("p", "q")
    more, _ = materialize(_confirm(rest, lines, percent), "links")
    return links.select("a", "b").union(more)


def line_components(df: DataFrame, *, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, no, first)`` of every line that isn't blank: ``first`` is the
    ``(doc_id, no)`` of the first line of its component."""
    places, shared = _shared_lines(df, percent, id_col, text_col)
    shared, _ = materialize(shared, "components")
    alone = places.join(shared, ["doc_id", "no"], "left_anti").select("doc_id", "no", F.struct("doc_id", "no").alias("first"))
    return shared.union(alone)


def _shared_lines(df: DataFrame, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, no, h1, h2)`` of all lines, and ``(doc_id, no, first)`` of those
    whose component has other lines too."""
    spark = df.sparkSession
    classes, places = _classes(df, id_col, text_col)
    members = _members(classes)
    codes, _ = materialize(members.select("code").distinct(), "codes")
    known = _among(classes.select(F.col("h1").alias("code"), "h2", "g", *_MINIMA), codes, ["code"], "left_semi").select("code", "h2", "g", _word().alias("five"))
    words = (F.max(F.when(F.col("g") == k, F.col("five"))).alias(x) for k, x in enumerate(_SKETCH))
    known = known.groupBy("code", "h2").agg(*words).select(F.col("code").alias("h1"), "h2", "code", *_SKETCH)
    known, _ = materialize(known, "sketches")
    sketches, _ = materialize(known.select("code", *_SKETCH).dropDuplicates(["code"]), "sketches")
    stars = members.filter("code != pivot").select(F.col("pivot").alias("p"), F.col("code").alias("q")).distinct()
    stars, _ = materialize(_likely(stars, sketches), "stars")
    found = _among(_hashed(df, id_col, text_col).select(*_NODE, "line"), known.select(*_NODE, "code"), _NODE)
    lines, _ = materialize(found.distinct(), "candidates")
    ends, _ = materialize(_ends(stars), "ends")
    bits, _ = materialize(_bit_sets(lines.join(_small(ends), "code", "left_semi")), "bits")
    links, _ = materialize(_confirm(_possible(stars, bits, percent).select("p", "q"), lines, percent), "links")

    # A bucket of several components: compare across them, not within them.
    nodes = known.select("code", F.struct(*_NODE).alias("node"))
    joined = connected_components(links).select(F.col("id").alias("node"), F.col("component").alias("label"))
    labels, _ = materialize(nodes.join(joined, "node", "left").select("code", F.coalesce("label", "node").alias("label")), "labels")
    rest, _ = materialize(_across(members, labels, sketches).join(stars, ["p", "q"], "left_anti"), "pairs")
    others, _ = materialize(_ends(rest).join(_small(ends), "code", "left_anti"), "ends")
    added, _ = materialize(_bit_sets(lines.join(_small(others), "code", "left_semi")), "bits")
    bits = bits.union(added)
    rest, _ = materialize(_possible(rest, bits, percent), "pairs")
    more = _confirm_across(rest, lines, percent)
    release(spark)
    return places, _first_lines(places, connected_components(links.union(more)))


def _first_lines(places: DataFrame, components: DataFrame) -> DataFrame:
    """The first line of each line's component, for lines that aren't alone."""
    classes = places.groupBy(*_NODE).agg(F.min(F.struct("doc_id", "no")).alias("first"), F.count("*").alias("n"))
    classes = classes.join(components.select("id.h1", "id.h2", "component"), _NODE, "left").filter("n > 1 or component is not null")
    classes, _ = materialize(classes, "repeated")
    firsts = classes.filter("component is not null").groupBy("component").agg(F.min("first").alias("of_all"))
    classes = classes.join(firsts, "component", "left").select(*_NODE, "n", F.coalesce("of_all", "first").alias("first"))
    # Fewer than HOT classes can each hold more than one in HOT of all lines: those
    # are broadcast, so that a line of every document is no join key.
    many = places.count() / HOT
    hot = classes.filter(F.col("n") > many).select(*_NODE, F.col("first").alias("at_once"))
    split = places.join(F.broadcast(hot), _NODE, "left")
    cold = split.filter("at_once is null").drop("at_once").join(classes.filter(F.col("n") <= many).drop("n"), _NODE)
    return split.filter("at_once is not null").select("doc_id", "no", F.col("at_once").alias("first")).union(cold.select("doc_id", "no", "first"))


def dedup_lines(df: DataFrame, *, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, text, n_lines, n_kept, n_full)``: the texts without repeated lines.

    ``n_full`` counts the lines left that aren't blank. With ``carry``, those
    columns come along in a struct ``row``.

    Lines (split at ``\\n``) are linked when the Jaccard similarity of their
    shingle sets is at least ``percent`` hundredths; of a component only the line
    of the least document id, and there of the least position, stays. Blank lines
    are neither linked nor removed. ``n_lines`` counts all lines, ``n_kept`` those
    left; a null or empty text is one blank line and comes back empty. Ids must be
    unique: rows of equal id are one document; lines of a null id stay.
    """
    known = df.filter(F.col(id_col).isNotNull())
    _, shared = _shared_lines(known, percent, id_col, text_col)
    repeated = shared.filter((F.col("first.doc_id") != F.col("doc_id")) | (F.col("first.no") != F.col("no")))
    dropped, _ = materialize(repeated.groupBy("doc_id").agg(F.collect_set("no").alias("dropped")), "dropped")
    row = [F.struct(*carry).alias("row")] if carry else []
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"), *row)
    row = ["row"] if carry else []
    # Broadcast up to a million line numbers (8 MB), however they are spread.
    size = dropped.agg(F.sum(F.size("dropped"))).first()[0] or 0
    out = docs.join(F.broadcast(dropped) if size <= 2 * BROADCAST_ROWS else dropped, "doc_id", "left").select("doc_id", "text", "dropped", F.split("text", "\n").alias("lines"), *row)
    kept = F.when(F.col("dropped").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda _, i: ~F.array_contains("dropped", i)))
    out = out.select("doc_id", "text", F.size("lines").cast("long").alias("n_lines"), "dropped", kept.alias("kept"), *row)
    text = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n"))
    full = F.size(F.filter("kept", lambda t: t.rlike(_FULL))).cast("long")
    return out.select("doc_id", text.alias("text"), "n_lines", F.size("kept").cast("long").alias("n_kept"), full.alias("n_full"), *row)

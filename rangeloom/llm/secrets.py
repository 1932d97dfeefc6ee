"""Secrets: known shapes, and strings that a battery of randomness tests accepts.

Built-in functions only. Candidates are runs of ``16`` token characters and more
that aren't plain words (letters only, of one case or capitalised: a secret of that
kind is left out). Each gets an inferred encoding, the smallest alphabet that holds
it; its characters become numbers in that alphabet, on which run

* a chi-squared test of uniformity over nine equal-probability bins (8 degrees
  of freedom),
* the Wald-Wolfowitz runs test about the middle of the alphabet, and
* the lag-one serial correlation.

The sum of the three is chi-squared with ten degrees of freedom for random text;
a candidate whose upper tail, in closed form, is below ``min_random`` isn't random
and is out. The others are weighed against ordinary text: under a fixed model of
words, numbers, paths and identifiers (chances of the next character's kind, and of
the letter), the ratio of the string's chance to its chance as random text of its
encoding is a valid p-value, as a ratio of likelihoods reaches 1/p with a chance of
at most p. It needs nothing of the table at hand, and sharpens with every character
of a string. Within each length class the Benjamini-Hochberg rule at ``fdr`` then
picks the strings that are reported.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rangeloom.llm import spans as sp
from rangeloom.llm.common import materialize, text_or_empty

# Possessive repeats and the look-behind match the same text as plain ones, since
# what follows is outside the repeated class; they keep long runs linear.
BASE = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++""",
    "access": r"AKIA[A-Z0-9]++",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
}
_VALUE = r"""[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)$"""
CANDIDATE = r"(?<![\p{L}\p{N}+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}+(?![\p{L}\p{N}+/_=-])"
# name, pattern, alphabet in numeric order
ENCODINGS = [
    ("hex", "^[0-9a-f]+$", "0123456789abcdef"),
    ("HEX", "^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", "^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("upper36", "^[A-Z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("lower36", "^[a-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", "^[A-Za-z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "^[A-Za-z0-9+/]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "^[A-Za-z0-9_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("any", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
]
BINS, LEVELS, CLASSES = 9, 400, 6
ORDINARY = r"^[A-Za-z]?[a-z]+$|^[A-Z]+$"
# Ordinary text: kinds of characters (lower, upper, digit, mark), the chances of the
# first one's kind and of the next one's kind after each, and letters in 1/1000.
KINDS = [(2, ENCODINGS[8][2][52:62]), (1, ENCODINGS[8][2][:26]), (0, ENCODINGS[8][2][26:52]), (3, "+/-_")]
FIRST = [0.50, 0.30, 0.15, 0.05]
AFTER = [[0.90, 0.02, 0.02, 0.06], [0.55, 0.35, 0.04, 0.06], [0.03, 0.02, 0.80, 0.15], [0.55, 0.20, 0.20, 0.05]]
LETTERS = dict(zip("abcdefghijklmnopqrstuvwxyz", [80, 16, 32, 42, 130, 19, 21, 40, 74, 4, 10, 45, 27, 72, 74, 22, 4, 64, 68, 83, 33, 11, 14, 5, 12, 8]))


def _codes(text: Column) -> tuple[Column, Column, Column]:
    """Encoding's name, its size and the text's numbers in it (padding left out)."""
    body = F.regexp_replace(text, "=+$", "")
    name, size, alphabet = F.lit(None), F.lit(None), F.lit(None)
    for n, pattern, letters in reversed(ENCODINGS):
        test = text.rlike(pattern) if pattern else F.lit(True)
        name = F.when(test, n).otherwise(name)
        size = F.when(test, len(letters)).otherwise(size)
        alphabet = F.when(test, letters).otherwise(alphabet)
    codes = F.transform(F.array(alphabet), lambda a: F.transform(F.filter(F.split(body, ""), lambda c: c != ""), lambda c: F.instr(a, c) - 1))[0]
    return name, size, codes


def randomness(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with ``encoding`` and ``p_random`` of ``text_col``.

    ``p_random``: the chance that random text of its encoding deviates at least
    as much in uniformity, runs and serial correlation together.
    """
    name, size, codes = _codes(F.col(text_col))
    df = df.select("*", name.alias("encoding"), size.cast("double").alias("_k"), codes.alias("_c"))
    df = df.select("*", F.size("_c").cast("double").alias("_n"), ((F.col("_k") - 1) / 2).alias("_mid"))
    # Alphabet letters split unevenly over nine bins: expected counts follow the letters.
    bin_of = lambda c: F.floor(c * BINS / F.col("_k"))
    letters = lambda b: F.ceil((b + 1) * F.col("_k") / BINS) - F.ceil(b * F.col("_k") / BINS)
    chi = F.aggregate(
        F.sequence(F.lit(0), F.lit(BINS - 1)),
        F.lit(0.0),
        lambda s, b: F.transform(
            F.array(F.struct(F.size(F.filter("_c", lambda c: bin_of(c) == b)).alias("o"), (F.col("_n") * letters(b) / F.col("_k")).alias("e"))),
            lambda x: s + (x["o"] - x["e"]) * (x["o"] - x["e"]) / x["e"],
        )[0],
    )
    pairs = F.arrays_zip(F.slice("_c", F.lit(1), F.greatest(F.size("_c") - 1, F.lit(0))).alias("a"), F.slice("_c", F.lit(2), F.greatest(F.size("_c"), F.lit(1))).alias("b"))
    df = df.select(
        "*",
        chi.alias("_chi"),
        (1 + F.size(F.filter(pairs, lambda p: (p["a"] > F.col("_mid")) != (p["b"] > F.col("_mid"))))).cast("double").alias("_runs"),
        F.size(F.filter("_c", lambda c: c > F.col("_mid"))).cast("double").alias("_up"),
        F.aggregate(pairs, F.lit(0.0), lambda s, p: s + (p["a"] - F.col("_mid")) * (p["b"] - F.col("_mid"))).alias("_lag"),
        F.aggregate("_c", F.lit(0.0), lambda s, c: s + (c - F.col("_mid")) * (c - F.col("_mid"))).alias("_var"),
    )
    down = F.col("_n") - F.col("_up")
    mean = 1 + 2 * F.col("_up") * down / F.col("_n")
    var = (mean - 1) * (mean - 2) / F.greatest(F.col("_n") - 1, F.lit(1.0))
    # All on one side: as unlikely as n equal tosses.
    runs = F.when(var > 0, (F.col("_runs") - mean) * (F.col("_runs") - mean) / var).otherwise(F.col("_n"))
    serial = F.when(F.col("_var") > 0, F.col("_n") * F.pow(F.col("_lag") / F.col("_var"), 2)).otherwise(F.lit(0.0))
    df = df.select("*", ((F.col("_chi") + runs + serial) / 2).alias("_x"))
    x = F.col("_x")
    tail = F.exp(-x) * (1 + x * (1 + x / 2 * (1 + x / 3 * (1 + x / 4))))
    return df.select("*", tail.alias("p_random")).drop("_k", "_c", "_n", "_mid", "_chi", "_runs", "_up", "_lag", "_var", "_x")


def text_chance(letter: str, before: str | None) -> float:
    """Chance of a character after another (None: as the first) in ordinary text."""
    kind = next(k for k, letters in KINDS if letter in letters)
    row = FIRST if before is None else AFTER[next(k for k, letters in KINDS if before in letters)]
    share = {0: LETTERS.get(letter, 0) / sum(LETTERS.values()), 1: 1 / 26, 2: 1 / 10, 3: 1 / 4}[kind]
    return row[kind] * share


def as_text(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with ``level``: tenths of decimal orders by which the string is less
    likely as ordinary text than as random text of its encoding (0 to ``LEVELS``);
    its p-value is at most ``10 ** (-level / 10)``."""
    letters = "".join(a for _, a in KINDS)
    numbers = lambda values: F.expr(f"array({', '.join(f'{v!r}D' for v in values)})")
    # log10 of a kind's chance first, then after each kind; of a letter's within its kind.
    kinds = numbers([math.log10(x) for row in (FIRST, *AFTER) for x in row])
    shares = numbers([math.log10(text_chance(c, None) / FIRST[k]) for k, a in KINDS for c in a])
    _, size, _ = _codes(F.col(text_col))
    body = F.regexp_replace(text_col, "=+$", "")
    codes = F.transform(F.filter(F.split(body, ""), lambda c: c != ""), lambda c: F.instr(F.lit(letters), c) - 1)
    df = df.select("*", size.cast("double").alias("_k"), codes.alias("_c"))
    ends = [sum(len(a) for _, a in KINDS[: k + 1]) for k in range(len(KINDS))]
    kind = lambda c: F.when(c < ends[0], KINDS[0][0]).when(c < ends[1], KINDS[1][0]).when(c < ends[2], KINDS[2][0]).otherwise(KINDS[3][0])
    df = df.select("*", F.transform("_c", lambda c: kind(c)).alias("_s"))
    steps = F.transform("_c", lambda c, i: F.get(shares, c) + F.get(kinds, F.when(i == 0, F.lit(0)).otherwise(4 * (F.get("_s", i - 1) + 1)) + F.get("_s", i)))
    df = df.select("*", F.aggregate(steps, F.lit(0.0), lambda a, x: a + x).alias("_t"))
    below = F.size("_c") * F.log10("_k") + F.col("_t")
    return df.select("*", F.greatest(F.lit(0), F.least(F.lit(LEVELS), F.floor(below * -10))).cast("int").alias("level")).drop("_k", "_c", "_s", "_t")


def _length_class(text: Column) -> Column:
    """Lengths of 16, 21, 27, 36, 48 and 64 characters begin a class."""
    return F.least(F.floor(F.log2(F.length(text) / 16.0) * 2.5), F.lit(CLASSES - 1)).cast("int")


def thresholds(tested: DataFrame, fdr: float) -> DataFrame:
    """``(length_class, min_level)`` by Benjamini-Hochberg; at most six rows.

    ``tested`` has a row a distinct string: ``length_class`` and ``level``. The
    counts per class and level are a fixed-size table.
    """
    counts = tested.groupBy("length_class", "level").agg(F.count("*").alias("n"))
    at_least = Window.partitionBy("length_class").orderBy(F.desc("level"))
    whole = Window.partitionBy("length_class")
    ranked = counts.select("length_class", "level", F.sum("n").over(at_least).alias("found"), F.sum("n").over(whole).alias("all"))
    passing = ranked.filter(F.pow(F.lit(10.0), -F.col("level") / 10) * F.col("all") <= fdr * F.col("found"))
    return passing.groupBy("length_class").agg(F.min("level").alias("min_level"))


def find_secrets(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fdr: float = 0.05, min_random: float = 1e-4) -> DataFrame:
    """``(doc_id, spans)``: every secret of every whole text.

    ``spans`` holds structs ``(start, kind_no, kind, end, text)`` by start, then
    kind: ``assign``, ``access`` and ``hex`` by their shapes, ``random`` for
    strings that pass the battery and overlap none of these. A null or empty text
    has no spans; rows are kept as often as they occur; an empty table gives no
    rows. The texts are read once: what was found in them is written to the
    shared scratch folder before the thresholds are counted.
    """
    out = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    patterns = BASE | {"random": CANDIDATE}
    out = out.select("*", *(sp.matches(F.col("text"), p).alias(f"m_{k}") for k, p in patterns.items()))
    usual = lambda t: t.rlike(ORDINARY)
    found = out.select(
        "doc_id",
        *(sp.positions(F.col("text"), p, F.col(f"m_{k}")).alias(f"s_{k}") for k, p in BASE.items()),
        # Positions cost more than the matches, and most long strings are ordinary words.
        F.when(F.exists("m_random", lambda t: ~usual(t)), sp.positions(F.col("text"), CANDIDATE, F.col("m_random"))).alias("s_random"),
    )
    found = found.select(
        "doc_id",
        F.filter("s_assign", lambda s: F.length(F.regexp_extract(s["text"], _VALUE, 1)) >= 6).alias("s_assign"),
        F.filter("s_access", lambda s: F.length(s["text"]) >= 20).alias("s_access"),
        "s_hex",
        F.filter("s_random", lambda s: ~usual(s["text"])).alias("s_random"),
    )
    found, _ = materialize(found, "secrets")
    strings = found.select(F.explode("s_random.text").alias("s")).distinct()
    tested = as_text(randomness(strings, "s").filter(F.col("p_random") >= min_random).select("s"), "s")
    cuts = thresholds(tested.select(_length_class(F.col("s")).alias("length_class"), "level"), fdr).collect()
    level = F.lit(LEVELS + 1)
    for row in cuts:  # a row a length class
        level = F.when(F.col("length_class") == row["length_class"], row["min_level"]).otherwise(level)

    def base(kind: str, no: int) -> Column:
        return F.transform(f"s_{kind}", lambda s: F.struct(s["start"].alias("start"), F.lit(no).alias("kind_no"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["text"].alias("text")))

    found = found.select("doc_id", F.concat(*(base(k, i) for i, k in enumerate(BASE))).alias("base"), "s_random", F.monotonically_increasing_id().alias("row"))
    free = found.select("row", "base", F.explode("s_random").alias("r")).filter(
        ~F.exists("base", lambda s: (s["start"] < F.col("r.end")) & (F.col("r.start") < s["end"]))
    )
    free = randomness(free.select("row", F.col("r.start").alias("start"), F.col("r.end").alias("end"), F.col("r.text").alias("s")), "s")
    free = as_text(free.filter(F.col("p_random") >= min_random), "s").withColumn("length_class", _length_class(F.col("s"))).filter(F.col("level") >= level)
    added = free.groupBy("row").agg(
        F.collect_list(F.struct("start", F.lit(len(BASE)).alias("kind_no"), F.lit("random").alias("kind"), "end", F.col("s").alias("text"))).alias("added")
    )
    none = F.expr("cast(array() as array<struct<start:bigint,kind_no:int,kind:string,end:bigint,text:string>>)")
    return found.join(added, "row", "left").select("doc_id", F.array_sort(F.concat("base", F.coalesce("added", none))).alias("spans"))

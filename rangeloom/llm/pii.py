"""Personal data: proposed by patterns, confirmed by checksums, scored by context.

Built-in functions only. Patterns propose spans; validators drop those that fail
(octets of an address, Luhn for cards, mod-97 for bank account numbers, issued
ranges for social-security numbers); words within ``CONTEXT`` characters before or
after a span raise its score, some before it lower it. ``BASE`` kinds stay whatever their score; the
others need ``min_score``, so that context decides for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeloom.llm import spans as sp
from rangeloom.llm.common import text_or_empty

# A start just after the same class of character can't begin a leftmost match
# unless the match before ended there; saying so keeps long runs linear. The
# possessive repeats match the same text, as what follows is outside the class.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ADDED = {
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
_PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.6, "ssn": 0.3}
_NEAR = {
    "email": "mail|contact|courriel|correo|kontakt|write to",
    "ip": r"\bip\b|address|host|server|login",
    "card": "card|visa|mastercard|credit|carte|karte|tarjeta",
    "phone": r"phone|tel\b|call|mobile|fax|telefon|t[ée]l[ée]",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": r"ssn|social|security|tax",
}
_AGAINST = r"version|order|invoice|isbn|serial|figure|chapter|\bv\.?$"
CONTEXT = 40


def _valid(kind: str, text: Column) -> Column:
    digits = F.regexp_replace(text, "[^0-9]", "")
    if kind == "ip":
        return text.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "ssn":
        return ~text.rlike("^(?:000|666|9)|-00-|-0000$")
    if kind == "iban":
        plain = F.replace(text, F.lit(" "), F.lit(""))
        turned = F.concat(F.expr("''"), F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
        # Letters count 10 to 35; the remainder is carried over the characters.
        rest = F.aggregate(
            F.split(turned, ""),
            F.lit(0),
            lambda r, c: F.when(c == "", r)
            .when(c.between("0", "9"), (r * 10 + F.ascii(c) - 48) % 97)
            .otherwise((r * 100 + F.ascii(c) - 55) % 97),
        )
        return F.length(plain).between(15, 34) & (rest == 1)
    return F.lit(True)


def find_pii(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_score: float = 0.5, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, text, spans)``: every personal-data span of every whole text.

    ``spans`` holds structs ``(kind, start, end, text, score)`` by kind as listed,
    then start. Each kind is searched left to right without overlaps; a match
    that fails its check is dropped and not tried again. A null or empty text has
    no spans (its text is returned empty); rows are kept as often as they occur.
    With ``carry``, those columns come along in a struct ``row``.
    """
    kinds = BASE | ADDED
    row = ["row"] if carry else []
    out = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"), *(F.struct(*carry).alias(r) for r in row))
    out = out.select("*", *(sp.matches(F.col("text"), p).alias(f"m_{k}") for k, p in kinds.items()))
    out = out.select("doc_id", "text", *row, *(sp.positions(F.col("text"), p, F.col(f"m_{k}")).alias(f"s_{k}") for k, p in kinds.items()))

    def scored(kind: str) -> Column:
        def score(s: Column) -> Column:
            from_ = F.greatest(s["start"] - CONTEXT, F.lit(0)).cast("int")
            before = F.lower(F.substring(F.col("text"), from_ + 1, s["start"].cast("int") - from_))
            after = F.lower(F.substring(F.col("text"), s["end"].cast("int") + 1, F.lit(CONTEXT)))
            near = before.rlike(_NEAR[kind]) | after.rlike(_NEAR[kind])
            value = F.lit(_PRIOR[kind]) + F.when(near, 0.3).otherwise(0.0) - F.when(before.rlike(_AGAINST), 0.2).otherwise(0.0)
            return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"),
                            F.round(F.least(value, F.lit(1.0)), 3).alias("score"))

        kept = F.transform(F.filter(F.col(f"s_{kind}"), lambda s: _valid(kind, s["text"])), score)
        return kept if kind in BASE else F.filter(kept, lambda s: s["score"] >= min_score)

    return out.select("doc_id", "text", F.concat(*(scored(k) for k in kinds)).alias("spans"), *row)


def redact(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, text, spans)`` with each span's text replaced by ``<KIND>``.

    Overlapping spans of different kinds become one replacement, named after the
    one that starts first (at a tie the longer).
    """
    row = ["row"] if carry else []
    found = find_pii(df, id_col=id_col, text_col=text_col, carry=carry)
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), s["end"].alias("end"), s["kind"].alias("kind"))))
    found = found.select("doc_id", "text", "spans", ordered.alias("ordered"), *row)
    return found.select(
        "doc_id", sp.replace(F.col("text"), F.col("ordered"), lambda s: F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))).alias("text"), "spans", *row
    )

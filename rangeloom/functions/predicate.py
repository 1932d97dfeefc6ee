"""When two ranges match."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from rangeloom.model import flag, number, word

TYPES = ("any", "start", "end", "within", "equal")


@dataclass(frozen=True)
class Match:
    """Options of a match.

    ``max_gap`` -1 asks for a shared position, 0 and more also accepts ranges that
    many positions apart; ``min_overlap`` asks for that many shared positions.
    The other types bound the distance of starts, of ends, or of both by
    ``max_gap`` (0 if it is -1), or ask for the query to lie in the subject, there
    with at most ``max_gap`` more positions in the subject if it is above 0.
    """

    type: str = "any"
    max_gap: int = -1
    min_overlap: int = 0
    ignore_strand: bool = False

    def __post_init__(self):
        word("type", self.type, TYPES)
        object.__setattr__(self, "max_gap", number("max_gap", self.max_gap, -1))
        object.__setattr__(self, "min_overlap", number("min_overlap", self.min_overlap, 0))
        flag("ignore_strand", self.ignore_strand)

    @property
    def slack(self) -> int:
        return max(self.max_gap, 0)


def overlap_condition(m: Match, q: str = "q_", s: str = "s_") -> Column:
    """The match of columns with prefixes ``q`` and ``s``, apart from the sequence."""
    qs, qe, ss, se = (F.col(p + c) for p in (q, s) for c in ("start", "end"))
    ok = F.greatest(ss - qe, qs - se) - 1 <= m.max_gap
    if m.min_overlap > 0:
        ok &= F.least(qe, se) - F.greatest(qs, ss) + 1 >= m.min_overlap
    if m.type in ("start", "equal"):
        ok &= F.abs(qs - ss) <= m.slack if m.slack else qs == ss
    if m.type in ("end", "equal"):
        ok &= F.abs(qe - se) <= m.slack if m.slack else qe == se
    if m.type == "within":
        ok &= (qs >= ss) & (qe <= se)
        if m.max_gap > 0:
            ok &= (se - ss) - (qe - qs) <= m.max_gap
    if not m.ignore_strand:
        a, b = F.col(q + "strand"), F.col(s + "strand")
        ok &= (a == "*") | (b == "*") | (a == b)
    return ok

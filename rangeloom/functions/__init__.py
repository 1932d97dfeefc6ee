"""Column expressions."""

from rangeloom.functions.predicate import Match, overlap_condition

__all__ = ["Match", "overlap_condition"]

"""First-match rules, tiers, bins and label maps as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from patronage.functions.numeric import col


def first_match(rules: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """The value of the first rule whose condition holds."""
    out = None
    for condition, value in rules:
        out = F.when(condition, F.lit(value)) if out is None else out.when(condition, F.lit(value))
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def at_least(c: str | Column, tiers: Sequence[tuple[float, str]], below: str) -> Column:
    """Tier by descending lower bounds: the first bound the value reaches."""
    c = col(c)
    return F.when(c.isNotNull(), first_match([(c >= bound, label) for bound, label in tiers], below))


def under(c: str | Column, tiers: Sequence[tuple[float, str]], above: str) -> Column:
    """Tier by ascending upper bounds that are not part of the tier."""
    c = col(c)
    return F.when(c.isNotNull(), first_match([(c < bound, label) for bound, label in tiers], above))


def right_closed_bins(c: str | Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Bins (edge, next edge]; values at or below the first edge or above the last get null."""
    c = col(c)
    inside = (c > edges[0]) & (c <= edges[-1])
    rules = [(c <= edge, label) for edge, label in zip(edges[1:-1], labels)]
    return F.when(inside, first_match(rules, labels[-1]))


def label_map(c: str | Column, mapping: Mapping, default: str | None = None) -> Column:
    """Look a value up in a small fixed mapping; unmapped or null gives ``default``."""
    c = col(c)
    return first_match([(c == key, text) for key, text in mapping.items()], default)


def order_of(c: str | Column, labels: Sequence[str]) -> Column:
    """Position of a label in its business order, last when unknown."""
    c = col(c)
    return first_match([(c == label, i) for i, label in enumerate(labels, 1)], len(labels) + 1)


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")

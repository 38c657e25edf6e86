"""Label sets: canonical keys, projections and matchers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(labels: Column) -> Column:
    """The label set as JSON with sorted keys, which can be grouped by and joined on."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(labels))))


def keep(labels: Column, names: list[str]) -> Column:
    return F.map_filter(labels, lambda k, _: k.isin(names) if names else F.lit(False))


def drop(labels: Column, names: list[str]) -> Column:
    return F.map_filter(labels, lambda k, _: ~k.isin([*names, "__name__"]))


def literals(pattern: str) -> list[str]:
    r"""The values that a pattern stands for: alternatives apart at ``|``, within one pair of parentheses or
    none, with ``\.`` for a dot; anything else is literal, and without ``|`` all of it is."""
    if "|" not in pattern:
        return [pattern.replace("\\.", ".")]
    if pattern.startswith("(") and pattern.endswith(")"):
        pattern = pattern[1:-1]
    return [x.replace("\\.", ".") for x in pattern.split("|")]


def matches(labels: Column, matchers: list[tuple[str, str, str]]) -> Column:
    """Whether a label set satisfies all (label, operator, pattern), operators being =, !=, =~ and !~.

    A label that is absent satisfies the negative ones only. Of several matchers on a label the last counts,
    and ``__name__`` is no label. Equality takes alternatives as well.
    """
    out = F.lit(True)
    for label, (op, pattern) in {m[0]: m[1:] for m in matchers if m[0] != "__name__"}.items():
        value = labels[label]
        hit = F.coalesce(value.isin(literals(pattern)), F.lit(False))
        if op in ("=", "=~"):
            out = out & hit
        elif op in ("!=", "!~"):
            out = out & ~hit
        else:
            raise ValueError(f"unknown label operator {op!r}")
    return out


def held(labels: dict[str, str], matchers: list[tuple[str, str, str]]) -> bool:
    """``matches`` of one label set, on the driver."""
    hit = {m[0]: (m[1], labels.get(m[0]) in literals(m[2])) for m in matchers if m[0] != "__name__"}
    return all(found == (op in ("=", "=~")) for op, found in hit.values())

"""Left fold over an array column that also emits one string per element.

``aggregate`` alone would append every emitted string to one growing array, which copies the array at each step.
Here the elements are folded in slices of ``SLICE``: the inner fold collects the strings of one slice, the outer fold
joins them into a single piece.  The work per row is close to linear, stays inside one row, and needs neither a shuffle
nor a sort, so a markup rule built on it is a narrow projection.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SLICE = 32


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` under a name (lambda bodies have no common subexpressions)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold_emit(
    items: Column,
    init: dict[str, Column],
    step: Callable[[Callable[[str], Column], Callable[..., Column], Column], Column],
    finish: Callable[[Callable[[str], Column]], Column],
) -> Column:
    """Fold ``items`` from the left; return every emitted string joined, followed by ``finish(last state)``.

    ``step(get, then, item)`` returns the next state: ``get(name)`` reads a field of the current one, and
    ``then(emitted, **changed)`` builds the next one from the string to write and the fields that differ.
    """
    no_out = F.array().cast("array<string>")

    def pack(state: dict[str, Column], out: Column) -> Column:
        return F.struct(*[state[k].alias(k) for k in init], out.alias("out"))

    def inner(acc: Column, item: Column) -> Column:
        def then(emitted: Column, **changed: Column) -> Column:
            return pack({k: changed.get(k, acc[k]) for k in init}, F.array_append(acc["out"], emitted))

        return step(lambda k: acc[k], then, item)

    def outer(acc: Column, piece: Column) -> Column:
        folded = F.aggregate(piece, pack({k: acc[k] for k in init}, no_out), inner)
        return let(
            folded, lambda r: pack({k: r[k] for k in init}, F.array_append(acc["out"], F.array_join(r["out"], "")))
        )

    def run(all_items: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(all_items), F.lit(1)), F.lit(SLICE))
        return F.aggregate(
            F.transform(starts, lambda i: F.slice(all_items, i, SLICE)),
            pack(init, no_out),
            outer,
            lambda acc: F.concat(F.array_join(acc["out"], ""), finish(lambda k: acc[k])),
        )

    return let(items, run)

"""Prefix scans over arrays and cuts of texts by spans, as native expressions whose work grows with the length.

A text's parts are found by code points, which costs a walk from its start, and
arrays are grown by copying. Both are done in blocks of BLOCK, so that neither
is repeated over the whole for each element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` evaluated once."""
    return F.transform(F.array(x), f)[0]


def blocks(values: Column, f: Callable[[Column, Column], Column]) -> Column:
    """``f`` of each block of BLOCK values and the block's number, put together."""
    numbers = F.when(F.size(values) > 0, F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(numbers, lambda b: f(F.slice(values, b * BLOCK + 1, F.lit(BLOCK)), b)))


def _running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(values, F.array().cast("array<int>"), lambda now, x: F.concat(now, F.array(F.coalesce(op(F.try_element_at(now, F.lit(-1)), x), x))))


def scan(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Prefix sums, maxima or the like of integers, in two levels of blocks."""

    def join(within: Column) -> Column:
        tops = _running(blocks(within, lambda w, b: F.array(F.element_at(w, -1))), op)
        return let(tops, lambda t: blocks(within, lambda w, b: F.when(b == 0, w).otherwise(F.transform(w, lambda x: op(t[b - 1], x)))))

    return let(values, lambda v: let(blocks(v, lambda w, b: _running(w, op)), join))


def sums(values: Column) -> Column:
    return scan(values, lambda a, b: a + b)


def pieces(text: Column, spans: Column, make: Callable[[Column, Column, Column], Column]) -> Column:
    """``make(span, gap, own)`` of each span: the text between the span before and it, and its own.

    ``spans`` (start, end, ...) are in code points, sorted, and don't overlap.
    """

    def block(all_: Column, own: Column, b: Column) -> Column:
        base = F.when(b == 0, F.lit(0)).otherwise(F.get(all_, b * BLOCK - 1)["end"])

        def each(at: Column, part: Column) -> Column:
            def one(r: Column, e: Column) -> Column:
                return make(r, F.substring(part, e - at + 1, r["start"] - e), F.substring(part, r["start"] - at + 1, r["end"] - r["start"]))

            return F.transform(own, lambda r, i: let(F.when(i == 0, at).otherwise(F.get(own, i - 1)["end"]), lambda e: one(r, e)))

        return let(base, lambda at: let(F.substring(text, at + 1, F.element_at(own, -1)["end"] - at), lambda part: each(at, part)))

    return let(spans, lambda s: blocks(s, lambda own, b: block(s, own, b)))


def replaced(text: Column, spans: Column, by: Callable[[Column], Column]) -> Column:
    """``text`` with each span replaced; ``spans`` as in :func:`pieces`."""
    rest = lambda s: F.substring(text, F.element_at(s, -1)["end"] + 1, F.length(text))
    return F.when(F.size(spans) > 0, let(spans, lambda s: F.concat(F.array_join(pieces(text, s, lambda r, gap, own: F.concat(gap, by(r))), ""), rest(s)))).otherwise(text)

"""Places of pattern matches as array expressions, in n log n steps for n matches.

Inside a lambda Spark evaluates again, for each element, whatever stands there, also what does not depend on
it. ``let`` therefore binds a value to a lambda variable first, and ``running`` makes running sums by doubling
instead of growing an array match by match.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is made once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each element the ``join`` of all up to it: step p adds what step p - 1 made of the 2**p before."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))
    before = lambda acc, i, p: F.get(acc, i - F.pow(F.lit(2.0), p).cast("int"))
    return F.aggregate(steps, values, lambda acc, p: F.transform(acc, lambda x, i: F.coalesce(join(x, before(acc, i, p)), x)))


def matches(text: Column, pattern: Column, row: Callable[[Column, Column, Column, Column], Column]) -> Column:
    """An array of ``row(number, start, end, match)`` for the matches in ``text``, from left to right.

    Places are in code points, end exclusive; they follow from the lengths of the pieces between the matches.
    """
    hits, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.transform(F.split(text, pattern, -1), F.length)
    sizes = lambda s: F.transform(s["hits"], lambda h, i: F.get(s["gaps"], i) + F.length(h))
    total = lambda s: let(sizes(s), lambda x: running(x, lambda a, b: a + b))
    placed = lambda s: F.struct(s["hits"].alias("hits"), total(s).alias("ends"))
    rows = lambda s: F.transform(s["hits"], lambda h, i: row(i, F.get(s["ends"], i) - F.length(h), F.get(s["ends"], i), h))
    return let(F.struct(hits.alias("hits"), gaps.alias("gaps")), lambda s: let(placed(s), rows))

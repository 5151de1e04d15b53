"""Where regular expressions match, by built-in functions only: offsets in code points, leftmost, not overlapping."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,m:string,before:string,after:string>"
NONE = f"cast(array() as array<{SPAN}>)"
CONTEXT = 40
AFTER = 20


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def staged(value: Column, *steps: Callable[[Column], Column]) -> Column:
    """steps applied one after the other; each sees its argument as a value that is computed once, also inside lambdas
    (an expression that stands in a lambda is computed again for every element)."""
    box = F.array(value)
    for step in steps:
        box = F.transform(box, step)
    return F.element_at(box, 1)


def located(text: Column, pattern: str, found: Column) -> Column:
    """Spans of ``found`` (what ``matches`` gave): start, end (exclusive), the match, and up to 40 characters before it and
    20 after it that belong to no other match. The pattern must not match the empty string.

    The text is split by the same pattern: the pieces between matches have the lengths that are missing. Ends are sums
    over the matches before, taken in about sqrt(n) blocks of sqrt(n) matches, as arrays can only grow by copying.
    """

    def sums(values: Column, start: Column) -> Column:
        zero = F.struct(start.alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        add = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x)).alias("out"))
        return F.aggregate(values, zero, add, lambda acc: acc["out"])

    def steps(b: Column) -> Column:
        step = F.transform(b["f"], lambda m, i: F.length(F.get(b["p"], i)) + F.length(m))
        return F.struct(b["p"].alias("p"), b["f"].alias("f"), step.alias("step"), F.ceil(F.sqrt(F.size(b["f"]))).cast("int").alias("c"))

    def block(b: Column, k: Column) -> Column:
        return F.slice(b["step"], k * b["c"] + 1, b["c"])

    def blocks(b: Column) -> Column:
        totals = F.transform(F.sequence(F.lit(0), b["c"] - 1), lambda k: F.aggregate(block(b, k), F.lit(0), lambda x, y: x + y))
        return F.struct(*(b[c].alias(c) for c in ("p", "f", "step", "c")), totals.alias("totals"))

    def bases(b: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), F.slice(sums(b["totals"], F.lit(0)), F.lit(1), b["c"] - 1))
        return F.struct(*(b[c].alias(c) for c in ("p", "f", "step", "c")), before.alias("bases"))

    def ends(b: Column) -> Column:
        each = F.flatten(F.transform(b["bases"], lambda base, k: sums(block(b, k), base)))
        return F.struct(b["p"].alias("p"), b["f"].alias("f"), each.alias("ends"))

    def spans(b: Column) -> Column:
        return F.transform(
            b["ends"],
            lambda e, i: F.struct(
                (e - F.length(F.get(b["f"], i))).alias("start"),
                e.alias("end"),
                F.get(b["f"], i).alias("m"),
                F.right(F.get(b["p"], i), F.lit(CONTEXT)).alias("before"),
                F.left(F.get(b["p"], i + 1), F.lit(AFTER)).alias("after"),
            ),
        )

    start = F.struct(F.split(text, pattern, -1).alias("p"), found.alias("f"))
    return F.when(F.size(found) > 0, staged(start, steps, blocks, bases, ends, spans)).otherwise(F.expr(NONE))


def labelled(spans: Column, number: int, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("no"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def joined(*arrays: Column) -> Column:
    """One array of (start, no, end, kind), by start and then by number of kind."""
    return F.array_sort(F.concat(*arrays))


def listed(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: Column, spans: Column, mask: str) -> Column:
    """The text with each span, or run of overlapping ones, replaced by ``mask``; spans are sorted by start."""

    def step(acc: Column, s: Column) -> Column:
        gap = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], gap).otherwise(acc["out"]).alias("out")
        )

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def normal_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal variable; the error is below 1e-7."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = reduce(lambda acc, b: (acc + b) * t, [1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530], F.lit(0.0))
    tail = F.exp(-a * a / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)

"""Nucleosome calls linked over ordered samples, and how they shift."""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import LINK_MIN_OCCUPANCY, LINK_TOLERANCE, SHIFT_THRESHOLD
from ..functions.scalar import one_direction, sample_suffix
from ..storage import materialize
from .intervals import running

#: Positions of a stretch.
STRETCH = 1 << 17
#: What a stretch makes of the state it is entered with: the last call that is used up, as a dyad and a number among the
#: calls of that dyad; no dyad if none of the stretch's own calls is.
MAP = "chr string, stretch long, in_dyad long, in_nth long, out_dyad long, out_nth long"


def _columns(i: int) -> list[str]:
    return [f"{c}{sample_suffix(i)}" for c in ("dyad", "occupancy", "pdyad")]


def _numbers(table: pa.Table, column: str) -> np.ndarray:
    return table.column(column).to_numpy(zero_copy_only=False).astype(np.int64)


def _reach(old: pa.Table, dyads: np.ndarray, tolerance: int) -> tuple[list[int], list[int]]:
    """By row, the first of the sorted dyads that it can take, and the one after the last."""
    first = np.searchsorted(dyads, _numbers(old, "_low") - tolerance, "left")
    return first.tolist(), np.searchsorted(dyads, _numbers(old, "_high") + tolerance, "right").tolist()


def _entered(dyads: np.ndarray, at: int) -> tuple[int | None, int]:
    """The state in which the first ``at`` of the sorted dyads are used up."""
    return (None, 0) if at == 0 else (int(dyads[at - 1]), int(at - np.searchsorted(dyads, dyads[at - 1], "left")))


def _taken(dyads: np.ndarray, state: tuple[int | None, int]) -> int:
    """How many of the sorted dyads are used up in a state."""
    dyad, nth = state
    return 0 if dyad is None else int(min(np.searchsorted(dyads, dyad, "left") + nth, np.searchsorted(dyads, dyad, "right")))


def _stretch_map(old: pa.Table, dyads: np.ndarray, start: int, reach: int, tolerance: int) -> list[tuple]:
    """The states that may enter a stretch, with those that leave it; only the first state of those that leave alike.

    Rows take calls in order: each the first that is left within its reach. So a row turns the number of calls used up, x, into
    max(x, first) and one more if that is before the end of its reach. This keeps the order of states, so states that
    meet stay together.
    """
    states = np.arange(np.searchsorted(dyads, start + reach, "left") + 1)
    inside = states.copy()
    for first, last in zip(*_reach(old, dyads, tolerance), strict=True):
        inside = np.maximum(inside, first)
        inside += inside < last
        if inside[0] == inside[-1] and len(inside) > 1:
            states, inside = states[:1], inside[:1]
    keep = np.flatnonzero(np.diff(inside, prepend=-1))
    return [(*_entered(dyads, int(states[k])), *_entered(dyads, int(inside[k]))) for k in keep]


def _compose(maps: pd.DataFrame) -> pd.DataFrame:
    """The state with which each stretch of a chromosome is entered, following the maps from one to the next."""
    none, out, state = (-(1 << 62), 0), [], (-(1 << 62), 0)
    pair = lambda d, n: none if pd.isna(d) else (int(d), int(n))
    for stretch, rows in maps.groupby("stretch", sort=True):
        out.append((maps["chr"].iloc[0], stretch, None if state == none else state[0], state[1]))
        steps = sorted((pair(r.in_dyad, r.in_nth), pair(r.out_dyad, r.out_nth)) for r in rows.itertuples())
        state = max(state, steps[bisect_right(steps, state, key=lambda s: s[0]) - 1][1])
    frame = pd.DataFrame(out, columns=["chr", "stretch", "in_dyad", "in_nth"])
    return frame.astype({"in_dyad": "Int64"})


def add_sample(
    linked: DataFrame | None,
    calls: DataFrame,
    index: int,
    min_occupancy: float = LINK_MIN_OCCUPANCY,
    tolerance: int = LINK_TOLERANCE,
    width: int = STRETCH,
) -> DataFrame:
    """Links the calls (chr, dyad, dyad_score, min_occ_score) of sample ``index`` to those of the samples before it.

    Both sides are walked in order of position; heads within ``tolerance`` are matched one to one, else the smaller one
    stays alone. A row whose last dyad is missing matches within ``tolerance`` of any of its dyads.

    The walk is cut into stretches of ``width`` positions by the rows' mean dyads, wherever that is. What a stretch hangs on is
    which calls near its start are used up, so each one first tells what it makes of every such state, then the states
    are followed along the chromosome (a row for each stretch and state that matters), then each stretch is linked from
    the state it is entered with. A task holds the rows and calls of one stretch: two for each base, but for calls that
    repeat a dyad, which are taken in order of their scores. Calls without a dyad are left out; no calls link nothing.
    """
    new = calls.where(F.col("min_occ_score") > min_occupancy).na.drop(subset=["dyad"])
    new = new.select("chr", *(F.col(c).cast(t).alias(n) for c, t, n in zip(("dyad", "min_occ_score", "dyad_score"), ("long", "double", "double"), _columns(index), strict=True)))
    if linked is None:
        return new
    old = [c for i in range(index) for c in _columns(i)]
    dyads = [f"dyad{sample_suffix(i)}" for i in range(index)]
    mine, known = f"dyad{sample_suffix(index)}", F.filter(F.array(*dyads), lambda d: d.isNotNull())
    rows = linked.select("chr", *old).withColumn("_mean", F.floor(F.aggregate(known, F.lit(0).cast("long"), lambda a, d: a + d) / F.size(known)))
    ends = {"_low": F.coalesce(dyads[-1], F.array_min(known)), "_high": F.coalesce(dyads[-1], F.array_max(known))}
    rows = rows.withColumns({**ends, "_wide": F.array_max(known) - F.array_min(known), "stretch": F.floor(F.col("_mean") / width)})
    rows = materialize(rows, "link-rows")
    reach = tolerance + (rows.agg(F.max("_wide")).first()[0] or 0)
    near = F.sequence(F.floor((F.col(mine) - reach) / width), F.floor((F.col(mine) + reach) / width))
    new = materialize(new, "link-calls")
    news = new.withColumn("stretch", F.explode(near))
    order = [(c, "ascending") for c in ["_mean", *dyads, *(c for c in old if c not in dyads)]]

    def sides(key: tuple, left: pa.Table, right: pa.Table) -> tuple[pa.Table, pa.Table, np.ndarray]:
        calls = right.sort_by([(c, "ascending") for c in _columns(index)])
        return left.sort_by(order), calls, _numbers(calls, mine)

    def mapped(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        chrom, stretch = (k.as_py() for k in key)
        left, _, at = sides(key, left, right)
        steps = _stretch_map(left, at, stretch * width, reach, tolerance)
        return pa.Table.from_arrays([pa.array([chrom] * len(steps), pa.string()), *(pa.array(x, pa.int64()) for x in ([stretch] * len(steps), *zip(*steps, strict=True)))], names=["chr", "stretch", "in_dyad", "in_nth", "out_dyad", "out_nth"])

    def linked_up(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        entry = right.filter(pc.is_valid(right["_nth"])).to_pylist()[0]
        left, right, at = sides(key, left, right.filter(pc.is_null(right["_nth"])))
        start = x = _taken(at, (entry[mine], entry["_nth"]))
        rows, calls = [], []
        for i, (first, last) in enumerate(zip(*_reach(left, at, tolerance), strict=True)):
            x = max(x, first)
            rows.append(i)
            calls.append(x if x < last else None)
            x += x < last
        met = {c for c in calls if c is not None}
        # A call is told by the stretch that uses it up; one that none does by the last that it lies near.
        final = (at + reach) // width == key[1].as_py()
        alone = [j for j in range(start, len(at)) if j not in met and (j < x or final[j])]
        rows, calls = pa.array(rows + [None] * len(alone), pa.int64()), pa.array(calls + alone, pa.int64())
        chrom = pa.array([key[0].as_py()] * len(rows), pa.string())
        return pa.Table.from_arrays([chrom, *(t.column(c).take(at).combine_chunks() for t, at, cs in ((left, rows, old), (right, calls, _columns(index))) for c in cs)], names=["chr", *old, *_columns(index)])

    by = ["chr", "stretch"]
    maps = rows.groupBy(*by).cogroup(news.select(*by, *_columns(index)).groupBy(*by)).applyInArrow(mapped, MAP)
    entries = maps.groupBy("chr").applyInPandas(_compose, "chr string, stretch long, in_dyad long, in_nth long")
    states = entries.select(*by, F.col("in_dyad").alias(mine), *(F.lit(None).cast("double").alias(c) for c in _columns(index)[1:]), F.col("in_nth").alias("_nth"))
    told = news.select(*by, *_columns(index), F.lit(None).cast("long").alias("_nth")).unionByName(states)
    schema = ", ".join(["chr string", *(f"{c} {'long' if c.startswith('dyad') else 'double'}" for c in [*old, *_columns(index)])])
    return rows.groupBy(*by).cogroup(told.groupBy(*by)).applyInArrow(linked_up, schema)


def link(samples: list[DataFrame], **options: float) -> DataFrame:
    """The linkage map of ordered samples: chr, and dyadX, occupancyX, pdyadX for X = A, B, ..., with shift_XY between them."""
    linked = reduce(lambda acc, x: add_sample(acc, x[1], x[0], **options), enumerate(samples), None)
    return linked.withColumns(shifts(len(samples)))


def shifts(n: int) -> dict[str, Column]:
    """shift_XY: what a dyad moved from a sample to the next; null if either lacks it."""
    pairs = [(sample_suffix(i), sample_suffix(i + 1)) for i in range(n - 1)]
    return {f"shift_{a}{b}": F.col(f"dyad{b}") - F.col(f"dyad{a}") for a, b in pairs}


def named(linked: DataFrame, n: int) -> DataFrame:
    """Adds ``name``, nuc_0 and so on, in order of chromosome and dyads; counted in bins, then over bins, then chromosomes."""
    dyads = [f"dyad{sample_suffix(i)}" for i in range(n)]
    linked = materialize(linked, "linked")
    rows = linked.withColumn("_at", F.coalesce(*dyads))
    rows = running(rows, F.lit(1).cast("long"), "sum", "_k", ["_at", *dyads], at="_at")
    sizes = linked.groupBy("chr").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("chr").rowsBetween(Window.unboundedPreceding, -1)  # a row for each chromosome
    before = sizes.select("chr", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    name = F.concat(F.lit("nuc_"), (F.col("_before") + F.col("_k") - 1).cast("string"))
    return rows.join(before, "chr").withColumn("name", name).drop("_at", "_k", "_before")


def cumulative_shifts(shift: list[str]) -> dict[str, Column]:
    """Shifts with respect to the first sample; null from the first missing one on."""
    return {f"{c}_first": reduce(lambda a, b: a + b, [F.col(x) for x in shift[: i + 1]]) for i, c in enumerate(shift)}


def shift_class(shift: list[str], threshold: int = SHIFT_THRESHOLD) -> Column:
    """1_no_shift, 2_directional_shift, 3_nondirectional_shift or 4_not_always_present."""
    values = F.array(*shift)
    return (
        F.when(F.forall(values, lambda s: s.isNotNull() & (F.abs(s) <= threshold)), "1_no_shift")
        .when(F.exists(values, lambda s: s.isNull()), "4_not_always_present")
        .when(one_direction(values, threshold), "2_directional_shift")
        .otherwise("3_nondirectional_shift")
    )


def pair_category(a: str = "dyadA", b: str = "dyadB") -> dict[str, Column]:
    """category (null_A, null_B, not_null) of a pair of samples, and dyad: the one that is there, or the greater."""
    kind = F.when(F.col(a).isNull(), "null_A").when(F.col(b).isNull(), "null_B").otherwise("not_null")
    return {"category": kind, "dyad": F.greatest(a, b)}


def beds(linked: DataFrame, n: int, half: int = 73) -> DataFrame:
    """(chr, start, end) from the smallest dyad less ``half`` to the greatest plus ``half`` + 1."""
    dyads = F.array(*(f"dyad{sample_suffix(i)}" for i in range(n)))
    return linked.select("chr", (F.array_min(dyads) - half).alias("start"), (F.array_max(dyads) + half + 1).alias("end"))

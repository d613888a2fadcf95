"""Exact order statistics and quantiles by narrowing brackets.

Spark's exact ``percentile`` keeps every distinct value of a group in one buffer. Here a
sketch (one for all wanted ranks of a bracket, of a sample where the bracket is large) proposes two pivots
on both sides of a wanted rank, a count over all rows settles between which of them it lies, and the rows strictly between become the next
bracket: about a hundredth of the rows before, whatever the distribution. Once a
bracket is small its distinct values are counted. So the number of passes depends on the
number of rows alone, and a repeated value, a heavy tail or the full range of doubles does not add
any. The sample only proposes pivots: a rank beside them costs a further pass, never exactness.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from seacast.session import stored

#: Accuracy of a sketch, rows that it sees of a bracket (about), and rows of a bracket whose values are counted one by one.
ACCURACY, SAMPLE, SMALL = 2_000, 200_000, 20_000
#: More than the cells that the pivots of a bracket make.
CELLS = 1_000_000


class Place(NamedTuple):
    """The value at a rank, the rank's index among equal values, and how many are equal."""

    value: float | int
    index: int
    size: int


def order_statistics(
    df: DataFrame, values: dict[str, Column], ranks: dict[str, set[int]], sizes: dict[str, int] | None = None
) -> dict[tuple[str, int], Place]:
    """The place at each wanted 0-based rank of each named numeric column; ``sizes`` are their non-null rows, if known.

    NaN has to be null already; nulls do not count, and a rank beyond the values is an error. The
    values pass through a one-element ``inline``, so that an expensive expression runs once per row
    and pass however often its result is compared.
    """
    places = {name: f"v{i}" for i, name in enumerate(values)}
    rows = df.select(F.inline(F.array(F.struct(*[values[n].alias(c) for n, c in places.items()]))))
    if sizes is None:
        row = rows.agg(*[F.count(c).alias(c) for c in places.values()]).first()
        sizes = {n: row[c] for n, c in places.items()}
    # (name, rank) -> values above low and below high, how many values come before them, how many they are
    wanted = {}
    for name, name_ranks in ranks.items():
        for rank in name_ranks:
            if not 0 <= rank < sizes[name]:
                raise ValueError(f"{name} has {sizes[name]} values, no rank {rank}")
            wanted[name, rank] = (None, None, 0, sizes[name])
    found: dict[tuple[str, int], Place] = {}

    def inside(name: str, low, high) -> Column:
        v = F.col(places[name])
        return v.isNotNull() & (F.lit(True) if low is None else v > F.lit(low)) & (F.lit(True) if high is None else v < F.lit(high))

    while wanted:
        small = sorted({(n, *w[:2]) for (n, _), w in wanted.items() if w[3] <= SMALL}, key=repr)
        if small:
            hits = F.array_compact(F.array(*[F.when(inside(*b), F.struct(F.lit(i).alias("b"), F.col(places[b[0]]).cast(_kind(rows, places)).alias("v"))) for i, b in enumerate(small)]))
            counted: dict[int, list] = {}
            for r in rows.where(reduce(Column.__or__, [inside(*b) for b in small])).select(F.explode(hits).alias("r")).groupBy("r.b", "r.v").agg(F.count(F.lit(1)).alias("n")).collect():
                counted.setdefault(r["b"], []).append((r["v"], r["n"]))
            for (name, rank), (low, high, below, size) in list(wanted.items()):
                if size <= SMALL:
                    for value, n in sorted(counted[small.index((name, low, high))]):
                        if rank < below + n:
                            found[name, rank] = Place(value, rank - below, n)
                            break
                        below += n
                    del wanted[name, rank]
        large = list(wanted.items())
        if not large:
            return found
        # One sketch of a sample and one count of each distinct pivot for all ranks of a bracket.
        brackets: dict[tuple, list[tuple[str, int]]] = {}
        for key, bracket in large:
            brackets.setdefault((key[0], *bracket), []).append(key)
        sketches = []
        for i, ((name, low, high, below, size), keys) in enumerate(brackets.items()):
            part = min(1.0, SAMPLE / size)
            margin = 1.5 / ACCURACY + (2 / math.sqrt(SAMPLE) if part < 1 else 0)
            shares = sorted((rank - below + 0.5) / size for _, rank in keys)
            near = [[shares[0], shares[0]]]
            for share in shares[1:]:  # ranks side by side have the same pivots
                if share - near[-1][1] < margin:
                    near[-1][1] = share
                else:
                    near.append([share, share])
            sides = [min(max(s, 0.0), 1.0) for first, last in near for s in (first - margin, last + margin)]
            drawn = (F.col("_draw") < part) & inside(name, low, high)
            sketches.append(F.percentile_approx(F.when(drawn, F.col(places[name])), sides, ACCURACY).alias(f"p{i}"))
        pivots = [sorted(set(p or [])) for p in rows.withColumn("_draw", F.rand(11)).agg(*sketches).first()]
        # A value's cell: 2 * i before pivot i (and behind the one before it), 2 * i + 1 at it. One row of counts for each cell.
        cells = []
        for i, ((name, low, high, _, _), found_here) in enumerate(zip(brackets, pivots)):
            v, at = F.col(places[name]), F.lit(2 * len(found_here))
            for k in reversed(range(len(found_here))):
                at = F.when(v < F.lit(found_here[k]), 2 * k).when(v == F.lit(found_here[k]), 2 * k + 1).otherwise(at)
            cells.append(F.when(inside(name, low, high), F.lit(i * CELLS).cast("long") + at))
        counted_cells = rows.select(F.explode(F.array(*cells)).alias("cell")).where("cell IS NOT NULL").groupBy("cell").count()
        sizes_of = {r["cell"]: r["count"] for r in counted_cells.collect()}
        settled = []
        for i, found_here in enumerate(pivots):
            upto = 0
            for k in range(len(found_here)):
                upto += sizes_of.get(CELLS * i + 2 * k, 0)
                settled += [upto, upto := upto + sizes_of.get(CELLS * i + 2 * k + 1, 0)]
        settled = iter(settled)
        for ((name, low, high, below, size), keys), found_here in zip(brackets.items(), pivots):
            edges = [(low, None, 0), *((pivot, next(settled), next(settled)) for pivot in found_here), (high, size, None)]
            for _, rank in keys:
                at = rank - below
                for (a, _, a_upto), (b, b_under, b_upto) in zip(edges, edges[1:]):
                    if at < b_under:
                        wanted[name, rank] = (a, b, below + a_upto, b_under - a_upto)
                        break
                    if b_upto is not None and at < b_upto:
                        found[name, rank] = Place(b, at - b_under, b_upto - b_under)
                        del wanted[name, rank]
                        break
        if any(w[3] > SMALL for w in wanted.values()):  # further passes read the rows of the brackets only
            rows = stored(rows.where(reduce(Column.__or__, [inside(n, *w[:2]) for (n, _), w in wanted.items()])), "brackets")
    return found


def _kind(rows: DataFrame, places: dict[str, str]) -> str:
    """One type for the values of all columns: whole numbers stay whole."""
    kinds = {rows.schema[c].dataType.simpleString() for c in places.values()}
    return "bigint" if kinds <= {"bigint", "int", "smallint", "tinyint"} else "double"


def clean_double(col: str) -> Column:
    """The column as a double with NaN as null."""
    value = F.col(col).cast("double")
    return F.when(~F.isnan(value), value)


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, dict[float, float | None]]:
    """Quantiles with linear interpolation between neighbours, per column."""
    values = {c: clean_double(c) for c in cols}
    if not values:
        return {}
    counts = [F.struct(F.count(v).alias("n"), F.count_if(F.abs(v) == float("inf")).alias("wide")) for v in values.values()]
    row = df.agg(*[c.alias(f"s{i}") for i, c in enumerate(counts)]).first()
    if wide := [name for i, name in enumerate(values) if row[i]["wide"]]:
        raise ValueError(f"{wide} hold an infinite value")
    sizes = {name: row[i]["n"] for i, name in enumerate(values)}
    ranks = {}
    for name, n in sizes.items():
        if n:
            spots = [p * (n - 1) for p in probs]
            ranks[name] = {math.floor(s) for s in spots} | {math.ceil(s) for s in spots}
    stats = order_statistics(df, values, ranks, sizes)
    out: dict[str, dict[float, float | None]] = {}
    for name, n in sizes.items():
        out[name] = {}
        for p in probs:
            if not n:
                out[name][p] = None
                continue
            spot = p * (n - 1)
            low, high = stats[(name, math.floor(spot))].value, stats[(name, math.ceil(spot))].value
            share, gap = spot - math.floor(spot), high - low
            out[name][p] = low if low == high else low + gap * share if math.isfinite(gap) else low * (1 - share) + high * share
    return out

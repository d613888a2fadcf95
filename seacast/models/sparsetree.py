"""A decision tree over sparse vectors of any width: a level costs one pass over the cells that are there."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from seacast.functions.direction import lookup
from seacast.session import stored

NUMBERS, HOT, NODE = "_numbers", "_hot", "_node"


class Split(NamedTuple):
    """Rows whose value at ``place`` is above ``threshold`` go to node 2 * n + 1 below node n, the others to 2 * n."""

    place: int
    threshold: float


class SparseTree:
    """Gini tree of at most ``depth`` levels over vectors whose first ``numeric`` places are numbers and whose others are 0 or 1.

    A numeric place is split at the midpoints of its values or, if it has more than ``bins`` of them, at ``bins`` - 1 quantiles; another one at
    one half. Only cells that are 1 are counted for the latter: a node's other rows follow from its totals, so the work
    grows with the non-zero cells, not with rows times width. The driver holds a split for each node of a level.
    """

    def __init__(self, label: str, numeric: int, depth: int = 5, bins: int = 32, features: str = "features"):
        self.label, self.numeric, self.depth, self.bins, self.features = label, numeric, depth, bins, features

    def cells(self, df: DataFrame) -> DataFrame:
        """``df`` with its numbers as an array and the places of the others that are not 0."""
        vector = F.unwrap_udt(self.features)
        values = vector["values"]
        places = F.when(vector["type"] == 0, vector["indices"]).otherwise(F.transform(values, lambda v, i: i))
        told = df.withColumns({"_places": places, "_values": values})
        both = F.map_from_arrays("_places", "_values")
        hot = F.filter("_places", lambda p: (p >= self.numeric) & (F.try_element_at(F.col("_cells"), p) != 0))
        numbers = F.array(*[F.coalesce(F.try_element_at("_cells", F.lit(i)), F.lit(0.0)) for i in range(self.numeric)]).cast("array<double>")
        return told.withColumn("_cells", both).withColumns({NUMBERS: numbers, HOT: hot}).drop("_places", "_values", "_cells")

    def thresholds(self, rows: DataFrame) -> dict[int, list[float]]:
        slots = F.posexplode(NUMBERS).alias("place", "value")
        values = stored(rows.select(slots).distinct(), "values")
        sizes = {r["place"]: r["n"] for r in values.groupBy("place").agg(F.count(F.lit(1)).alias("n")).collect()}
        few = [p for p, n in sizes.items() if n <= self.bins]
        seen: dict[int, list[float]] = {p: [] for p in few}
        for r in values.where(F.col("place").isin(few)).collect():
            seen[r["place"]].append(r["value"])
        out = {p: [(a + b) / 2 for a, b in zip(v, v[1:])] for p, v in ((p, sorted(v)) for p, v in seen.items())}
        many = [p for p in sizes if p not in seen]
        if many:
            shares = [i / self.bins for i in range(1, self.bins)]
            row = rows.agg(*[F.percentile_approx(F.col(NUMBERS)[p], shares, 10_000).alias(f"q{p}") for p in many]).first()
            out |= {p: sorted(set(row[f"q{p}"])) for p in many}
        return out

    def fit(self, df: DataFrame) -> "SparseTreeModel":
        """The tree of all rows of ``df``; a null label is an error."""
        rows = stored(self.cells(df.select(F.col(self.label).cast("double").alias("_label"), self.features)).drop(self.features), "cells")
        labels = sorted((r[0] for r in rows.select("_label").distinct().collect()), key=lambda v: (v is not None, v))
        if not labels or labels[0] is None:
            raise ValueError(f"{self.label} holds nulls or no row")
        vector = F.unwrap_udt(self.features)
        width = df.agg(F.max(F.coalesce(vector["size"], F.size(vector["values"])))).first()[0]
        counts = [f"_c{i}" for i in range(len(labels))]
        counted = [F.count_if(F.col("_label") == v).cast("double").alias(c) for c, v in zip(counts, labels)]
        cuts = self.thresholds(rows)
        spark = df.sparkSession
        tried = spark.createDataFrame([(p, i, t) for p, ts in cuts.items() for i, t in enumerate(ts)], "place int, _at int, threshold double")
        bins = [self.binned(p, ts) for p, ts in cuts.items() if ts]
        splits: dict[int, Split] = {}
        answers: dict[int, float] = {}
        open_nodes = [1]
        for level in range(self.depth + 1):
            at = rows.withColumn(NODE, self.node(splits)).where(F.col(NODE).isin(open_nodes))
            totals = at.groupBy(NODE).agg(*counted).collect()
            for r in totals:
                answers[r[NODE]] = labels[max(range(len(labels)), key=lambda i: (r[counts[i]], -i))]
            impure = [r for r in totals if sum(r[c] > 0 for c in counts) > 1]
            if level == self.depth or not impure:
                break
            every = spark.createDataFrame([(r[NODE], *(r[c] for c in counts)) for r in impure], ", ".join([f"{NODE} int", *(f"_t{c} double" for c in counts)]))
            at = at.where(F.col(NODE).isin([r[NODE] for r in impure]))
            sides = at.select(NODE, "_label", F.explode(HOT).alias("place")).groupBy(NODE, "place").agg(*counted).withColumn("threshold", F.lit(0.5))
            if bins:
                binned = at.select(NODE, "_label", F.inline(F.array(*bins))).groupBy(NODE, "place", "_bin").agg(*counted)
                upto = binned.join(F.broadcast(tried), "place").where("_bin <= _at")
                sides = sides.unionByName(upto.groupBy(NODE, "place", "threshold").agg(*[F.sum(c).alias(c) for c in counts]))
            told = sides.join(F.broadcast(every), NODE)
            best = told.withColumn("_gain", self.gain(counts)).where("_gain > 1e-12").groupBy(NODE)
            order = F.struct("_gain", (-F.col("place")).alias("p"), (-F.col("threshold")).alias("t"))
            found = best.agg(F.max(order).alias("b")).collect()
            splits |= {r[NODE]: Split(-r["b"]["p"], -r["b"]["t"]) for r in found}
            open_nodes = [2 * r[NODE] + side for r in found for side in (0, 1)]
            if not open_nodes:
                break
        return SparseTreeModel(self, splits, answers, width)

    @staticmethod
    def binned(place: int, thresholds: Sequence[float]) -> Column:
        """(place, _bin): how many thresholds the row's number is above."""
        below = F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: t < F.col(NUMBERS)[place])
        return F.struct(F.lit(place).alias("place"), F.size(below).alias("_bin"))

    @staticmethod
    def gain(counts: Sequence[str]) -> Column:
        """What a split takes from the Gini impurity of its node, from the counts of one side and the totals; null if a side is empty."""
        one, all_ = sum((F.col(c) for c in counts), F.lit(0.0)), sum((F.col(f"_t{c}") for c in counts), F.lit(0.0))

        def squares(of: Sequence[Column]) -> Column:
            return sum((x * x for x in of), F.lit(0.0))

        side = F.try_divide(squares([F.col(c) for c in counts]), one)
        rest = F.try_divide(squares([F.col(f"_t{c}") - F.col(c) for c in counts]), all_ - one)
        return (side + rest) / all_ - squares([F.col(f"_t{c}") for c in counts]) / (all_ * all_)

    def node(self, splits: dict[int, Split], at: int = 1) -> Column:
        """The node below ``at`` where a row ends; nodes without split keep their rows."""
        if at not in splits:
            return F.lit(at)
        place, threshold = splits[at]
        above = F.col(NUMBERS)[place] > threshold if place < self.numeric else F.array_contains(HOT, place)
        return F.when(above, self.node(splits, 2 * at + 1)).otherwise(self.node(splits, 2 * at))


class SparseTreeModel:
    """A fitted :class:`SparseTree`: its splits, the class of each node, and the width of its vectors."""

    def __init__(self, tree: SparseTree, splits: dict[int, Split], answers: dict[int, float], width: int):
        self.tree, self.splits, self.answers, self.numFeatures = tree, splits, answers, width

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with the class of its leaf as ``prediction``."""
        cells = self.tree.cells(df).withColumn(NODE, self.tree.node(self.splits))
        return cells.withColumn("prediction", lookup(F.col(NODE), self.answers)).drop(NUMBERS, HOT, NODE)

"""Exact-size splits and samples without sorting the table.

Rows are ordered by a seeded md5 digest of their key, then by the key. Only the digests at the
cut ranks are looked up; the split itself is then a comparison per row, with no shuffle (with
classes: a join with their cuts). The look-up narrows down the first 52 bits; where several rows
share those of a cut, their whole digests and keys decide.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from seacast.operators.quantiles import order_statistics
from seacast.session import stored

#: Stands for a null part of a key.
NO_VALUE = "\x00"

PLACE, TEXT = "_place", "_text"


def hash_text(keys: Sequence[str], seed: int = 42) -> Column:
    """The seeded order as text: the md5 of ``key|...|seed`` and that text itself."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit(NO_VALUE)) for k in keys]
    text = F.concat_ws("|", *parts, F.lit(str(seed)))
    return F.concat(F.md5(text), text)


def _placed(df: DataFrame, keys: Sequence[str], seed: int, cols: Sequence[str]) -> DataFrame:
    """``cols``, the order text of each row and its first 52 bits.

    The text passes through a one-element ``inline``, so that comparisons on it neither move
    below it nor repeat the digest.
    """
    texts = df.select(*cols, F.inline(F.array(F.struct(hash_text(keys, seed).alias(TEXT)))))
    return texts.withColumn(PLACE, F.conv(F.substring(TEXT, 1, 13), 16, 10).cast("long"))


#: Bits of the order that one pass over the rows looks at, and rows of a bracket whose texts are counted one by one.
BITS, STEP, SMALL = 52, 13, 20_000
#: Cuts that every task may hold at once.
HELD_CUTS = 40_000


def _cut_texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(_class, _rank, _cut): the order text at each wanted 0-based rank of each class of ``rows`` (_class, place, text).

    A pass counts rows by class and the next bits of their place, and running totals tell in which of these
    parts a rank lies; the places are digests, so a part has a few thousandths of a percent of its bracket. Once brackets are
    small (or all bits are used: then only a collision or a key that is there twice shares them) their texts are
    counted. Classes are keys of the counts, so their number is not bounded, and a class with most rows is one
    row per part and task in the shuffle.
    """
    at = wanted.select("_class", "_rank", F.lit(0).cast("long").alias("_prefix"), F.col("_rank").alias("_left"))
    shift, few = BITS, True

    def settled(counts: DataFrame, key: str) -> DataFrame:
        """The part of each bracket in which its ranks lie."""
        order = Window.partitionBy("_class", "_prefix").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
        ranks = at.groupBy("_class", "_prefix").agg(F.collect_list(F.struct("_rank", "_left")).alias("_ranks"))
        before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0))).join(ranks, ["_class", "_prefix"])
        here = F.filter("_ranks", lambda r: (r["_left"] >= F.col("_before")) & (r["_left"] < F.col("_before") + F.col("_n")))
        hit = before.withColumn("_hit", F.explode(here))
        return hit.select("_class", F.col("_hit._rank").alias("_rank"), F.col(key), (F.col("_hit._left") - F.col("_before")).alias("_left"), "_n")

    def inside(shift: int) -> DataFrame:
        some = rows.select("_class", PLACE, TEXT, F.shiftright(PLACE, shift).alias("_prefix"))
        if shift == BITS:
            return some
        here = at.select("_class", "_prefix").distinct()
        return some.join(F.broadcast(here) if few else here, ["_class", "_prefix"], "left_semi")

    while shift:
        parts = inside(shift).groupBy("_class", "_prefix", F.shiftright(PLACE, shift - STEP).alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
        found = stored(settled(parts, "_part"), "cuts")
        at, shift = found.select("_class", "_rank", F.col("_part").alias("_prefix"), "_left"), shift - STEP
        most, size = found.agg(F.max("_n"), F.count(F.lit(1))).first()
        few = size <= HELD_CUTS
        if (most or 0) <= SMALL:
            break
    texts = inside(shift).groupBy("_class", "_prefix", TEXT).agg(F.count(F.lit(1)).alias("_n"))
    return settled(texts, TEXT).select("_class", "_rank", F.col(TEXT).alias("_cut"))


def _cuts(rows: DataFrame, ranks: Sequence[int]) -> dict[int, str | None]:
    """The order text at each rank of the whole table; None for a rank below 0."""
    whole = rows.withColumn("_class", F.lit(""))
    wanted = rows.sparkSession.createDataFrame([("", r) for r in set(ranks) if r >= 0], "_class string, _rank bigint")
    return dict.fromkeys(ranks) | {r["_rank"]: r["_cut"] for r in _cut_texts(whole, wanted).collect()}


def _of_class(rows: DataFrame, sizes: DataFrame, table: DataFrame, width: int = 1) -> DataFrame:
    """``rows`` (with _class) and what ``table`` (_class, ``width`` cuts or so) has for their class, null where it has nothing.

    No class with many rows is dealt to one task: tasks hold the table or, if it is large, its part for classes of more than one in
    ``held`` rows (``sizes`` has _class, _size), of which there are fewer than that. The others' rows meet it by a shuffle.
    """
    held = max(HELD_CUTS // max(width, 1), 1)
    table = stored(table, "by-class")
    if table.count() <= held:
        return rows.join(F.broadcast(table), "_class", "left")
    n = sizes.agg(F.sum("_size")).first()[0]
    large = sizes.where(F.col("_size") * held > F.lit(n)).select("_class", F.lit(True).alias("_large"))
    told = rows.join(F.broadcast(large), "_class", "left").withColumn("_large", F.col("_large").isNotNull() | F.col("_class").isNull())
    of_large = table.join(F.broadcast(large), "_class", "left_semi")
    near = told.where("_large").drop("_large").join(F.broadcast(of_large), "_class", "left")
    return near.unionByName(told.where("NOT _large").drop("_large").join(table, "_class", "left"))


def _upto(cut: str | None) -> Column:
    return F.lit(False) if cut is None else F.col(TEXT) <= F.lit(cut)


def split_exact(
    df: DataFrame, keys: Sequence[str], train: float = 0.7, val: float = 0.15, seed: int = 42, mode: str = "hash", out: str = "split"
) -> DataFrame:
    """Adds the part of each row: int(n*train) train, int(n*val) val, the rest test.

    ``mode='time'`` cuts along the (unique, numeric or date) key itself instead of its hash; there a
    row without a key is an error, because it has no place.
    """
    if mode == "hash":
        rows, place = _placed(df, keys, seed, df.columns), F.col(PLACE)
    elif mode == "time":
        kind = df.schema[keys[0]].dataType.simpleString()
        place = F.unix_date(keys[0]).cast("long") if kind == "date" else F.unix_micros(F.col(keys[0]).cast("timestamp"))
        rows = df
    else:
        raise ValueError(f"mode must be 'hash' or 'time', got {mode!r}")
    n, known = rows.agg(F.count(F.lit(1)), F.count(place)).first()
    if known < n:
        raise ValueError(f"{n - known} rows have no {keys[0]}")
    ranks = [int(n * train) - 1, int(n * train) + int(n * val) - 1]
    if mode == "hash":
        cuts = _cuts(rows, ranks)
        first, second = (_upto(cuts[r]) for r in ranks)
    else:
        found = order_statistics(rows, {"h": place}, {"h": {r for r in ranks if r >= 0}}, {"h": n})
        first, second = (place <= F.lit(found["h", r].value) if r >= 0 else F.lit(False) for r in ranks)
    part = F.when(first, F.lit("train")).when(second, F.lit("val")).otherwise(F.lit("test"))
    return rows.withColumn(out, part).drop(PLACE, TEXT)


def largest_remainder(sizes: dict[str, int], total: int) -> dict[str, int]:
    """``total`` shared out in proportion to ``sizes``; leftovers by largest remainder, then name."""
    n = sum(sizes.values())
    exact = {k: total * v / n for k, v in sizes.items()}
    shares = {k: math.floor(x) for k, x in exact.items()}
    order = sorted(exact, key=lambda k: (-(exact[k] - shares[k]), k))
    for k in order[: total - sum(shares.values())]:
        shares[k] += 1
    return shares


def _classes(df: DataFrame, label: str, keys: Sequence[str], seed: int) -> tuple[DataFrame, DataFrame]:
    """(rows with class and order text, (_class, _size) of each class); a null class is an error."""
    placed = _placed(df, keys, seed, df.columns).withColumn("_class", F.col(label).cast("string"))
    sizes = stored(placed.groupBy("_class").agg(F.count(F.lit(1)).alias("_size")), "classes")
    if not sizes.where(F.col("_class").isNull()).isEmpty():
        raise ValueError(f"{label} holds nulls")
    return placed, sizes


def split_stratified(
    df: DataFrame, label: str, keys: Sequence[str], test: float = 0.2, seed: int = 42, out: str = "split"
) -> DataFrame:
    """Train/test with ceil(n*test) test rows shared out over the classes, whatever their number: in proportion to their
    sizes, what rounding leaves by largest remainder, then name."""
    placed, sizes = _classes(df, label, keys, seed)
    n = sizes.agg(F.sum("_size")).first()[0] or 0
    total = math.ceil(n * test)
    exact = F.lit(total) * F.col("_size") / F.lit(max(n, 1))
    shares = stored(sizes.withColumn("_share", F.floor(exact).cast("long")).withColumn("_rest", exact - F.col("_share")), "shares")
    more = shares.orderBy(F.col("_rest").desc(), "_class").limit(total - (shares.agg(F.sum("_share")).first()[0] or 0)).select("_class", F.lit(1).alias("_more"))
    ranks = shares.join(more, "_class", "left").select("_class", (F.col("_share") + F.coalesce("_more", F.lit(0)) - 1).alias("_rank"))
    cuts = _cut_texts(placed, stored(ranks.where("_rank >= 0"), "ranks")).drop("_rank")
    rows = _of_class(placed, sizes, cuts)
    return rows.select(*df.columns, F.when(F.col(TEXT) <= F.col("_cut"), F.lit("test")).otherwise(F.lit("train")).alias(out))


def stratified_folds(df: DataFrame, label: str, keys: Sequence[str], k: int, seed: int = 42, out: str = "fold") -> DataFrame:
    """Fold number 0..k-1; each class, whatever their number, is cut into k parts of equal size (plus or minus one row)."""
    placed, sizes = _classes(df, label, keys, seed)
    ends = F.transform(F.sequence(F.lit(1), F.lit(k - 1)), lambda i: F.floor(F.col("_size") * i / k).cast("long") - 1) if k > 1 else F.array().cast("array<bigint>")
    ranks = sizes.select("_class", F.explode(ends).alias("_rank")).where("_rank >= 0").distinct()
    # Folds that end before the first row have no cut: every row lies above them. Folds may end at the same row.
    lists = _cut_texts(placed, stored(ranks, "ranks")).groupBy("_class").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_cut"))).alias("_cuts"))
    rows = _of_class(placed, sizes, sizes.select("_class", ends.alias("_ends")).join(lists, "_class", "left"), k)
    above = F.filter("_ends", lambda r: (r < 0) | (F.col(TEXT) > F.try_element_at("_cuts", r)))
    return rows.select(*df.columns, F.size(above).cast("int").alias(out))


def sample_exact(df: DataFrame, keys: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all, when there are fewer) by the seeded order."""
    size = df.count()
    if n >= size:
        return df
    placed = _placed(df, keys, seed, df.columns)
    cut = _cuts(placed, [n - 1])[n - 1] if n > 0 else None
    return placed.where(_upto(cut)).drop(PLACE, TEXT)


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Weight n / (k * n_class) of each row, joined from the table of class counts; null for a null class."""
    counts = stored(df.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("_class")).agg(F.count(F.lit(1)).alias("_size")), "classes")
    n, k = counts.agg(F.sum("_size"), F.count(F.lit(1))).first()
    weights = counts.select("_class", (F.lit(n or 0) / (F.lit(k) * F.col("_size"))).alias(out))
    rows = df.drop(out).withColumn("_class", F.col(label).cast("string"))
    return _of_class(rows, counts, weights).drop("_class")

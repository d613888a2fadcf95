"""Daily roll-up of crossings and its rate statistics."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from seacast.functions.direction import SEA_STATES, sea_ordinal

# The columns whose values are counted per day; their place is the slot number.
SLOTS = ["vent", "ciel", "mer", "ligne", "houle_dominante"]
NUMBER_SLOTS = ["houle_dominante"]


def order_key(ts: str, row_id: str) -> Column:
    """(time, id) packed into one decimal, ids being 0 or more.

    A decimal lives in the fixed-width aggregation buffer, so ``min`` over it stays a
    hash aggregate; ``min`` over a struct would sort every input partition.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp")).cast("decimal(20,0)")
    return micros * F.lit(Decimal(2**63)) + F.col(row_id).cast("decimal(20,0)")


def daily_rollup(
    df: DataFrame, day: str = "jour", order: Column | None = None, sea: str = "lexical"
) -> DataFrame:
    """One row per day: counts and rate of the target, first line, modes, extremes, means.

    Each crossing is expanded to one row per text-like column and pre-aggregated on
    (day, column, value) with fixed-width buffers: a hash aggregate on the map side, so a
    day that holds a third of all rows reaches the shuffle as a few dozen rows. The second
    step picks modes, first line and sea state from those counts.

    ``sea='lexical'`` takes the alphabetically last sea state, ``'ordinal'`` the roughest.
    """
    if sea not in ("lexical", "ordinal"):
        raise ValueError(f"sea must be 'lexical' or 'ordinal', got {sea!r}")
    order = order_key("horaire", "crossing_id") if order is None else order
    slots = [
        F.struct(
            F.lit(number).alias("slot"),
            (F.lit(None).cast("string") if col in NUMBER_SLOTS else F.col(col)).alias("text"),
            (F.col(col) if col in NUMBER_SLOTS else F.lit(None).cast("double")).alias("number"),
        )
        for number, col in enumerate(SLOTS)
    ]
    rows = df.where(F.col(day).isNotNull()).withColumn("_order", order)
    expanded = rows.select(
        F.col(day).alias("_day"),
        F.inline(F.array(*slots)),
        "annulation", "vent_noeud", "houle_max", "houle", "houle_periode", "temperature", "_order",
    )

    def in_slot(col: str) -> Column:
        return F.col("slot") == SLOTS.index(col)

    once = in_slot("vent")

    def only_once(col: str) -> Column:
        return F.when(once, F.col(col))

    counted = expanded.groupBy("_day", "slot", "text", "number").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(in_slot("ligne") & F.col("text").isNotNull(), F.col("_order"))).alias("first_at"),
        F.count(only_once("annulation")).alias("n_target"),
        F.sum(only_once("annulation")).alias("s_target"),
        F.max(only_once("vent_noeud")).alias("vent_noeud"),
        F.max(only_once("houle_max")).alias("houle_max"),
        F.sum(only_once("houle")).alias("s_houle"),
        F.count(only_once("houle")).alias("n_houle"),
        F.sum(only_once("houle_periode")).alias("s_periode"),
        F.count(only_once("houle_periode")).alias("n_periode"),
        F.min(only_once("temperature")).alias("t_min"),
        F.max(only_once("temperature")).alias("t_max"),
    )

    def mode(col: str, value: str) -> Column:
        """Most frequent non-null value, the smallest one on a tie."""
        usable = in_slot(col) & F.col(value).isNotNull()
        return F.min(F.when(usable, F.struct(-F.col("n"), F.col(value)))).getField(value)

    if sea == "lexical":
        sea_state = F.max(F.when(in_slot("mer"), F.col("text")))
    else:
        rank = F.when(in_slot("mer"), F.nullif(sea_ordinal(F.col("text")).cast("int"), F.lit(-1)))
        states = F.array(*[F.lit(s) for s in SEA_STATES])
        sea_state = F.get(states, F.max(rank))
    return counted.groupBy(F.col("_day").alias(day)).agg(
        F.sum("n_target").alias("n_traversees"),
        F.sum("s_target").alias("n_annulations"),
        F.try_divide(F.sum("s_target").cast("double"), F.sum("n_target")).alias("annulation_pct"),
        F.min_by("text", "first_at").alias("ligne"),
        mode("vent", "text").alias("vent"),
        F.max("vent_noeud").alias("vent_noeud"),
        mode("houle_dominante", "number").alias("houle_dominante"),
        F.max("houle_max").alias("houle_max"),
        F.try_divide(F.sum("s_houle"), F.sum("n_houle")).alias("houle"),
        F.try_divide(F.sum("s_periode"), F.sum("n_periode")).alias("houle_periode"),
        sea_state.alias("mer"),
        F.min("t_min").alias("temperature_min"),
        F.max("t_max").alias("temperature_max"),
        mode("ciel", "text").alias("ciel"),
    )


def daily_max(df: DataFrame, day: str = "jour") -> DataFrame:
    """Per day count, sum, maximum and mean of the target (the biased ``max`` label)."""
    return (
        df.where(F.col(day).isNotNull())
        .groupBy(day)
        .agg(
            F.count("annulation").alias("n_traversees"),
            F.sum("annulation").alias("n_annulations"),
            F.max("annulation").alias("annulation_max"),
            F.avg("annulation").alias("annulation_pct"),
        )
    )


def binarise(df: DataFrame, col: str = "annulation_pct", threshold: float = 0.166, out: str = "annulation_binary"):
    """1 where ``col`` reaches the threshold, else 0 (also for null)."""
    return df.withColumn(out, F.coalesce((F.col(col) >= F.lit(threshold)).cast("int"), F.lit(0)))


def target_stats(df: DataFrame) -> DataFrame:
    """Rows, cancelled rows and percentage over the whole table."""
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("annulation").alias("n_annulations"),
        (F.avg("annulation") * 100).alias("pct"),
    )


def day_rate_stats(daily: DataFrame, col: str = "annulation_pct") -> DataFrame:
    """Mean, sample standard deviation, minimum and maximum of the day rates."""
    return daily.agg(
        F.count(col).alias("n_days"),
        F.avg(col).alias("mean"),
        F.stddev_samp(col).alias("std"),
        F.min(col).alias("min"),
        F.max(col).alias("max"),
    )


def monthly_distribution(df: DataFrame, ts: str = "horaire") -> DataFrame:
    """Count, sum and rate (3 digits, half to even) per calendar month."""
    return (
        df.where(F.col(ts).isNotNull())
        .groupBy(F.date_trunc("month", F.col(ts)).cast("date").alias("mois"))
        .agg(
            F.count("annulation").alias("total"),
            F.sum("annulation").alias("annulations"),
            F.bround(F.avg("annulation"), 3).alias("pct"),
        )
    )


def period_compare(df: DataFrame, inside: Column, day: str = "jour") -> DataFrame:
    """The target's raw and per-day statistics for all rows and for the rows ``inside``.

    One pass: conditional counts per (day, inside), then one row per period.
    """
    per_day = (
        df.where(F.col(day).isNotNull())
        .groupBy(day, F.coalesce(inside, F.lit(False)).alias("_in"))
        .agg(
            F.count("annulation").alias("n"),
            F.sum("annulation").alias("s"),
            F.max("annulation").alias("m"),
        )
    )
    both = per_day.select(
        day, F.explode(F.when(F.col("_in"), F.array(F.lit("all"), F.lit("range"))).otherwise(F.array(F.lit("all")))).alias("period"),
        "n", "s", "m",
    ).groupBy(day, "period").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("m").alias("m"))
    return both.groupBy("period").agg(
        F.sum("n").alias("n_traversees"),
        F.sum("s").alias("n_annulations"),
        F.try_divide(F.sum("s") * 100.0, F.sum("n")).alias("pct"),
        F.count(F.lit(1)).alias("n_days"),
        F.sum(F.when(F.col("m") == 1, 1).otherwise(0)).alias("n_days_hit"),
        (F.avg(F.when(F.col("m") == 1, 1.0).otherwise(0.0)) * 100).alias("pct_days_hit"),
        F.avg("n").alias("mean_per_day"),
        F.min("n").alias("min_per_day"),
        F.max("n").alias("max_per_day"),
    )


def rate_by_flag(df: DataFrame, flag: str, target: str = "annulation") -> DataFrame:
    """Mean target per flag value."""
    return (
        df.where(F.col(flag).isNotNull())
        .groupBy(F.col(flag).alias("flag"))
        .agg(F.count(target).alias("n"), F.avg(target).alias("rate"))
    )


def rate_by_group_flag(df: DataFrame, group: str, names: list[str], flags: list[str], target: str = "annulation"):
    """Mean target per (group, flag column, flag 0/1); a missing cell counts as 0.

    All flags are answered in one pass; the result has one row per listed cell.
    """
    spark = df.sparkSession
    long = df.select(
        F.col(group).alias("_g"), F.col(target).alias("_y"),
        F.inline(F.array(*[F.struct(F.lit(f).alias("_f"), F.col(f).cast("int").alias("_v")) for f in flags])),
    )
    rates = long.groupBy("_g", "_f", "_v").agg(F.avg("_y").alias("_rate"))
    cells = spark.createDataFrame([(n, f, v) for n in names for f in flags for v in (0, 1)], "name string, flag string, value int")
    joined = cells.join(
        rates, (F.col("name") == F.col("_g")) & (F.col("flag") == F.col("_f")) & (F.col("value") == F.col("_v")), "left"
    )
    return joined.select("name", "flag", "value", F.coalesce("_rate", F.lit(0.0)).alias("rate"))


def crosstab_cells(df: DataFrame, row: str, col: str) -> DataFrame:
    """Row-normalised cross-tab in long form, over all values: ``row, col, share`` of each pair that occurs.

    The shares of a row sum to 1; a pair that does not occur has no row (its share is 0).
    """
    known = df.where(F.col(row).isNotNull() & F.col(col).isNotNull())
    cells = known.groupBy(row, col).agg(F.count(F.lit(1)).alias("_c"))
    totals = cells.groupBy(F.col(row).alias("_row")).agg(F.sum("_c").alias("_n"))
    return cells.join(totals, F.col(row) == F.col("_row")).select(row, col, (F.col("_c") / F.col("_n")).alias("share"))


def crosstab_share(df: DataFrame, row: str, col: str, values: list) -> DataFrame:
    """Row-normalised cross-tab: share of each ``col`` value per ``row`` value, absent cell 0.

    One column per listed value. A row that has a value outside the list ends the query with an
    error, so the shares always sum to 1; :func:`crosstab_cells` needs no list.
    """
    counts = df.where(F.col(row).isNotNull() & F.col(col).isNotNull()).groupBy(row).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count(F.when(F.col(col) == v, 1)).alias(f"_c{i}") for i, v in enumerate(values)],
    )
    listed = sum((F.col(f"_c{i}") for i in range(len(values))), F.lit(0))
    total = F.when(listed == F.col("_n"), F.col("_n")).otherwise(F.raise_error(F.lit(f"{col} has values that are not listed")).cast("bigint"))
    return counts.select(row, *[(F.col(f"_c{i}") / total).alias(f"{col}_{v}") for i, v in enumerate(values)])

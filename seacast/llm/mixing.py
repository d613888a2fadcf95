"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seacast.llm.common import prefix_sums, words
from seacast.session import stored

#: Weights of the sources in code point order (null last), repeated.
WEIGHTS = (5, 2, 1)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, limit: int = 2) -> DataFrame:
    """(source_no, source, source_size, target): ``share`` of all sizes split by weight, at most ``limit`` times a source.

    Excess over the limit goes to the others by weight until none is above. Each round is one aggregate
    over the table of sources; the driver sees two sums.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = prefix_sums(sums.select("*", F.col("source").isNull().alias("_last"), F.lit(0).alias("_all"), F.lit(1).alias("_one")), ["_all"], ["_last", "source"], "_one", "source_no")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int"))
    sources = stored(ranked.select("source_no", "source", "source_size", weight.cast("double").alias("weight")), "sources")
    goal = share * (sources.agg(F.sum("source_size")).collect()[0][0] or 0)
    level, known = 0.0, None
    while True:
        above = F.lit(level) * F.col("weight") > limit * F.col("source_size")
        row = sources.agg(
            F.coalesce(F.sum(F.when(above, limit * F.col("source_size"))), F.lit(0)), F.sum(F.when(~above, F.col("weight"))),
            F.count(F.when(above, 1)),
        ).collect()[0]
        if row[1] is None or row[2] == known:
            break
        known, level = row[2], (goal - row[0]) / row[1]
    target = F.least(F.lit(level) * F.col("weight"), limit * F.col("source_size").cast("double"))
    return sources.select("source_no", "source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, limit: int = 2, seed: int = 11, row: str | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): how many words of each document the mix takes.

    Within a source, documents are ordered by a hash of (seed, doc_id). The mix takes the source's whole
    epochs and then documents in that order up to the exact budget, floor(target); the document at the
    cut gives its first words. A null text has size 0; a null source is a source of its own; a null
    doc_id sorts by the hash of the empty string; repeated rows count as documents of their own. A very long text
    counts whole. ``row`` names a unique column that orders rows which are otherwise equal; it is kept.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    more = [row] if row else []
    sizes = docs.select("doc_id", "source", F.size(words()).cast("long").alias("size"), key.alias("_key"), *more)
    sizes = stored(sizes, "sizes")
    targets = source_targets(sizes, weights, share, limit)
    numbered = sizes.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = prefix_sums(numbered, ["source_no"], ["_key", "doc_id", "size", *more], "size", "_before")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.floor("target") - epochs * F.col("source_size")
    last = F.greatest(F.lit(0), F.least(rest - F.col("_before"), F.col("size")))
    return placed.select(*more, "doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + last).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a document once per epoch, the one at the cut with its first words
    joined by one space. Documents without words, and rows the budget leaves out, are not part of it.

    The rows are written once with a number, so that each takes what the mix gives to it, also where several have
    the same id, source and size. A column named like the number is kept.
    """
    number = next(n for n in (f"_row{i}" for i in range(len(docs.columns) + 1)) if n not in {c.lower() for c in docs.columns})
    rows = stored(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    plan = mix(rows.select(number, "doc_id", "source", "text"), row=number, **options).where("taken > 0")
    plan = plan.select(F.col(number).alias("_at"), F.col("size").alias("_n"), F.col("taken").alias("_taken"))
    whole = F.floor(F.col("_taken") / F.greatest("_n", F.lit(1)))  # what is taken has words; a pushed-down filter may not know that
    cut = F.col("_taken") - whole * F.col("_n")
    copies = F.sequence(F.lit(1), (whole + F.when(cut > 0, 1).otherwise(0)).cast("int"))
    plan = plan.select("_at", whole.alias("_whole"), cut.alias("_cut"), copies.alias("_copies"))
    kept = rows.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(number).alias("_number"))
    spread = kept.join(plan, F.col("_number") == F.col("_at")).select("_doc", "_whole", "_cut", F.explode("_copies").alias("_copy"))
    short = F.array_join(F.slice(words(F.col("_doc")["text"]), 1, F.greatest(F.col("_cut"), F.lit(1)).cast("int")), " ")
    text = F.when(F.col("_copy") > F.col("_whole"), short).otherwise(F.col("_doc")["text"]).alias("text")
    return spread.select(*[text if c == "text" else F.col("_doc").getField(c).alias(c) for c in docs.columns])

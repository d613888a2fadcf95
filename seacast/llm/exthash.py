"""Exact deduplication through an extendible-hash index written to shared files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from seacast.llm.common import SPACE, without
from seacast.session import stored

#: Distinct hashes that a bucket holds before it splits.
CAPACITY = 4_096


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", " ")


def directory(keys: DataFrame, capacity: int = CAPACITY, max_depth: int | None = None) -> DataFrame:
    """(prefix, depth): the buckets of an extendible hash over the distinct values of ``keys.h``.

    Doubling the directory gives every bucket one more bit; a bucket that holds more than ``capacity``
    keys splits, the others keep their depth. All depths are counted at once from one histogram of
    ``2 ** max_depth`` cells, and a bucket is the shallowest prefix that fits under a parent that does
    not. At ``max_depth`` (16 cells for each bucket expected, if not given) an overfull bucket stays.
    """
    if max_depth is None:
        max_depth = min(24, max(1, (-(-keys.count() // capacity) * 16 - 1).bit_length()))
    cells = keys.groupBy(cell(F.col("h"), F.lit(max_depth)).alias("cell")).agg(F.count(F.lit(1)).alias("keys"))
    depths = F.explode(F.sequence(F.lit(0), F.lit(max_depth))).alias("depth")
    at = F.expr(f"shiftright(cell, {max_depth} - depth)").alias("prefix")
    sums = cells.select(depths, "cell", "keys").groupBy("depth", at).agg(F.sum("keys").alias("keys"))
    full = sums.where(F.col("keys") > capacity).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("above"))
    below = sums.withColumn("above", F.expr("shiftright(prefix, 1)")).join(full, ["depth", "above"], "left_semi")
    root = sums.where(F.col("depth") == 0)
    leaf = (F.col("keys") <= capacity) | (F.col("depth") == max_depth)
    return root.unionByName(below.select("depth", "prefix", "keys")).where(leaf).select("prefix", "depth")


def cell(h: Column, depth: Column) -> Column:
    """The first ``depth`` bits of a 64-bit hash."""
    return F.when(depth == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", h, (F.lit(64) - depth).cast("int")))


def cells_of(buckets: DataFrame) -> tuple[DataFrame, int]:
    """((cell, prefix, depth), bits): the directory itself, one entry for each value of the first ``bits`` bits of a hash.

    A bucket of a smaller depth has several entries, as after doublings that did not concern it.
    """
    bits = buckets.agg(F.max("depth")).first()[0] or 0
    wide = F.expr(f"shiftleft(1L, {bits} - depth)")
    first = F.expr(f"shiftleft(prefix, {bits} - depth)")
    return buckets.select(F.explode(F.sequence(first, first + wide - 1)).alias("cell"), "prefix", "depth"), bits


def looked_up(rows: DataFrame, cells: DataFrame, bits: int, h: str = "h") -> DataFrame:
    """``rows`` with prefix and depth of the bucket that the directory names for their hash."""
    named = rows.withColumn("_cell", cell(F.col(h), F.lit(bits)))
    return named.join(cells.withColumnRenamed("cell", "_at"), F.col("_cell") == F.col("_at")).drop("_cell", "_at")


def build_index(docs: DataFrame, text: str = "text", hash_of=F.xxhash64, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame, int]:
    """(index, cells, bits): one entry per distinct normalised text, written to the shared folder, and the directory.

    Columns: prefix and depth of its bucket, h, chain_no and chain_len among the entries of one hash,
    norm (null where the chain has one entry), keep_id, group_size, text_sha256. The owner of a hash sees its least and
    greatest text, after a map-side pass that leaves one row per task of a hot text: where these
    are the same bytes, all are, and the hash has one entry; otherwise its texts are told apart by their bytes and
    chained. Buckets split by doubling the directory until none holds more than ``capacity`` hashes; entries are
    written by the owners of ranges of (bucket, hash).
    """
    texts = docs.select(F.col("doc_id"), normalised(F.col(text)).alias("norm")).select("doc_id", "norm", hash_of("norm").alias("h"))
    ends = texts.groupBy("h").agg(F.min("norm").alias("low"), F.max("norm").alias("high"), F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    slots = stored(ends.select("h", (F.col("low") == F.col("high")).alias("alone"), F.sha2("low", 256).alias("text_sha256"), "keep_id", "group_size"), "slots")
    entries = slots.where("alone").select("h", F.lit(None).cast("string").alias("norm"), "text_sha256", "keep_id", "group_size")
    shared = slots.where("NOT alone").select("h")
    if not shared.isEmpty():
        chained = texts.join(shared, "h", "left_semi").groupBy("h", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        entries = entries.unionByName(chained.withColumn("text_sha256", F.sha2("norm", 256)))
    cells, bits = cells_of(stored(directory(slots.select("h"), capacity), "directory"))
    cells = stored(cells, "cells")
    owners = looked_up(entries, cells, bits).repartitionByRange("prefix", "depth", "h")
    chain = Window.partitionBy("prefix", "depth", "h")
    index = stored(
        owners.withColumn("chain_no", F.row_number().over(chain.orderBy("norm")))
        .withColumn("chain_len", F.count(F.lit(1)).over(chain)), "index",
    )
    return index, cells, bits


def exact_dedup(docs: DataFrame, text: str = "text", hash_of=F.xxhash64, capacity: int = CAPACITY) -> DataFrame:
    """``docs`` with keep_id, group_size, kept and text_sha256; these replace columns of the same name.

    Texts are equal when identical after white space runs become one space; null counts as empty; a very long text is
    compared whole. The row with the smallest doc_id stays (nulls count as larger than any id); of several rows with that
    id one stays. A row finds its bucket in the directory and its entry in the bucket by its hash; where that has a
    chain, by the bytes of its text.
    """
    index, cells, bits = build_index(docs, text, hash_of, capacity)
    index = index.select(
        F.col("prefix").alias("_p2"), F.col("depth").alias("_d2"), F.col("h").alias("_h"), F.col("norm").alias("_text"),
        F.col("text_sha256").alias("_sha"), "chain_len", F.col("keep_id").alias("_keep"), F.col("group_size").alias("_size"),
    )
    cells = cells.select("cell", F.col("prefix").alias("_p"), F.col("depth").alias("_d"))
    out = ("keep_id", "group_size", "kept", "text_sha256", "_norm", "_h2", "_cell", "_at", "_p", "_d")
    keyed = docs.select(*without(docs, *out), normalised(F.col(text)).alias("_norm")).withColumn("_h2", hash_of("_norm"))
    placed = looked_up(keyed, cells, bits, "_h2")
    there = (F.col("_p") == F.col("_p2")) & (F.col("_d") == F.col("_d2")) & (F.col("_h2") == F.col("_h"))
    found = placed.join(index, there & ((F.col("chain_len") == 1) | (F.col("_norm") == F.col("_text"))))
    first = F.col("doc_id").eqNullSafe(F.col("_keep"))
    return found.select(
        *without(docs, *out), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"), first.alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def one_row_per_key(found: DataFrame) -> DataFrame:
    """Of several rows that are kept for one text (a doc_id that is there twice), leaves one.

    Only rows that stay meet by text; the others are dealt by their own id, so no copy group gathers.
    """
    meet = F.when(F.col("kept"), F.lit(0)).otherwise(F.xxhash64("doc_id"))
    order = Window.partitionBy("text_sha256", meet).orderBy(F.lit(1))
    return found.withColumn("_n", F.row_number().over(order)).withColumn("kept", F.col("kept") & (F.col("_n") == 1)).drop("_n")

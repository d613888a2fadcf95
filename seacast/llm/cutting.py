"""Packing by cutting-stock column generation: a linear program over a length histogram, patterns dealt to ranked pieces."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from seacast.llm.blocks import slices
from seacast.llm.common import prefix_sums
from seacast.llm.tokens import Encoder
from seacast.session import stored

#: Tokens of a sequence, tokens of a histogram bin, bytes of text encoded at once.
LENGTH, STEP, SLICE = 2048, 8, 1 << 20


def best_pattern(duals: np.ndarray, sizes: np.ndarray, width: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the pattern of the largest total dual that fits ``width``."""
    value, choice = np.zeros(width + 1), np.full(width + 1, -1)
    fits = np.searchsorted(sizes, np.arange(width + 1), side="right")
    for room in range(1, width + 1):
        value[room] = value[room - 1]
        if k := fits[room]:
            gains = value[room - sizes[:k]] + duals[:k]
            j = int(gains.argmax())
            if gains[j] > value[room] + 1e-12:
                value[room], choice[room] = gains[j], j
    pattern, room = np.zeros(len(sizes), np.int64), width
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            pattern[choice[room]] += 1
            room -= sizes[choice[room]]
    return float(value[width]), pattern


def column_generation(sizes: np.ndarray, demand: np.ndarray, width: int, gap: float = 2e-4, rounds: int = 6000) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, amounts): a basis of the linear program that covers ``demand`` with the fewest sequences.

    Revised simplex with the inverse of the basis; the knapsack prices columns until no pattern could
    save more than ``gap`` of the sequences. After ``rounds`` the basis reached is used: it covers the
    demand all the same.
    """
    m = len(sizes)
    columns = np.diag(width // sizes).astype(np.int64)
    inverse = np.diag(1.0 / (width // sizes))
    amounts = inverse @ demand
    for _ in range(rounds):
        duals = np.maximum(inverse.sum(axis=0), 0)
        value, pattern = best_pattern(duals, sizes, width)
        if value <= 1 + gap:
            break
        direction = inverse @ pattern
        ratios = np.where(direction > 1e-9, amounts / np.where(direction > 1e-9, direction, 1), np.inf)
        leave = int(ratios.argmin())
        amounts = np.maximum(amounts - ratios[leave] * direction, 0)
        amounts[leave] = ratios[leave]
        row = inverse[leave] / direction[leave]
        inverse -= np.outer(direction, row)
        inverse[leave] = row
        columns[:, leave] = pattern
    return columns.T[:m], amounts


def best_fit(sizes: np.ndarray, counts: np.ndarray, width: int) -> list[np.ndarray]:
    """Patterns for what rounding leaves: largest first, into the fullest sequence with room."""
    rooms: list[list[int]] = [[] for _ in range(width + 1)]
    made: list[np.ndarray] = []
    for j in reversed(range(len(sizes))):
        for _ in range(int(counts[j])):
            room = next((r for r in range(int(sizes[j]), width + 1) if rooms[r]), None)
            if room is None:
                made.append(np.zeros(len(sizes), np.int64))
                room, p = width, len(made) - 1
            else:
                p = rooms[room].pop()
            made[p][j] += 1
            rooms[room - int(sizes[j])].append(p)
    return made


def plan(histogram: dict[int, int], width: int) -> list[tuple[dict[int, int], int]]:
    """[(pieces of each size, how many sequences)] that hold all pieces of the histogram."""
    if not histogram:
        return []
    sizes = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[s] for s in sizes.tolist()], np.int64)
    patterns, amounts = column_generation(sizes, demand.astype(float), width)
    left, out = demand.copy(), []
    for pattern, amount in zip(patterns, np.floor(amounts + 1e-6).astype(np.int64)):
        use = pattern > 0
        times = int(min(amount, (left[use] // pattern[use]).min()))
        if times:
            left -= times * pattern
            out.append((pattern, times))
    out += [(p, 1) for p in best_fit(sizes, left, width)]
    return [({int(s): int(a) for s, a in zip(sizes, p) if a}, n) for p, n in out]


class Cutter:
    """Texts to pieces of at most ``length`` ids, with the crc32 of each piece's ids and, if asked, the ids."""

    def __init__(self, encoder: Encoder, end_id: int, length: int, with_ids: bool):
        self.encoder, self.end_id, self.length, self.with_ids = encoder, end_id, length, with_ids

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in slices(batches, SLICE):
            ids, offsets = self.encoder(table["text"].combine_chunks(), self.end_id)
            sizes = np.diff(offsets)
            pieces = -(-sizes // self.length)
            row = np.repeat(np.arange(len(sizes)), pieces)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * self.length
            length = np.minimum(sizes[row] - start, self.length)
            raw, begin = memoryview(ids.astype("<u4").tobytes()), offsets[row] + start
            cuts = [raw[4 * a : 4 * b] for a, b in zip(begin.tolist(), (begin + length).tolist())]
            columns = [table["doc_id"].combine_chunks().take(pa.array(row)), pa.array(start), pa.array(length), pa.array([zlib.crc32(c) for c in cuts], pa.int64()), pa.array(sizes[row])]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if self.with_ids:
                columns, names = [*columns, pa.array([bytes(c) for c in cuts], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)


def pack(docs: DataFrame, tokenizer: str, spaces: bool, end_id: int, length: int = LENGTH, step: int = STEP, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids: little-endian, 4 bytes
    each, when ``with_ids``).

    A document (its ids and ``end_id``; a null text has only that) is cut into pieces of ``length`` ids,
    which fill sequences of their own, and a rest. Rests are counted by length in bins of ``step`` ids;
    the driver sees this histogram only (``length / step`` rows at most). Column generation covers it by
    patterns, rounded down, and the few rests that rounding leaves are packed by best fit. Pieces are
    ranked within their bin by distributed prefix sums and each pattern takes a range of ranks, so a bin
    with a third of all pieces is dealt over all tasks. Repeated rows and null ids are documents of
    their own. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    extra = ", ids binary" if with_ids else ""
    kinds = f"doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint{extra}"
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    pieces = stored(rows.mapInArrow(Cutter(Encoder(tokenizer, spaces), end_id, length, with_ids), kinds), "pieces")
    size = F.ceil(F.col("length") / step).cast("int")
    rests = pieces.where(F.col("length") < length).withColumns({"_bin": size, "_one": F.lit(1)})
    counts = {r[0]: r[1] for r in rests.groupBy("_bin").count().collect()}
    dealt, sequences, ranks = [], 0, dict.fromkeys(counts, 0)
    for pattern, times in plan(counts, length // step):
        slot = 0
        for b, a in sorted(pattern.items(), reverse=True):
            dealt.append((b, ranks[b], ranks[b] + a * times, a, sequences, slot))
            ranks[b] += a * times
            slot += a
        sequences += times
    # As an Arrow table it is part of the plan: rows given as a list would start more Python workers on every executor.
    kinds = {"_b": pa.int32()} | dict.fromkeys(["_lo", "_hi", "_each", "_base", "_slot"], pa.int64())
    table = spark.createDataFrame(pa.table({c: pa.array([d[i] for d in dealt], kinds[c]) for i, c in enumerate(kinds)}))
    order = ["length", "doc_id", "start", "ids_crc32"]
    ranked = prefix_sums(rests, ["_bin"], order, "_one", "_rank")
    # As many rows as patterns have bins: a bound by length / step, whatever the number of documents.
    placed = ranked.join(F.broadcast(table), (F.col("_bin") == F.col("_b")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    inner = F.col("_rank") - F.col("_lo")
    placed = placed.withColumns({"sequence_id": (F.col("_base") + F.floor(inner / F.col("_each"))).cast("long"), "_at": F.col("_slot") + inner % F.col("_each")})
    before = Window.partitionBy("sequence_id").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
    full = pieces.where(F.col("length") == length).withColumns({"_all": F.lit(0), "_one": F.lit(1)})
    full = prefix_sums(full, ["_all"], ["doc_id", "start", "ids_crc32"], "_one", "_rank").withColumns(
        {"sequence_id": F.col("_rank") + F.lit(sequences).cast("long"), "offset": F.lit(0).cast("long")}
    )
    out = [*pieces.columns, "sequence_id", "offset"]
    return placed.select(out).unionByName(full.select(out))

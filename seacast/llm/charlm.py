"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from seacast.llm.blocks import POWERS, mixed, ragged, slices
from seacast.session import stored

UNKNOWN = "und"
#: Characters of an n-gram; bytes of text held at once; distinct windows that a task holds before it hands them on.
ORDER, SLICE, HELD = 4, 2 << 20, 1 << 19
#: Entries of all models up to which tasks hold them (16 bytes each); beyond, windows are joined with the tables.
ENTRIES = 6_000_000
#: Of the learning documents, one in so many is kept out of the counts to calibrate scores and rejection.
CALIBRATION = 20
#: Inverse temperatures tried, and the share of calibration documents of a language that the rejection bound leaves out.
TEMPERATURES, REJECTED = [2.0**-k for k in range(0, 14)], 0.001
#: Stands before the first character of a document; every character that is no letter is a blank.
PAD, BLANK = 10, 32
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _LETTERS[0]


class Chars:
    """Documents as lower-case letters and single blanks, each behind ``ORDER - 1`` pads."""

    def __init__(self, texts: list[str | None], order: int):
        low = ["" if t is None else t.lower() for t in texts]
        sizes = np.fromiter(map(len, low), np.int64, len(low))
        codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = letters()[codes]
        doc = np.repeat(np.arange(len(low)), sizes)
        before = np.concatenate([[False], letter[:-1]]) if len(codes) else letter
        before[(np.cumsum(sizes) - sizes)[sizes > 0]] = False
        keep = letter | before  # a blank only after a letter
        self.letters = np.bincount(doc[letter], minlength=len(low))
        self.sizes = np.bincount(doc[keep], minlength=len(low))
        pads = order - 1
        self.codes = np.full(int(keep.sum()) + pads * len(low), PAD, np.uint32)
        self.at = np.arange(int(keep.sum())) + pads * (doc[keep] + 1)  # place of each character; its window ends there
        self.codes[self.at] = np.where(letter, codes, BLANK)[keep]
        self.doc = doc[keep]

    def windows(self, order: int) -> np.ndarray:
        """A hash of the ``order`` characters that end at each place of ``at``."""
        return hashes(self.codes, self.at, order)


def hashes(codes: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    prefix = POWERS.prefix(mixed(codes.astype(np.uint64) + np.uint64(7)))
    return mixed(POWERS.ranges(prefix, ends - n + 1, ends + 1)) if len(ends) else np.zeros(0, np.uint64)


def strings(codes: np.ndarray, ends: np.ndarray, n: int) -> pa.Array:
    return pa.array(np.ascontiguousarray(codes[ends[:, None] + np.arange(1 - n, 1)]).view(f"<U{n}").reshape(-1), pa.string())


class Counts:
    """Documents to (lang, gram, n): windows of each language, told apart within a task."""

    def __init__(self, order: int):
        self.order = order

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        for table in slices(batches, SLICE):
            for lang, rows in grouped(table["lang"].to_pylist()):
                chars = Chars(table["text"].take(pa.array(rows)).to_pylist(), self.order)
                key, first, n = np.unique(chars.windows(self.order), return_index=True, return_counts=True)
                both = [key, n, chars.codes[chars.at[first][:, None] + np.arange(1 - self.order, 1)]]
                held[lang] = merged(held[lang], both) if lang in held else both
            if sum(len(x[0]) for x in held.values()) > HELD:
                yield from self.flush(held)
                held = {}
        yield from self.flush(held)

    def flush(self, held) -> Iterator[pa.RecordBatch]:
        for lang, (_, n, codes) in held.items():
            grams = pa.array(np.ascontiguousarray(codes).view(f"<U{self.order}").reshape(-1), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), grams, pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def merged(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    key, first, of = np.unique(np.concatenate([a[0], b[0]]), return_index=True, return_inverse=True)
    return [key, np.bincount(of, np.concatenate([a[1], b[1]]), len(key)).astype(np.int64), np.concatenate([a[2], b[2]])[first]]


def grouped(names: list[str]) -> Iterator[tuple[str, list[int]]]:
    rows: dict[str, list[int]] = {}
    for i, name in enumerate(names):
        rows.setdefault(name, []).append(i)
    yield from rows.items()


def fit(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, size, gram, weight, p): the interpolated Kneser-Ney model of each language of ``docs`` (text, lang).

    Rows with ``p`` are n-grams of ``size`` characters, ``p`` the probability of the last one after the others. Rows
    with ``weight`` are contexts of ``size - 1`` characters: a character that was not seen after it has ``weight``
    times its probability after the context without its first character. The highest order counts occurrences, the
    lower ones the different characters before; each order of each language has one discount n1 / (n1 + 2 n2), a half
    where one of both is 0. The row of size 0 is what all characters seen in any language, and one for all others, share.
    """
    counts = stored(docs.mapInArrow(Counts(order), "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    seen, tables = counts, {order: counts}
    for size in range(order - 1, 0, -1):
        seen = seen.groupBy("lang", F.substring("gram", 2, size).alias("gram")).agg(F.count("*").alias("n"))
        tables[size] = seen = stored(seen, "grams")
    chars = tables[1].select("gram").distinct().count() + 1
    lower = tables[1].select("lang").distinct().select("lang", F.lit(0).alias("size"), F.lit("").alias("gram"), F.lit(None).cast("double").alias("weight"), F.lit(1.0 / chars).alias("p"))
    made = [lower]
    for size in range(1, order + 1):
        one, few = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
        cuts = tables[size].groupBy("lang").agg(F.when((one > 0) & (few > 0), one / (one + 2 * few)).otherwise(0.5).alias("discount"))
        rows = tables[size].withColumn("context", F.substring("gram", 1, size - 1))
        contexts = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).join(cuts, "lang")
        contexts = contexts.withColumn("weight", F.col("discount") * F.col("kinds") / F.col("total"))
        below = lower.select("lang", F.col("gram").alias("shorter"), F.col("p").alias("below"))
        rows = rows.withColumn("shorter", F.substring("gram", 2, size - 1)).join(contexts, ["lang", "context"]).join(below, ["lang", "shorter"])
        p = (F.col("n") - F.col("discount")) / F.col("total") + F.col("weight") * F.col("below")
        lower = stored(rows.select("lang", F.lit(size).alias("size"), "gram", F.lit(None).cast("double").alias("weight"), p.alias("p")), "model")
        made += [lower, contexts.select("lang", F.lit(size).alias("size"), F.col("context").alias("gram"), "weight", F.lit(None).cast("double").alias("p"))]
    return stored(reduce(DataFrame.unionByName, made), "model")


def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams to the hashes of their characters."""
    for batch in batches:
        grams = batch.column("gram").to_pylist()
        codes, sizes = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32), np.fromiter(map(len, grams), np.int64, len(grams))
        prefix = POWERS.prefix(mixed(codes.astype(np.uint64) + np.uint64(7)))
        key = mixed(POWERS.ranges(prefix, np.cumsum(sizes) - sizes, np.cumsum(sizes))) if len(grams) else np.zeros(0, np.uint64)
        value = pc.coalesce(batch.column("p"), batch.column("weight"))
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("size"), batch.column("p").is_valid(), pa.array(key.view(np.int64)), value], ["lang", "size", "whole", "key", "value"])


class Arrays:
    """The models of all languages: for each size sorted hashes of n-grams and of contexts with their values."""

    def __init__(self, table: pa.Table, langs: list[str], order: int):
        lang, size, whole = (table[c].to_numpy() for c in ("lang", "size", "whole"))
        key, value = table["key"].to_numpy().view(np.uint64), table["value"].to_numpy()
        self.order, self.parts = order, []
        for name in langs:
            of = lang == name
            cells = []
            for n in range(order + 1):
                for kind in (True, False):
                    at = np.flatnonzero(of & (size == n) & (whole == kind))
                    at = at[np.argsort(key[at])]
                    cells.append((key[at], value[at]))
            self.parts.append(cells)

    def logs(self, codes: np.ndarray) -> np.ndarray:
        """-log2 of the probability of the last character of each row after the others, for each language."""
        flat, ends = codes.reshape(-1), np.arange(len(codes)) * self.order + self.order - 1
        grams = [hashes(flat, ends, n) for n in range(1, self.order + 1)]
        contexts = [hashes(flat, ends - 1, n - 1) for n in range(1, self.order + 1)]
        out = np.empty((len(self.parts), len(codes)))
        for k, cells in enumerate(self.parts):
            p = np.full(len(codes), cells[0][1][0])
            for n in range(1, self.order + 1):
                weight, _ = found(*cells[2 * n + 1], contexts[n - 1], 1.0)
                whole, there = found(*cells[2 * n], grams[n - 1], 0.0)
                p = np.where(there, whole, p * weight)
            out[k] = -np.log2(p)
        return out


def found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, otherwise: float) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    there = keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)
    return np.where(there, values[at] if len(keys) else otherwise, otherwise), there


class Entropies:
    """Documents to (..., letters, chars, entropies): bits a character under each language's model."""

    def __init__(self, arrays, order: int):
        self.arrays, self.order = arrays, order

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in slices(batches, SLICE):
            chars = Chars(table["text"].to_pylist(), self.order)
            _, first, of = np.unique(chars.windows(self.order), return_index=True, return_inverse=True)
            logs = self.arrays.value.logs(chars.codes[chars.at[first][:, None] + np.arange(1 - self.order, 1)])
            n = table.num_rows
            sums = np.stack([np.bincount(chars.doc, one[of], n) for one in logs], axis=1) / np.maximum(chars.sizes, 1)[:, None]
            lists = pa.FixedSizeListArray.from_arrays(pa.array(sums.reshape(-1)), len(logs)).cast(pa.list_(pa.float64()))
            rest = [table[c].combine_chunks() for c in table.column_names if c != "text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(chars.letters), pa.array(chars.sizes), lists], [*(c for c in table.column_names if c != "text"), "letters", "chars", "entropies"])


class Windows:
    """Documents to (row, letters, chars, gram, n): their distinct windows, for the way by joins."""

    def __init__(self, order: int):
        self.order = order

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in slices(batches, SLICE):
            chars = Chars(table["text"].to_pylist(), self.order)
            key = mixed(chars.windows(self.order) ^ mixed(chars.doc.astype(np.uint64) + np.uint64(1)))
            _, first, n = np.unique(key, return_index=True, return_counts=True)
            doc = chars.doc[first]
            yield pa.RecordBatch.from_arrays(
                [table["row"].combine_chunks().take(pa.array(doc)), pa.array(chars.letters[doc]), pa.array(chars.sizes[doc]), strings(chars.codes, chars.at[first], self.order), pa.array(n.astype(np.int64))],
                ["row", "letters", "chars", "gram", "n"],
            )


def entropies(docs: DataFrame, model: DataFrame, langs: list[str], order: int, entries: int = ENTRIES) -> DataFrame:
    """``docs`` without its text, with letters, chars and entropies (bits a character for each of ``langs``, in order).

    Up to ``entries`` n-grams and contexts of all languages together, tasks hold them as sorted hash arrays (16 bytes
    each); a larger model stays a table, and the distinct windows of the documents are joined with it. Both give the
    same sums but for the order of additions.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    if model.count() <= entries:
        table = model.mapInArrow(hashed, "lang string, size int, whole boolean, key bigint, value double").toArrow()
        arrays = docs.sparkSession.sparkContext.broadcast(Arrays(table, langs, order))
        return docs.mapInArrow(Entropies(arrays, order), f"{kinds}, letters bigint, chars bigint, entropies array<double>")
    return entropies_by_join(docs, model, langs, order)


def entropies_by_join(docs: DataFrame, model: DataFrame, langs: list[str], order: int) -> DataFrame:
    """:func:`entropies` with the model as tables: windows of all documents meet the n-grams and contexts of their suffixes."""
    rows = stored(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    windows = stored(rows.select("row", "text").mapInArrow(Windows(order), "row bigint, letters bigint, chars bigint, gram string, n bigint"), "windows")
    names = F.array(*map(F.lit, langs))
    by = model.groupBy("size", F.col("p").isNotNull().alias("whole"), "gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", F.coalesce("p", "weight").alias("v")))).alias("values"))
    by = stored(by, "values")
    base = model.where("size = 0").select("p").first()[0]
    types = windows.select("gram").distinct().withColumn("ps", F.transform(names, lambda _: F.lit(base)))
    for size in range(1, order + 1):
        for whole, part in ((False, F.substring("gram", order - size + 1, size - 1)), (True, F.substring("gram", order - size + 1, size))):
            side = by.where((F.col("size") == size) & (F.col("whole") == whole)).select(F.col("gram").alias("part"), "values")
            types = types.withColumn("part", part).join(side, "part", "left").drop("part")
            value = lambda lang: F.try_element_at("values", lang)
            step = (lambda lang, p: F.coalesce(value(lang), p)) if whole else (lambda lang, p: p * F.coalesce(value(lang), F.lit(1.0)))
            types = types.withColumn("ps", F.zip_with(names, "ps", step)).drop("values")
    sums = windows.join(types, "gram").groupBy("row").agg(
        F.max("letters").alias("letters"), F.max("chars").alias("chars"), *(F.sum(-F.log2(F.col("ps")[k]) * F.col("n")).alias(f"_h{k}") for k in range(len(langs)))
    )
    bits = F.array(*(F.coalesce(F.col(f"_h{k}") / F.col("chars"), F.lit(0.0)) for k in range(len(langs))))
    empty = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("letters", "chars")]
    kept = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return rows.drop("text").join(sums, "row", "left").select(*kept, *empty, bits.alias("entropies"))


def calibrate(judged: DataFrame, langs: list[str]) -> tuple[float, dict[str, float]]:
    """(temperature, bounds) from documents of known language: the inverse temperature with the least log loss of the right
    language, and for each language the entropy that ``REJECTED`` of its documents exceed."""
    right = F.element_at("entropies", F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int"))
    rows = judged.where((F.col("letters") > 0) & F.col("lang").isin(langs)).withColumn("right", right)

    def loss(t: float) -> Column:
        odds = F.transform("entropies", lambda h: F.pow(F.lit(2.0), F.least((F.col("right") - h) * F.col("chars") * t, F.lit(1000.0))))
        return F.avg(F.log2(F.aggregate(odds, F.lit(0.0), lambda a, x: a + x)))

    losses = rows.agg(*(loss(t).alias(str(k)) for k, t in enumerate(TEMPERATURES))).first()
    bounds = {r.lang: r.bound for r in rows.groupBy("lang").agg(F.percentile_approx("right", 1 - REJECTED, 10000).alias("bound")).collect()}
    best = min(range(len(TEMPERATURES)), key=lambda k: losses[k]) if losses[0] is not None else len(TEMPERATURES) // 2
    return TEMPERATURES[best], bounds


def identify(docs: DataFrame, learn: Column, fold: Column, order: int = ORDER, entries: int = ENTRIES) -> DataFrame:
    """``docs`` without its text, with lang_pred, score, entropy and rejected.

    Rows where ``learn`` holds, text and lang are not null are learned from; of these, rows where ``fold`` (a column of
    numbers) is 0 modulo ``CALIBRATION`` set temperature and rejection bounds instead, unless their language has no
    other row. ``lang_pred`` is the language with the least cross-entropy a character (ties: the first by code points),
    ``score`` its share of the tempered likelihoods, and ``rejected`` tells that its entropy is beyond what documents of
    the language reach. A null text, one without a letter, or any text where nothing can be learned is ``und`` with
    score 0 and no entropy. Whole texts count, in lower case, other characters than letters as one blank. Equal texts
    get equal results; a null ``learn`` counts as false. The languages are a label set, so their names fit the driver.
    """
    labelled = docs.where(F.coalesce(learn, F.lit(False)) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    labelled = labelled.select("text", F.col("lang").cast("string").alias("lang"), (F.coalesce(fold, F.lit(1)) % CALIBRATION == 0).alias("_fold"))
    common = [r.lang for r in labelled.where(~F.col("_fold")).select("lang").distinct().collect()]
    apart = F.col("_fold") & F.col("lang").isin(common)
    model = fit(labelled.where(~apart).select("text", "lang"), order)
    langs = sorted(r.lang for r in model.select("lang").distinct().collect())
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    if not langs:
        return docs.select(*rest, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("entropy"), F.lit(False).alias("rejected"))
    temperature, bounds = calibrate(entropies(labelled.where(apart).select("lang", "text"), model, langs, order, entries), langs)
    best = F.array_min("entropies")
    place = F.array_position("entropies", best).cast("int")
    odds = F.transform("entropies", lambda h: F.pow(F.lit(2.0), (best - h) * F.col("chars") * temperature))
    known = F.col("letters") > 0
    judged = entropies(docs, model, langs, order, entries)
    limit = F.element_at(F.array(*(F.lit(float(bounds.get(x, "inf"))) for x in langs)), place)
    return judged.select(
        *rest, F.when(known, F.element_at(F.array(*map(F.lit, langs)), place)).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(known, 1 / F.aggregate(odds, F.lit(0.0), lambda a, x: a + x)).otherwise(0.0).alias("score"),
        F.when(known, best).alias("entropy"), (known & (best > limit)).alias("rejected"),
    )

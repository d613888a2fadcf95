"""Landed CSV files as records: fields may hold line breaks, columns are bound by each file's header, bad records are told.

Files are read line by line in splits, so one large file is many tasks. A first pass tells the header of each file and
what the lines of a split do to a quoted field; from that follows whether a split begins inside of one. A second pass
writes the cells of the records, a batch of lines at once, and the few pieces of records that lie across splits, which are
put together by an aggregate per record.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from seacast.session import stored

#: Splits where a field stays open or closes again, and headers, up to which tasks hold them; beyond, lines are joined with them.
HELD_SPLITS = 10_000
#: Text that is cut at once; the masks over it take some fifteen times as much.
PART_BYTES = 4_000_000
ORDER = ["_file", "_block", "_row"]
CORRUPT = "_corrupt_record"
#: Parts of records: all of one, the end of one, the begin of one, a split in the midst of one.
WHOLE, END, BEGIN, MIDST = range(4)


def landed_lines(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(value, _file, _block, _row) of all lines below ``path``; a file that cannot be read is skipped (see :func:`file_report`)."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("ignoreCorruptFiles", True).option("lineSep", "\n").text(path)
    return text.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))


def closing(text: str, at: int) -> int:
    """Place after the quote that closes the field, or -1; doubled quotes and those after a backslash belong to it."""
    while True:
        quote = text.find('"', at)
        if quote < 0:
            return -1
        slashes = quote - len(text[at:quote].rstrip("\\")) - at
        if slashes % 2:
            at = quote + 1
        elif text[quote + 1 : quote + 2] == '"':
            at = quote + 2
        else:
            return quote + 1


#: The rest of a quoted field with its closing quote, as :func:`closing` finds it; a field that is closed; all fields of a line up to its end.
_REST = r'(?:[^"\\]++|\\.|"")*+"'
_FIELD = rf'(?:"{_REST}[^,]*+|(?:[^",][^,]*+)?)'
_FIELDS = rf"(?:,{_FIELD})*+"
_CLOSED = re.compile(_FIELD + _FIELDS, re.DOTALL).fullmatch
_CLOSED_INSIDE = re.compile(f"{_REST}[^,]*+{_FIELDS}", re.DOTALL).fullmatch
_CELL = re.compile(r'(?:"((?:[^"\\]++|\\.|"")*+)"([^,]*+)|([^",][^,]*+)?)(,|\Z)', re.DOTALL)


def open_after(line: str, inside: bool) -> bool:
    """Whether a quoted field is open at the end of a line that begins inside one or at the start of a field."""
    return (_CLOSED_INSIDE if inside else _CLOSED)(line) is None


def cells(record: str) -> list[str | None]:
    """The cells of a record; an empty one without quotes is None. What follows a closing quote belongs to its cell, and a
    field that is never closed is the last one."""
    if '"' not in record:
        return [c or None for c in record.split(",")]
    out, at = [], 0
    while found := _CELL.match(record, at):
        body, rest, plain, end = found.groups()
        out.append(plain if body is None else (unescaped(body) if '"' in body or "\\" in body else body) + rest)
        if not end:
            return out
        at = found.end()
    return [*out, unescaped(record[at + 1 :])]


def unescaped(body: str) -> str:
    return body.replace('""', '"').replace('\\"', '"').replace("\\\\", "\\")


def groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """Parts of batches whose lines come from one split, of PART_BYTES or so."""
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block = batch.column("_file"), batch.column("_block").to_numpy()
        codes = file.dictionary_encode().indices.to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], (np.diff(codes) != 0) | (np.diff(block) != 0)]))
        for a, b in zip(cuts.tolist(), np.append(cuts[1:], batch.num_rows).tolist()):
            part = batch.slice(a, b - a)
            step = -(-part.num_rows // -(-max(part.column("value").nbytes, 1) // PART_BYTES))
            for at in range(0, part.num_rows, step):
                yield file[a].as_py(), int(block[a]), part.slice(at, step)


def after(lines: Sequence[str]) -> list[bool]:
    """Whether a field is open after the lines, for a begin outside and inside of one; read from their end, up to a line that settles it."""
    ends = [False, True]
    for line in reversed(lines):
        ends = [ends[open_after(line, inside)] for inside in (False, True)]
        if ends[0] == ends[1]:
            break
    return ends


class Splits:
    """(_file, _block, after_out, after_in, header) of each split from its lines with quotes and with ``key``: whether a field is open
    at its end, for a begin outside and inside of one, and its first line that names ``key``."""

    def __init__(self, key: str):
        self.key = key

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        state, header = [False, True], None

        def row() -> pa.RecordBatch:
            told = {"_file": now[0], "_block": now[1], "after_out": state[0], "after_in": state[1], "header": header}
            return pa.RecordBatch.from_arrays([pa.array([told[f.name]], f.type) for f in SPLIT], schema=SPLIT)

        for file, block, part in groups(batches):
            if (file, block) != now:
                if now is not None:
                    yield row()
                now, state, header = (file, block), [False, True], None
            lines = part.column("value")
            if header is None:
                named = lines.filter(pc.match_substring(lines, self.key)).to_pylist()
                header = next((x.rstrip("\r") for x in named if self.key in plain_cells(x)), None)
            ends = after(Lazy(lines))
            state = [ends[s] for s in state]
        if now is not None:
            yield row()


SPLIT = pa.schema([("_file", pa.string()), ("_block", pa.int64()), ("after_out", pa.bool_()), ("after_in", pa.bool_()), ("header", pa.string())])


class Lazy(Sequence):
    """The texts of an array, taken out one by one."""

    def __init__(self, array: pa.Array):
        self.array = array

    def __len__(self) -> int:
        return len(self.array)

    def __getitem__(self, at):
        return self.array[at].as_py()


def plain_cells(line: str) -> list[str]:
    """What :func:`plain_names` gives for a line."""
    return [n.strip('" \ufeff\r') for n in line.split(",")]


QUOTE, COMMA, BREAK, RETURN, SLASH, SPACE = b'",\n\r\\ '


class Records:
    """Lines of splits to records: the cells of the wanted columns by the names in the file's header, or the text of a record that has
    another number of cells. Parts of records keep their text. ``_number`` counts the records of a split.

    A batch is cut by masks of its bytes where each quote opens a field at its begin, closes it, or is one of two; other batches go line by line.
    """

    def __init__(self, names: Sequence[str], key: str, told: tuple[Mapping[str, tuple[list[int], list[bool]]], Mapping[str, str]] | None, keep_text: bool):
        self.names, self.key, self.told, self.keep_text = list(names), key, told, keep_text
        self.schema = pa.schema([(n, pa.string()) for n in [*self.names, CORRUPT, "_file"]] + [(n, pa.int64()) for n in ("_block", "_row", "_number")] + [("_kind", pa.int32()), ("record", pa.string())])

    def begin(self, file: str, block: int, part: pa.RecordBatch) -> tuple[bool, str | None]:
        """Whether a split begins inside a quoted field, and the header of its file."""
        if self.told is None:
            return part.column("_inside")[0].as_py(), part.column("_header")[0].as_py()
        blocks, opened = self.told[0].get(file, ([], []))
        at = bisect_left(blocks, block)
        return bool(at and opened[at - 1]), self.told[1].get(file)

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, opened, held, number, begun, size, places = None, False, [], 0, False, -1, []
        for file, block, part in groups(batches):
            if (file, block) != now:
                if held:
                    yield self.part(now, held, number, BEGIN if begun else MIDST)
                now, held, number = (file, block), [], 0
                opened, header = self.begin(file, block, part)
                begun, (size, places) = not opened, bound(header, self.names)
            value, rows = part.column("value"), part.column("_row").to_numpy()
            cut = Cut(value, opened)
            if not cut.regular:
                texts, plain = [], not opened and not pc.any(pc.match_substring(value, '"')).as_py()
                for line, row in zip(value.to_pylist(), rows.tolist()):
                    held.append((line, row))
                    opened = open_after(line, opened) if '"' in line else opened
                    if not opened:
                        text = "\n".join(x for x, _ in held)
                        text = text.rstrip("\r") if plain else text.removesuffix("\r")
                        if begun:
                            texts.append((held[0][1], number, text))
                        else:
                            yield self.part(now, [(text, held[0][1])], number, END)
                        held, number, begun = [], number + 1, True
                if texts:
                    yield from self.by_text(now, texts, size, places)
                continue
            first = 0
            if opened:
                end = cut.ends[0] if len(cut.ends) else len(cut.bytes) - 1
                held.append((cut.text(0, end), rows[0].item()))
                if not len(cut.ends):
                    continue
                text, first = "\n".join(x for x, _ in held).removesuffix("\r"), 1
                if begun:
                    yield from self.by_text(now, [(held[0][1], number, text)], size, places)
                else:
                    yield self.part(now, [(text, held[0][1])], number, END)
                held, number, begun = [], number + 1, True
            if len(cut.ends) > first:
                yield self.by_bytes(now, cut, first, rows, number, size, places)
                number += len(cut.ends) - first
            opened = cut.rest < len(cut.bytes)
            if opened:
                held.append((cut.text(cut.rest, len(cut.bytes) - 1), rows[cut.line(cut.rest)].item()))
        if held:
            yield self.part(now, held, number, BEGIN if begun else MIDST)

    def part(self, now: tuple, held: Sequence[tuple[str, int]], number: int, kind: int) -> pa.RecordBatch:
        return self.batch(now, [None] * len(self.names), None, [held[0][1]], [number], kind, ["\n".join(x for x, _ in held)])

    def by_text(self, now: tuple, texts: Sequence[tuple[int, int, str]], size: int, places: Sequence[int | None]) -> Iterator[pa.RecordBatch]:
        """Records one by one, without blank ones and headers."""
        texts = [x for x in texts if x[2].strip(" ") and not (self.key in x[2] and self.key in plain_cells(x[2]))]
        if texts:
            columns, bad = bound_cells([x[2] for x in texts], size, places)
            yield self.batch(now, columns, bad, [x[0] for x in texts], [x[1] for x in texts], WHOLE, [x[2] for x in texts] if self.keep_text else None)

    def by_bytes(self, now: tuple, cut: "Cut", first: int, rows: np.ndarray, number: int, size: int, places: Sequence[int | None]) -> pa.RecordBatch:
        """The records of a cut from ``first`` on, without blank ones and headers."""
        starts, ends, cells_at, widths = cut.records(first)
        wanted = ~cut.blank(starts, ends)
        for at in cut.holding(self.key, starts):
            if wanted[at] and self.key in plain_cells(cut.text(starts[at], ends[at])):
                wanted[at] = False
        kept = np.flatnonzero(wanted)
        starts, ends, cells_at, good = starts[kept], ends[kept], cells_at[kept], widths[kept] == size
        columns = [None if p is None else cut.cells.take(pa.array(cells_at + p, mask=~good)) for p in places]
        bad = None
        if not good.all():
            bad = [None if g else cut.text(a, b) for g, a, b in zip(good.tolist(), starts.tolist(), ends.tolist())]
        text = [cut.text(a, b) for a, b in zip(starts.tolist(), ends.tolist())] if self.keep_text else None
        return self.batch(now, columns, bad, rows[cut.line(starts)], number + kept, WHOLE, text)

    def batch(self, now: tuple, columns: Sequence, bad, row, number, kind: int, text) -> pa.RecordBatch:
        n = len(row)
        made = [pa.nulls(n, pa.string()) if c is None else c if isinstance(c, pa.Array) else pa.array(c if isinstance(c, list) else [c], pa.string()) for c in (*columns, bad)]
        made += [pa.repeat(pa.scalar(now[0]), n), pa.repeat(pa.scalar(now[1], pa.int64()), n), pa.array(row, pa.int64()), pa.array(number, pa.int64()), pa.repeat(pa.scalar(kind, pa.int32()), n)]
        return pa.RecordBatch.from_arrays([*made, pa.nulls(n, pa.string()) if text is None else pa.array(text, pa.string())], schema=self.schema)


class Cut:
    """The records in the lines of a batch and their cells, by masks over the bytes; ``regular`` tells whether that is exact.

    A quote is inside a field if an odd number lies before it. That holds as long as each that opens stands at the begin of a field or
    behind the one that closes, and no backslash is inside a field.
    """

    def __init__(self, value: pa.StringArray, opened: bool):
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(value)], value), "\n")[0].as_buffer()
        self.bytes = text = np.append(np.frombuffer(joined, np.uint8), np.uint8(BREAK))
        quote = text == QUOTE
        quotes = np.flatnonzero(quote)
        breaks = text == BREAK
        self.breaks = np.flatnonzero(breaks)
        inside = None
        if opened or len(quotes):
            inside = ((np.cumsum(quote, dtype=np.int32) + opened) & 1).astype(bool)
        self.ends = self.breaks if inside is None else self.breaks[~inside[self.breaks]]
        self.returns = text[self.ends - 1] == RETURN
        self.regular = not np.any(self.returns & (text[self.ends - 2] == RETURN))
        self.rest = int(self.ends[-1]) + 1 if len(self.ends) else 0
        opening = quotes[inside[quotes]] if len(quotes) else quotes
        if len(quotes):
            before = text[opening - 1]
            outside = ~inside[opening - 1]
            begins = (opening == 0) | (outside & ((before == COMMA) | (before == BREAK)))
            double = ~begins & (before == QUOTE)
            self.regular &= bool(np.all(begins | double))
            self.regular &= not np.any(inside & (text == SLASH))
        if not self.regular:
            return
        ends = (text == COMMA) | breaks
        self.cell_ends = np.flatnonzero((ends if inside is None else ends & ~inside)[: self.rest])
        self.last = np.searchsorted(self.cell_ends, self.ends)
        keep = np.ones(len(text), bool)
        keep[quotes] = False
        if len(quotes):
            keep[opening[double]] = True
        keep[self.cell_ends] = False
        keep[self.ends[self.returns] - 1] = False
        upto = np.concatenate([[0], np.cumsum(keep, dtype=np.int32)])
        closed = self.cell_ends + 1
        self.cell_starts = np.concatenate([[0], closed[:-1]]) if len(closed) else closed
        stops = np.array(self.cell_ends)
        stops[self.last[self.returns]] -= 1
        offsets = np.concatenate([[0], upto[closed]]).astype(np.int32)
        known = np.packbits(stops > self.cell_starts, bitorder="little")
        self.cells = pa.StringArray.from_buffers(len(closed), pa.py_buffer(offsets), pa.py_buffer(text[: self.rest][keep[: self.rest]].tobytes()), pa.py_buffer(known.tobytes()))

    def records(self, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Begin, end, first cell and number of cells of the records from ``first`` on."""
        from_cell = np.concatenate([[0], self.last[:-1] + 1])
        stops = self.ends - self.returns
        return self.cell_starts[from_cell][first:], stops[first:], from_cell[first:], (self.last - from_cell + 1)[first:]

    def blank(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which records hold nothing but spaces."""
        out = starts == ends
        for at in np.flatnonzero(~out & (self.bytes[starts] == SPACE)):
            out[at] = not self.text(starts[at], ends[at]).strip(" ")
        return out

    def holding(self, key: str, starts: np.ndarray) -> list[int]:
        """The records with a place of ``key``."""
        text, wanted, out, at = self.bytes.tobytes(), key.encode(), [], 0
        while (at := text.find(wanted, at)) >= 0:
            place = int(np.searchsorted(starts, at, "right")) - 1
            if place >= 0 and (not out or out[-1] != place):
                out.append(place)
            at += 1
        return out

    def line(self, at):
        """The number of the line at a place."""
        return np.searchsorted(self.breaks, at)

    def text(self, start: int, end: int) -> str:
        return self.bytes[start:end].tobytes().decode()


def bound(header: str | None, names: Sequence[str]) -> tuple[int, list[int | None]]:
    """The number of cells that a header asks for, and the place of each name in it."""
    if header is None:
        return -1, [None] * len(names)
    given = header_names(header)
    return len(given), [given.index(n) if n in given else None for n in names]


def bound_cells(texts: Sequence[str], size: int, places: Sequence[int | None]) -> tuple[list[list[str | None]], list[str | None]]:
    """Columns of the cells at ``places``, and the texts of the records that have not ``size`` cells."""
    rows = [cells(x) for x in texts]
    columns = [[row[p] if p is not None and len(row) == size else None for row in rows] for p in places]
    return columns, [None if len(row) == size else x for row, x in zip(rows, texts)]


class Bound:
    """Records with the header of their file to the text cells of the wanted columns, found by name."""

    def __init__(self, names: Sequence[str], keep: Sequence[str]):
        self.names, self.keep = list(names), list(keep)

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layouts: dict[str | None, tuple[int, list[int | None]]] = {}
        for batch in batches:
            out: list[list] = [[] for _ in self.names]
            bad = []
            for record, header in zip(batch.column("record").to_pylist(), batch.column("_header").to_pylist()):
                if header not in layouts:
                    layouts[header] = bound(header, self.names)
                size, places = layouts[header]
                columns, wrong = bound_cells([record], size, places)
                bad += wrong
                for column, cell in zip(out, columns):
                    column += cell
            columns = [*(pa.array(c, pa.string()) for c in out), pa.array(bad, pa.string()), *(batch.column(c) for c in self.keep)]
            yield pa.RecordBatch.from_arrays(columns, [*self.names, CORRUPT, *self.keep])


def records(lines: DataFrame, names: Sequence[str], key: str, keep_text: bool, held_splits: int = HELD_SPLITS) -> DataFrame | None:
    """The cells of ``names``, ``_corrupt_record``, the order columns, ``_number`` and (if kept) the text of the records of
    :func:`landed_lines`, quoted line breaks in them; no blank ones and headers. None if no file has a header that names ``key``.

    ``_number`` counts the records of a split (for the first split of a file: of the file). A field that is never closed
    takes the rest of its file.
    """
    telling = lines.where(F.contains("value", F.lit('"')) | F.contains("value", F.lit(key))).select("value", "_file", "_block")
    splits = stored(telling.mapInArrow(Splits(key), "_file string, _block bigint, after_out boolean, after_in boolean, header string"), "splits")
    headers = splits.where("header IS NOT NULL").groupBy("_file").agg(F.min_by("header", "_block").alias("_header"))
    some = headers.limit(held_splits + 1).collect()
    if not some:
        return None
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.aggregate(F.collect_list(F.struct("after_out", "after_in")).over(earlier), F.lit(False), lambda s, x: F.when(s, x["after_in"]).otherwise(x["after_out"]))
    state = splits.withColumn("_open", F.when(before, F.col("after_in")).otherwise(F.col("after_out")))
    # A field that is open at the end of a split is open where the next splits begin, up to one with quotes.
    was = F.lag("_open", 1, False).over(Window.partitionBy("_file").orderBy("_block"))
    turns = state.withColumn("_was", was).where("_open <> _was").select("_file", "_block", "_open").limit(held_splits + 1).collect()
    columns = ", ".join([*(f"`{n}` string" for n in names), f"{CORRUPT} string", "_file string, _block bigint, _row bigint"])
    kinds = f"{columns}, _number bigint, _kind int, record string"
    if len(some) <= held_splits and len(turns) <= held_splits:
        inside: dict[str, tuple[list[int], list[bool]]] = {}
        for r in sorted(turns):
            blocks, opened = inside.setdefault(r["_file"], ([], []))
            blocks.append(r["_block"])
            opened.append(r["_open"])
        made = lines.mapInArrow(Records(names, key, (inside, {r["_file"]: r["_header"] for r in some}), keep_text), kinds)
    else:
        both = lines.select("_file", "_block").distinct().join(state.select("_file", "_block", "_open"), ["_file", "_block"], "left")
        begins = both.select("_file", "_block", F.coalesce(F.last("_open", ignorenulls=True).over(earlier), F.lit(False)).alias("_inside"))
        told = lines.join(begins.join(headers, "_file", "left"), ["_file", "_block"])
        made = told.repartition("_file", "_block").sortWithinPartitions(*ORDER).mapInArrow(Records(names, key, None, keep_text), kinds)
    made = stored(made, "landed")
    parts = made.where(F.col("_kind") != WHOLE)
    upto = Window.partitionBy("_file").orderBy("_block", F.col("_kind") == BEGIN).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = parts.withColumn("_record", F.count_if(F.col("_kind") == BEGIN).over(upto))
    pieces = F.array_sort(F.collect_list(F.struct("_block", "_row", "_number", "record")))
    whole = numbered.groupBy("_file", "_record").agg(pieces.alias("_pieces"))
    text = F.rtrim(F.concat_ws("\n", F.col("_pieces.record")), F.lit("\r"))
    joined = whole.select("_file", *(F.col("_pieces")[0][c].alias(c) for c in ("_block", "_row", "_number")), text.alias("record"))
    joined = joined.where(~names_key("record", key) & (F.trim("record") != "")).join(headers, "_file", "left").select("record", "_header", *ORDER, "_number")
    joined = joined.mapInArrow(Bound(names, [*ORDER, "_number", "record"]), f"{columns}, _number bigint, record string")
    return made.where(F.col("_kind") == WHOLE).drop("_kind").unionByName(joined)


def header_names(header: str) -> list[str]:
    """Column names of a header record."""
    return [(n or "").strip() for n in cells(header.lstrip("﻿"))]


def plain_names(line: str) -> Column:
    """The names in a header line as an array."""
    return F.transform(F.split(line, ","), lambda n: F.btrim(n, F.lit('" ﻿\r')))


def names_key(line: str, key: str) -> Column:
    return F.contains(line, F.lit(key)) & F.array_contains(plain_names(line), key)


def first_headers(lines: DataFrame, key: str) -> DataFrame:
    """(_file, _header): the first line of each file that names ``key``; a header is one line."""
    first = F.min_by("value", F.struct("_block", "_row"))
    return lines.where(names_key("value", key)).groupBy("_file").agg(F.rtrim(first, F.lit("\r")).alias("_header"))


def read_landed(spark: SparkSession, path: str, schema: T.StructType, key: str, pattern: str = "*", skip: Sequence[int] = (), held_splits: int = HELD_SPLITS) -> DataFrame:
    """The columns of ``schema``, ``_corrupt_record`` and the order columns of all records below ``path``.

    Columns are bound by the names in each file's own header, the first record that names ``key`` (other columns may
    come in any order and be fewer or more); a column that a header lacks is null. A record with another number of
    cells than its header, one of a file without header, and one with a cell that is not of its column's type has null
    there (the former in all columns) and keeps its text in ``_corrupt_record``. Empty cells are null; blank lines and
    repeated headers are left out, and so are the records of each file whose numbers (the first is 0) are in ``skip``.
    There is no limit to the number of files or headers. No header at all is an error. The records are written once, as they
    are when this is called, and read from there.
    """
    keep_text = any(not isinstance(f.dataType, T.StringType) for f in schema.fields)
    made = records(landed_lines(spark, path, pattern), schema.names, key, keep_text, held_splits)
    if made is None:
        raise FileNotFoundError(f"no file with a header that names {key!r} below {path}")
    if skip:
        made = made.where(~((F.col("_block") == 0) & F.col("_number").isin(*skip)))
    typed, wrong = [], F.lit(False)
    for f in schema.fields:
        cell = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            typed.append(cell)
        else:
            typed.append(cell.try_cast(f.dataType).alias(f.name))
            wrong = wrong | (cell.isNotNull() & cell.try_cast(f.dataType).isNull())
    return made.select(*typed, F.coalesce(CORRUPT, F.when(wrong, F.col("record"))).alias(CORRUPT), *ORDER)


def rejected(landed: DataFrame) -> DataFrame:
    """File, place and text of the records of :func:`read_landed` that are not whole."""
    return landed.where(F.col(CORRUPT).isNotNull()).select(*ORDER, CORRUPT)


def file_report(spark: SparkSession, path: str, schema: T.StructType, key: str, pattern: str = "*") -> DataFrame:
    """``file, lines, has_header, unknown, missing`` of the files that :func:`read_landed` cannot take whole: those without
    a header, with columns beyond the schema, or without some of it; files that could not be read have no lines."""
    lines = landed_lines(spark, path, pattern)
    headers = first_headers(lines, key)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select(F.col("path").alias("_file"))
    counted = files.join(lines.groupBy("_file").agg(F.count(F.lit(1)).alias("lines")), "_file", "left").join(headers, "_file", "left")
    given = plain_names("_header")
    wanted = F.array(*[F.lit(n) for n in schema.names])
    report = counted.select(
        F.col("_file").alias("file"), F.coalesce("lines", F.lit(0)).alias("lines"), F.col("_header").isNotNull().alias("has_header"),
        F.array_except(given, wanted).alias("unknown"), F.array_except(wanted, given).alias("missing"),
    )
    return report.where(~F.col("has_header") | (F.size("unknown") > 0) | (F.size("missing") > 0))

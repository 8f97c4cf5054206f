"""Extents of source constructs without a parser: balanced brackets, declaration blocks, and test sections by their attributes.

The bracket scanner is an automaton with the modes code, line comment, block comment and quote and a stack of open brackets.  It runs
over the significant bytes of an Arrow batch only, for all markers of the batch in step: each step is a few numpy operations on
the states, whatever the number of markers.  Blocks and sections are array functions inside a file's row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as N
from ..functions import text as T
from ..functions.text import let
from ..sources.settled import settle
from .intervals import merged

# fixed values: how a line begins that holds a comment only, and attributes that mark tests
COMMENTS = ("//", "#", "--", "\\*", "/*", "(*")
TEST_ATTRIBUTES = ("test", "rstest", "proptest", "test_case")
_SPAN = "path string, line int, start int, end int, error string"
_SIGNIFICANT = np.isin(np.arange(256), np.frombuffer(b"/*\n'\"`\\()[]{};", np.uint8))
_BLANK = np.isin(np.arange(256), np.frombuffer(b" \t\r\n\x0b\x0c", np.uint8))
_OPENER = np.zeros(256, np.uint8)
for _a, _b in ("()", "[]", "{}"):
    _OPENER[ord(_b)] = ord(_a)
_CODE, _LINE, _BLOCK, _QUOTE = range(4)
OUTSIDE, NOTHING, OPEN = "the marker is outside of the file", "nothing follows the marker", "the construct has no end"


def extents(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The offset of the byte that ends the construct from each start on, -1 if there is none before its stop."""
    events = np.flatnonzero(_SIGNIFICANT[data])
    n = len(start)
    end, at, skip = np.full(n, -1, np.int64), np.searchsorted(events, start), start.astype(np.int64)
    mode, quote, depth, brace = np.zeros(n, np.int8), np.zeros(n, np.uint8), np.zeros(n, np.int64), np.zeros(n, bool)
    stack = np.zeros((n, 16), np.uint8)
    live = np.flatnonzero(at < len(events))
    padded = np.append(data, 0)
    while len(live):
        place = events[at[live]]
        live, place = live[place < stop[live]], place[place < stop[live]]
        at[live] += 1
        act = place >= skip[live]
        own, p = live[act], place[act]
        b, after = data[p], np.where(p + 1 < stop[own], padded[p + 1], 0)
        m = mode[own]
        mode[own[(m == _LINE) & (b == 10)]] = _CODE
        done = (m == _BLOCK) & (b == 42) & (after == 47)
        mode[own[done]], skip[own[done]] = _CODE, p[done] + 2
        escape = (m == _QUOTE) & (b == 92)
        skip[own[escape]] = p[escape] + 2
        mode[own[(m == _QUOTE) & (b == quote[own])]] = _CODE
        code = m == _CODE
        for second, kind in ((47, _LINE), (42, _BLOCK)):
            comment = code & (b == 47) & (after == second)
            mode[own[comment]], skip[own[comment]] = kind, p[comment] + 2
        opens = code & ((b == 39) | (b == 34) | (b == 96))
        mode[own[opens]], quote[own[opens]] = _QUOTE, b[opens]
        push = code & ((b == 40) | (b == 91) | (b == 123))
        x = own[push]
        if len(x) and depth[x].max() + 1 >= stack.shape[1]:
            stack = np.concatenate([stack, np.zeros_like(stack)], 1)
        stack[x, depth[x]] = b[push]
        depth[x] += 1
        brace[own[code & (b == 123)]] = True
        close = code & (_OPENER[b] > 0) & (depth[own] > 0)
        fits = np.zeros(len(own), bool)
        fits[close] = stack[own[close], depth[own[close]] - 1] == _OPENER[b[close]]
        depth[own[fits]] -= 1
        over = (fits & (b == 125) & brace[own] & (depth[own] == 0)) | (code & (b == 59) & (depth[own] == 0))
        end[own[over]] = p[over]
        live = live[end[live] < 0]
        live = live[at[live] < len(events)]
    return end


def _structural(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("path", pa.string()), ("line", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("error", pa.string())])
    for b in batches:
        for i in range(0, b.num_rows, 256):  # bounded bytes at a time: files have at most a few MB
            part = b.slice(i, 256)
            texts = [t.encode() for t in part.column(1).to_pylist()]
            data = np.frombuffer(b"".join(texts), np.uint8)
            edge = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            first = np.ones(len(data), bool)  # of a line; a text's first byte begins one
            first[1:] = data[:-1] == 10
            first[edge[:-1][edge[:-1] < len(data)]] = True
            begin = np.flatnonzero(first)
            stop = np.append(begin[1:], len(data))
            line_of_text = np.searchsorted(begin, edge)
            seen = np.flatnonzero(~_BLANK[data])
            k = np.searchsorted(seen, begin)
            at = np.append(seen, len(data))[k]
            full = at < stop
            two = np.append(data, [0, 0])
            x, y = two[at], two[at + 1]
            comment = x == 35
            for c in COMMENTS:
                if len(c) == 2:
                    comment |= (x == ord(c[0])) & (y == ord(c[1]))
            code = np.flatnonzero(full & ~comment)
            marks = part.column(2)
            row = np.repeat(np.arange(part.num_rows), marks.value_lengths().to_numpy(zero_copy_only=False))
            line = marks.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            inside = (line >= 1) & (line <= line_of_text[row + 1] - line_of_text[row])
            j = np.searchsorted(code, line_of_text[row] + line)
            target = np.append(code, len(begin))[np.minimum(j, len(code))]
            follows = inside & (target < line_of_text[row + 1])
            end = np.full(len(row), -1, np.int64)
            asked = np.flatnonzero(follows)
            end[asked] = extents(data, begin[target[asked]], edge[row[asked] + 1])
            found = end >= 0
            own_line = lambda g, row=row, base=line_of_text: g - base[row] + 1
            start_line = own_line(np.where(follows, target, 0))
            end_line = own_line(np.searchsorted(begin, np.maximum(end, 0), side="right") - 1)
            error = np.where(~inside, OUTSIDE, np.where(~follows, NOTHING, np.where(found, "", OPEN)))
            columns = [part.column(0).take(pa.array(row)), pa.array(line, pa.int32()), pa.array(start_line.astype(np.int32), mask=~found), pa.array(end_line.astype(np.int32), mask=~found), pa.array(error, pa.string(), mask=found)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


def _marked(files: DataFrame, markers: DataFrame) -> DataFrame:
    """Files (path, text) with the lines of their markers (path, line); a file's markers are bounded by its lines."""
    lines = markers.groupBy("path").agg(F.array_sort(F.collect_set(F.col("line").cast("int"))).alias("marks"))
    return files.select("path", F.coalesce("text", F.lit("")).alias("text")).join(lines, "path")


def structural_spans(files: DataFrame, markers: DataFrame) -> DataFrame:
    """(path, line, start, end, error): what follows each marker, from the next line of code to the brace that closes it or to a
    semicolon outside of brackets; comments and quotes hide brackets."""
    return _marked(files, markers).mapInArrow(_structural, _SPAN)


def _lines_of(data: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the lines of concatenated texts begin and end (without their line break), and the first line of each text."""
    first = np.zeros(len(data) + 1, bool)
    first[1:] = data == 10
    first[edge[:-1]] = True
    first[edge[1:]] = False  # what follows a text's last line break isn't a line
    first[edge[:-1][edge[:-1] < edge[1:]]] = True
    begin = np.flatnonzero(first[: len(data)])
    stop = np.append(begin[1:], len(data))
    broken = data[stop - 1] == 10
    stop = stop - broken
    stop = stop - (broken & (stop > begin) & (data[stop - 1] == 13))
    return begin, stop, np.searchsorted(begin, edge)


def _after(data: np.ndarray, begin: np.ndarray, stop: np.ndarray, skipped: np.ndarray) -> np.ndarray:
    """The first byte of each line that isn't skipped, its stop if there is none."""
    seen = np.flatnonzero(~skipped[data])
    return np.minimum(np.append(seen, len(data))[np.searchsorted(seen, begin)], stop)


def _comments(data: np.ndarray, at: np.ndarray, stop: np.ndarray) -> np.ndarray:
    two = np.append(data, [0, 0])
    found = np.zeros(len(at), bool)
    for c in COMMENTS:
        hit = at + len(c) <= stop
        for k, x in enumerate(c.encode()):
            hit &= two[np.minimum(at + k, len(data))] == x
        found |= hit
    return found


def _declarations(marker: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("line", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("error", pa.string())])
        space = np.arange(256) == 32
        for b in batches:
            for i in range(0, b.num_rows, 256):  # bounded bytes at a time: files have at most a few MB
                part = b.slice(i, 256)
                texts = [t.encode() for t in part.column(1).to_pylist()]
                whole = b"".join(texts)
                data = np.frombuffer(whole, np.uint8)
                edge = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
                begin, stop, of_text = _lines_of(data, edge)
                text = _after(data, begin, stop, _BLANK)
                full, indent = text < stop, text - begin
                comment = _comments(data, _after(data, begin, stop, space), stop)
                code = np.flatnonzero(full & ~comment)
                held = np.array([m.start() for m in re.finditer(b"(?=" + re.escape(marker.encode()) + b")", whole)], np.int64)
                line_of = np.searchsorted(begin, held, side="right") - 1
                marked = np.zeros(len(begin), bool)
                marked[line_of[held + len(marker.encode()) <= stop[line_of]]] = True
                ends = np.flatnonzero(marked & comment)
                # of each end, the next one that is less indented; the last one stands for none
                further, depth = np.full(len(ends) + 1, len(ends), np.int64), np.append(indent[ends], -1)
                open_: list[int] = []
                for k, d in enumerate(depth[:-1].tolist()):
                    while open_ and depth[open_[-1]] > d:
                        further[open_.pop()] = k
                    open_.append(k)
                marks = part.column(2)
                row = np.repeat(np.arange(part.num_rows), marks.value_lengths().to_numpy(zero_copy_only=False))
                line = marks.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                low, high = of_text[row], of_text[row + 1]
                inside = (line >= 1) & (line <= high - low)
                j = np.searchsorted(code, low + np.maximum(line, 0))
                start = np.append(code, len(begin))[j]
                good = inside & (start < high)
                own = np.append(indent, 0)[np.where(inside, low + line - 1, len(begin))]
                at = np.searchsorted(ends, start, side="right")
                stops = np.append(ends, len(begin))
                live = np.flatnonzero(good & (depth[at] > own) & (stops[at] < high))
                while len(live):  # a step goes past all ends that are as far indented or further
                    at[live] = further[at[live]]
                    live = live[(depth[at[live]] > own[live]) & (stops[at[live]] < high[live])]
                last = np.minimum(stops[at], high) - 1
                seen = np.flatnonzero(full)
                end = np.append(seen, 0)[np.maximum(np.searchsorted(seen, last, side="right") - 1, 0)]
                number = lambda g, good=good, low=low: pa.array((g - low + 1).astype(np.int32), mask=~good)
                error = np.where(~inside, OUTSIDE, np.where(~good, NOTHING, ""))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(line, pa.int32()), number(start), number(end), pa.array(error, pa.string(), mask=good)], schema=schema)

    return run


def declaration_spans(files: DataFrame, markers: DataFrame, marker: str = "@anchor") -> DataFrame:
    """(path, line, start, end, error): from the next line of code up to the next comment with a marker that is at most as far
    indented as this one, without blank lines at the end.

    Lines are classified once for all markers of a batch, and each marker looks its lines up in sorted arrays.
    """
    return _marked(files, markers).mapInArrow(_declarations(marker), _SPAN)


def _attribute(line: Column) -> Column:
    return F.startswith(F.ltrim(line), F.lit("#["))


def _test_attribute(line: Column) -> Column:
    """Whether a line is an attribute that marks a test; a test that is negated in a condition is none."""

    def marks(own: Column) -> Column:
        condition = F.regexp_replace(F.regexp_extract(own, r"^cfg\((.*)\)$", 1), r"not\([^()]*\)", "")
        named = let(F.substring_index(own, "(", 1), lambda name: name.isin(*TEST_ATTRIBUTES) | name.endswith("::test"))
        return F.when(own.startswith("cfg("), F.lower(condition).rlike(r"(^|[^\p{L}\p{N}_])test($|[^\p{L}\p{N}_])")).otherwise(named & (own != ""))

    own = F.regexp_extract(F.regexp_replace(line, r"\s", ""), r"^#\[(.*)\]$", 1)
    begins = F.startswith(F.btrim(line, F.lit(" \t\r\n\x0b\x0c")), F.lit("#"))  # few lines do, so few are matched
    return F.when(begins, let(own, marks)).otherwise(False)


def test_ranges(files: DataFrame) -> DataFrame:
    """(path, start, end): the sections of Rust files that test attributes mark, with all attributes above, merged if they touch.

    Attributes stand on lines of their own; the section ends where the scanner ends what follows.  Files with marks are settled with
    them, so that each file is read once and no text is shuffled.
    """
    rust = files.where((N.extension(F.col("path")) == "rs") & F.contains("text", F.lit("#[")) & F.contains("text", F.lit("test"))).select("path", "text")
    present = lambda xs: F.filter(xs, lambda i: i.isNotNull())
    rows = rust.withColumn("_lines", T.lines(F.col("text")))
    rows = rows.withColumn("_tests", present(F.transform("_lines", lambda x, i: F.when(_test_attribute(x), i + 1)))).where(F.size("_tests") > 0)
    rows = rows.withColumn("_other", present(F.transform("_lines", lambda x, i: F.when(~_attribute(x), i + 1))))

    def first(m: Column) -> Column:
        above = F.array_max(F.filter("_other", lambda i: i < m))
        return F.struct(m.alias("line"), F.coalesce(above + 1, F.lit(1)).alias("from"))

    rows = settle(rows.select("path", "text", F.transform("_tests", first).alias("marks")), "marked")
    marks = rows.select("path", F.inline("marks"))
    found = rows.select("path", "text", F.transform("marks", lambda m: m["line"]).alias("marks")).mapInArrow(_structural, _SPAN)
    found = found.where("error IS NULL").select("path", "line", "end")
    whole = marks.join(found, ["path", "line"]).select("path", F.col("from").alias("start"), "end")
    return merged(whole, "path", "start", "end").select("path", "start", "end")


test_ranges.__test__ = False

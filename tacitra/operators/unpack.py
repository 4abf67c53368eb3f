"""Several values packed in one string field: one row per value, its place kept.

The work is done on Arrow string buffers. Quote parity, bracket spans and delimiter masks are computed over all
bytes of a batch at once, the positions of effective delimiters give child offsets, the children are gathered into a
list array, and the list array is flattened with its parent ordinals.

Defined results
* null, empty and blank fields, and fields of delimiters only, give no row;
* repeated values count each time; empty places do not count;
* an unclosed quote, angle bracket or parenthesis is an ordinary character;
* a field with at least one ``@`` is a list of addresses: any of ``, ; | / tab newline space`` ends a value once it has
  an address; text before the address (a display name, commas and slashes included) belongs to it;
* a field without ``@`` is a list of names: ``; | tab newline`` end a value, a comma only behind a closing quote;
* extra columns of the input are ignored; the output columns are exactly those documented.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_HARD = np.zeros(256, bool)  # ends a value in both kinds of field
_HARD[[ord(c) for c in ";|\t\n\r"]] = True
_SOFT = np.zeros(256, bool)  # ends a value in address fields only
_SOFT[[ord(c) for c in ",/ \v\f"]] = True
_STOP = np.zeros(256, bool)  # cannot be part of a bare address
_STOP[[ord(c) for c in " \t\n\r\v\f<>()\",;|/:"]] = True
_TRIM = np.zeros(256, bool)
_TRIM[[ord(c) for c in " \t\n\r\v\f\","]] = True


def _last(mask: np.ndarray) -> np.ndarray:
    """Of each byte, the place of the last set byte up to it, else -1."""
    return np.maximum.accumulate(np.where(mask, np.arange(mask.size), -1))


def _next(mask: np.ndarray) -> np.ndarray:
    """Of each byte, the place of the next set byte from it on, else the size."""
    n = mask.size
    return np.minimum.accumulate(np.where(mask, np.arange(n), n)[::-1])[::-1]


def _spans(opening: np.ndarray, closing: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Bytes of a bracket that is opened and later closed in the same row, both brackets included."""
    opened = _last(opening)
    return (opened >= start) & (opened > _shift(_last(closing))) & (_next(closing) < end)


def _shift(a: np.ndarray) -> np.ndarray:
    out = np.empty_like(a)
    out[0], out[1:] = -1, a[:-1]
    return out


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls become empty strings."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


def _gather(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """A string array of the byte ranges [begin, end)."""
    size = np.maximum(end - begin, 0)
    offsets = np.zeros(size.size + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    index = np.repeat(begin - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.LargeStringArray.from_buffers(size.size, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[index]).tobytes()))


def split_packed(column: pa.Array) -> pa.LargeListArray:
    """A list array of the values packed in each string of ``column`` (see the module's rules)."""
    data, offsets = _buffers(column)
    rows, n = offsets.size - 1, data.size
    empty = pa.LargeListArray.from_arrays(pa.array(np.zeros(rows + 1, np.int64)), pa.array([], pa.large_string()))
    if not n:
        return empty
    row = np.repeat(np.arange(rows), np.diff(offsets))
    start, end = offsets[row], offsets[row + 1]

    # quotes that count: not behind an odd run of backslashes, and not the last of an odd number
    back = data == 92
    plain = np.maximum(_shift(_last(~back)), start - 1)
    quote = (data == 34) & ((np.arange(n) - 1 - plain) % 2 == 0)
    seen = np.concatenate(([0], np.cumsum(quote)))
    odd = (seen[offsets[1:]] - seen[offsets[:-1]]) % 2 == 1
    if odd.any():
        last = _last(quote)[offsets[1:][odd] - 1]
        quote[last] = False
        seen = np.concatenate(([0], np.cumsum(quote)))
    inside = (seen[1:] - seen[start]) % 2 == 1  # from the opening quote up to the byte before the closing one
    quoted = inside | quote
    bracket = _spans((data == 60) & ~quoted, (data == 62) & ~quoted, start, end)
    paren = _spans((data == 40) & ~quoted, (data == 41) & ~quoted, start, end)
    free = ~(quoted | bracket | paren)

    at = data == 64
    total = np.concatenate(([0], np.cumsum(at)))
    addressed = ((total[offsets[1:]] - total[offsets[:-1]]) > 0)[row]
    # what stands beyond the white space around a byte
    solid = ~_SPACE[data]
    after = _next(solid)
    following = np.where(after < end, data[np.minimum(after, n - 1)], 0)
    before = _shift(_last(solid))
    preceding = np.where(before >= start, data[np.maximum(before, 0)], 0)
    before_quote = (preceding == 34) & quoted[np.maximum(before, 0)]
    glue = _SPACE[data] & ((following == 40) | before_quote & (following == 60))
    cut = free & np.where(addressed, (_HARD | _SOFT)[data] & ~glue, _HARD[data] | (data == 44) & before_quote)

    # segments between cuts; rows end one as well
    segment_end = np.unique(np.concatenate((np.flatnonzero(cut), offsets[1:][np.diff(offsets) > 0])))
    # a cut byte at a row's first place coincides with the end of the row before it
    segment_begin = np.concatenate(([0], segment_end[:-1]))
    segment_begin = segment_begin + ((segment_begin < n) & cut[np.minimum(segment_begin, n - 1)])
    keep = segment_end > segment_begin
    segment_begin, segment_end = segment_begin[keep], segment_end[keep]
    owner = row[segment_begin]
    with_at = total[segment_end] > total[segment_begin]
    by_address = addressed[segment_begin]

    # address fields: the address around the last @ of each segment
    own_at = _last(at)[segment_end - 1]
    stop = _STOP[data]
    left = np.maximum(_last(stop)[np.maximum(own_at, 0)] + 1, offsets[owner])
    right = np.minimum(_next(stop)[np.maximum(own_at, 0)], offsets[owner + 1])
    # names: the segment without outer white space and quotes; also what follows the last address of a field
    trimmed = ~_TRIM[data]
    name_left = _next(trimmed)[segment_begin]
    name_right = np.maximum(_last(trimmed)[segment_end - 1] + 1, name_left)
    named = name_left < segment_end
    order = np.arange(segment_begin.size)
    later = np.zeros(rows, np.int64) - 1
    np.maximum.at(later, owner[with_at], order[with_at])
    tail = by_address & ~with_at & named & (order > later[owner])
    begin, finish = np.where(with_at, left, name_left), np.where(with_at, right, name_right)
    chosen = np.where(by_address, with_at, named)
    if tail.any():  # words behind the last address make one value
        first_tail = tail & ~np.concatenate(([False], tail[:-1] & (owner[1:] == owner[:-1])))
        last_tail = tail & ~np.concatenate((tail[1:] & (owner[1:] == owner[:-1]), [False]))
        finish[first_tail] = name_right[last_tail]
        chosen = chosen | first_tail
    begin, finish, owner = begin[chosen], finish[chosen], owner[chosen]
    single = (finish - begin > 2) & (data[begin] == 39) & (data[np.maximum(finish - 1, 0)] == 39)
    values = pc.if_else(pa.array(with_at[chosen]), pc.utf8_lower(found := _gather(data, begin + single, finish - single)), found) if begin.size else pa.array([], pa.large_string())
    child = np.zeros(rows + 1, np.int64)
    np.cumsum(np.bincount(owner, minlength=rows), out=child[1:])
    return pa.LargeListArray.from_arrays(pa.array(child), values)


def unpack_fields(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id, field, pos, value): one row per value packed in each of ``fields``; no shuffle, one pass over the input.

    ``pos`` counts the values of a field from 1. Rows of repeated ids are treated on their own.
    """
    source = df.select(F.col(f"`{id_col}`").alias("id"), *[F.col(f"`{f}`").cast("string").alias(f"f{i}") for i, f in enumerate(fields)])
    id_type = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, name in enumerate(fields):
                lists = split_packed(batch.column(1 + i))
                flat = lists.flatten()
                if not len(flat):
                    continue
                parent = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
                pos = (np.arange(len(flat)) - np.asarray(lists.offsets)[:-1][parent] + 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(parent)), pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(flat), np.int8)), [name]).cast(pa.string()), pa.array(pos), flat.cast(pa.string())],
                    names=["id", "field", "pos", "value"],
                )

    return source.mapInArrow(run, f"id {id_type}, field string, pos int, value string").withColumnRenamed("id", id_col)

"""Rows that fail to parse: load the valid records, set the others apart with a reason.

Structural indexing over whole Arrow batches: the bodies of a batch are one byte array with record
offsets; numpy masks of quotes, their prefix parity within each record, and the masks of commas
give the delimiters and record ends without a loop over rows or characters. Vectorised count and
type checks then make each record either valid or rejected with the first reason that applies.

A quote toggles the parity. Up to the first fault of a record the parity says whether a byte is
quoted, and a doubled quote toggles twice, so that three local tests find the first fault: a quote
that opens and follows neither a delimiter nor directly a quote, a quote that closes and precedes
neither a delimiter nor directly a quote (blanks skipped), and an odd number of quotes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# fixed values: the order in which reasons count
REASONS = ("quoting", "columns", "src", "dst", "weight")
_QUOTE, _COMMA, _SPACE, _TAB, _CR = 34, 44, 32, 9, 13
_INT = r"^[+-]?[0-9]+$"
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_MAX, _MIN = b"9223372036854775807", b"9223372036854775808"


def _slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A string array of the byte ranges, made by one gather."""
    sizes = np.maximum(ends - starts, 0)
    offsets = np.zeros(len(sizes) + 1, dtype=np.int64)
    np.cumsum(sizes, out=offsets[1:])
    index = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - starts, sizes)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[index]))]).cast(pa.large_string())


def _longs(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(valid, value) of ASCII decimal integers within 64 bits."""
    valid = np.array(pc.match_substring_regex(text, _INT))
    value = np.zeros(len(text), dtype=np.int64)
    at = np.flatnonzero(valid)
    if len(at):
        some = text.take(pa.array(at))
        minus = np.array(pc.starts_with(some, "-"))
        digits = pc.utf8_ltrim(pc.utf8_ltrim(some, characters="+-"), characters="0")
        size = np.array(pc.binary_length(digits))
        raw = np.array(digits.cast(pa.large_binary()).to_pylist(), dtype="S20")
        fits = (size < 19) | ((size == 19) & (raw <= np.where(minus, _MIN, _MAX)))
        valid[at[~fits]] = False
        at, raw, minus = at[fits], raw[fits], minus[fits]
        whole = np.where(raw == b"", b"0", raw).astype(np.uint64)
        value[at] = np.where(minus, (~whole + np.uint64(1)).view(np.int64), whole.view(np.int64))
    return valid, value


def _doubles(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(valid, is null, value): empty is null, everything else a finite decimal number."""
    empty = np.array(pc.equal(pc.binary_length(text), 0))
    valid = np.array(pc.match_substring_regex(text, _NUMBER))
    value = np.zeros(len(text), dtype=np.float64)
    at = np.flatnonzero(valid)
    if len(at):
        value[at] = [float(x) for x in text.take(pa.array(at)).to_pylist()]
        valid &= np.isfinite(value)
    return valid | empty, empty, value


def index_records(body: pa.Array, columns: int = 4) -> dict[str, np.ndarray]:
    """Structural index of a batch: faults and, for records of ``columns`` fields, field spans.

    Null bodies count as empty ones.
    """
    body = pc.fill_null(body.cast(pa.large_string()), "")
    n = len(body)
    _, off, buf = body.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[body.offset : body.offset + n + 1]
    data = np.frombuffer(buf, dtype=np.uint8)[: offsets[-1]] if buf is not None and n else np.zeros(0, np.uint8)
    base, data = offsets[0], data[offsets[0] :]
    starts, ends = offsets[:-1] - base, offsets[1:] - base
    full = ends > starts
    cr = np.zeros(n, dtype=bool)
    cr[full] = data[ends[full] - 1] == _CR
    ends = ends - cr
    size = len(data)

    inside = np.zeros(size + 1, dtype=np.int32)  # bytes of records, the ignored CR left out
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    inside = np.cumsum(inside[:-1]) > 0
    quote = (data == _QUOTE) & inside
    before = np.zeros(size + 1, dtype=np.int64)  # quotes before each byte
    np.cumsum(quote, out=before[1:])
    record = np.repeat(np.arange(n), offsets[1:] - offsets[:-1])
    parity = (before[:-1] - before[starts][record]) & 1
    odd = ((before[ends] - before[starts]) & 1).astype(bool)
    comma = (data == _COMMA) & inside & (parity == 0)
    delimiters = np.flatnonzero(comma)

    # the nearest byte that is no blank, on either side, within the record
    ink = inside & (data != _SPACE) & (data != _TAB)
    place = np.arange(size)
    last = np.maximum.accumulate(np.where(ink, place, -1)) if size else place
    following = np.minimum.accumulate(np.where(ink, place, size)[::-1])[::-1] if size else place
    q = np.flatnonzero(quote)
    of, opens = record[q], parity[q] == 0
    left = np.where(q > 0, last[np.maximum(q - 1, 0)], -1)
    right = np.where(q + 1 < size, following[np.minimum(q + 1, size - 1)], size) if size else q
    at_start, at_end = left < starts[of], right >= ends[of]
    after_comma = ~at_start & comma[np.maximum(left, 0)] if size else at_start
    before_comma = ~at_end & (data[np.minimum(right, max(size - 1, 0))] == _COMMA) if size else at_end
    touches_left = ~at_start & quote[np.maximum(q - 1, 0)] & (q - 1 >= starts[of]) if size else at_start
    touches_right = ~at_end & quote[np.minimum(q + 1, max(size - 1, 0))] & (q + 1 < ends[of]) if size else at_end
    fault = np.where(opens, ~(at_start | after_comma | touches_left), ~(at_end | before_comma | touches_right))
    quoting = odd.copy()
    quoting[of[fault]] = True

    commas = np.zeros(n, dtype=np.int64)
    np.add.at(commas, record[delimiters], 1)
    whole = ~quoting & (commas == columns - 1)
    spans_from = np.zeros((n, columns), dtype=np.int64)
    spans_to = np.zeros((n, columns), dtype=np.int64)
    cuts = delimiters[whole[record[delimiters]]].reshape(-1, columns - 1)
    spans_from[:, 0], spans_to[:, -1] = starts, ends
    spans_from[whole, 1:], spans_to[whole, :-1] = cuts + 1, cuts
    for k in range(columns):  # trim blanks, then the quotes
        a, b = spans_from[whole, k], spans_to[whole, k]
        some = b > a
        first = np.where(some, following[np.minimum(a, max(size - 1, 0))], b) if size else b
        end = np.where(some, last[np.maximum(b - 1, 0)] + 1, a) if size else a
        some &= first < b
        a, b = np.where(some, first, a), np.where(some, end, a)
        quoted = some & (data[np.minimum(a, max(size - 1, 0))] == _QUOTE) if size else some
        spans_from[whole, k], spans_to[whole, k] = a + quoted, b - quoted
    return {"data": data, "quoting": quoting, "columns": ~quoting & ~whole, "whole": whole, "from": spans_from, "to": spans_to}


def parse_batch(body: pa.Array) -> dict[str, pa.Array]:
    """src, dst, weight, label and reason of each record; reason is null for valid ones."""
    x = index_records(body)
    n, at = len(body), np.flatnonzero(x["whole"])
    fields = [_slices(x["data"], x["from"][at, k], x["to"][at, k]) for k in range(4)]
    (src_ok, src), (dst_ok, dst), (weight_ok, empty, weight) = _longs(fields[0]), _longs(fields[1]), _doubles(fields[2])
    reason = np.full(n, -1)
    reason[at[~weight_ok]] = 4
    reason[at[~dst_ok]] = 3
    reason[at[~src_ok]] = 2
    reason[x["columns"]], reason[x["quoting"]] = 1, 0
    bad = reason >= 0

    def spread(values: np.ndarray, null: np.ndarray) -> pa.Array:
        out, mask = np.zeros(n, dtype=values.dtype), np.ones(n, dtype=bool)
        out[at], mask[at] = values, null
        return pa.array(out, mask=mask | bad)

    label = pc.replace_substring(fields[3], '""', '"')
    where = np.full(n, -1)
    where[at] = np.arange(len(at))
    labels = label.take(pa.array(where, mask=(where < 0) | bad)).cast(pa.string())
    none = np.zeros(len(at), dtype=bool)
    return {
        "src": spread(src, none),
        "dst": spread(dst, none),
        "weight": spread(weight, empty),
        "label": labels,
        "reason": pa.array(np.array([*REASONS, ""])[reason], mask=~bad).cast(pa.string()),
    }


class DelimitedRecords:
    """Valid rows and reasoned rejects of a table with one raw record per row.

    ``records`` has ``key`` columns and ``src, dst, weight, label, reason``. Defined results: a null
    or empty body is rejected for ``columns``; an empty weight is a null weight; repeated rows stay
    repeated; other columns of the input, also ones named like the results, are ignored unless
    listed in ``keys``; an empty table gives an empty table. Narrow: no shuffle.
    """

    def __init__(self, df: DataFrame, body: str = "body", keys: tuple[str, ...] = ("line_id",)):
        made = T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType()), T.StructField("weight", T.DoubleType()), T.StructField("label", T.StringType()), T.StructField("reason", T.StringType())])
        if clash := {x.name for x in made} & set(keys):
            raise ValueError(f"key columns named like results: {sorted(clash)}")
        kept = df.select(*keys, df[body].alias("__body"))
        schema = T.StructType([*(kept.schema[k] for k in keys), *made])

        def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = parse_batch(batch.column(len(keys)))
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keys))), *out.values()], names=[*keys, *out])

        self._keys = list(keys)
        self.records = kept.mapInArrow(parse, schema)

    def valid(self) -> DataFrame:
        return self.records.filter("reason IS NULL").select(*self._keys, "src", "dst", "weight", "label")

    def rejects(self) -> DataFrame:
        return self.records.filter("reason IS NOT NULL").select(*self._keys, "reason")

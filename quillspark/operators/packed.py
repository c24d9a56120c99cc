"""Values packed into one text field, split into one row each (Arrow buffers)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\r\n\x0b\x0c")] = True
#: What may stand between values and is never part of one.
_DELIM = np.zeros(256, bool)
_DELIM[list(b",;|/&")] = True
_OPEN = np.zeros(256, bool)
_OPEN[list(b"[{(")] = True
_CLOSE = np.zeros(256, bool)
_CLOSE[list(b"]})")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[list(b"0123456789")] = True
_WORD = np.zeros(256, bool)
_WORD[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
_WORD[128:] = True


def _at(mask: np.ndarray, index: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """mask[index] where low <= index < high, else False."""
    inside = (index >= low) & (index < high)
    return inside & mask[np.clip(index, 0, len(mask) - 1)]


def _last_true(mask: np.ndarray) -> np.ndarray:
    """For each place the greatest index <= it at which mask holds, or -1."""
    return np.maximum.accumulate(np.where(mask, np.arange(len(mask)), -1))


def _next_true(mask: np.ndarray) -> np.ndarray:
    """For each place the least index >= it at which mask holds, or len(mask)."""
    n = len(mask)
    return n - 1 - _last_true(mask[::-1])[::-1] if n else np.zeros(0, int)


def split_items(texts: pa.Array) -> pa.ListArray:
    """The item values of each text, in order, as a list array.

    Works on the whole Arrow buffer at once.  Quote parity tells what stands
    inside an enclosing quote (there nothing separates); a value starts at an
    unquoted item code (digit, dot, two digits; the word Item before it or
    not) that follows the start, a delimiter, a line break or tab, a bracket, or another
    bare code, and at a quote whose content starts with one.  It runs to the next
    start, without the delimiters before it.  A caption may hold delimiters:
    only one that a new item, a quote, a bracket or the end follows separates.
    NULL and texts without items give an empty list.
    """
    texts = texts.cast(pa.string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if len(texts) == 0:
        return pa.array([], pa.list_(pa.string()))
    texts = pa.concat_arrays([texts])  # rebased to offset 0
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    n = len(raw)
    if n == 0:
        return pa.ListArray.from_arrays(pa.array(np.zeros(len(texts) + 1, np.int32)), pa.array([], pa.string()))
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    lo, hi = offsets[row], offsets[row + 1]
    here = np.arange(n)
    space, delim, opened, closed = _SPACE[raw], _DELIM[raw], _OPEN[raw], _CLOSE[raw]
    before, after = _last_true(~space), _next_true(~space)
    prev_ink = np.where(here > 0, before[np.maximum(here - 1, 0)], -1)
    next_ink = np.where(here < n - 1, after[np.minimum(here + 1, n - 1)], n)
    newline = (raw == ord("\n")) | (raw == ord("\r")) | (raw == ord("\t"))
    line, next_line = _last_true(newline), _next_true(newline)
    lead_ok = (prev_ink < lo) | _at(delim | opened, prev_ink, lo, hi) | (line > prev_ink)
    trail_ok = (next_ink >= hi) | _at(delim | closed, next_ink, lo, hi) | (next_line < next_ink)

    def first_in_row(mask: np.ndarray) -> np.ndarray:
        nxt = np.append(_next_true(mask), n)
        start = nxt[np.minimum(offsets[:-1], n)]
        return np.where(start < offsets[1:], start, np.iinfo(np.int64).max)

    double, single = raw == ord('"'), raw == ord("'")
    escaped = _at(raw == ord("\\"), here - 1, lo, hi)
    opening_double, opening_single = double & lead_ok, single & lead_ok
    kind_single = first_in_row(opening_single) < first_in_row(opening_double)  # the kind that opens first encloses
    single_row = kind_single[row]
    quote = np.where(single_row, single & (lead_ok | trail_ok), double & ~escaped)
    total = np.bincount(row[quote], minlength=len(texts))
    odd = total % 2 == 1  # an unclosed last quote encloses nothing
    if odd.any():
        last = _last_true(quote)[np.maximum(offsets[1:] - 1, 0)]
        quote = quote.copy()
        quote[last[odd]] = False
    count = np.cumsum(quote)
    parity = (count - np.append(0, count)[lo]) % 2  # 1 from an opening quote up to before its closing one
    inside = (parity == 1) | quote
    first_quote = quote & (parity == 1) & lead_ok
    # item codes: d.dd, not part of a longer number or word
    digit = _DIGIT[raw]
    code = digit & _at(raw == ord("."), here + 1, lo, hi) & _at(digit, here + 2, lo, hi) & _at(digit, here + 3, lo, hi)
    code &= ~_at(_WORD[raw] | (raw == ord(".")), here - 1, lo, hi) & ~_at(_WORD[raw], here + 4, lo, hi)
    lower = np.where((raw >= 65) & (raw <= 90), raw + 32, raw)

    def word_before(at: np.ndarray, word: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where `word` ends just before the place, over white space: (start of word, whether)."""
        end = np.where(at > 0, before[np.maximum(at - 1, 0)], -1)
        begin, ok = end - len(word) + 1, np.ones(len(at), bool)
        for k, ch in enumerate(word):
            ok &= _at(lower == ch, begin + k, lo[np.minimum(at, n - 1)], hi[np.minimum(at, n - 1)])
        ok &= (end < at - 1) & ~_at(_WORD[raw], begin - 1, lo[np.minimum(at, n - 1)], hi[np.minimum(at, n - 1)])
        return begin, ok

    codes = np.flatnonzero(code)
    begin, with_item = word_before(codes, b"item")
    starts = np.where(with_item, begin, codes)
    is_start = np.zeros(n, bool)
    p = np.where(starts > 0, before[np.maximum(starts - 1, 0)], -1)
    row_lo, row_hi = lo[codes], hi[codes]
    after_bare = _at(digit, p, row_lo, row_hi) & _at(code, p - 3, row_lo, row_hi)  # codes that only white space separates
    _, after_and = word_before(starts, b"and")
    after_quote = _at(double | single, p, row_lo, row_hi)
    after_line = np.where(starts > 0, line[np.maximum(starts - 1, 0)], -1) > np.maximum(p, row_lo - 1)
    fresh = (p < row_lo) | _at(delim | opened | closed, p, row_lo, row_hi) | after_bare | after_and | after_quote | after_line
    bare = fresh & ~inside[codes]
    is_start[starts[bare]] = True
    # a quote encloses a value if its content starts with an item code
    quotes = np.flatnonzero(first_quote)
    content = next_ink[quotes]
    item_word = content + 4
    for k, ch in enumerate(b"item"):
        item_word = np.where(_at(lower == ch, content + k, lo[quotes], hi[quotes]), item_word, -1)
    after_word = np.where(item_word >= 0, after[np.clip(item_word, 0, n - 1)], content)
    holds = _at(code, after_word, lo[quotes], hi[quotes])
    # ends
    stop = is_start | first_quote
    stop_at = np.append(_next_true(stop), n)
    bare_starts = np.flatnonzero(is_start)
    bare_code = codes[bare][np.argsort(starts[bare], kind="stable")]
    bare_end = np.minimum(stop_at[np.minimum(bare_starts + 1, n)], hi[bare_starts])
    follow = np.where(bare_code + 4 < n, after[np.minimum(bare_code + 4, n - 1)], n)
    no_caption = _at(delim | closed, follow, lo[bare_starts], hi[bare_starts])
    bare_end = np.where(no_caption, bare_code + 4, bare_end)
    filler = _last_true(~(space | delim | closed | opened))
    bare_end = filler[np.maximum(bare_end - 1, 0)] + 1
    for _ in range(2):  # a trailing 'and' separates, too
        tail_and = (bare_end - 4 > bare_code) & _at(space, bare_end - 4, lo[bare_starts], hi[bare_starts])
        for k, ch in enumerate(b"and"):
            tail_and &= lower[np.clip(bare_end - 3 + k, 0, n - 1)] == ch
        bare_end = np.where(tail_and, filler[np.maximum(bare_end - 4, 0)] + 1, bare_end)
    closing = quote & (parity == 0)
    q_open = quotes[holds]
    q_close = np.append(_next_true(closing & trail_ok), n)[np.minimum(q_open + 1, n)]
    q_close = np.minimum(q_close, hi[q_open] - 1)
    q_begin = next_ink[q_open]
    q_end = before[np.maximum(q_close - 1, 0)] + 1
    begins = np.concatenate([bare_starts, q_begin])
    ends = np.concatenate([bare_end, q_end])
    quoted = np.concatenate([np.zeros(len(bare_starts), bool), np.ones(len(q_begin), bool)])
    keep = ends > begins
    order = np.argsort(begins[keep], kind="stable")
    begins, ends, quoted = begins[keep][order], ends[keep][order], quoted[keep][order]
    # child offsets and values
    sizes = ends - begins
    child = np.append(0, np.cumsum(sizes)).astype(np.int32)
    take = np.repeat(begins - child[:-1], sizes) + np.arange(child[-1])
    values = pa.StringArray.from_buffers(len(begins), pa.py_buffer(child.tobytes()), pa.py_buffer(np.ascontiguousarray(raw[take]).tobytes()))
    if quoted.any():
        kind = kind_single[row[begins]] if len(begins) else quoted
        plain = pc.replace_substring(pc.replace_substring(values, '\\"', '"'), '""', '"')
        simple = pc.replace_substring(pc.replace_substring(values, "\\'", "'"), "''", "'")
        values = pc.if_else(pa.array(quoted & kind), simple, pc.if_else(pa.array(quoted & ~kind), plain, values))
    per_row = np.bincount(row[begins], minlength=len(texts)) if len(begins) else np.zeros(len(texts), int)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(per_row)).astype(np.int32)), values)


def unpack_items(df: DataFrame, *, key: str, packed: str) -> DataFrame:
    """One row per packed value: ``key, position INT (from 1), item STRING``.

    ``df`` should hold each key once; a repeated row gives its values again.
    Rows whose text is NULL, empty, or without an item give no row.  There is
    no shuffle: each Arrow batch is scanned where it lies.
    """
    small = df.select(F.col(key).cast("string").alias("k"), F.col(packed).cast("string").alias("t"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = split_items(batch.column("t"))
            parent = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
            first = np.frombuffer(lists.buffers()[1], np.int32)[: len(lists)] if len(lists) else np.zeros(0, np.int32)
            ordinal = np.arange(len(parent)) - first[parent] + 1 if len(parent) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([batch.column("k").take(pa.array(parent, pa.int64())), pa.array(ordinal, pa.int32()), lists.flatten()], names=["k", "position", "item"])

    return small.mapInArrow(scan, "k string, position int, item string").withColumnRenamed("k", key)

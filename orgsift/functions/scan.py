"""Hits of many patterns in plain texts, found by columns: RE2, inside Arrow, searches all texts of a batch at once.

RE2 takes time in proportion to a text whatever the pattern, where a search that tracks back takes the
square of a run of letters.  Its word ends, spaces and cases are those of ASCII, so it reads plain texts
only, and patterns are written out for it: letters as classes of both cases, \\s and \\d as the characters
that Java counts among them.
"""

import re
from functools import lru_cache
from re import _constants as _codes, _parser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

_MARK, _PART = "\x1e", "\x1f"
_CLASSES = {_codes.CATEGORY_SPACE: " \t\n\x0b\f\r", _codes.CATEGORY_DIGIT: "0123456789",
            _codes.CATEGORY_WORD: "".join(map(chr, [*range(48, 58), *range(65, 91), 95, *range(97, 123)]))}
SLICE_BYTES = 1 << 21
SLICE_HITS = 20000


class _Other(Exception):
    """A pattern has a part that is not written out."""


def _both_cases(code: int) -> str:
    """An ASCII letter in both cases; of other characters none is in a plain text, unless it matches an ASCII letter."""
    if chr(code) in "\u017f\u0130\u0131\u212a":
        raise _Other
    return chr(code).lower() + chr(code).upper() if code < 128 else chr(code)


def _char_class(chars, negated: bool = False) -> str:
    return f"[{'^' * negated}{''.join(f'\\x{{{ord(c):x}}}' for c in sorted(set(chars)))}]"


def _members(items) -> str:
    negated, chars = False, ""
    for op, arg in items:
        if op is _codes.NEGATE:
            negated = True
        elif op is _codes.LITERAL:
            chars += _both_cases(arg)
        elif op is _codes.RANGE and arg[1] < 128:
            chars += "".join(map(_both_cases, range(arg[0], arg[1] + 1)))
        elif op is _codes.CATEGORY and arg in _CLASSES:
            chars += _CLASSES[arg]
        else:
            raise _Other
    return _char_class(chars, negated)


def _written(parsed) -> str:
    out = ""
    for op, arg in parsed:
        if op is _codes.LITERAL:
            out += _char_class(_both_cases(arg))
        elif op is _codes.IN:
            out += _members(arg)
        elif op is _codes.AT and arg is _codes.AT_BOUNDARY:
            out += r"\b"
        elif op is _codes.SUBPATTERN and not arg[1] and not arg[2]:
            out += ("(?:" if arg[0] is None else "(") + _written(arg[3]) + ")"
        elif op is _codes.BRANCH:
            out += "(?:" + "|".join(map(_written, arg[1])) + ")"
        elif op in (_codes.MAX_REPEAT, _codes.MIN_REPEAT) and arg[2].getwidth()[0] > 0:  # the engines differ in repeats of nothing
            least, most, what = arg
            if max(least, 0 if most is _codes.MAXREPEAT else most) > 1000:
                raise _Other
            out += f"(?:{_written(what)}){{{least},{'' if most is _codes.MAXREPEAT else most}}}" + "?" * (op is _codes.MIN_REPEAT)
        else:
            raise _Other
    return out


@lru_cache(1000)
def written_out(pattern: str):
    """A pattern with the flags iu, for RE2: it finds in plain texts what Java finds; None where it has a part that is not written out."""
    try:
        parsed = _parser.parse(pattern[5:]) if pattern.startswith("(?iu)") else None
        if parsed is None or parsed.getwidth()[0] == 0:
            return None
        out = _written(parsed)
        pc.match_substring_regex(pa.array(["x"]), out)
        return out
    except (re.error, OverflowError, _Other, pa.ArrowException):
        return None


def is_plain(text) -> Column:
    """Whether a text is ASCII without the marks of the search; false for null."""
    text = F.col(text) if isinstance(text, str) else text
    marked = F.contains(text, F.lit(_MARK)) | F.contains(text, F.lit(_PART))
    return F.coalesce((F.length(text) == F.octet_length(text)) & ~marked, F.lit(False))


def _pieces(texts: pa.Array, pattern: str, grouped: bool):
    """(text, hit number, start, end, parts or None) of all hits, as arrays."""
    found = np.flatnonzero(pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False))
    if not len(found):
        return None
    marked = pc.replace_substring_regex(texts.take(pa.array(found)), pattern, f"{_MARK}\\0{_PART}\\1{_MARK}" if grouped else f"{_MARK}\\0{_MARK}")
    lists = pc.split_pattern(marked, _MARK)  # gap, hit, gap, hit, .. gap
    ends, flat = lists.offsets.to_numpy().astype(np.int64), lists.flatten()
    ends -= ends[0]
    counts = np.diff(ends)
    no = np.arange(ends[-1]) - np.repeat(ends[:-1], counts)
    is_hit, parts = no % 2 == 1, None
    size = pc.binary_length(flat).to_numpy().astype(np.int64)
    if grouped:
        both = pc.split_pattern(flat.filter(pa.array(is_hit)), _PART).flatten()  # hit, part, hit, part ..
        parts = both.take(pa.array(np.arange(1, len(both), 2)))
        size[is_hit] = pc.binary_length(both.take(pa.array(np.arange(0, len(both), 2)))).to_numpy()
    upto = np.cumsum(size)
    begin = upto - size
    begin -= np.repeat(begin[ends[:-1]], counts)
    start = begin[is_hit]
    return np.repeat(found, counts)[is_hit], no[is_hit] // 2, start, start + size[is_hit], parts


def _cut(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The texts between places of a buffer."""
    size = end - begin
    ends = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(ends[-1]) + np.repeat(begin - ends[:-1], size)
    return pa.StringArray.from_buffers(len(begin), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data[at]))


def _found_in(texts: pa.Array, patterns):
    """(pattern, text, hit number, start, end) of the hits of all patterns as arrays, and their parts; None without a hit."""
    made = [(i, *found) for i, (p, grouped) in enumerate(patterns) if (found := _pieces(texts, p, grouped)) is not None]
    if not made:
        return None
    scan = np.repeat(np.array([m[0] for m in made], np.int32), [len(m[1]) for m in made])
    parts = pa.concat_arrays([pa.nulls(len(m[1]), pa.string()) if m[5] is None else m[5] for m in made])
    return scan, *[np.concatenate([m[k] for m in made]) for k in range(1, 5)], parts


def _bytes_of(texts: pa.Array):
    """Where each text begins and the last one ends in the bytes of all, and these bytes."""
    places = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    return places, np.frombuffer(texts.buffers()[2] or b"", np.uint8)


def _hits_of(keys: pa.Array, texts: pa.Array, patterns, pad: int):
    """Columns of the hits of all patterns in a slice of texts, some rows at a time."""
    texts = pa.concat_arrays([texts])  # a slice still has the buffers of all texts
    found = _found_in(texts, patterns)
    if found is None:
        return
    scan, row, no, start, end, parts = found
    places, data = _bytes_of(texts)
    first, last = places[row], places[row + 1]
    for at in range(0, len(row), SLICE_HITS):
        k = slice(at, at + SLICE_HITS)
        b, e = first[k] + start[k], first[k] + end[k]
        columns = [keys.take(pa.array(row[k])), pa.array(scan[k]), pa.array(no[k].astype(np.int32)), _cut(data, b, e), parts[k], pa.array(start[k]), pa.array(end[k])]
        if pad:
            columns += [_cut(data, np.maximum(b - pad, first[k]), b), _cut(data, e, np.minimum(e + pad, last[k]))]
        yield columns


def _lists_of(keys: pa.Array, texts: pa.Array, patterns):
    """Columns of a slice of texts: for each text the list of its hits by pattern and place."""
    texts = pa.concat_arrays([texts])
    found = _found_in(texts, patterns)
    kind = pa.struct([("_i", pa.int32()), ("part", pa.string())])
    if found is None:
        yield [keys, pa.array([[]] * len(texts), pa.list_(kind))]
        return
    scan, row, _, start, end, parts = found
    order = np.argsort(row, kind="stable")
    places, data = _bytes_of(texts)
    begin = places[row]
    part = pc.coalesce(parts, _cut(data, begin + start, begin + end)).take(pa.array(order))
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(texts)))]).astype(np.int32)
    yield [keys, pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(scan[order]), part], fields=list(kind)))]


def _search(columns_of, names, *args):
    """A batch is searched in slices, so that a task holds the hits of a few megabytes of texts."""
    def run(batches):
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).cast(pa.string())
            upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(texts):
                begin = upto[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(upto, begin + SLICE_BYTES, "right")))
                for columns in columns_of(keys.slice(at, to - at), texts.slice(at, to - at), *args):
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                at = to
    return run


def plain_hits(docs: DataFrame, key: str, text: str, patterns, pad: int = 0) -> DataFrame:
    """Hits in plain texts of patterns (as written_out gives them, whether its group is wanted): key, _i (the pattern),
    hit_no, hit, part (null without a group), start_pos, end_pos and, with pad, before and after.
    """
    rows = docs.select(key, F.col(text).alias("_text"))
    schema = T.StructType([rows.schema[0], *T.StructType.fromDDL(
        "_i int, hit_no int, hit string, part string, start_pos bigint, end_pos bigint" + ", before string, after string" * bool(pad)).fields])
    return rows.mapInArrow(_search(_hits_of, schema.names, list(patterns), pad), schema)


def plain_lists(docs: DataFrame, key: str, text: str, patterns) -> DataFrame:
    """Plain texts with the list of their hits: key, _found (array of _i, part), where a part is the hit or its wanted group."""
    rows = docs.select(key, F.col(text).alias("_text"))
    schema = T.StructType([rows.schema[0], *T.StructType.fromDDL("_found array<struct<_i: int, part: string>>").fields])
    return rows.mapInArrow(_search(_lists_of, schema.names, list(patterns)), schema)

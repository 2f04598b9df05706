"""Reader for the few fields of the public TensorFlow ``Event`` message that hold
scalars and text.  A small helper of the decoding tasks; see ``eventfiles``."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

# Field and type numbers of the public .proto files (fixed values).
EVENT_WALL_TIME, EVENT_STEP, EVENT_SUMMARY = 1, 2, 5
SUMMARY_VALUE = 1
VALUE_TAG, VALUE_SIMPLE, VALUE_TENSOR = 1, 2, 8
VALUE_KINDS = {2, 3, 4, 5, 6, 8}  # members of the value oneof
TENSOR_DTYPE, TENSOR_SHAPE, TENSOR_CONTENT, TENSOR_STRING = 1, 2, 4, 8
SHAPE_DIM, DIM_SIZE = 2, 1
DT_STRING = 7
# dtype: (struct code of tensor_content, number of the typed field, struct code of its items or None for varints)
NUMERIC = {
    1: ("f", 5, "f"),     # float
    2: ("d", 6, "d"),     # double
    3: ("i", 7, None),    # int32
    4: ("B", 7, None),    # uint8
    5: ("h", 7, None),    # int16
    6: ("b", 7, None),    # int8
    9: ("q", 10, None),   # int64
    14: ("H", 13, None),  # bfloat16
    17: ("H", 7, None),   # uint16
    19: ("e", 13, None),  # half
    22: ("I", 16, None),  # uint32
    23: ("Q", 17, None),  # uint64
}
BFLOAT16, HALF = 14, 19

_DOUBLE, _FLOAT = struct.Struct("<d"), struct.Struct("<f")


class Undecodable(ValueError):
    pass


def _varint(buf: bytes, pos: int, end: int) -> tuple[int, int]:
    result = shift = 0
    while pos < end and shift < 70:
        byte = buf[pos]
        pos += 1
        result |= (byte & 0x7F) << shift
        if byte < 0x80:
            return result, pos
        shift += 7
    raise Undecodable


def _signed(v: int) -> int:
    v &= 0xFFFFFFFFFFFFFFFF
    return v - (1 << 64) if v >> 63 else v


def _fields(buf: bytes, pos: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(field, wire type, start, stop) of a message; for varints ``start`` is the value."""
    while pos < end:
        key, pos = _varint(buf, pos, end)
        field, kind = key >> 3, key & 7
        if not field:
            raise Undecodable
        if kind == 0:
            value, pos = _varint(buf, pos, end)
            yield field, kind, value, 0
            continue
        if kind == 2:
            size, pos = _varint(buf, pos, end)
        elif kind == 1:
            size = 8
        elif kind == 5:
            size = 4
        else:
            raise Undecodable
        if pos + size > end:
            raise Undecodable
        yield field, kind, pos, pos + size
        pos += size


def parse_event(buf: bytes, pos: int, end: int, scalars: bool = True, texts: bool = True):
    """``(wall_time, step, [(tag, value, text), ...])``; raises ``Undecodable``."""
    wall, step, spans = 0.0, 0, []
    for field, kind, a, b in _fields(buf, pos, end):
        if field == EVENT_WALL_TIME and kind == 1:
            wall = _DOUBLE.unpack_from(buf, a)[0]
        elif field == EVENT_STEP and kind == 0:
            step = _signed(a)
        elif field == EVENT_SUMMARY and kind == 2:
            spans.append((a, b))
    values = []
    for a, b in spans:
        for field, kind, va, vb in _fields(buf, a, b):
            if field == SUMMARY_VALUE and kind == 2:
                item = _value(buf, va, vb, scalars, texts)
                if item is not None:
                    values.append(item)
    return wall, step, values


def _value(buf: bytes, pos: int, end: int, scalars: bool, texts: bool):
    tag, which, a0, b0 = "", 0, 0, 0
    for field, _, a, b in _fields(buf, pos, end):
        if field == VALUE_TAG:
            try:
                tag = buf[a:b].decode("utf-8")
            except UnicodeDecodeError:
                raise Undecodable from None
        elif field in VALUE_KINDS:
            which, a0, b0 = field, a, b
    if which == VALUE_SIMPLE:
        return (tag, _FLOAT.unpack_from(buf, a0)[0], None) if scalars and b0 - a0 == 4 else None
    if which != VALUE_TENSOR:
        return None
    dtype, count, content = 0, 1, None
    typed: list[tuple[int, int, int, int]] = []
    for item in _fields(buf, a0, b0):
        field, kind, a, b = item
        if field == TENSOR_DTYPE:
            dtype = a
        elif field == TENSOR_SHAPE:
            count = _elements(buf, a, b)
        elif field == TENSOR_CONTENT:
            content = (a, b)
        else:
            typed.append(item)
    if dtype == DT_STRING:
        if not texts or count < 1:
            return None
        strings = [buf[a:b].decode("utf-8", "replace") for f, _, a, b in typed if f == TENSOR_STRING]
        if len(strings) == 1:
            strings *= count  # one stored element stands for all
        return (tag, None, "\n".join(strings)) if len(strings) == count else None
    if not scalars or dtype not in NUMERIC or count != 1:
        return None
    value = _single(buf, dtype, content, typed)
    return None if value is None else (tag, value, None)


def _elements(buf: bytes, pos: int, end: int) -> int:
    count = 1
    for field, kind, a, b in _fields(buf, pos, end):
        if field == SHAPE_DIM and kind == 2:
            size = 0
            for f, k, v, _ in _fields(buf, a, b):
                if f == DIM_SIZE and k == 0:
                    size = _signed(v)
            count *= size
    return count


def _single(buf: bytes, dtype: int, content, typed) -> float | None:
    code, number, item = NUMERIC[dtype]
    if content is not None and content[1] > content[0]:
        if content[1] - content[0] != struct.calcsize("<" + code):
            return None
        raw = struct.unpack_from("<" + code, buf, content[0])[0]
        return _bfloat(raw) if dtype == BFLOAT16 else float(raw)
    for field, kind, a, b in typed:
        if field != number:
            continue
        if item is not None:
            if b - a != struct.calcsize("<" + item):
                return None
            return float(struct.unpack_from("<" + item, buf, a)[0])
        if kind == 0:
            raw = a
        else:
            raw, stop = _varint(buf, a, b)
            if stop != b:
                return None
        if dtype == BFLOAT16:
            return _bfloat(raw & 0xFFFF)
        if dtype == HALF:
            return float(struct.unpack("<e", struct.pack("<H", raw & 0xFFFF))[0])
        return float(raw) if dtype in (22, 23) else float(_signed(raw))
    return None


def _bfloat(bits: int) -> float:
    return _FLOAT.unpack(struct.pack("<I", bits << 16))[0]


# --- many records ----------------------------------------------------------------

LONGEST = 1024  # longer events are parsed one by one
_FEW, _MISSES, _KINDS = 32, 8, 16  # fewer of a length, after so many that are unlike the rest, or after so many kinds, as well


def _plain(event: bytes):
    """Where the tag, wall time, step and value stand in an event with one simple value and each field once, as (start, stop); None
    for any other event.  Absent numbers have no place."""
    wall = step = span = None
    pos, end = 0, len(event)
    while pos < end:
        key, pos = _varint(event, pos, end)
        begin = pos
        if key == EVENT_WALL_TIME << 3 | 1 and wall is None:
            pos += 8
            wall = begin, pos
        elif key == EVENT_STEP << 3 and step is None:
            pos = _varint(event, pos, end)[1]
            step = begin, pos
        elif key == EVENT_SUMMARY << 3 | 2 and span is None:
            size, begin = _varint(event, pos, end)
            pos = begin + size
            span = begin, pos
        else:
            return None
    if span is None or pos != end:
        return None
    items = list(_fields(event, *span))
    if len(items) != 1 or items[0][:2] != (SUMMARY_VALUE, 2):
        return None
    known = sorted(f for f in _fields(event, *items[0][2:]) if f[0] == VALUE_TAG or f[0] in VALUE_KINDS)
    if [f[:2] for f in known] != [(VALUE_TAG, 2), (VALUE_SIMPLE, 5)]:
        return None
    return known[0][2:], wall, step, known[1][2:]


def parse_alike(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple]:
    """(numbers of events, their tags as rows of bytes, wall times, steps, values) of events that differ only in these four; what is
    not among them is left to parse_event().

    Two events of equal length whose other bytes are equal are parsed in the same way, so that one of them shows where the parts of
    all stand.  Only tags in ASCII are taken: no others can be undecodable.
    """
    for size in np.flatnonzero(np.bincount(np.minimum(lengths, LONGEST + 1))[:LONGEST + 1] >= _FEW).tolist():
        if not size:
            continue
        left = np.flatnonzero(lengths == size)
        rows = np.lib.stride_tricks.sliding_window_view(buf, size)[starts[left]]
        misses = 0
        for _ in range(_KINDS):
            if len(left) < _FEW or misses >= _MISSES:
                break
            try:
                found = _plain(rows[0].tobytes())
            except Undecodable:
                found = None
            if found is None:
                misses += 1
                left, rows = left[1:], rows[1:]
                continue
            tag, wall, step, value = found
            fixed = np.full(size, 0xFF, np.uint8)
            for place in (value, wall):
                if place is not None:
                    fixed[slice(*place)] = 0
            fixed[slice(*tag)] = 0x80
            if step is not None:
                fixed[slice(*step)] = 0x80  # whether another byte follows
            like = rows[0].copy()
            like[slice(*tag)] = 0
            alike = (((rows ^ like) & fixed) == 0).all(axis=1)
            if not alike.any():
                misses += 1
                left, rows = left[1:], rows[1:]
                continue
            misses = 0 if alike.sum() >= _FEW else misses + 1
            some = rows if alike.all() else rows[alike]
            walls = np.zeros(len(some)) if wall is None else np.ascontiguousarray(some[:, slice(*wall)]).view("<f8")[:, 0]
            steps = np.zeros(len(some), np.uint64)
            for k in range(*(step or (0, 0))):
                steps |= (some[:, k] & 0x7F).astype(np.uint64) << np.uint64(7 * (k - step[0]))
            values = np.ascontiguousarray(some[:, slice(*value)]).view("<f4")[:, 0]
            yield left[alike], some[:, slice(*tag)], walls, steps.view(np.int64), values
            left, rows = left[~alike], rows[~alike]

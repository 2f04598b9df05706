"""Record boundaries of event files, found from any place.

A record is its length (8 bytes, little-endian), a checksum of these, the data, and a checksum of the data.  The
checksum of the length tells where a record begins, so that a stretch of a file can be cut without what is before
it.  Checksums are only a hint: cut() follows the records from the start over all stretches and walks a stretch again
that begins elsewhere, as in files without checksums or with records inside of records.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

POLYNOMIAL = 0x82F63B78  # fixed value: CRC-32C, bits reversed
MASK_DELTA, MASK_TURN = 0xA282EAD8, 15  # fixed values: how stored checksums are masked
HEAD, FRAME = 12, 16  # length and its checksum; all that surrounds the data

_LENGTH = struct.Struct("<Q")
_FIRST_BLOCK, _MOST_BLOCK = 1 << 13, 1 << 20


def _tables() -> np.ndarray:
    """tables[k][b]: checksum of byte b followed by k zero bytes, without its initial and final inversion."""
    out = np.zeros((8, 256), np.uint32)
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = (c >> 1) ^ np.where(c & 1, np.uint32(POLYNOMIAL), np.uint32(0))
    out[0] = c
    for k in range(1, 8):
        out[k] = (out[k - 1] >> 8) ^ out[0][out[k - 1] & 0xFF]
    return out


_TABLES = _tables()
_BYTE = [int(v) for v in _TABLES[0]]


def masked(crc):
    return ((crc >> MASK_TURN | crc << (32 - MASK_TURN)) + MASK_DELTA) & 0xFFFFFFFF


def checksum(data: bytes) -> int:
    """Masked checksum of any bytes."""
    crc = 0xFFFFFFFF
    for b in data:
        crc = crc >> 8 ^ _BYTE[(crc ^ b) & 0xFF]
    return masked(crc ^ 0xFFFFFFFF)


def checksums(rows: np.ndarray) -> np.ndarray:
    """Masked checksums of the rows of a byte matrix."""
    crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for column in rows.T:
        crc = crc >> 8 ^ _TABLES[0][(crc ^ column) & 0xFF]
    return masked((crc ^ 0xFFFFFFFF).astype(np.uint64)).astype(np.uint32)


def framed(data: bytes) -> bytes:
    """A record with its checksums."""
    length = _LENGTH.pack(len(data))
    return length + struct.pack("<I", checksum(length)) + data + struct.pack("<I", checksum(data))


def heads(block: bytes) -> np.ndarray:
    """Places in a block where eight bytes are followed by their masked checksum."""
    data = np.frombuffer(block, np.uint8)
    n = len(data) - HEAD + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    crc = np.full(n, 0xFFFFFFFF, np.uint32)
    for k in range(8):
        crc ^= _TABLES[7 - k][data[k:k + n] ^ 0xFF] if k < 4 else _TABLES[7 - k][data[k:k + n]]
    stored = np.zeros(n, np.uint64)
    for k in range(4):
        stored |= data[8 + k:8 + k + n].astype(np.uint64) << np.uint64(8 * k)
    return np.flatnonzero(masked(crc.astype(np.uint64)) == stored)


def first_record(window, start: int, stop: int, size: int) -> int | None:
    """The first place in [start, stop) where a record begins whose successor begins one as well, or ends the file."""
    at, step = start, _FIRST_BLOCK
    while at < stop:
        length = min(step, stop - at) + HEAD - 1
        length = min(length, size - at)
        if length < HEAD:
            return None
        buf, off = window.get(at, length)
        for place in heads(bytes(buf[off:off + length])):
            found = at + int(place)
            after = found + FRAME + _length(window, found)
            if after + HEAD > size:
                return found  # the last whole record, or one that is still being written
            buf, off = window.get(after, HEAD)
            if len(heads(bytes(buf[off:off + HEAD]))):
                return found
        at, step = at + min(step, stop - at), min(4 * step, _MOST_BLOCK)
    return None


def _length(window, at: int) -> int:
    buf, off = window.get(at, 8)
    return _LENGTH.unpack_from(buf, off)[0]


def walk(window, at: int, stop: int, size: int) -> tuple[int, int]:
    """From a record on: the first boundary at or behind ``stop``, or behind the last whole record; and the records before it."""
    count = 0
    while at < stop and at + HEAD <= size:
        after = at + FRAME + _length(window, at)
        if after > size:
            break
        at, count = after, count + 1
    return at, count


def cut(stretches: list[tuple[int, int | None, int, int]], start: int, size: int, first_rec: int, again) -> Iterator[tuple[int, int, int]]:
    """Whole records of a file from ``start`` on: (start, stop, number of the first record) of stretches.

    ``stretches`` are (end of the stretch, place of the first record found in it, boundary behind it, records), in
    order.  ``again(at, stop)`` walks a stretch whose first record is elsewhere.  Only the last one may end inside of
    a record that is still being written.
    """
    at, rec, held = start, first_rec, None
    for stop, begin, after, count in stretches:
        if at >= stop:
            continue  # a record covers the whole stretch
        if begin != at:
            after, count = again(at, stop)
        if after > at:
            if held:
                yield held
            held = (at, after, rec)
            at, rec = after, rec + count
        if after < stop:
            break
    if held is None:
        held = (at, size, rec)
    yield held[0], size, held[2]

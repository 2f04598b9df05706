"""Writes synthetic event files for tests."""

import os
import struct


def _varint(n):
    n &= 0xFFFFFFFFFFFFFFFF
    out = b""
    while True:
        low, n = n & 0x7F, n >> 7
        out += bytes([low | (0x80 if n else 0)])
        if not n:
            return out


def _len(field, data):
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def _int(field, n):
    return _varint(field << 3) + _varint(n)


def simple(tag, value):
    return _len(1, _len(1, tag.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", value))


def shape(*dims):
    return b"".join(_len(2, _int(1, d)) for d in dims)


def tensor(tag, dtype, dims=(), content=b"", typed=b""):
    body = _int(1, dtype) + _len(2, shape(*dims)) + (_len(4, content) if content else b"") + typed
    return _len(1, _len(1, tag.encode()) + _len(8, body))


def strings(tag, values, dims=None):
    dims = (len(values),) if dims is None else dims
    return tensor(tag, 7, dims, typed=b"".join(_len(8, v if isinstance(v, bytes) else v.encode()) for v in values))


def floats(tag, values, dims):
    return tensor(tag, 1, dims, typed=_len(5, b"".join(struct.pack("<f", v) for v in values)))


def event(step, wall, *values):
    body = _varint(1 << 3 | 1) + struct.pack("<d", wall) + _int(2, step)
    return body + (_len(5, b"".join(values)) if values else _len(3, b"brain.Event:2"))


def record(data, checked=False):
    if checked:
        from scalarlake.sources.framing import framed

        return framed(data)
    return struct.pack("<Q", len(data)) + b"\0" * 4 + data + b"\0" * 4


def write(path, *events, append=False, raw=b"", checked=False):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "ab" if append else "wb") as f:
        for e in events:
            f.write(record(e, checked))
        f.write(raw)

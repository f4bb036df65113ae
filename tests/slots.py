"""Byte-level file-record slots for tests."""

import struct
from datetime import datetime

EPOCH = datetime(1601, 1, 1)


def ticks(at):
    return 0 if at is None else int((at - EPOCH).total_seconds()) * 10_000_000 + at.microsecond * 10


def attribute(kind, content, resident=True, length=None, size=None):
    total = 24 + len(content)
    padded = total + -total % 8
    head = struct.pack(
        "<IIBBHHHIH2x", kind, padded if length is None else length, 0 if resident else 1, 0, 0, 0, 0,
        len(content) if size is None else size, 24,
    )
    return (head + content).ljust(padded, b"\0")


def standard(*times, **options):
    return attribute(0x10, struct.pack("<4Q", *[t if isinstance(t, int) else ticks(t) for t in times]) + bytes(16), **options)


def file_name(name, namespace, created, parent=5, raw_name=None, chars=None, **options):
    encoded = name.encode("utf-16-le") if raw_name is None else raw_name
    content = struct.pack("<Q4Q24x", parent | 3 << 48, *[ticks(created)] * 4) + bytes(
        [len(encoded) // 2 if chars is None else chars, namespace]
    )
    return attribute(0x30, content + encoded, **options)


def slot(*attributes, flags=1, number=0, signature=b"FILE", usa_offset=48, usa_count=3, used=None,
         record_bytes=1024, first=56, end=struct.pack("<I", 0xFFFFFFFF)):
    usn = b"\x07\x00"
    body = bytearray(record_bytes)
    attrs = b"".join(attributes) + end
    body[0:4] = signature
    struct.pack_into("<HH", body, 4, usa_offset, usa_count)
    struct.pack_into("<HHI", body, 20, first, flags, first + len(attrs) if used is None else used)
    struct.pack_into("<I", body, 44, number)
    body[first : first + len(attrs)] = attrs
    usa = bytearray(usn)
    for k in range(1, record_bytes // 512 + 1):
        tail = slice(512 * k - 2, 512 * k)
        usa += body[tail]
        body[tail] = usn
    body[48 : 48 + len(usa)] = usa
    return bytes(body)

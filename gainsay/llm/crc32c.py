"""Masked CRC-32C of many byte strings at once.

A record is padded in front with zeros, which a checksum with a zero start does not see, and cut into
blocks. The blocks of all records go through the tables side by side; then each record's blocks are
joined by the linear map that a whole block of zeros applies to a checksum.
"""

from __future__ import annotations

import numpy as np

# The reflected Castagnoli polynomial and the mask of the record format.
POLYNOMIAL = 0x82F63B78
MASK_DELTA = 0xA282EAD8

BLOCK_WORDS = 64


def _tables() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1).astype(np.uint32)
    out = [table]
    for _ in range(3):
        out.append(table[out[-1] & 0xFF] ^ (out[-1] >> 8))
    return np.stack(out)


_T = _tables()


def _by_tables(x: np.ndarray, tables: np.ndarray) -> np.ndarray:
    return (
        tables[3][x & 0xFF] ^ tables[2][(x >> 8) & 0xFF]
        ^ tables[1][(x >> 16) & 0xFF] ^ tables[0][x >> 24]
    )


def _block_shift() -> np.ndarray:
    """Tables of the map from a checksum to that after one block of zeros."""
    values = np.arange(256, dtype=np.uint32)
    out = []
    for place in (24, 16, 8, 0):
        x = values << np.uint32(place)
        for _ in range(BLOCK_WORDS):
            x = _by_tables(x, _T)
        out.append(x)
    return np.stack(out)


_SHIFT = _block_shift()


def crc32c(records: list[bytes]) -> np.ndarray:
    """CRC-32C of every record; each must have four bytes or more."""
    size = 4 * BLOCK_WORDS
    lengths = np.fromiter(map(len, records), dtype=np.int64, count=len(records))
    if not len(records):
        return np.zeros(0, dtype=np.uint32)
    if lengths.min() < 4:
        raise ValueError("a record must have four bytes or more")
    blocks = -(-lengths // size)
    ends = np.cumsum(blocks)
    data = np.zeros(int(ends[-1]) * size, dtype=np.uint8)
    for record, end, length in zip(records, (ends * size).tolist(), lengths.tolist()):
        data[end - length : end] = np.frombuffer(record, dtype=np.uint8)
    # A start of all ones is the same as inverting the first four bytes.
    data[(ends * size - lengths)[:, None] + np.arange(4)] ^= 0xFF
    words = np.ascontiguousarray(data.view("<u4").reshape(-1, BLOCK_WORDS).T)
    part = np.zeros(words.shape[1], dtype=np.uint32)
    for row in words:
        part = _by_tables(part ^ row, _T)
    crc = part[ends - blocks]
    for step in range(1, int(blocks.max())):
        longer = np.flatnonzero(blocks > step)
        crc[longer] = _by_tables(crc[longer], _SHIFT) ^ part[(ends - blocks)[longer] + step]
    return crc ^ np.uint32(0xFFFFFFFF)


def masked(records: list[bytes]) -> np.ndarray:
    """Rotated and shifted, so that a checksum over data that holds checksums stays useful."""
    crc = crc32c(records)
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)

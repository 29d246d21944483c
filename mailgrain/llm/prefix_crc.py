"""CRC-32 of any stretch of a byte stream from the registers at its two ends.

The register that a CRC keeps is linear over GF(2) in what it has read. So the stream is scanned once, and the CRC
of ``stream[start:end]`` is the register at ``end`` with the one at ``start``, moved on by the bytes between, cancelled.
Moving on by ``2**k`` bytes is a fixed linear map, kept as four tables of 256 numbers.
"""

from __future__ import annotations

import numpy as np

U32 = np.uint32
FULL = U32(0xFFFFFFFF)
BLOCK_BITS = 8
BLOCK = 1 << BLOCK_BITS


def _byte_table() -> np.ndarray:
    """The register after one byte, from the reflected polynomial of CRC-32 (a fixed value)."""
    table = np.arange(256, dtype=U32)
    for _ in range(8):
        table = (table >> U32(1)) ^ np.where(table & U32(1), U32(0xEDB88320), U32(0))
    return table


_STEP = _byte_table()


def _moved(table: np.ndarray, register: np.ndarray) -> np.ndarray:
    low, high = register & U32(0xFFFF), register >> U32(16)
    return table[0][low & U32(255)] ^ table[1][low >> U32(8)] ^ table[2][high & U32(255)] ^ table[3][high >> U32(8)]


def _shift_tables(count: int) -> list[np.ndarray]:
    """Tables that move a register on by 1, 2, 4, ... zero bytes."""
    values = np.arange(256, dtype=U32)[None, :] << (U32(8) * np.arange(4, dtype=U32)[:, None])
    tables = [_STEP[values & U32(255)] ^ (values >> U32(8))]
    while len(tables) < count:
        tables.append(_moved(tables[-1], tables[-1]))
    return tables


_SHIFT = _shift_tables(40)


def shifted(register: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Each register moved on by its own number of zero bytes."""
    out, longest = register.copy(), int(length.max()) if len(length) else 0
    for k in range(longest.bit_length()):
        some = np.flatnonzero((length >> k) & 1)
        out[some] = _moved(_SHIFT[k], out[some])
    return out


class Running:
    """The registers of one stream: blocks are scanned side by side, then each block's start is carried on."""

    def __init__(self, data: np.ndarray):
        blocks = max(1, -(-len(data) // BLOCK))
        columns = np.zeros(blocks * BLOCK, np.uint8)
        columns[: len(data)] = data
        columns = np.ascontiguousarray(columns.reshape(blocks, BLOCK).T)
        self.within = np.empty((BLOCK, blocks), U32)
        register = np.zeros(blocks, U32)
        for i in range(BLOCK):
            register = _STEP[(register ^ columns[i]) & U32(255)] ^ (register >> U32(8))
            self.within[i] = register
        ends, reach = register.copy(), 1
        while reach < blocks:
            before = _moved(_SHIFT[BLOCK_BITS + reach.bit_length() - 1], ends[:-reach])
            ends[reach:] ^= before
            reach *= 2
        self.before = np.concatenate((np.zeros(1, U32), ends[:-1]))

    def at(self, place: np.ndarray) -> np.ndarray:
        """The register after ``place`` bytes."""
        block, last = np.divmod(np.maximum(place - 1, 0), BLOCK)
        found = self.within[last, block] ^ shifted(self.before[block], last + 1)
        return np.where(place > 0, found, U32(0))


def stretch_crc(running: Running, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32, as usually written, of the stretches ``start`` to ``end``."""
    return running.at(end) ^ shifted(running.at(start) ^ FULL, end - start) ^ FULL

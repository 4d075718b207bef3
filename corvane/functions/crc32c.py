"""CRC-32C (Castagnoli) of binary columns, a batch at a time in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the reversed polynomial.
POLYNOMIAL = 0x82F63B78
LANES = 256


@cache
def table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


@cache
def _zeros(n: int) -> np.ndarray:
    """What n zero bytes make of each bit of a register: 32 images, by doubling."""
    if n == 1:
        bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
        return table()[bits & 0xFF] ^ (bits >> np.uint32(8))
    half = _zeros(n // 2)
    both = np.array([_through(half, x) for x in half], np.uint32)
    return np.array([_through(_zeros(1), x) for x in both], np.uint32) if n % 2 else both


def _through(images: np.ndarray, register: int) -> int:
    return int(np.bitwise_xor.reduce(images[[k for k in range(32) if int(register) >> k & 1]], initial=0))


def crc32c(data: bytes) -> int:
    """Long inputs run in LANES pieces side by side, which are joined by what the bytes after each make of it."""
    t, register = table(), 0xFFFFFFFF
    step = len(data) // LANES
    if step >= 16:
        piece = np.frombuffer(data, np.uint8, step * LANES).reshape(LANES, step)
        lanes = np.zeros(LANES, np.uint32)
        lanes[0] = register
        for k in range(step):
            lanes = t[(lanes ^ piece[:, k]) & 0xFF] ^ (lanes >> np.uint32(8))
        images, register = _zeros(step), 0
        for x in lanes:
            register = _through(images, register) ^ int(x)
        data = data[step * LANES :]
    t = t.tolist()
    for b in data:
        register = t[(register ^ b) & 0xFF] ^ (register >> 8)
    return register ^ 0xFFFFFFFF


def crc32c_of(data: Column) -> Column:
    """CRC-32C of a binary column as long; null for null."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            yield pa.array([None if x is None else crc32c(x) for x in a.to_pylist()], pa.int64())

    return F.arrow_udf(run, "long")(data)

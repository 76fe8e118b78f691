"""Sets of hashes as bitmaps of fixed size, to ask in Python workers whether a hash may be known."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Bits:
    """A set of hashes as a bitmap, each known by ``len(shifts)`` bits."""

    def __init__(self, size: int, shifts: tuple[int, ...]) -> None:
        self.size, self.shifts = size, shifts
        self.packed = np.zeros(size // 8, np.uint8)

    @staticmethod
    def of(hashes: DataFrame, size: int, shifts: tuple[int, ...]) -> Bits:
        """From a column ``h``; at most ``size`` small numbers come to the driver."""
        out = Bits(size, shifts)
        at = hashes.select(F.explode(F.array(*[F.pmod(F.shiftrightunsigned("h", k), F.lit(size)).cast("int") for k in shifts])).alias("b")).distinct().toPandas()["b"].to_numpy(np.int64)
        full = np.zeros(size, bool)
        full[at] = True
        out.packed = np.packbits(full, bitorder="little")
        return out

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for k in self.shifts:
            b = ((h >> np.uint64(k)) & np.uint64(self.size - 1)).astype(np.int64)
            out &= (self.packed[b >> 3] >> (b & 7).astype(np.uint8)) & 1 == 1
        return out

"""Checksums and hashes that Spark lacks, vectorised over all rows of a batch.

Spark's own: ``crc32`` (IEEE), ``xxhash64`` (seed 42), ``sha2``, ``md5``.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Bytes that every row is cut into: their checksums are walked side by side, then joined.
_BLOCK = 256


@lru_cache(maxsize=4)
def _tables(poly: int, bits: int, reflected: bool) -> tuple[np.ndarray, np.ndarray]:
    """The table of one byte, and for each byte of a state what ``_BLOCK`` zero bytes make of it."""
    kind, top = (np.uint64 if bits == 64 else np.uint32), 1 << (bits - 1)
    one = []
    for i in range(256):
        c = i if reflected else i << (bits - 8)
        for _ in range(8):
            if reflected:
                c = c >> 1 ^ poly if c & 1 else c >> 1
            else:
                c = (c << 1 & (1 << bits) - 1) ^ poly if c & top else c << 1
        one.append(c)
    table = np.array(one, dtype=kind)
    state = np.array([[v << 8 * k for v in range(256)] for k in range(bits // 8)], dtype=kind)
    for _ in range(_BLOCK):
        state = _step(state, kind(0), table, bits, reflected)
    return table, state


def _step(crc: np.ndarray, byte, table: np.ndarray, bits: int, reflected: bool) -> np.ndarray:
    kind = table.dtype.type
    if reflected:
        return table[((crc ^ byte) & kind(255)).astype(np.int64)] ^ (crc >> kind(8))
    return table[((crc >> kind(bits - 8)) ^ byte).astype(np.int64)] ^ (crc << kind(8))


def _crc(data: pd.Series, poly: int, bits: int, reflected: bool, ones: bool) -> np.ndarray:
    """Checksums of all rows; ``ones`` inverts the first and the last state.  A row gets zero
    bytes before it up to whole blocks, which change nothing from state 0, and ones at the start
    are its first bytes inverted; blocks are walked together, a byte a step, and then joined a
    block a step, so a long row costs as many steps as it has blocks."""
    table, over = _tables(poly, bits, reflected)
    kind, head = table.dtype.type, bits // 8
    rows = [b or b"" for b in data]
    sizes = np.array([len(b) for b in rows], dtype=np.int64)
    blocks = np.maximum(1, -(-sizes // _BLOCK))
    at = np.concatenate([[0], np.cumsum(blocks)])
    flat = np.zeros(at[-1] * _BLOCK, dtype=np.uint8)
    ends = at[1:] * _BLOCK
    where = np.repeat(ends - np.cumsum(sizes), sizes) + np.arange(int(sizes.sum()))
    flat[where] = np.frombuffer(b"".join(rows), dtype=np.uint8)
    if ones:
        for j in range(head):
            long = sizes > j
            flat[(ends - sizes)[long] + j] ^= 255
    grid = flat.reshape(-1, _BLOCK)
    part = np.zeros(len(grid), dtype=kind)
    for j in range(_BLOCK):
        part = _step(part, grid[:, j].astype(kind), table, bits, reflected)
    crc = part[at[:-1]].copy()
    order = np.argsort(-blocks, kind="stable")
    for j in range(1, int(blocks.max()) if len(rows) else 0):
        live = order[: int(np.searchsorted(-blocks[order], -j, side="left"))]
        old, moved = crc[live], part[at[live] + j]
        for k in range(head):
            moved = moved ^ over[k][((old >> kind(8 * k)) & kind(255)).astype(np.int64)]
        crc[live] = moved
    if ones:
        full = kind((1 << bits) - 1)
        for i in np.flatnonzero(sizes < head):  # ones reach beyond so short a row
            c = np.array([full])
            for byte in rows[i]:
                c = _step(c, kind(byte), table, bits, reflected)
            crc[i] = c[0]
        crc ^= full
    return crc


@F.pandas_udf(T.LongType())
def crc32c(data: pd.Series) -> pd.Series:
    """Castagnoli."""
    return pd.Series(_crc(data, 0x82F63B78, 32, reflected=True, ones=True).astype(np.int64)).where(data.notna().to_numpy())


@F.pandas_udf(T.LongType())
def crc64(data: pd.Series) -> pd.Series:
    """CRC-64 of ECMA-182 (most significant bit first, from state 0), the bytes of its value in
    reverse order, as a signed long."""
    return pd.Series(_crc(data, 0x42F0E1EBA9EA3693, 64, reflected=False, ones=False).byteswap().view(np.int64)).where(data.notna().to_numpy())


@F.pandas_udf(T.LongType())
def xxh64(data: pd.Series) -> pd.Series:
    """XXH64 with seed 0, as a signed long (Spark's own has seed 42)."""
    import xxhash

    return data.map(lambda b: None if b is None else int.from_bytes(xxhash.xxh64_digest(b), "big", signed=True))


@F.pandas_udf(T.BinaryType())
def xxh128(data: pd.Series) -> pd.Series:
    import xxhash

    return data.map(lambda b: None if b is None else xxhash.xxh3_128_digest(b))

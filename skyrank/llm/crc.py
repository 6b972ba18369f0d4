"""CRC-32C of many byte ranges at once, and the mask that stored checksums carry."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_POLYNOMIAL = 0x82F63B78    # Castagnoli, reflected
_MASK_DELTA = 0xA282EAD8
#: Ranges are cut into blocks of so many bytes, which advance side by side.
BLOCK = 512


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """What a byte adds 1 to 4 bytes before the end, and the same for whole blocks of zeros behind a state."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(_POLYNOMIAL), table >> 1).astype(np.uint32)
    step = lambda s: table[s & 0xFF] ^ (s >> 8)
    near = [table]
    for _ in range(3):
        near.append(step(near[-1]))
    far = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    for _ in range(BLOCK):
        far = step(far)
    return np.stack(near), far


def _fold(tables: np.ndarray, s: np.ndarray) -> np.ndarray:
    return tables[0][s & 0xFF] ^ tables[1][(s >> 8) & 0xFF] ^ tables[2][(s >> 16) & 0xFF] ^ tables[3][s >> 24]


def crc32c(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The checksums of the ranges of ``data`` (bytes) as unsigned 32-bit numbers.

    A range is padded with zeros in front, which a state of zero ignores; the customary start value
    of all ones is the same as its first four bytes inverted.
    """
    near, far = _tables()
    starts, sizes = np.asarray(starts, np.int64), np.asarray(sizes, np.int64)
    blocks = np.maximum(1, -(-sizes // BLOCK))
    last = np.cumsum(blocks)
    first = last - blocks
    padded = np.zeros(int(last[-1]) * BLOCK if len(last) else 0, np.uint8)
    for a, n, end in zip(starts.tolist(), sizes.tolist(), (last * BLOCK).tolist()):
        padded[end - n:end] = data[a:a + n]
        padded[end - n:end - n + min(n, 4)] ^= 0xFF
    words = np.ascontiguousarray(padded.view("<u4").reshape(-1, BLOCK // 4).T)
    state = np.zeros(words.shape[1], np.uint32)
    for word in words:
        state = _fold(near[::-1], state ^ word)
    out, left, at = np.zeros(len(sizes), np.uint32), np.arange(len(sizes)), 0
    while len(left):
        out[left] = _fold(far, out[left]) ^ state[first[left] + at]
        at += 1
        left = left[blocks[left] > at]
    short = np.uint32(0xFFFFFFFF) >> (8 * np.minimum(sizes, 4)).astype(np.uint64)    # start bits that no byte took up
    return out ^ np.uint32(0xFFFFFFFF) ^ np.where(sizes < 4, short, 0).astype(np.uint32)


def masked(crc: np.ndarray) -> np.ndarray:
    """A checksum in the form it is stored in beside its data."""
    crc = crc.astype(np.uint32)
    return (((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(_MASK_DELTA)).astype(np.uint32)

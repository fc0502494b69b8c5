"""xz at preset 9 for many small values."""

from __future__ import annotations

import lzma

import numpy as np

PRESET = 9
#: Fixed value of the encoder at this preset: nodes of a search tree that it visits at most.
DEPTH = 48
#: Smaller dictionaries, in bits, that are tried first; the match finder's table has half as many slots, at preset 9 2^24.
TRIED = (17, 23)
SLOTS = 1 << 24
#: Where the block header stands in a stream with data. It names the dictionary size.
HEADER = slice(12, 24)
PRESET_HEADER = lzma.compress(b"a", preset=PRESET)[HEADER]


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def _slots(data: bytes) -> np.ndarray:
    """The slot of the match finder's table at preset 9 for each four bytes; a smaller table takes the low bits."""
    b = np.frombuffer(data, np.uint8)
    if len(b) < 4:
        return np.empty(0, np.uint32)
    return (_CRC[b[:-3]] ^ b[1:-2] ^ (b[2:-1].astype(np.uint32) << 8) ^ (_CRC[b[3:]] << 5)) & np.uint32(SLOTS - 1)


def _same_matches(slots: np.ndarray, bits: int) -> bool:
    """Whether a table of 2^bits slots finds the matches of the full one.

    A slot holds a search tree. Other slots' entries in it lie outside the searched prefix, so they hide no match unless the search ends by its
    depth. So a slot may hold what several slots of the full table hold if it has at most DEPTH entries.
    """
    keys = np.sort(((slots & np.uint32((1 << bits) - 1)).astype(np.uint64) << np.uint64(24)) | slots)
    low = keys >> np.uint64(24)
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    last = np.append(first[1:], len(keys)) - 1
    large = last - first >= DEPTH
    return bool((keys[first[large]] == keys[last[large]]).all())


def compress(data: bytes) -> bytes:
    """``lzma.compress(data, preset=9)``, byte for byte.

    The encoder sets up memory by its dictionary size, 64 MiB, for each value, which takes longer than packing a short one. A smaller size that
    holds the value gives the same bytes after the header if the match finder's smaller table finds the same matches, which is tested first.
    """
    slots = _slots(data) if data else None
    for bits in TRIED:
        if data and len(data) <= 1 << bits and (len(slots) <= DEPTH or _same_matches(slots, bits - 1)):
            out = lzma.compress(data, filters=[{"id": lzma.FILTER_LZMA2, "preset": PRESET, "dict_size": 1 << bits}])
            return out[: HEADER.start] + PRESET_HEADER + out[HEADER.stop :]
    return lzma.compress(data, preset=PRESET)

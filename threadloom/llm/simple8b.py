"""Simple-8b: token ids packed in 64-bit words.

A word holds a 4-bit selector (its highest bits) and 60 bits of payload. Selectors 1 to 14 pack COUNT ids of BITS bits,
the first id lowest. Selector 0 is the escape: the next word is one whole id of more than 60 bits. Ids are encoded in
blocks of BLOCK_IDS; each block begins on a word of its own, so that blocks decode by themselves, without a loop over
ids or words. The last word of a block may hold fewer ids than its selector says; the number of ids tells.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
BLOCK_IDS = 1 << 16
#: Fixed values of the format: ids per word and bits per id, by selector.
COUNT = (1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = 0
_COUNTS = np.array([*COUNT, 0], np.int64)
_LIMITS = np.array([1 << b for b in range(64)], np.uint64)


#: The length in bits of small numbers.
_BITS = np.searchsorted(_LIMITS, np.arange(1 << 17, dtype=np.uint64), "right").astype(np.uint8)


def lengths(ids: np.ndarray) -> np.ndarray:
    """Each id's length in bits."""
    return _BITS[ids] if ids.max() < len(_BITS) else np.searchsorted(_LIMITS, ids, "right").astype(np.uint8)


def choices(bits: np.ndarray) -> np.ndarray:
    """The selector with which a word that begins at each id holds the most; what lies behind the end takes no bits."""
    n = len(bits)
    longest = {1: np.concatenate([bits, np.zeros(max(COUNT) - 1, np.uint8)])}
    for size in (1, 2, 4, 8, 16):
        # the longest of twice as many from each id on
        longest[2 * size] = np.maximum(longest[size][:-size], longest[size][size:])
    choice = np.full(n, ESCAPE, np.uint8)
    choice[bits <= BITS[14]] = 14
    least = int(bits.min())
    for s in range(13, 0, -1):
        if least > BITS[s]:
            break
        count = COUNT[s]
        half = 1 << (count.bit_length() - 1)
        most = np.maximum(longest[half][:n], longest[half][count - half : count - half + n])
        choice[most <= BITS[s]] = s
    return choice


def encode_block(ids: np.ndarray) -> np.ndarray:
    """The words of at most BLOCK_IDS ids."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64)
    ids = ids.astype(np.uint64, copy=False)
    choice = choices(lengths(ids))
    step = _COUNTS.astype(np.uint8)[choice].tobytes()
    at, i = [], 0
    while i < n:
        at.append(i)
        i += step[i]
    at = np.array(at)
    chosen = choice[at]
    place = np.cumsum(np.where(chosen == ESCAPE, 2, 1))
    out = np.zeros(int(place[-1]), np.uint64)
    place = place - np.where(chosen == ESCAPE, 2, 1)
    padded = np.concatenate([ids, np.zeros(60, np.uint64)])
    for s in np.unique(chosen).tolist():
        rows = np.flatnonzero(chosen == s)
        if s == ESCAPE:
            out[place[rows] + 1] = ids[at[rows]]
            continue
        word = np.full(len(rows), s << 60, np.uint64)
        for j in range(COUNT[s]):
            word |= padded[at[rows] + j] << U64(j * BITS[s])
        out[place[rows]] = word
    return out


def decode_block(words: np.ndarray, n: int) -> np.ndarray:
    """The n ids of a block's words."""
    selector = (words >> U64(60)).astype(np.uint8)
    if (selector == ESCAPE).any():
        raw = np.zeros(len(words), bool)
        i = 0
        for i in np.flatnonzero(selector == ESCAPE).tolist():  # an escaped id looks like any selector
            if not raw[i]:
                raw[i + 1] = True
        # a raw word that looks like an escape has been skipped above, as raw is set before it is met
        counts = np.where(raw, 0, _COUNTS[selector])
    else:
        raw, counts = None, _COUNTS[selector]
    start = np.cumsum(counts) - counts
    out = np.zeros(n + 60, np.uint64)
    for s in np.unique(selector if raw is None else selector[~raw]).tolist():
        rows = np.flatnonzero(selector == s if raw is None else (selector == s) & ~raw)
        if s == ESCAPE:
            out[start[rows]] = words[rows + 1]
            continue
        mask = U64((1 << BITS[s]) - 1)
        for j in range(COUNT[s]):
            out[start[rows] + j] = (words[rows] >> U64(j * BITS[s])) & mask
        # what a short last word holds beyond n is 0 and is cut off below
    return out[:n]


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, the word at which each block begins, and their number last)."""
    blocks = [encode_block(ids[i : i + BLOCK_IDS]) for i in range(0, len(ids), BLOCK_IDS)]
    offsets = np.cumsum([0, *map(len, blocks)], dtype=np.int64)
    return (np.concatenate(blocks) if blocks else np.zeros(0, np.uint64)), offsets


def decode(words: np.ndarray, offsets: np.ndarray, n: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks first to last - 1 (all by default) of n ids in all."""
    last = len(offsets) - 1 if last is None else last
    parts = [decode_block(words[offsets[b] : offsets[b + 1]], min(BLOCK_IDS, n - b * BLOCK_IDS)) for b in range(first, last)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)

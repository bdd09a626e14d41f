"""The numbers of ``draws.uniform`` for whole arrays of texts, inside tasks that make many of them."""

from __future__ import annotations

from math import sin

import numpy as np

#: MD5's constants: an addend and a rotation for each of the 64 rounds (RFC 1321).
ADDENDS = [np.uint32(int(abs(sin(i + 1)) * 2**32)) for i in range(64)]
TURNS = [np.uint32(t) for turns in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in turns * 4]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def digits(numbers: np.ndarray) -> np.ndarray:
    """Decimal digits as bytes, a row for each number; all have as many digits as the first."""
    powers = 10 ** np.arange(len(str(numbers[0])) - 1, -1, -1, dtype=np.int64)
    return (numbers[:, None] // powers % 10 + 48).astype(np.uint8)


def equal_digits(low: int, high: int) -> list[np.ndarray]:
    """The numbers from ``low`` to ``high``, one array for each number of digits."""
    edges = [low, *[10**e for e in range(1, 19) if low < 10**e <= high], high + 1]
    return [np.arange(a, b, dtype=np.int64) for a, b in zip(edges, edges[1:]) if a < b]


def padded(texts: np.ndarray) -> np.ndarray:
    """Rows of bytes of one length as MD5 pads them: a bit, zeros and the length in bits, to whole blocks of 64 bytes."""
    count, length = texts.shape
    out = np.zeros((count, (length + 8) // 64 * 64 + 64), np.uint8)
    out[:, :length], out[:, length] = texts, 0x80
    out[:, -8:] = np.frombuffer((8 * length).to_bytes(8, "little"), np.uint8)
    return out


def heads(blocks: np.ndarray) -> np.ndarray:
    """The number that the first eight hexadecimal digits of MD5 give, for each row of ``padded`` bytes."""
    state = [np.full(len(blocks), s, np.uint32) for s in START]
    for at in range(0, blocks.shape[1], 64):
        words = np.ascontiguousarray(np.ascontiguousarray(blocks[:, at : at + 64]).view("<u4").T)
        used = words.any(axis=1)
        a, b, c, d = state
        for i in range(64):
            if i < 16:
                f, g = d ^ (b & (c ^ d)), i
            elif i < 32:
                f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
            elif i < 48:
                f, g = b ^ c ^ d, (3 * i + 5) % 16
            else:
                f, g = c ^ (b | ~d), 7 * i % 16
            f += a
            f += ADDENDS[i]
            if used[g]:
                f += words[g]
            turned = f << TURNS[i]
            turned |= f >> (np.uint32(32) - TURNS[i])
            turned += b
            a, b, c, d = d, turned, b, c
        state = [x + y for x, y in zip(state, (a, b, c, d))]
    return state[0].byteswap()

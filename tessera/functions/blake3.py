"""BLAKE3 (256 bit) with the chunks of a buffer hashed side by side in numpy."""

from __future__ import annotations

import numpy as np

#: Fixed values of the published algorithm: initial words, message permutation and flags.
IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], np.uint32)
PERMUTATION = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
CHUNK, BLOCK = 1024, 64


def _rotate(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def _compress(cv: np.ndarray, words: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """New chaining values (lanes, 8) from chaining values and message words (lanes, 16)."""
    lanes = len(cv)
    s = [cv[:, i].copy() for i in range(8)] + [np.full(lanes, IV[i], np.uint32) for i in range(4)]
    s += [(counter & np.uint64(0xFFFFFFFF)).astype(np.uint32), (counter >> np.uint64(32)).astype(np.uint32), length.astype(np.uint32), flags.astype(np.uint32)]
    m = [words[:, i] for i in range(16)]
    quarter = [(0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14)]
    for _ in range(7):
        for k, (a, b, c, d) in enumerate(quarter):
            for word, r1, r2 in ((m[2 * k], 16, 12), (m[2 * k + 1], 8, 7)):
                s[a] = s[a] + s[b] + word
                s[d] = _rotate(s[d] ^ s[a], r1)
                s[c] = s[c] + s[d]
                s[b] = _rotate(s[b] ^ s[c], r2)
        m = [m[p] for p in PERMUTATION]
    return np.stack([s[i] ^ s[i + 8] for i in range(8)], axis=1)


def digest(data: bytes) -> bytes:
    n = max(1, -(-len(data) // CHUNK))
    padded = np.zeros(n * CHUNK, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    words = padded.view("<u4").reshape(n, 16, 16).astype(np.uint32)
    sizes = np.full(n, CHUNK)
    sizes[-1] = len(data) - (n - 1) * CHUNK
    cv = np.tile(IV, (n, 1))
    counter = np.arange(n, dtype=np.uint64)
    last_block = np.maximum(0, (sizes - 1) // BLOCK)
    for k in range(16):
        at = np.nonzero(k <= last_block)[0]
        if not len(at):
            break
        final = k == last_block[at]
        flags = np.where(k == 0, CHUNK_START, 0) | np.where(final, CHUNK_END, 0) | np.where(final & (n == 1), ROOT, 0)
        length = np.where(final, sizes[at] - k * BLOCK, BLOCK)
        cv[at] = _compress(cv[at], words[at, k], counter[at], length, flags)
    # Parents pair neighbours level by level; an odd one out moves up as it is.
    while len(cv) > 1:
        even = len(cv) // 2 * 2
        pairs = cv[:even].reshape(-1, 16)
        flags = np.full(len(pairs), PARENT | (ROOT if len(cv) == 2 else 0))
        up = _compress(np.tile(IV, (len(pairs), 1)), pairs, np.zeros(len(pairs), np.uint64), np.full(len(pairs), BLOCK), flags)
        cv = np.concatenate([up, cv[even:]])
    return cv[0].astype("<u4").tobytes()

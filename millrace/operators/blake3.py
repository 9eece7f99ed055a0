"""BLAKE3 (unkeyed, 32 bytes of output) after its public specification, for many messages at once in numpy.

All chunks of all messages go through a block in lockstep; then the parents of each level of all trees do.
"""

from __future__ import annotations

import numpy as np

# Initial state, message permutation and domain flags of the specification.
IV = np.array((0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19), np.uint32)
PERMUTATION = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
CHUNK, BLOCK = 1024, 64
LANES = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))


#: Bytes that are hashed together.
TOGETHER = 1 << 22


def _compress(value: np.ndarray, m: np.ndarray, counter: np.ndarray, size: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """One compression of n states (8 x n) with their blocks (16 x n)."""
    v = np.concatenate([value, np.repeat(IV[:4, None], value.shape[1], 1), [counter & 0xFFFFFFFF, counter >> 32, size, flags]]).astype(np.uint32)
    turn = lambda x, n: x >> np.uint32(n) | x << np.uint32(32 - n)
    for k in range(7):
        for i, (a, b, c, d) in enumerate(LANES):
            for word, right, left in ((m[2 * i], 16, 12), (m[2 * i + 1], 8, 7)):
                v[a] += v[b] + word
                v[d] = turn(v[d] ^ v[a], right)
                v[c] += v[d]
                v[b] = turn(v[b] ^ v[c], left)
        if k < 6:
            m = m[PERMUTATION]
    return v[:8] ^ v[8:]


def _many(messages: list[bytes]) -> list[bytes]:
    sizes = np.array([len(x) for x in messages], np.int64)
    n_chunks = np.maximum(1, -(-sizes // CHUNK))
    owner = np.repeat(np.arange(len(messages)), n_chunks)
    counter = np.arange(len(owner)) - np.repeat(np.cumsum(n_chunks) - n_chunks, n_chunks)
    filled = np.minimum(CHUNK, sizes[owner] - counter * CHUNK)
    data = np.zeros((len(owner), CHUNK), np.uint8)
    first = np.cumsum(n_chunks) - n_chunks
    for i, x in enumerate(messages):
        data[first[i] : first[i] + n_chunks[i]].reshape(-1)[: len(x)] = np.frombuffer(x, np.uint8)
    words = data.view("<u4").reshape(len(owner), CHUNK // BLOCK, 16)
    n_blocks = np.maximum(1, -(-filled // BLOCK))
    value = np.repeat(IV[:, None], len(owner), 1)
    for b in range(int(n_blocks.max(initial=0))):
        on = np.flatnonzero(n_blocks > b)
        last = n_blocks[on] == b + 1
        flags = CHUNK_START * (b == 0) + last * (CHUNK_END + ROOT * (n_chunks[owner[on]] == 1))
        value[:, on] = _compress(value[:, on], words[on, b].T.astype(np.uint32), counter[on], np.where(last, filled[on] - b * BLOCK, BLOCK), flags)
    while len(owner) > len(messages):  # a level of parents: neighbours meet, an odd last one goes up as it is
        count = np.bincount(owner, minlength=len(messages))
        place = np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
        left = np.flatnonzero((place % 2 == 0) & (place + 1 < count[owner]))
        flags = PARENT + ROOT * (count[owner[left]] == 2)
        value[:, left] = _compress(np.repeat(IV[:, None], len(left), 1), np.concatenate([value[:, left], value[:, left + 1]]), np.zeros(len(left), np.int64), np.full(len(left), BLOCK), flags)
        kept = place % 2 == 0
        value, owner = value[:, kept], owner[kept]
    return [row.tobytes() for row in np.ascontiguousarray(value.T).astype("<u4")]


def blake3_many(messages: list[bytes]) -> list[bytes]:
    out, some, amount = [], [], 0
    for x in messages:
        some.append(x)
        amount += max(len(x), CHUNK)
        if amount >= TOGETHER:
            out += _many(some)
            some, amount = [], 0
    return out + (_many(some) if some else [])


def blake3(data: bytes) -> bytes:
    return _many([data])[0]

"""Minimal perfect hashes of string sets: hash and displace.

Keys fall into buckets of about four. From the largest bucket on, each takes the first
displacement that puts its keys on free slots; buckets of one key name their slot outright. Every
key gets a slot of its own below the number of keys, and the keys are stored in the order of their
slots, so that a look-up is checked against the very key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pulseframe.llm.words import U, mix, range_hash, text_buffer

_BYTE = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
_STEP, _SPREAD = U(0x9E3779B97F4A7C15), U(0xA0761D6478BD642F)
KEYS_PER_BUCKET, TRIES = 4, 64


def hashes(keys: pa.Array, salt: int = 0) -> np.ndarray:
    raw, at = text_buffer(keys)
    base = int(mix(np.array([salt + 1], U))[0]) | 1
    return mix(range_hash(raw, at[:-1], at[1:], base, of=_BYTE))


def _slots(h: np.ndarray, displacement: np.ndarray, n: int) -> np.ndarray:
    return (mix(h + displacement.astype(U) * _STEP) % U(n)).astype(np.int64)


def _buckets(h: np.ndarray, n: int) -> np.ndarray:
    return (mix(h ^ _SPREAD) % U(-(-n // KEYS_PER_BUCKET))).astype(np.int64)


def build(keys: pa.Array) -> tuple[int, np.ndarray, pa.Array]:
    """Salt, displacements, and the distinct keys in the order of their slots."""
    n, salt = len(keys), 0
    h = hashes(keys)
    while len(np.unique(h)) < n:
        salt += 1
        h = hashes(keys, salt)
    bucket = _buckets(h, n)
    order = np.argsort(bucket, kind="stable")
    number, first, size = np.unique(bucket[order], return_index=True, return_counts=True)
    displacement = np.zeros(-(-n // KEYS_PER_BUCKET), np.int32)
    taken, slot = np.zeros(n, bool), np.empty(n, np.int64)
    for i in np.argsort(-size, kind="stable"):
        mine = order[first[i] : first[i] + size[i]]
        if size[i] == 1:
            break
        tried = 1
        while True:
            steps = np.arange(tried, tried + TRIES)
            at = np.sort(_slots(h[mine][None, :], steps[:, None], n), axis=1)
            good = ~taken[at].any(1) & (np.diff(at, axis=1) > 0).all(1)
            if good.any():
                displacement[number[i]] = step = steps[int(np.argmax(good))]
                slot[mine] = _slots(h[mine], np.array([step]), n)
                taken[slot[mine]] = True
                break
            tried += TRIES
    alone = order[first[size == 1]]
    slot[alone] = np.flatnonzero(~taken)
    displacement[bucket[alone]] = -1 - slot[alone]
    return salt, displacement, keys.take(pa.array(np.argsort(slot)))


def find(terms: pa.Array, h: np.ndarray, displacement: np.ndarray, keys: pa.Array) -> np.ndarray:
    """Slot of each term, -1 for one that is no key. ``h``: hashes of the terms with the salt."""
    n = len(keys)
    d = displacement[_buckets(h, n)].astype(np.int64)
    slot = np.where(d < 0, -1 - d, _slots(h, np.maximum(d, 0), n))
    same = np.asarray(pc.equal(keys.take(pa.array(slot)), terms))
    return np.where(same, slot, -1)

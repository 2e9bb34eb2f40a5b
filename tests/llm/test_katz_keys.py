"""Blocks and ranges ask for distinct keys that were sorted, not hashed."""

import numpy as np
import pyarrow as pa

from pulseframe.llm import blocks, katz
from pulseframe.llm.words import U, unpack

RANGES = 7


def _no_hashing(monkeypatch):
    whole = np.unique

    def unique(x, **more):
        assert more, "np.unique without an inverse or counts hashes the values"
        return whole(x, **more)

    monkeypatch.setattr(np, "unique", unique)


def test_a_block_asks_for_each_key_once(monkeypatch):
    texts = ["a b a b", "", None, "B a c", "a b"]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(5), pa.int64()), pa.array(texts), pa.array([0, 1, 0, 1, 0], pa.int32())], names=["doc_id", "text", "block"])
    token, history, _ = katz._tokens(batch)
    at = np.repeat([0, 1, 0, 1, 0], [5, 1, 1, 4, 3])
    wanted = {(kind, b): sorted(set(keys[at == b].tolist())) for kind, keys in (
        (katz.UNIGRAM, token), (katz.BIGRAM, katz.pair_key(history, token))) for b in (0, 1)}
    _no_hashing(monkeypatch)
    got = {}
    for rows in katz._asker(RANGES)([x for _ in range(2) for x in blocks._pack([batch])]):  # of two tasks, with the same texts
        for kind, part, block, keys in zip(*(rows.column(c).to_pylist() for c in ("kind", "part", "block", "keys"))):
            keys = unpack(keys)
            assert set(katz._range_of(keys, RANGES).tolist()) == {part}
            got.setdefault((kind, block), []).extend(keys.tolist())
    assert got == wanted


def test_a_range_asks_for_each_word_once(monkeypatch):
    words = katz.mix(np.arange(50, dtype=U))
    batch = pa.RecordBatch.from_arrays([pa.array([3], pa.int32()), pa.array([np.concatenate([words, words[::3]]).tobytes()], pa.binary())], names=["part", "b"])
    _no_hashing(monkeypatch)
    (rows,) = katz._word_asker(RANGES)([batch])
    assert [x for keys in rows.column("keys").to_pylist() for x in unpack(keys).tolist()] == sorted(words.tolist())
    assert katz._ascending(U([])).tolist() == []

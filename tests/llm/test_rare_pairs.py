"""Members of a large group that are too far from all others are no pair with each of them."""

import numpy as np

from pulseframe.llm import near_dedup


def test_far_members_of_a_large_group_make_few_pairs(spark):
    rng = np.random.default_rng(3)
    own = iter(range(1000, 100_000))
    core, sets = np.arange(148), []

    def edited(x, n):
        return np.sort(np.concatenate([rng.permutation(x)[n:], [next(own) for _ in range(n)]]))

    for d in range(240):
        sets.append(edited(core, 3) if d < 120 else edited(sets[-1], 3) if d % 20 == 19 else edited(core, 26))
    component = [0 if d < 120 else d for d in range(240)]
    linked = {(a, b) for a in range(240) for b in range(a) if component[a] != component[b]
              and 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}

    x = near_dedup.mix(np.concatenate(sets).astype(np.uint64))
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    places = (near_dedup.sketches(x, first) & np.uint64(0xFF)).astype(np.uint8)
    packed = [(d, bytearray(near_dedup.pack(np.sort(x[a:b])))) for d, (a, b) in enumerate(zip(first, first[1:]))]
    nodes = spark.createDataFrame([(d, len(s), component[d], d >= 120, bytearray(p.tobytes())) for d, (s, p) in enumerate(zip(sets, places))],
                                  "node long, n_shingles long, component long, minor boolean, places binary")
    keys = near_dedup.rare_shingles(spark.createDataFrame(packed, "doc_id long, shingles binary"), nodes.select("node", "n_shingles"), 80)
    signs = nodes.select("node", "places").mapInArrow(near_dedup._signs, "node long, " + ", ".join(f"sign{i} long" for i in range(4)))
    pairs = near_dedup.rare_pairs(keys.join(nodes.drop("places"), "node").join(signs, "node"), 80)
    got = {(r.a, r.b) for r in pairs.collect()}

    shared = {r.node: set(r["keys"]) for r in keys.collect()}
    meet = sum(not shared[a].isdisjoint(shared[b]) for a in shared for b in shared if a >= 120 and (b < 120 or b < a))
    assert len(linked) >= 6 and linked <= got
    assert meet > 5000 and len(got) < 240  # what a shared rare shingle alone would make, and what is left


def test_signs_of_linked_sets():
    assert near_dedup.signs_apart(100) == 0
    apart = near_dedup.signs_apart(80)
    assert 26 < apart < 64  # the mean of linked sets, and of sets of similarity 0.5

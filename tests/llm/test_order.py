"""The n-gram order of the Jaccard join and the pairs that share a prefix."""

import random

import numpy as np
import pyarrow as pa
from paramill.llm import jaccard_join
from paramill.llm.components import least_reached
from paramill.llm.jaccard_join import Sketch, pairs_of_neighbours, prefix_length, ranks, short_prefix_length

ONE = np.uint64(1 << (jaccard_join.CODE_BITS - jaccard_join.SEEN_BITS))


def summed(*tasks):
    sketches = []
    for codes in tasks:
        sketches.append(Sketch())
        for part in codes:
            sketches[-1].add(np.array(part, dtype=np.uint64) * ONE)
    rows = []
    for key, blobs in enumerate(zip(*[s.parts() for s in sketches], strict=True)):
        out = jaccard_join._sum_sketch((pa.scalar(key),), pa.table({"counts": pa.array(list(blobs), pa.binary())}))
        rows.append(np.frombuffer(jaccard_join.zlib.decompress(out.column("counts")[0].as_py()), dtype=np.uint8))
    return np.stack(rows)


def test_codes_met_once_come_first_though_a_neighbour_was_met():
    top = (1 << jaccard_join.SEEN_BITS) - 1
    sketch = summed([[0, 1, 2, 3, 8], [9, 9, top]], [[3, 40], [40] * 30, [40] * 90], [[], [top]])
    found = ranks(np.array([0, 1, 2, 8, 3, 9, top, 40], dtype=np.uint64) * ONE, sketch)
    assert found[:4].tolist() == [0] * 4 and (found[4:] > 0).all()
    assert found[7] > found[4:7].max()  # the frequent one last


def test_prefixes_join_all_that_could_link_and_no_others_by_their_ends():
    draw = random.Random(3)
    sets = []
    for _ in range(12):
        base = draw.sample(range(4000), draw.randrange(7, 90))
        for _ in range(6):
            kept = set(draw.sample(base, draw.randrange(int(0.7 * len(base)), len(base) + 1))) | set(draw.sample(range(4000), draw.randrange(4)))
            sets.append(np.array(sorted(kept), dtype=np.uint64))
    code, name, size, short = [], [], [], []
    for i, s in enumerate(sets):
        own = s[: prefix_length(len(s))]
        code.append(own)
        name.append(np.full(len(own), i))
        size.append(np.full(len(own), int(np.log2(len(s)) * jaccard_join.SIZE_STEPS)))
        short.append(np.arange(len(own)) < short_prefix_length(len(s)))
    u, v = pairs_of_neighbours(*map(np.concatenate, (code, name, size, short)))
    joined = least_reached(np.stack([u, v], axis=1), len(sets))
    linked = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            common = len(np.intersect1d(a, b))
            if 100 * common >= 75 * (len(a) + len(b) - common):
                linked += 1
                assert joined[i] == joined[j]
    assert linked > 20
    # an n-gram that only ends two prefixes joins nothing
    last = [np.array([7, 7], dtype=np.uint64), np.array([1, 2]), np.array([5000, 5000])]
    assert len(pairs_of_neighbours(*last, np.array([False, False]))[0]) == 0
    assert len(pairs_of_neighbours(*last, np.array([False, True]))[0]) == 1

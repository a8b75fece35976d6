"""Owners of codes count n-grams, also where a sketch is too crowded to tell those met once."""

import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from paramill.llm import jaccard_join
from paramill.llm.components import least_reached
from paramill.llm.shingles import set_key, shingle_codes


def edges_of(texts, owners=3):
    """Links that the owners of prefix n-grams draw, with a sketch in which every n-gram was met often."""
    full = SimpleNamespace(value=np.full((jaccard_join.SKETCH_RANGES, jaccard_join._SEEN_BYTES + jaccard_join._COUNT_BYTES), 255, dtype=np.uint8))
    third = -(-len(texts) // 3)
    rows = [pa.RecordBatch.from_arrays([pa.array(texts[a : a + third])], names=["text"]) for a in range(0, len(texts), third)]
    run, sent = jaccard_join._bundles(full, owners), []
    for task, batch in enumerate(rows):
        jaccard_join.TaskContext = SimpleNamespace(get=lambda task=task: SimpleNamespace(partitionId=lambda: task))
        sent += list(run(iter([batch])))
    for key, work in (("owner", jaccard_join._met_again), ("bundle", jaccard_join._prefixes(owners)), ("owner", jaccard_join._edges)):
        table = pa.Table.from_batches(sent)
        keys = table.column(key).to_numpy()
        sent = [b for k in np.unique(keys) for b in work((pa.scalar(int(k)),), table.filter(pa.array(keys == k))).to_batches()]
    table = pa.Table.from_batches(sent, pa.schema([("u", pa.int64()), ("v", pa.int64())]))
    return set(zip(table.column("u").to_pylist(), table.column("v").to_pylist(), strict=True))


def test_a_passage_in_all_texts_joins_no_block(monkeypatch):
    """The order used to be that of the codes where the sketch was crowded, so common passages joined all."""
    monkeypatch.setattr(jaccard_join, "TaskContext", None)
    draw = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [" ".join(f"w{draw.randrange(10**9)}" for _ in range(120)) + " " + passage for _ in range(60)]
    texts.append("new words before " + texts[7])
    names = [set_key(shingle_codes(t)) for t in texts]
    assert {frozenset(e) for e in edges_of(texts)} == {frozenset((names[7], names[60]))}


def test_all_links_lie_in_blocks(monkeypatch):
    monkeypatch.setattr(jaccard_join, "TaskContext", None)
    draw = random.Random(8)
    texts = []
    for _ in range(25):
        base = [f"w{draw.randrange(900)}" for _ in range(draw.choice([1, 3, 6, 9, 14, 40, 90]))]
        for _ in range(6):
            words = [w for w in base if draw.random() > 0.01]
            texts.append(" ".join(words + [f"w{draw.randrange(900)}" for _ in range(draw.randrange(3))]))
    sets = {set_key(c): c for t in texts if len(c := shingle_codes(t))}
    place = {k: i for i, k in enumerate(sets)}
    joined = least_reached(np.array([[place[u], place[v]] for u, v in edges_of(texts)]), len(sets))
    codes, linked = list(sets.values()), 0
    for i, a in enumerate(codes):
        for j, b in enumerate(codes[:i]):
            common = len(np.intersect1d(a, b))
            if 100 * common >= 75 * (len(a) + len(b) - common):
                linked += 1
                assert joined[i] == joined[j]
    assert linked > 20


def test_prefixes_hold_the_rarest_after_those_met_once():
    code, place, met = np.array([2, 4, 6, 2, 4], dtype=np.uint64), np.array([0, 0, 0, 1, 1]), np.array([24, 8, 16, 24, 8])
    got = jaccard_join.ordered_prefixes(np.array([12, 40]), np.array([4, 20]), code, place, met)
    # of the first set's four prefix n-grams one was met once; the second's eleven all were
    assert [x.tolist() for x in got] == [[4, 6, 2], [0, 0, 0], [True, False, False]]


def test_tiles_of_a_group_are_summed_one_after_the_other():
    """All pairs of a group's tiles used to lie in memory at once."""
    n, rows = 600, []
    blob = jaccard_join.zlib.compress(np.zeros((n, n), dtype="<u4").tobytes(), 1)
    for tile in range(20):
        names = np.arange(tile * n, (tile + 1) * n, dtype="<i8")
        rows += [{"tile": f"{tile}:0:0", "classes": names.tobytes(), "left": n, "sizes": np.full(n, 9, "<i8").tobytes(), "counts": blob}] * 2
    table = pa.Table.from_pylist(rows)
    tracemalloc.start()
    out = jaccard_join._verify((pa.scalar(0),), table)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows == 0 and most < 20e6  # a tile's pairs take 3 MB

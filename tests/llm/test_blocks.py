"""Blocks of token ids: rounds look at fewer and fewer places, and rules are expanded level by level."""

import numpy as np
import pytest
from paramill.llm import chunk_ids, token_files

V = token_files.VOCABULARY


def documents(n, of, seed=1):
    random = np.random.default_rng(seed)
    return [random.integers(0, of, n).astype("<u4").tobytes() for _ in range(9)]


@pytest.mark.parametrize(("n", "of"), [(1, 1), (2, 1), (40, 1), (900, 2), (30_000, 3), (9_000, 60), (4_000, V)])
def test_blocks_give_their_documents(n, of):
    docs = documents(n, of)
    block = token_files.Block(token_files.Block.pack(list(range(9)), docs))
    assert [block.document(i).tobytes() for i in range(9)] == docs
    ids = token_files.expand(block.symbols, token_files.expansions(block.rules))
    assert ids.tobytes() == b"".join(docs)


def test_no_frequent_pair_is_left():
    docs = documents(20_000, 12)
    block = token_files.Block(token_files.Block.pack(list(range(9)), docs))
    assert V + len(block.rules) < 1 << 16
    cuts = block.symbol_starts.astype(int).tolist()
    left = {}
    for a, b in zip(cuts, cuts[1:], strict=False):
        for pair in zip(block.symbols[a : b - 1].tolist(), block.symbols[a + 1 : b].tolist(), strict=True):
            left[pair] = left.get(pair, 0) + 1
    assert max(left.values()) < token_files.LEAST


def test_later_rounds_look_at_places_that_may_be_frequent(monkeypatch):
    """Every round used to count the pairs at all places."""
    seen, frequent = [], token_files._frequent

    def counted(symbols, live):
        seen.append((len(symbols), len(live)))
        return frequent(symbols, live)

    monkeypatch.setattr(token_files, "_frequent", counted)
    often, rare = np.tile(np.arange(40, dtype="<u4"), 400), np.random.default_rng(3).integers(100, V, 30_000).astype("<u4")
    token_files.Block.pack([0, 1], [often.tobytes(), rare.tobytes()])
    assert len(seen) > 3 and seen[-1][0] > 30_000 and seen[-1][1] < 3_000


def test_rules_by_levels():
    rules = np.array([[5, 6], [V, V], [V + 1, 7], [8, V + 2], [9, 9]], dtype="<u2")
    assert token_files.rule_lengths(rules).tolist() == [2, 4, 5, 6, 2]
    table = token_files.expansions(rules)
    assert token_files.expand(np.array([V + 3, 1, V + 4], dtype="<u2"), table).tolist() == [8, 5, 6, 5, 6, 7, 1, 9, 9]
    with pytest.raises(ValueError):
        token_files.rule_lengths(np.array([[V, 1]], dtype="<u2"))


def test_a_worker_forgets_what_it_remembered_for_another_step():
    memory = chunk_ids._Memory(len)
    chunk_ids.begin("packing")
    assert memory["word"] == 4
    chunk_ids.begin("packing")
    assert memory == {"word": 4}
    chunk_ids.begin("near copies")
    assert memory == {}


def test_pieces_as_the_library_has_them():
    ids = chunk_ids.chunk_ids()
    for chunk in ("word", "Word's", "x1y", "naïve", "a_b", "__", "½x", "\x01", "~a", "été,", "'s", "1", "ÀÉ"):
        assert ids.packed([chunk])[0] == np.array(ids.tokenizer.encode(chunk, add_special_tokens=False).ids, dtype="<u4").tobytes()

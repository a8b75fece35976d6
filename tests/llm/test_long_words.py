"""Words of any length are summed over all their segmentations, across slices."""

import math
import random

import numpy as np
import pytest
from paramill.llm import language


@pytest.fixture(scope="module")
def pieces():
    return language.Pieces()


@pytest.fixture(params=[language.SLICE, 7])
def slices(request, monkeypatch):
    monkeypatch.setattr(language, "SLICE", request.param)


def probabilities(pieces, languages):
    drawn = np.random.default_rng(4).random((pieces.size + 1, languages)) + 0.01
    return drawn / drawn.sum(axis=0)


def brute(pieces, word, p):
    """Log probability of a word by one sum per end, in plain Python."""
    word, sums = "▁" + word, [0.0]
    for end in range(1, len(word) + 1):
        terms = []
        for begin in range(end):
            piece = pieces.ids.get(word[begin:end], pieces.size if begin == end - 1 else None)
            if piece is not None:
                terms.append(sums[begin] + math.log(p[piece]))
        top = max(terms)
        sums.append(top + math.log(sum(math.exp(t - top) for t in terms)))
    return sums[-1]


def words():
    draw = random.Random(2)
    drawn = ["".join(draw.choice("abdeinorstꙮü") for _ in range(n)) for n in (1, 5, 31, 32, 33, 34, 40, 40, 90, 300)]
    return [*drawn, "o" * 700, "internationalisation" * 5, "日本語" * 30, "a"]


def test_logs_of_all_lengths(pieces, slices):
    p = probabilities(pieces, 3)
    got = pieces.logs(words(), p)
    for word, row in zip(words(), got, strict=True):
        np.testing.assert_allclose(row, [brute(pieces, word, p[:, i]) for i in range(3)], rtol=1e-10)


def test_nothing_is_cut_and_nothing_underflows(pieces):
    text = "ꙮ" * 5000
    assert language.words_of(f"x {text}1y") == ["x", text, "y"]
    p = np.full((pieces.size + 1, 2), 1e-8)
    p[:, 1] = 1e-7
    got = pieces.logs([text], p)[0]
    assert np.isfinite(got).all() and got[0] < got[1]


def test_expected_uses_agree(pieces, slices):
    p = probabilities(pieces, 1)[:, 0]
    short = [w for w in words() if len(w) <= language.SHORT]
    times = np.arange(1, len(short) + 1)
    np.testing.assert_allclose(pieces.long_expected(short, times, np.log(p)), pieces.short_expected(short, times, p), rtol=1e-9, atol=1e-12)
    # the pieces that are used cover all letters
    times = np.arange(1, len(words()) + 1)
    uses = pieces.expected(words(), times, p)
    lengths = np.ones(pieces.size + 1)
    for piece, i in pieces.ids.items():
        lengths[i] = len(piece)
    assert (uses * lengths).sum() == pytest.approx(sum(n * (len(w) + 1) for n, w in zip(times, words(), strict=True)))


def test_a_word_as_long_as_a_document(spark, monkeypatch):
    monkeypatch.setattr(language, "LETTERS_REMEMBERED", 100)
    texts = ["the house and the garden " * 20, "das haus und der garten " * 20]
    rows = [(i, texts[i % 2], ["en", "de"][i % 2]) for i in range(40)]
    rows += [(100, "theandthehouse" * 3000, None), (101, "dasunddashaus" * 3000, None)]
    got = {r.doc_id: r.lang_pred for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[100] == "en" and got[101] == "de" and all(got[i] == ["en", "de"][i % 2] for i in range(40))

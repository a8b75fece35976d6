"""The network against plain loops over bytes, its gradients against differences, repeated labels."""

import math

import numpy as np
import pytest
from paramill.llm import quality
from paramill.llm.quality import CHUNK, EMBEDDING, FILTERS, STRIDE, WIDTH


def by_loops(network, text):
    """Score of a text: every filter at every second byte, the largest answer of each chunk, their largest and mean."""
    w = network.weights
    data = list(text.encode())
    chunks = max(1, -(-len(data) // CHUNK))
    data += [0] * (chunks * CHUNK + WIDTH - STRIDE - len(data))
    pooled = []
    for c in range(chunks):
        best = [0.0] * FILTERS
        for at in range(c * CHUNK, (c + 1) * CHUNK, STRIDE):
            for f in range(FILTERS):
                answer = float(w["bias"][f])
                for i in range(WIDTH):
                    for e in range(EMBEDDING):
                        answer += float(w["embedding"][data[at + i]][e]) * float(w["filters"][i * EMBEDDING + e][f])
                best[f] = max(best[f], answer)
        pooled.append(best)
    total = float(w["offset"][0])
    for f in range(FILTERS):
        column = [best[f] for best in pooled]
        total += max(column) * float(w["output"][f]) + sum(column) / chunks * float(w["output"][FILTERS + f])
    return 1 / (1 + math.exp(-total))


def test_scores_equal_plain_loops():
    network = quality.Network(seed=3)
    texts = ["", "a", "Ünïcode and the like, " * 3, "x" * CHUNK + "the end", "one two three four " * 70]
    assert network.scores(texts) == pytest.approx([by_loops(network, t) for t in texts], abs=1e-5)


@pytest.mark.parametrize("section", [2, 128])
def test_gradients_equal_differences(monkeypatch, section):
    monkeypatch.setattr(quality, "SECTION", section)
    network = quality.Network(seed=3)
    network.weights = {k: v.astype(np.float64) for k, v in network.weights.items()}
    rng = np.random.default_rng(1)
    chunks = [quality.chunks_of(bytes(rng.integers(32, 122, n).tolist())) for n in (40, 600, 2500)]
    labels = np.array([1.0, 0.0, 1.0])

    def loss():
        total = 0.0
        for c, y in zip(chunks, labels, strict=True):
            pooled = network.pooled(c)
            z = network.logit(pooled.max(axis=0), pooled.mean(axis=0))
            total += np.log1p(np.exp(-z)) + (1 - y) * z
        return total / len(labels)

    for name, gradient in network.gradients(chunks, labels).items():
        weights = network.weights[name].reshape(-1)
        for i in rng.choice(weights.size, min(12, weights.size), replace=False):
            kept, step = weights[i], 1e-6
            weights[i] = kept + step
            above = loss()
            weights[i] = kept - step
            below = loss()
            weights[i] = kept
            assert gradient.reshape(-1)[i] == pytest.approx((above - below) / (2 * step), abs=1e-6), name


def test_fitting_reads_whole_texts():
    """What tells the labels apart stands in one place of a long text."""
    filler = "plain words go on and on and say nothing at all, "
    texts = [filler * 40 * (i % 5 + 1) + ("QQZZ!!QQ" if i % 2 else "") + filler * (300 - 40 * (i % 5 + 1)) for i in range(40)]
    network = quality.Network().fit([t.encode() for t in texts], [i % 2 for i in range(40)])
    scores = network.scores(texts)
    assert min(scores[1::2]) > max(scores[0::2])


def test_repeated_labels_and_documents(spark):
    docs = [(i, "good clean text " * 20 if i % 2 else "@@@ ### !!! " * 20) for i in range(200)] + [(1, None), (None, "x")]
    labels = [(i, i % 2) for i in range(200)] + [(1, 1)] * 3000 + [(2, 1)] + [(4, None), (6, 7), (None, 1)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == 202
    assert all(r.predicted == r.doc_id % 2 for r in rows if r.doc_id is not None and r.doc_id > 1)

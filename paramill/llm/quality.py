"""Quality classifier: a convolutional network over bytes, in numpy.

Learned filters look at eight bytes at a time, every two bytes, over chunks that overlap so that
every window of the document is seen. Each filter's largest response in a chunk, then its largest
and its mean over all chunks, make one probability in a logistic output. The network is fitted by
Adam on a bounded sample of labelled documents and applied to whole texts in the tasks, a section
of chunks at a time.

Fitting uses at most ``PER_LABEL`` documents of each label (about; drawn by a hash of doc_id, from
rows outside the held-out fold), each with its whole text; the output's offset then restores the
labels' true shares. Scoring reads every byte.

Defined cases: a null text counts as empty, an empty text is one chunk of padding and gets a score;
labels other than 0 and 1, and null ones, are not learnt from; a document labelled more than once
has its most frequent label and is not learnt from if both are as frequent; of rows that share a
doc_id the text that is smallest in byte order is learnt from. With one label only, its value is
every score, and with none 0.5. Repeated rows are scored each. Further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paramill.llm.common import arrow_map, held_out

PER_LABEL = 1200
FOLDS, HELD_OUT = 4, 2
ACCEPTED = 0.7
#: Window and step of the filters, chunk step in bytes, embedding width, filters.
WIDTH, STRIDE, CHUNK, EMBEDDING, FILTERS = 8, 2, 512, 6, 24
EPOCHS, BATCH, RATE, SEED = 8, 32, 0.01, 11
#: Chunks that are convolved at a time.
SECTION = 128


def chunks_of(data: bytes) -> np.ndarray:
    """Chunks (n, CHUNK + WIDTH - STRIDE) of byte values; zeros behind the end."""
    n = max(1, -(-len(data) // CHUNK))
    padded = np.zeros(n * CHUNK + WIDTH - STRIDE, dtype=np.uint8)
    padded[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK + WIDTH - STRIDE)[::CHUNK]


class Network:
    def __init__(self, seed: int = SEED):
        random = np.random.default_rng(seed)
        draw = lambda *shape, scale: (random.normal(size=shape) * scale).astype(np.float32)
        self.weights = {
            "embedding": draw(256, EMBEDDING, scale=0.5),
            "filters": draw(WIDTH * EMBEDDING, FILTERS, scale=1 / math.sqrt(WIDTH * EMBEDDING)),
            "bias": np.zeros(FILTERS, dtype=np.float32),
            "output": draw(2 * FILTERS, scale=0.3),
            "offset": np.zeros(1, dtype=np.float32),
        }
        self.constant: float | None = None

    def pooled(self, chunks: np.ndarray, places: bool = False):
        """Largest response of each filter in each chunk (n, FILTERS), and its window if asked."""
        w = self.weights
        embedded = w["embedding"][chunks]
        windows = np.lib.stride_tricks.sliding_window_view(embedded.reshape(len(chunks), -1), WIDTH * EMBEDDING, axis=1)
        windows = windows[:, :: STRIDE * EMBEDDING]
        answers = (np.ascontiguousarray(windows).reshape(-1, WIDTH * EMBEDDING) @ w["filters"]).reshape(len(chunks), -1, FILTERS)
        best = np.maximum(answers.max(axis=1) + w["bias"], 0)
        return (best, answers.argmax(axis=1)) if places else best

    def logit(self, largest: np.ndarray, mean: np.ndarray) -> np.ndarray:
        return np.concatenate([largest, mean], axis=-1) @ self.weights["output"] + self.weights["offset"][0]

    def gradients(self, chunks: list[np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over a batch of documents."""
        w = self.weights
        flat = np.concatenate(chunks)
        starts = np.cumsum([0] + [len(c) for c in chunks])
        sections = [slice(at, at + SECTION) for at in range(0, len(flat), SECTION)]
        pooled, places = (np.concatenate(part) for part in zip(*(self.pooled(flat[s], places=True) for s in sections), strict=True))
        spans = list(zip(starts[:-1], starts[1:], strict=True))
        winners = np.stack([a + pooled[a:b].argmax(axis=0) for a, b in spans])
        features = np.stack([np.concatenate([pooled[a:b].max(axis=0), pooled[a:b].mean(axis=0)]) for a, b in spans])
        error = (1 / (1 + np.exp(-(features @ w["output"] + w["offset"][0]))) - labels) / len(labels)
        back = error[:, None] * w["output"]
        to_pooled = np.zeros_like(pooled)
        for i, (a, b) in enumerate(spans):
            to_pooled[a:b] += back[i, FILTERS:] / (b - a)
            to_pooled[winners[i], np.arange(FILTERS)] += back[i, :FILTERS]
        to_pooled[pooled <= 0] = 0
        to_embedding, to_filters = np.zeros_like(w["embedding"]), np.zeros_like(w["filters"])
        for s in sections:
            part = flat[s]
            at = places[s][:, :, None] * STRIDE + np.arange(WIDTH)
            seen = part[np.arange(len(part))[:, None, None], at]  # bytes in each filter's best window
            windows = w["embedding"][seen].reshape(len(part), FILTERS, -1)
            np.add.at(to_embedding, seen.ravel(), (to_pooled[s][:, :, None] * w["filters"].T).reshape(-1, EMBEDDING))
            to_filters += np.einsum("cf,cfw->wf", to_pooled[s], windows)
        return {
            "embedding": to_embedding,
            "filters": to_filters,
            "bias": to_pooled.sum(axis=0),
            "output": features.T @ error,
            "offset": np.array([error.sum()]),
        }

    def fit(self, documents: list[bytes], labels: list[int], shares: tuple[float, float] = (1.0, 1.0)) -> Network:
        """``shares``: which part of all documents with label 0 and 1 the sample holds."""
        if len(set(labels)) < 2:
            self.constant = float(labels[0]) if labels else 0.5
            return self
        random = np.random.default_rng(SEED)
        cut = [chunks_of(d) for d in documents]
        wanted = np.array(labels, dtype=np.float32)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step, steps = 0, EPOCHS * -(-len(cut) // BATCH)
        for _ in range(EPOCHS):
            order = random.permutation(len(cut))
            for at in range(0, len(cut), BATCH):
                some = order[at : at + BATCH]
                step += 1
                rate = RATE * (1 - step / (steps + 1))
                for k, g in self.gradients([cut[i] for i in some], wanted[some]).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
                    self.weights[k] = (self.weights[k] - rate * move).astype(np.float32)
        self.weights["offset"] = self.weights["offset"] + np.float32(math.log(shares[0] / shares[1]))
        return self

    def scores(self, texts: list[str | None]) -> list[float]:
        if self.constant is not None:
            return [self.constant] * len(texts)
        logits = np.zeros(len(texts))
        waiting: list[tuple[int, np.ndarray]] = []
        size = 0

        def settle():
            pooled = self.pooled(np.concatenate([c for _, c in waiting]))
            at = 0
            for i, c in waiting:
                own = pooled[at : at + len(c)]
                logits[i] = self.logit(own.max(axis=0), own.mean(axis=0))
                at += len(c)

        for i, text in enumerate(texts):
            chunks = chunks_of((text or "").encode())
            if len(chunks) > SECTION:
                largest, total = np.zeros(FILTERS, dtype=np.float32), np.zeros(FILTERS)
                for first in range(0, len(chunks), SECTION):
                    own = self.pooled(chunks[first : first + SECTION])
                    largest = np.maximum(largest, own.max(axis=0))
                    total += own.sum(axis=0)
                logits[i] = self.logit(largest, total / len(chunks))
                continue
            waiting.append((i, chunks))
            size += len(chunks)
            if size >= SECTION:
                settle()
                waiting, size = [], 0
        if waiting:
            settle()
        return (1 / (1 + np.exp(-np.clip(logits, -60, 60)))).tolist()


def learn(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Network:
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    named = named.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(FOLDS, HELD_OUT))
    # one label per document, so that what is drawn below is bounded by per_label
    named = named.groupBy("doc_id").agg(F.avg("quality").alias("share")).filter("share <> 0.5")
    named = named.select("doc_id", (F.col("share") > 0.5).cast("int").alias("quality"))
    counts = {r["quality"]: r["count"] for r in named.groupBy("quality").count().collect()}
    share = {q: min(1.0, per_label / max(1, counts.get(q, 0))) for q in (0, 1)}
    limit = F.when(F.col("quality") == 0, share[0]).otherwise(share[1]) * (1 << 20)
    drawn = named.filter(F.pmod(F.xxhash64(F.lit("drawn"), "doc_id"), F.lit(1 << 20)) < limit)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = sample.select("doc_id", "quality", F.col("text").cast("binary").alias("data")).orderBy("doc_id").collect()
    return Network().fit([bytes(r["data"]) for r in rows], [r["quality"] for r in rows], (share[0], share[1]))


def score(docs: DataFrame, network: Network) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""

    def run(batches):
        for batch in batches:
            scores = network.scores(batch.column(2).to_pylist())
            predicted = pa.array([int(s >= ACCEPTED) for s in scores], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), predicted], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(FOLDS, HELD_OUT).alias("held_out"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, learn(docs, labels))

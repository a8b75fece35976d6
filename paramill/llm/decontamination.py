"""Passages of test items in documents, by a generalised suffix automaton.

The items' words are cut into overlapping segments and dealt into shards of a bounded number of
words. Each shard is one automaton over all its segments, and documents stream past it: every word
moves the state and the length of the longest match that ends there. A match as long as the window
names a state that stands for exactly one window, which knows the items it occurs in; items shorter
than the window are found as accepting states on the suffix links. A word is hit if a window's
occurrence covers it. With several shards the documents pass them one after the other and carry
their hits along, so no document is ever gathered and memory holds one automaton at a time.

Defined cases: null text has no words; an item without words has no window; a null item_id counts as
the empty string; rows that repeat an item_id are one item with the windows of all; repeated
documents are documents of their own. Without items nothing is hit. Further columns are ignored by
:func:`contamination` and pass unchanged through :func:`decontaminated`.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paramill.llm.common import arrow_map, whole_text, written

WINDOW = 10
#: Words of the items that one automaton holds (in expectation), and that one segment holds at most.
SHARD_WORDS, SEGMENT_WORDS = 100_000, 10_000
#: Everything below 0x80 but digits and letters parts words; A-Z become a-z.
_TABLE = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())
_WORDS = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
SCANNED = "doc_id long, text string, marks binary, items array<string>"
DIGEST = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Automaton:
    """The suffix automaton of many word sequences, for windows of a fixed number of words."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        sequences = [(item, [self.ids.setdefault(w, len(self.ids)) for w in words]) for item, words in items]
        ends = []
        for item, sequence in sequences:
            state = 0
            for c in sequence:
                state = self._extended(state, c)
            ends.append((item, state, len(sequence)))
        self._name(sequences, ends)

    def _extended(self, last: int, c: int) -> int:
        """The state of the sequence read so far and ``c``, adding what lacks."""
        next_, link, length = self.next, self.link, self.length
        if c in next_[last]:
            q = next_[last][c]
            return q if length[q] == length[last] + 1 else self._copied(last, c, q)
        new = len(next_)
        next_.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in next_[p]:
            next_[p][c] = new
            p = link[p]
        if p >= 0:
            q = next_[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._copied(p, c, q)
        return new

    def _copied(self, p: int, c: int, q: int) -> int:
        """Part the shorter strings of ``q`` off into a state of their own."""
        next_, link, length = self.next, self.link, self.length
        copy = len(next_)
        next_.append(dict(next_[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and next_[p].get(c) == q:
            next_[p][c] = copy
            p = link[p]
        return copy

    def _name(self, sequences: list, ends: list) -> None:
        """Which state stands for the window that ends in a state, the items of windows, and the
        nearest state on the suffix links (or the state itself) that ends a short item."""
        n, w = len(self.next), self.window
        order = sorted(range(1, n), key=self.length.__getitem__)
        self.anchor, self.short = [0] * n, [0] * n
        self.items: dict[int, set[str]] = {}
        for item, state, size in ends:
            if 0 < size < w:
                self.items.setdefault(state, set()).add(item)
        for v in order:
            up = self.link[v]
            if self.length[v] >= w:
                self.anchor[v] = v if self.length[up] < w else self.anchor[up]
            self.short[v] = v if v in self.items and self.length[v] < w else self.short[up]
        for item, sequence in sequences:
            v = 0
            for at, c in enumerate(sequence):
                v = self.next[v][c]
                if at + 1 >= w:
                    self.items.setdefault(self.anchor[v], set()).add(item)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(hit spans of words, in order of their ends; items with an occurring window)."""
        next_, link, length, short, window = self.next, self.link, self.length, self.short, self.window
        state = matched = 0
        spans: list[tuple[int, int]] = []
        states: set[int] = set()
        for at, c in enumerate(map(self.ids.get, words)):
            if c is None:
                state = matched = 0
                continue
            to = next_[state].get(c)
            if to is None:
                while state and to is None:
                    state = link[state]
                    to = next_[state].get(c)
                matched = length[state]
            if to is None:
                matched = 0
                continue
            state = to
            matched += 1
            if matched >= window:
                spans.append((at + 1 - window, at + 1))
                states.add(self.anchor[state])
            s = short[state]
            if s:
                if s == state and matched < length[s]:
                    s = short[link[s]]
                while s:
                    spans.append((at + 1 - length[s], at + 1))
                    states.add(s)
                    s = short[link[s]]
        found: set[str] = set()
        for s in states:
            found |= self.items[s]
        return spans, found


_built: dict[tuple, Automaton] = {}


def _automaton(shard: list[tuple[str, bytes]], key: tuple, window: int) -> Automaton:
    """One per Python worker, kept between its tasks."""
    if key not in _built:
        _built.clear()
        _built[key] = Automaton([(item, words.split()) for item, words in shard], window)
    return _built[key]


def _marked(marks: bytes | None, spans: list[tuple[int, int]], size: int) -> bytes | None:
    """One byte per word, 1 where hit; None where nothing is."""
    if not spans:
        return marks
    out = bytearray(marks or bytes(size))
    for start, end in spans:
        out[start:end] = b"\x01" * (end - start)
    return bytes(out)


def _pass(shard, key: tuple, window: int, finish):
    """Stream rows (doc_id, text, marks, items) past one automaton."""

    def run(batches):
        automaton = _automaton(shard.value, key, window)
        for batch in batches:
            texts, marks, items = (batch.column(i).to_pylist() for i in (1, 2, 3))
            sizes = []
            for i, text in enumerate(texts):
                words = words_of(text)
                spans, found = automaton.scan(words)
                sizes.append(len(words))
                marks[i] = _marked(marks[i], spans, len(words))
                if found:
                    items[i] = sorted(found.union(items[i] or ()))
            yield finish(batch, sizes, marks, items)

    return run


def _carried(batch, sizes, marks, items) -> pa.RecordBatch:
    columns = [batch.column(0), batch.column(1), pa.array(marks, pa.binary()), pa.array(items, pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "marks", "items"])


def _digest(batch, sizes, marks, items) -> pa.RecordBatch:
    hit = [m.count(1) if m else 0 for m in marks]
    items = [i or [] for i in items]
    columns = [
        batch.column(0),
        pa.array(sizes, pa.int64()),
        pa.array(hit, pa.int64()),
        pa.array([len(i) for i in items], pa.int64()),
        pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in items], pa.string()),
        pa.array([h > 0 for h in hit], pa.bool_()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in DIGEST.split(", ")])


def segments(benchmark: DataFrame, window: int = WINDOW, size: int = SEGMENT_WORDS) -> DataFrame:
    """item_id, words (parted by spaces), n: the items in segments that share window - 1 words with
    the one before, so that every window lies in one of them. Written once."""

    def run(batches):
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                for first in range(0, max(len(words) - window + 1, 1 if words else 0), size):
                    own = words[first : first + size + window - 1]
                    rows.append((item, b" ".join(own), len(own)))
            if rows:
                kinds = (pa.string(), pa.binary(), pa.int64())
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["item_id", "words", "n"])

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), whole_text().alias("text"))
    return written(arrow_map(items, run, "item_id string, words binary, n long").distinct(), "benchmark-segments")


def _shards(benchmark: DataFrame, window: int, shard_words: int):
    """The segments of one shard after the other; what reaches the driver at once is bounded."""
    rows = segments(benchmark, window, min(SEGMENT_WORDS, max(window, shard_words)))
    total = rows.agg(F.sum("n").alias("n")).first()["n"] or 0
    shards = -(-total // shard_words) or 1
    for shard in range(shards):
        own = rows.filter(F.pmod(F.xxhash64("words"), F.lit(shards)) == shard) if shards > 1 else rows
        yield shard == shards - 1, [(r["item_id"], bytes(r["words"])) for r in own.select("item_id", "words").collect()]


def _scanned(rows: DataFrame, benchmark: DataFrame, window: int, shard_words: int, finish, schema: str) -> DataFrame:
    """``rows`` (doc_id, text, marks, items) after all shards; the last pass ends with ``finish``."""
    context = rows.sparkSession.sparkContext
    for last, shard in _shards(benchmark, window, shard_words):
        key = (window, hashlib.sha256(repr(sorted(shard)).encode()).hexdigest())
        shared = context.broadcast(shard)
        if last:
            return arrow_map(rows, _pass(shared, key, window, finish), schema)
        rows = written(arrow_map(rows, _pass(shared, key, window, _carried), SCANNED), "scanned")
    raise AssertionError("there is always a last shard")


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.lit(None).cast("binary").alias("marks"),
        F.lit(None).cast("array<string>").alias("items"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return _scanned(_plain(docs), benchmark, window, shard_words, _digest, DIGEST)


def without_spans(text: str, marks: bytes) -> str:
    """The text without its marked words, each cut with what parts it from the word before."""
    data = text.encode("utf-8", "surrogatepass")
    kept, at = [], 0
    for word, marked in zip(_WORDS.finditer(data), marks, strict=True):
        if not marked:
            kept.append(data[at : word.end()])
        at = word.end()
    kept.append(data[at:])
    return b"".join(kept).decode("utf-8", "surrogatepass")


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """``docs`` without the hit spans; documents with more than ``max_coverage`` of their words hit go.

    The columns of ``docs`` pass unchanged but for ``text``.
    """
    whole = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    rows = whole.select(
        "row", "text", F.lit(None).cast("binary").alias("marks"), F.lit(None).cast("array<string>").alias("items")
    )
    names = ["row", "text", "marks", "items"]

    def carried(batch, sizes, marks, items):
        columns = [batch.column(0), batch.column(1), pa.array(marks, pa.binary()), pa.array(items, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def cleaned(batch, sizes, marks, items):
        texts = batch.column(1).to_pylist()
        stays = [not m or m.count(1) <= max_coverage * n for m, n in zip(marks, sizes, strict=True)]
        done = [without_spans(t, m) if m and s else t for t, m, s in zip(texts, marks, stays, strict=True)]
        whole = pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.string())], names=["row", "text"])
        return whole.filter(pa.array(stays, pa.bool_()))

    out = T.StructType([T.StructField("row", docs.schema), T.StructField("text", T.StringType())])
    carrying = T.StructType([*out.fields, T.StructField("marks", T.BinaryType()), T.StructField("items", T.ArrayType(T.StringType()))])
    for last, shard in _shards(benchmark, window, shard_words):
        key = (window, hashlib.sha256(repr(sorted(shard)).encode()).hexdigest())
        shared = rows.sparkSession.sparkContext.broadcast(shard)
        if not last:
            rows = written(arrow_map(rows, _pass(shared, key, window, carried), carrying), "scanned")
            continue
        done = arrow_map(rows, _pass(shared, key, window, cleaned), out)
        return done.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
    raise AssertionError("there is always a last shard")


ORACLE = r"""
WITH item_words AS (
  SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
  FROM item_words, range(1, 1000000) t(i) WHERE len(w) > 0 AND i <= greatest(len(w) - 9, 1)),
doc_words AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
places AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM doc_words),
found AS MATERIALIZED (
  SELECT r, i, k, item_id FROM (
    SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS gram
    FROM places, (SELECT DISTINCT k FROM windows) WHERE i + k - 1 <= len(w)) JOIN windows USING (k, gram)),
hits AS (SELECT r, count(DISTINCT word) AS n FROM (SELECT r, unnest(range(i, i + k)) AS word FROM (SELECT DISTINCT r, i, k FROM found)) GROUP BY r),
items AS (
  SELECT r, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(m.n, 0)::BIGINT AS n_items,
       sha256(coalesce(m.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hits h USING (r) LEFT JOIN items m USING (r)
"""

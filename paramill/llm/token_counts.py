"""Exact token counts by dynamic programming over prefixes.

Byte-pair encoding has a local test: two neighbouring tokens can stand next to each other
exactly if no merge over their boundary would have come before the merges inside them. So the
encoding of every prefix of a piece follows from shorter prefixes: it ends in the one vocabulary
entry that is compatible with the last token of the prefix before it. The table of all prefixes
costs little more than the encoding of the whole, and answers how many tokens a truncated text
has, or how much text fits a budget, without encoding again.

Texts are split by the tokenizer's published pattern. A split always falls before a space that a
character other than white space follows, so counts of the chunks between such spaces add up;
each task remembers the counts of chunks it has met (bounded, then started anew).

Defined cases: null text counts as empty (0 bytes, 0 tokens, not over the limit); the string of
a special token inside a text is that one token, as the library has it by default; repeated rows
are counted each. Further columns are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paramill.llm.chunk_ids import REMEMBERED, _Memory, letter_of_byte
from paramill.llm.common import arrow_map

NEVER = 1 << 30
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


class PrefixCounter:
    def __init__(self, name: str = "byte_bpe_50k.json"):
        import ahocorasick
        import public_tokenizers
        import regex

        with open(public_tokenizers.path(name), encoding="utf-8") as f:
            spec = json.load(f)
        letters = {c: b for b, c in letter_of_byte().items()}
        raw = {token: bytes(letters[c] for c in token) for token in spec["model"]["vocab"]}
        ids = spec["model"]["vocab"]
        self.vocabulary = {raw[token]: i for token, i in ids.items()}
        self.longest = max(map(len, self.vocabulary))
        self.ending = ahocorasick.Automaton()
        for token, i in self.vocabulary.items():
            self.ending.add_word(token.decode("latin-1"), (len(token), i))
        self.ending.make_automaton()
        self.merge_rank: dict[tuple[int, int], int] = {}
        halves: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merge_rank[ids[left], ids[right]] = rank
            halves[ids[left + right]] = (ids[left], ids[right])
        self.halves = halves
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, self.specials)) or r"(?!)")
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.odd_space = regex.compile(r" \s| $")
        self.before_word = regex.compile(r"(?V1)(?= \S)")
        self.compatible: dict[int, bool] = {}
        self.edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.pieces = _Memory(lambda piece: self.last(piece.encode())[1])
        self.tables = _Memory(self._table)
        self.first = _Memory(self._chunk)
        self.spaced = _Memory(lambda chunk: self._chunk(" " + chunk))

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The parts of a token that touch its boundary (side 0: left, 1: right), each with the
        rank of the merge that swallows it."""
        found = self.edges.get((token, side))
        if found is None:
            found, part, until = [], token, NEVER
            while True:
                found.append((part, until))
                if part not in self.halves:
                    break
                until = self.merge_rank[self.halves[part]]
                part = self.halves[part][side]
            self.edges[token, side] = found
        return found

    def _fits(self, left: int, right: int) -> bool:
        """No merge over the boundary comes first; of equal ranks the one further left does."""
        code = left << 17 | right
        known = self.compatible.get(code)
        if known is None:
            rank_of = self.merge_rank.get
            known = not any(
                (rank := rank_of((a, b))) is not None and rank < until_a and rank <= until_b
                for a, until_a in self._edge(left, 1)
                for b, until_b in self._edge(right, 0)
            )
            if len(self.compatible) > 4 * REMEMBERED:
                self.compatible.clear()
            self.compatible[code] = known
        return known

    def piece(self, word: bytes) -> list[int]:
        """Token counts of all prefixes of one piece of the pattern, from 0 bytes to all.

        The automaton names, at every byte, the tokens that end there, the longest first; the first
        one that fits behind the tokens of the prefix before it is the last token of this prefix.
        """
        counts, last, done = [0] * (len(word) + 1), [-1] * (len(word) + 1), 0
        fits, known = self._fits, self.compatible.get
        for at, (size, token) in self.ending.iter(word.decode("latin-1")):
            if at < done:
                continue
            begin = at + 1 - size
            before = last[begin]
            if before >= 0:
                fit = known(before << 17 | token)
                if not (fits(before, token) if fit is None else fit):
                    continue
            done = at + 1
            counts[done], last[done] = counts[begin] + 1, token
        return counts

    def _table(self, piece: str) -> bytes:
        """Token counts of a piece's prefixes from 1 byte on, each prefix as a text of its own; four
        bytes per count."""
        counts = self.piece(piece.encode())[1:]
        if piece in CONTRACTIONS:
            for n in range(1, len(counts)):
                counts[n - 1] = self._chunk(piece[:n])
        return struct.pack(f"={len(counts)}i", *counts)

    def last(self, word: bytes) -> tuple[int, int]:
        """Last token and number of tokens of one piece: the entry of the table for the whole
        piece, with only those entries for shorter prefixes that it rests on."""
        if len(word) > self.longest:
            return -1, self.piece(word)[-1]
        find, fits, compatible = self.vocabulary.get, self._fits, self.compatible
        table = {0: (-1, 0)}

        def entry(end: int) -> tuple[int, int]:
            found = table.get(end)
            if found is None:
                for begin in range(end):
                    token = find(word[begin:end])
                    if token is None:
                        continue
                    before, n = entry(begin)
                    if before >= 0:
                        fit = compatible.get(before << 17 | token)
                        if not (fits(before, token) if fit is None else fit):
                            continue
                    found = table[end] = (token, n + 1)
                    break
            return found

        return entry(len(word))

    def _chunk(self, chunk: str) -> int:
        return sum(map(self.pieces.__getitem__, self.pattern.findall(chunk)))

    def _plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        if not self.odd_space.search(text):
            first, *rest = text.split(" ")
            return self.first[first] + sum(map(self.spaced.__getitem__, rest))
        total = 0
        for chunk in self.before_word.split(text):
            word = chunk[:1] == " " and not chunk[1:2].isspace()
            total += self.spaced[chunk[1:]] if word else self.first[chunk]
        return total

    def count(self, text: str) -> int:
        if self.specials and any(s in text for s in self.specials):
            return sum(map(self._plain, self.special.split(text))) + len(self.special.findall(text))
        return self._plain(text)

    def prefixes(self, text: str) -> np.ndarray:
        """Token counts of ``text``'s prefixes by their length in bytes.

        Exact at every character boundary, where the prefix is a text of its own: the piece that
        the cut shortens is split again by the pattern, and white space at the cut is one piece.
        """
        data = text.encode()
        table = np.zeros(len(data) + 1, dtype=np.int32)
        base = at = 0
        begin = 0
        for match in [*self.special.finditer(text), None]:
            stop = match.start() if match else len(text)
            before = base
            base, at = self._prefixes(text[begin:stop], table, base, at)
            if match:
                shown = match.group()
                for n in range(1, len(shown)):  # cut, the special string is ordinary text
                    table[at + len(shown[:n].encode())] = before + self._plain(text[begin:stop] + shown[:n])
                at += len(shown.encode())
                base += 1
                table[at] = base
                begin = match.end()
        return table

    def _prefixes(self, text: str, table: np.ndarray, base: int, at: int) -> tuple[int, int]:
        """Fill the table for a text without special strings behind ``base`` tokens, ``at`` bytes."""
        pieces = self.pattern.findall(text)
        if not pieces:
            return base, at
        parts = [self.tables[piece] for piece in pieces]
        lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4
        joined = np.frombuffer(b"".join(parts), dtype=np.int32)
        ends = np.cumsum(lengths)
        totals = np.cumsum(joined[ends - 1])  # tokens up to the end of each piece
        before = base + totals - joined[ends - 1]
        filled = table[at + 1 : at + len(joined) + 1]
        filled[:] = joined + np.repeat(before, lengths)
        for i in [i for i, piece in enumerate(pieces[:-1], 1) if piece.isspace()]:
            piece = pieces[i]
            if not piece[0].isspace():
                continue
            run, begin = pieces[i - 1].encode(), int(ends[i - 1])
            behind = int(before[i]) - self.piece(run)[-1]
            if piece.isspace():
                n = int(lengths[i])
                filled[begin : begin + n] = behind + np.array(self.piece(run + piece.encode())[-n:])
            elif piece[0] == " ":
                # a prefix that ends behind this space ends in white space, which is one piece
                filled[begin] = behind + self.piece(run + b" ")[-1]
        return base + int(totals[-1]), at + len(joined)


class PrefixTable:
    """A stored table: exact token count at every prefix."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts

    def store(self) -> bytes:
        return zlib.compress(np.diff(self.counts, prepend=0).astype("<i4").tobytes(), 1)

    @staticmethod
    def load(blob: bytes) -> PrefixTable:
        return PrefixTable(np.cumsum(np.frombuffer(zlib.decompress(blob), dtype="<i4"), dtype=np.int64))

    def at(self, n_bytes: int) -> int:
        """Tokens of the prefix of so many bytes."""
        return int(self.counts[n_bytes])

    def fits(self, budget: int, text: str) -> int:
        """Bytes of the longest prefix of whole characters that has at most ``budget`` tokens."""
        ends = np.cumsum([0] + [len(c.encode()) for c in text])
        return int(ends[np.nonzero(self.counts[ends] <= budget)[0][-1]])


_shared: dict[str, PrefixCounter] = {}


def counter(name: str = "byte_bpe_50k.json") -> PrefixCounter:
    if name not in _shared:
        _shared[name] = PrefixCounter(name)
    return _shared[name]


def token_counts(docs: DataFrame, limit: int = 1024, tables: bool = True, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit and, unless ``tables`` is off,
    the stored prefix table (:class:`PrefixTable`), whose last entry is n_tokens."""

    def run(batches):
        count = counter(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            if tables:
                stored = [count.prefixes(t) for t in texts]  # at most ROWS_AT_ONCE texts
                n = [int(s[-1]) for s in stored]
            else:
                n = [count.count(t) for t in texts]
            columns = [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
            names = ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            if tables:
                columns.append(pa.array([PrefixTable(s).store() for s in stored], pa.binary()))
                names.append("prefixes")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    return arrow_map(rows, run, schema + (", prefixes binary" if tables else ""))

"""Language identification by unigram pieces, summed over all segmentations.

A language is a probability for every piece of a fixed public vocabulary. A word's probability is
the sum over all ways to cut it into pieces, which a forward algorithm gives without listing them.
The probabilities are learnt from labelled documents by expectation maximisation: a round counts,
word by word, how often each piece is expected in the segmentations, and adds up over all words in
Spark. Every document is scored as a whole; workers remember the scores of words they have met.

Words are whole runs of letters, lower-cased, however long. Those above 32 letters are summed in
logarithms, slice by slice. A letter outside the vocabulary is a piece of one small probability in
every language.

Learning uses at most ``PER_LANGUAGE`` documents of each language, drawn by a hash of doc_id, from
rows with text and lang outside the held-out fold.

Defined cases: ``lang_pred`` is ``und`` with score 0 if the text is null or has no letter, or if
there was nothing to learn from; ties go to the language first in code point order; repeated rows
are scored each. Further columns are ignored.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paramill.llm.common import ROWS_AT_ONCE, arrow_map, forget, held_out, ship, small_batches, written

#: Labelled documents per language that are learnt from, at most, and rounds over them.
PER_LANGUAGE, ROUNDS = 400, 2
FOLDS, HELD_OUT = 3, 1
#: Letters up to which a word's probabilities fit a double; letters of longer words that are cut into
#: pieces together, letters of words held together, and letters of words that a task remembers, at most.
SHORT, SLICE, LETTERS_AT_ONCE, LETTERS_REMEMBERED = 32, 4096, 1 << 18, 1 << 23
#: Probability of a letter outside the vocabulary, and pseudo-count of every piece.
UNKNOWN, SMOOTHING = 1e-8, 0.05
#: Words whose scores a task remembers, words of a text summed together, and words looked up together.
REMEMBERED, SECTION, WORDS_AT_ONCE = 200_000, 4096, 1 << 16
#: Bits of a letter's code point.
LETTER_BITS = 21
UNDECIDED = "und"
#: Letters with the marks that belong to them.
_WORDS = regex.compile(r"(?:\p{L}\p{M}*)+")


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


class Edges(NamedTuple):
    """Pieces that fit into marked words: word, first letter, end and piece of each, and the words' letters."""

    word: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    letters: np.ndarray

    def steps(self, place: np.ndarray):
        """The edges by ``place``, and within by word: order, and the bounds of every place from 0 on."""
        order = np.argsort(place * len(self.letters) + self.word, kind="stable")
        return order, np.searchsorted(place[order], np.arange(self.letters.max() + 2))


def _sums_by_word(values: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, ascending in ``word``, and the sums of their values."""
    starts = np.nonzero(np.concatenate([[True], word[1:] != word[:-1]]))[0] if len(word) else np.zeros(0, dtype=np.int64)
    return word[starts], np.add.reduceat(values, starts, axis=0) if len(word) else values


def _log_sums_by_word(values: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for logarithms."""
    starts = np.nonzero(np.concatenate([[True], word[1:] != word[:-1]]))[0]
    top = np.maximum.reduceat(values, starts, axis=0)
    sums = np.add.reduceat(np.exp(values - np.repeat(top, np.diff(np.append(starts, len(word))), axis=0)), starts, axis=0)
    return word[starts], top + np.log(sums)


def _by_length(words: list[str]):
    """Short words' places first, then sections of longer ones, of similar length and bounded together."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    yield np.nonzero(lengths <= SHORT)[0]
    longer = np.nonzero(lengths > SHORT)[0]
    longer = longer[np.argsort(lengths[longer], kind="stable")]
    first = 0
    for at in range(1, len(longer) + 1):
        if at == len(longer) or (at + 1 - first) * lengths[longer[at]] > LETTERS_AT_ONCE:
            yield longer[first:at]
            first = at


class Pieces:
    """The vocabulary: pieces without control and byte entries, by their letters."""

    def __init__(self, name: str = "piece_bpe_32k.model"):
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        self.size = model.get_piece_size()
        plain = (i for i in range(self.size) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)))
        self.ids = {model.id_to_piece(i): i for i in plain}
        # every beginning of a piece is a node; a (node, next letter) pair leads to the node it makes
        nodes = {"": 0}
        for piece in self.ids:
            for n in range(1, len(piece) + 1):
                nodes.setdefault(piece[:n], len(nodes))
        keys = np.array([nodes[text[:-1]] << LETTER_BITS | ord(text[-1]) for text in nodes if text], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.nodes = keys[order], order + 1
        self.piece_of = np.array([self.ids.get(text, -1) for text in nodes], dtype=np.int64)
        self.longest = max(map(len, self.ids))

    def edges(self, words: list[str]) -> Edges:
        """All pieces in the marked words."""
        return self.edges_of(["▁" + word for word in words])

    def edges_of(self, marked: list[str]) -> Edges:
        """All pieces in words that have their marks; a letter that is no piece has an edge of its own.

        All places take a step together, to the node of one more letter, while pieces go on.
        """
        letters = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
        codes = np.frombuffer("".join(marked).encode("utf-32-le"), dtype="<u4").astype(np.int64)
        word = np.repeat(np.arange(len(marked)), letters)
        last = np.cumsum(letters)
        begin = np.arange(len(codes)) - (last - letters)[word]
        limit = last[word]
        at, node = np.arange(len(codes)), np.zeros(len(codes), dtype=np.int64)
        found = []
        length = 0
        while len(at):
            length += 1
            key = node << LETTER_BITS | codes[at + length - 1]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            goes_on = self.keys[place] == key
            node = np.where(goes_on, self.nodes[place], 0)
            piece = self.piece_of[node]
            if length == 1:
                piece = np.where(piece < 0, self.size, piece)
            fits = piece >= 0
            found.append((at[fits], np.full(np.count_nonzero(fits), length), piece[fits]))
            alive = goes_on & (at + length < limit[at])
            at, node = at[alive], node[alive]
        start, length, piece = (np.concatenate(column) for column in zip(*found, strict=True))
        return Edges(word[start], begin[start], begin[start] + length, piece, letters)

    def sums(self, edges: Edges, probabilities: np.ndarray) -> np.ndarray:
        """Sums over all segmentations of every prefix: (letters + 1, words, languages).

        All words take a step together: the sums up to one end need only the sums before it.
        """
        out = np.zeros((edges.letters.max() + 1, len(edges.letters), probabilities.shape[1]))
        out[0] = 1.0
        order, cuts = edges.steps(edges.end)
        word, begin, piece = edges.word[order], edges.begin[order], edges.piece[order]
        for end in range(1, len(out)):
            span = slice(cuts[end], cuts[end + 1])
            rows, sums = _sums_by_word(out[begin[span], word[span]] * probabilities[piece[span]], word[span])
            out[end, rows] = sums
        return out

    def forward(self, words: list[str], probabilities: np.ndarray) -> np.ndarray:
        """Probability of every word, summed over all its segmentations: (words, languages)."""
        edges = self.edges(words)
        return self.sums(edges, probabilities)[edges.letters, np.arange(len(words))]

    def slices(self, marked: list[str], backwards: bool = False):
        """The edges of long words by slices of their letters: bounds, then word, begin, end and piece.

        Forwards a slice has the edges that end in it, sorted by end; backwards those that begin in it,
        sorted by begin; both then by word.
        """
        lengths = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
        firsts = range(0, int(lengths.max()), SLICE)
        for a in reversed(firsts) if backwards else firsts:
            b = min(a + SLICE, int(lengths.max()))
            low, high = (a, b + self.longest) if backwards else (max(0, a - self.longest), b)
            there = np.nonzero(lengths > low)[0]
            edges = self.edges_of([marked[i][low:high] for i in there])
            word, begin, end = there[edges.word], edges.begin + low, edges.end + low
            inside = np.nonzero(begin < b if backwards else end > a)[0]
            order = inside[np.lexsort((word[inside], (begin if backwards else end)[inside]))]
            yield a, b, word[order], begin[order], end[order], edges.piece[order]

    def logs(self, words: list[str], probabilities: np.ndarray) -> np.ndarray:
        """Logarithms of the words' probabilities, for words of any length: (words, languages)."""
        out = np.zeros((len(words), probabilities.shape[1]))
        short, *longer = _by_length(words)
        if len(short):
            out[short] = np.log(self.forward([words[i] for i in short], probabilities))
        for some in longer:
            out[some] = self.long_logs([words[i] for i in some], np.log(probabilities))
        return out

    def long_logs(self, words: list[str], logs: np.ndarray) -> np.ndarray:
        """The forward algorithm in logarithms; only as many ends are held as a piece is long."""
        marked = ["▁" + word for word in words]
        ending = defaultdict(list)
        for i, word in enumerate(marked):
            ending[len(word)].append(i)
        held = self.longest + 1
        sums = np.full((held, len(words), logs.shape[1]), -np.inf)
        sums[0] = 0.0
        out = np.zeros((len(words), logs.shape[1]))
        for a, b, word, begin, end, piece in self.slices(marked):
            cuts = np.searchsorted(end, np.arange(a + 1, b + 2))
            for at in range(a + 1, b + 1):
                span = slice(cuts[at - a - 1], cuts[at - a])
                rows, found = _log_sums_by_word(sums[begin[span] % held, word[span]] + logs[piece[span]], word[span])
                sums[at % held] = -np.inf
                sums[at % held, rows] = found
                if at in ending:
                    out[ending[at]] = sums[at % held, ending[at]]
        return out

    def long_expected(self, words: list[str], times: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """Expected uses in logarithms, for words of any length and one language."""
        marked = ["▁" + word for word in words]
        letters, numbers = np.array([len(word) for word in marked]), np.arange(len(words))
        before = np.full((letters.max() + 1, len(words)), -np.inf)
        before[0] = 0.0
        for a, b, word, begin, end, piece in self.slices(marked):
            cuts = np.searchsorted(end, np.arange(a + 1, b + 2))
            for at in range(a + 1, b + 1):
                span = slice(cuts[at - a - 1], cuts[at - a])
                rows, found = _log_sums_by_word(before[begin[span], word[span]] + logs[piece[span]], word[span])
                before[at, rows] = found
        after = np.full_like(before, -np.inf)
        after[letters, numbers] = np.log(times) - before[letters, numbers]
        uses = np.zeros(self.size + 1)
        for a, b, word, begin, end, piece in self.slices(marked, backwards=True):
            cuts = np.searchsorted(begin, np.arange(a, b + 1))
            for at in range(b - 1, a - 1, -1):
                span = slice(cuts[at - a], cuts[at - a + 1])
                rows, found = _log_sums_by_word(after[end[span], word[span]] + logs[piece[span]], word[span])
                after[at, rows] = found
            uses += np.bincount(piece, np.exp(before[begin, word] + logs[piece] + after[end, word]), minlength=self.size + 1)
        return uses

    def expected(self, words: list[str], times: np.ndarray, probability: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in the words' segmentations, for one language."""
        short, *longer = _by_length(words)
        uses = self.short_expected([words[i] for i in short], times[short], probability) if len(short) else np.zeros(self.size + 1)
        for some in longer:
            uses += self.long_expected([words[i] for i in some], times[some], np.log(probability))
        return uses

    def short_expected(self, words: list[str], times: np.ndarray, probability: np.ndarray) -> np.ndarray:
        edges = self.edges(words)
        before = self.sums(edges, probability[:, None])[:, :, 0]
        after = np.zeros_like(before)
        numbers = np.arange(len(words))
        after[edges.letters, numbers] = times / before[edges.letters, numbers]
        order, cuts = edges.steps(edges.begin)
        word, begin, end, piece = (column[order] for column in (edges.word, edges.begin, edges.end, edges.piece))
        for at in range(len(before) - 2, -1, -1):
            span = slice(cuts[at], cuts[at + 1])
            rows, sums = _sums_by_word(after[end[span], word[span]] * probability[piece[span]], word[span])
            after[at, rows] = sums
        return np.bincount(piece, before[begin, word] * probability[piece] * after[end, word], minlength=self.size + 1)


@functools.lru_cache(maxsize=2)
def loaded(vocabulary: str) -> Pieces:
    """The vocabulary, read once per process."""
    return Pieces(vocabulary)


class Languages:
    """Learnt probabilities: one column per language, one row per piece, the last for unknown letters."""

    def __init__(self, names: list[str], probabilities: np.ndarray, vocabulary: str):
        self.names, self.probabilities, self.vocabulary = names, probabilities, vocabulary

    def score(self, batches):
        """Rows of (doc_id, held_out, text) to (doc_id, held_out, lang_pred, score)."""
        pieces = loaded(self.vocabulary)
        place: dict[str, int] = {}
        held = 0
        logs = np.zeros((REMEMBERED, len(self.names)))

        def add(words: list[str], lengths: list[int], texts: list[int], totals: np.ndarray) -> None:
            """Add the scores of consecutive sections of words to the texts they belong to."""
            nonlocal held
            different = dict.fromkeys(words)
            fresh = [word for word in different if word not in place]
            if len(place) + len(fresh) > REMEMBERED or held > LETTERS_REMEMBERED:
                place.clear()
                held = 0
                fresh = list(different)
            held += sum(map(len, fresh))
            for first in range(0, len(fresh), SECTION):
                part = fresh[first : first + SECTION]
                at = len(place)
                logs[at : at + len(part)] = pieces.logs(part, self.probabilities)
                place.update(zip(part, range(at, at + len(part)), strict=True))
            rows = np.fromiter(map(place.__getitem__, words), dtype=np.int64, count=len(words))
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
            np.add.at(totals, texts, np.add.reduceat(logs[rows], starts, axis=0))

        for batch in batches:
            totals = np.zeros((batch.num_rows, len(self.names)))
            decided = np.zeros(batch.num_rows, dtype=bool)
            words, lengths, texts = [], [], []
            for at, text in enumerate(batch.column(2).to_pylist() if self.names else []):
                own = words_of(text or "")
                decided[at] = bool(own)
                for first in range(0, len(own), SECTION):
                    section = own[first : first + SECTION]
                    words += section
                    lengths.append(len(section))
                    texts.append(at)
                    if len(words) >= WORDS_AT_ONCE:
                        add(words, lengths, texts, totals)
                        words, lengths, texts = [], [], []
            if words:
                add(words, lengths, texts, totals)
            predicted, scores = [], []
            for total, known in zip(totals, decided.tolist(), strict=True):
                best = int(np.argmax(total)) if known else 0
                predicted.append(self.names[best] if known else UNDECIDED)
                scores.append(float(1.0 / np.exp(total - total[best]).sum()) if known else 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(predicted, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, rounds: int = ROUNDS, vocabulary: str = "piece_bpe_32k.model") -> Languages:
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(FOLDS, HELD_OUT))
    counts = {r["lang"]: r["count"] for r in labelled.groupBy(F.col("lang").cast("string").alias("lang")).count().toLocalIterator()}
    names = sorted(counts)
    size = loaded(vocabulary).size
    if not names:
        return Languages([], np.zeros((size + 1, 0)), vocabulary)
    # a hash of the id below a share of its range that gives the wanted number of documents
    share = F.create_map(*[x for name in names for x in (F.lit(name), F.lit(min(1.0, per_language / counts[name])))])
    drawn = F.pmod(F.xxhash64(F.lit("drawn"), "doc_id"), F.lit(1 << 20)) < share[F.col("lang").cast("string")] * (1 << 20)
    sample = labelled.filter(drawn).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))

    def count_words(batches):
        for batch in batches:
            seen: dict[tuple[str, str], int] = defaultdict(int)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word in words_of(text):
                    seen[lang, word] += 1
            if seen:
                columns = [pa.array([k[0] for k in seen]), pa.array([k[1] for k in seen]), pa.array(list(seen.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "word", "n"])

    counted = arrow_map(sample, count_words, "lang string, word string, n long")
    words = written(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    number = {name: i for i, name in enumerate(names)}
    probabilities = np.full((size + 1, len(names)), 1.0 / size)
    probabilities[size] = UNKNOWN
    for _ in range(rounds):
        now = probabilities

        def expect(batches, now=now):
            pieces = loaded(vocabulary)
            sums = np.zeros((pieces.size + 1, len(names)))
            for batch in batches:
                langs = np.array([number[lang] for lang in batch.column(0).to_pylist()])
                words, times = np.array(batch.column(1).to_pylist(), dtype=object), batch.column(2).to_numpy()
                for language in np.unique(langs):
                    own = langs == language
                    sums[:, language] += pieces.expected(words[own].tolist(), times[own], now[:, language])
            piece, language = np.nonzero(sums[: pieces.size])
            arrays = [pa.array(piece, pa.int32()), pa.array(language, pa.int32()), pa.array(sums[piece, language], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["piece", "language", "uses"])

        uses = arrow_map(words, expect, "piece int, language int, uses double").groupBy("piece", "language").agg(F.sum("uses").alias("uses"))
        probabilities = np.full_like(now, SMOOTHING)
        for r in uses.toLocalIterator():  # pieces of the vocabulary times languages at most
            probabilities[r["piece"], r["language"]] += r["uses"]
        probabilities[size] = 0.0
        probabilities /= probabilities.sum(axis=0)
        probabilities[size] = UNKNOWN
    forget(words)
    return Languages(names, probabilities, vocabulary)


def identify(docs: DataFrame, model: Languages | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    model = model or learn(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(FOLDS, HELD_OUT).alias("held_out"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, model.score, "doc_id long, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language could be told, with all their columns.

    Rejected: no letter (so null and empty texts), or no language with a probability of at least
    ``least``. Every row is judged by its own text, also among rows that share a doc_id. One narrow
    pass: the text alone goes to Python, the other columns stay where they are.
    """
    model = learn(docs)
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)

    @F.arrow_udf("boolean")
    def told(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in texts:
            answers = []
            for first in range(0, len(array), ROWS_AT_ONCE):
                part = array.slice(first, ROWS_AT_ONCE)
                asked = pa.RecordBatch.from_arrays([pa.nulls(len(part), pa.int64()), pa.nulls(len(part), pa.bool_()), part], names=["doc_id", "held_out", "text"])
                found = next(iter(model.score(iter([asked]))))
                answers += [p != UNDECIDED and s >= least for p, s in zip(found.column(2).to_pylist(), found.column(3).to_pylist(), strict=True)]
            yield pa.array(answers, pa.bool_())
            pa.default_memory_pool().release_unused()

    return docs.filter(told(F.col("text").cast("string")))

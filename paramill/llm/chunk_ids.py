"""Token ids of whole texts by the public word vocabulary, remembered per different chunk.

That tokenizer drops white space and never lets a token or a normalisation step reach over a
space or a line feed, so the ids of a text are those of its pieces between spaces and line
feeds, one after the other. Each Python worker keeps the ids of chunks it has met (bounded, then
started anew). A new chunk of Latin-1 characters, for which normalising is lower-casing alone, is
cut by the published pattern and goes straight to the library's merge model; any other chunk goes
through the library as a whole.
"""

from __future__ import annotations

import re
import struct
import weakref

#: Remembered chunks and pieces per Python worker, and the longest ones worth remembering.
REMEMBERED = 600_000
LONGEST = 48
_LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACES = "\\x09-\\x0d \x85\xa0"
#: The tokenizer's pattern, restricted to lower-case Latin-1.
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+")


def letter_of_byte() -> dict[int, str]:
    """The published rule that writes bytes as letters: printable Latin-1 stands for itself,
    the other bytes follow from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


_memories: list[weakref.ref] = []
_step = ""


def begin(step: str) -> None:
    """Tell what this Python worker does from now on: workers outlive their stages, and what was remembered for
    another step would lie beside what this one holds."""
    global _step
    if step != _step:
        _step = step
        for memory in [m for r in _memories if (m := r()) is not None]:
            memory.clear()


class _Memory(dict):
    """Remembers what ``work`` gives for short keys; starts anew when full."""

    def __init__(self, work):
        super().__init__()
        self.work = work
        _memories.append(weakref.ref(self))

    def __missing__(self, key):
        value = self.work(key)
        if len(key) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[key] = value
        return value


class ChunkIds:
    def __init__(self, name: str = "word_bpe_49k.json"):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.model = self.tokenizer.model
        self.letters = letter_of_byte()
        self.bytes_of = [struct.pack("<I", i) for i in range(self.tokenizer.get_vocab_size())]
        self.pieces = _Memory(self._piece)
        self.chunks = _Memory(self._chunk)

    def _piece(self, piece: str) -> bytes:
        if not (piece.isascii() and piece.isalnum()):  # these letters stand for themselves
            piece = piece.encode().decode("latin-1").translate(self.letters)
        tokens = self.model.tokenize(piece)
        if len(tokens) == 1:
            return self.bytes_of[tokens[0].id]
        bytes_of = self.bytes_of
        return b"".join([bytes_of[t.id] for t in tokens])

    def _chunk(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        if chunk.isascii():
            if chunk.isalpha():  # one piece of the pattern
                return self.pieces[chunk.lower()]
            plain = True
        else:
            plain = max(chunk) < "Ā"
        if plain and "<|" not in chunk:
            found = PIECES.findall(chunk.lower())
            return self.pieces[found[0]] if len(found) == 1 else b"".join([self.pieces[p] for p in found])
        ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def packed(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null counts as empty."""
        of = self.chunks.__getitem__
        return [b"".join(map(of, (t or "").replace("\n", " ").split(" "))) for t in texts]


_shared: dict[str, ChunkIds] = {}


def chunk_ids(name: str = "word_bpe_49k.json") -> ChunkIds:
    """One per Python worker, kept between its tasks."""
    if name not in _shared:
        _shared[name] = ChunkIds(name)
    return _shared[name]

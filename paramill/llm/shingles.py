"""Word shingles of whole texts as sorted 48-bit n-gram codes."""

from __future__ import annotations

import hashlib

import numpy as np

from paramill.llm.chunk_ids import _Memory

WORDS = 5
CODE_BITS = 48
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _word(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


_words = _Memory(_word)


def shingle_codes(text: str | None) -> np.ndarray:
    """Different codes of the text's runs of five words, ascending; of all its words if there are
    fewer; none without words. A-Z count as lower case; words end at the ASCII white space
    characters only."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.array(list(map(_words.__getitem__, words)), dtype=np.uint64)
    n = min(WORDS, len(hashes))
    codes = np.full(len(hashes) - n + 1, n, dtype=np.uint64)  # sequences of other lengths differ
    for i in range(n):
        codes += hashes[i : len(hashes) - n + 1 + i] * _FACTORS[i]
    codes ^= codes >> np.uint64(33)
    codes *= _MIX
    codes ^= codes >> np.uint64(29)
    return np.unique(codes >> np.uint64(64 - CODE_BITS))


def set_key(codes: np.ndarray) -> int:
    """A signed 64-bit name of a set of codes."""
    return int.from_bytes(hashlib.blake2b(codes.astype("<u8").tobytes(), digest_size=8).digest(), "little", signed=True)

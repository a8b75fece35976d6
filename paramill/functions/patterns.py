"""Java regular expressions built from the vocabulary.

Character classes are spelled out instead of relying on ``\\w`` and ``\\b``: Unicode
letters, every Unicode number (so that ``²`` counts, as in ``m²``) and ``_``.
"""

from __future__ import annotations

import re

from paramill import vocabulary as v

WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\s\x1c-\x1f]"

# number, optional range, optional unit -- fixed pattern
NUMBER = r"-?\d+(?:\.\d+)?"
RANGE_MARK = rf"{SPACE}*(?:~|－|～|{SPACE}-{SPACE}){SPACE}*"


def quoted(text: str) -> str:
    """``text`` as a literal inside a Java pattern."""
    return re.sub(r"([\\^$.|?*+()\[\]{}\-])", r"\\\1", text)


UNIT = "(?:" + "|".join(quoted(u) for u in v.UNITS) + ")"
# the look-ahead is a cheap first test that most characters fail
MENTION = rf"(?iuU)(?=[-\d])(?<![\p{{L}}\p{{N}}_.]){NUMBER}(?:{RANGE_MARK}{NUMBER})?{SPACE}*{UNIT}?(?!{WORD}|/)"
# on a mention that was already found, the value is its leading part
MENTION_VALUE = rf"(?U)^{NUMBER}(?:{RANGE_MARK}{NUMBER})?"
MENTION_UNIT = rf"(?iuU){UNIT}$"
RANGE = rf"(?U)^({NUMBER}){RANGE_MARK}({NUMBER})$"

TRIM = rf"(?U)^{SPACE}+|{SPACE}+$"


def alias_pattern(alias: str) -> str:
    """ASCII spellings stand alone as words; other spellings match anywhere."""
    if alias.isascii():
        return rf"(?<!{WORD}){quoted(alias)}(?!{WORD})"
    return quoted(alias)


def _by_first_letter(texts: list[str]) -> str:
    """One of ``texts`` in their order. Those that share a first letter are one branch, since a place in the
    text can only begin with one of them."""
    groups: dict[str, list[str]] = {}
    for t in texts:
        groups.setdefault(t[0], []).append(quoted(t[1:]))
    return "(?:" + "|".join(f"{quoted(c)}(?:{'|'.join(rest)})" for c, rest in groups.items()) + ")"


def any_alias(aliases: list[str]) -> str:
    """One of ``aliases``; at one position the earlier spelling wins.

    Words share one pair of boundary checks, so most positions fail on the first test.
    """
    words = [a for a in aliases if a.isascii()]
    others = [a for a in aliases if not a.isascii()]
    branches = []
    if words:
        branches.append(rf"(?=[a-z])(?<!{WORD}){_by_first_letter(words)}(?!{WORD})")
    if others:
        branches.append(rf"(?=[^\x00-\x7f]){_by_first_letter(others)}")
    return "(?:" + "|".join(branches) + ")"


def longest_alias(aliases: list[str]) -> str:
    """Matches nothing at every place where one of ``aliases`` begins; group 1 is the longest of them.

    Shorter ones there are the beginnings of it that :func:`beginnings` names, so no spelling is missed,
    also where two overlap.
    """
    return f"(?=({any_alias(sorted(aliases, key=len, reverse=True))}))"


def beginnings(alias: str, aliases: list[str]) -> list[str]:
    """Those of ``aliases`` that stand wherever ``alias`` stands and begin where it begins."""
    follows = re.compile(r"[^\W_]|_")
    return [a for a in aliases if alias.startswith(a) and (a == alias or not a.isascii() or not follows.match(alias[len(a)]))]


NUMERIC_ALIASES: list[str] = [
    a for a, p in v.ALIAS_PARAMETER.items() if p in v.EXPECTED_GROUP
]
NUMERIC_ALIAS = any_alias(NUMERIC_ALIASES)

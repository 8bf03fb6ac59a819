"""X13 for long lists: literals replaced in list order, by an automaton that finds which of them occur.

Replacing one literal after another reads a text once per literal. Here a text is read once to find the
literals it holds; only these are replaced, in the order of the list, so the result is that of
``functions.text.redact``, whose replacements see what earlier ones left.

A literal that the text does not hold can still match later, with letters of a replacement. A match that
holds letters of one either lies within the replacement, or goes on beyond one of its ends (or one of
an inner replacement's), and so holds its first or its last letter. Literals of these two kinds are always tried.
"""

from __future__ import annotations

from typing import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, functions as F

from .text import REDACTED

#: Bytes of literals in one automaton; a longer list is run in slices, one after the other.
SLICE_BYTES = 8 << 20


class Redactor:
    """The literals of one slice, in order; null and empty ones do nothing, repeated ones count each time."""

    def __init__(self, literals: Sequence[str | None], marker: str = REDACTED):
        import ahocorasick

        self.marker = marker
        self.literals = [s for s in literals if s]
        places: dict[str, list[int]] = {}
        for i, s in enumerate(self.literals):
            places.setdefault(s, []).append(i)
        self.always = [i for i, s in enumerate(self.literals) if marker and (s in marker or marker[0] in s or marker[-1] in s)]
        self.found = ahocorasick.Automaton()
        for s, at in places.items():
            self.found.add_word(s, tuple(at))
        if places:
            self.found.make_automaton()

    def __call__(self, text: str) -> str:
        if not self.literals:
            return text
        held = {at for _, at in self.found.iter(text)}
        for i in sorted({i for at in held for i in at}.union(self.always)):
            text = text.replace(self.literals[i], self.marker)
        return text


def slices(literals: Sequence[str | None], most: int = SLICE_BYTES) -> list[list[str]]:
    """The list in order, in pieces of at most ``most`` bytes (a longer literal is its own)."""
    out, size = [[]], 0
    for s in literals:
        n = len(s.encode()) if s else 0
        if out[-1] and size + n > most:
            out.append([])
            size = 0
        out[-1].append(s)
        size += n
    return out


def redact_list(text, literals: Sequence[str | None], marker: str = REDACTED) -> Column:
    """``text`` with each literal, in list order, replaced by ``marker`` (not empty), for lists of any length.

    Null texts stay null. One Arrow pass for each slice of the list, which goes to the
    executors with the function.
    """
    if not marker:
        raise ValueError("the replacement must not be empty")
    c = F.col(text) if isinstance(text, str) else text
    for piece in slices(literals):
        c = _pass(piece, marker)(c)
    return c


def _pass(piece: list[str], marker: str):
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        redactor = Redactor(piece, marker)
        for texts in batches:
            yield texts.map(redactor, na_action="ignore")

    return run

"""Texts as code point arrays, in groups of bounded size."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np

#: Code points handled at once. Longer texts are cut into slices whose sums add up to the text's.
SLICE = 1 << 19


def slices(texts: list[str | None], limit: int = SLICE) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Groups of (places in ``texts``, pieces) of at most about ``limit`` code points; null and empty texts give none."""
    at, pieces, held = [], [], 0
    for i, text in enumerate(texts):
        for start in range(0, len(text or ""), limit):
            piece = text[start : start + limit]
            if held + len(piece) > limit and at:
                yield np.array(at), pieces
                at, pieces, held = [], [], 0
            at.append(i)
            pieces.append(piece)
            held += len(piece)
    if at:
        yield np.array(at), pieces


def codes(pieces: list[str], gap: str = "\n") -> tuple[np.ndarray, np.ndarray]:
    """Code points of the pieces, each after a ``gap`` (and one at the end), and where each piece's gap is."""
    joined = np.frombuffer((gap + gap.join(pieces) + gap).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    starts = np.cumsum([0, *[len(p) + len(gap) for p in pieces[:-1]]])
    return joined, starts


@cache
def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


#: Classes of characters in ``classes``.
SPACE, LOWER, UPPER, DIGIT, STOP, SYMBOL, BAR, MARK = range(8)


@cache
def classes() -> np.ndarray:
    """For each code point its class; beyond the basic plane, letters count as lower case."""
    out = np.full(0x110000, SYMBOL, dtype=np.uint8)
    out[0x10000:] = LOWER
    kinds = {"Lu": UPPER, "Lt": UPPER, "Nd": DIGIT, "Nl": DIGIT, "No": DIGIT, "Zs": SPACE, "Zl": SPACE, "Zp": SPACE, "Cc": SPACE}
    for i in range(0x10000):
        kind = unicodedata.category(chr(i))
        out[i] = kinds.get(kind, LOWER if kind[0] in "LM" else SYMBOL)
    out[[ord(c) for c in ".,;:?\"'()-"]] = STOP
    out[ord("|")], out[ord("!")] = BAR, MARK
    return out

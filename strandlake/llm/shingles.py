"""Hashed word shingles of many texts at once, in numpy."""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

from strandlake.llm.textvec import SLICE, codes

WORDS = 5
ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _word_chars() -> np.ndarray:
    out = np.zeros(0x110000, dtype=bool)
    out[:0x30000] = [unicodedata.category(chr(i))[0] in "LMN" for i in range(0x30000)]
    return out


@cache
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    base, n = 0xD6E8FEB86659FD93, SLICE * 2 + 2
    out = []
    for factor in (base, pow(base, -1, 1 << 64)):
        power = np.full(n, factor, dtype=np.uint64)
        power[0] = 1
        out.append(np.cumprod(power, dtype=np.uint64))
    up, down = out
    return up, down


def _parts(texts: list[str | None]):
    """Groups of (place, piece) of bounded size; a long text is cut where a word ends, if it has an end."""
    group, held = [], 0
    for i, text in enumerate(texts):
        text = (text or "").lower()
        at = 0
        while at < len(text):
            end = min(len(text), at + SLICE)
            if end < len(text):
                cut = end
                while cut > at and text[cut - 1].isalnum():
                    cut -= 1
                end = cut if cut > at else end
            if held + end - at > SLICE and group:
                yield group
                group, held = [], 0
            group.append((i, text[at:end]))
            held += end - at + 1
            at = end
    if group:
        yield group


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, runs of letters, marks and digits in lower case, text after text; and each one's text."""
    hashes, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    up, down = powers()
    for group in _parts(texts):
        c, starts = codes([p for _, p in group])
        word = _word_chars()[c]
        first = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))
        last = np.flatnonzero(word & ~np.concatenate([word[1:], [False]])) + 1
        sums = np.concatenate([[np.uint64(0)], np.cumsum((c.astype(np.uint64) + np.uint64(1)) * up[: len(c)], dtype=np.uint64)])
        hashes.append(mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64) * ODD))
        of.append(np.array([i for i, _ in group])[np.searchsorted(starts, first, side="right") - 1])
    return np.concatenate(hashes), np.concatenate(of)


def shingles(texts: list[str | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, count, text) of the distinct shingles of each text, sorted by text and hash, and text keys. A text of fewer than
    ``words`` words is one shingle of them all; one without words has none. Keys: two 64-bit hashes of the whole word
    sequence, (texts, 2)."""
    h, of = word_hashes(texts)
    n = np.bincount(of, minlength=len(texts)) if len(of) else np.zeros(len(texts), np.int64)
    ends = np.cumsum(n)
    starts = ends - n
    keys = np.zeros((len(texts), 2), np.uint64)
    place = (np.arange(len(h)) - starts[of]).astype(np.uint64) if len(h) else np.zeros(0, np.uint64)
    for j, salt in enumerate((np.uint64(0x51ED270B), np.uint64(0xA0761D65))):
        run = np.concatenate([[np.uint64(0)], np.cumsum(mix(h * (salt | np.uint64(1)) + mix(place + salt)), dtype=np.uint64)])
        keys[:, j] = mix(run[ends] - run[starts] + n.astype(np.uint64))
    gram = np.zeros(len(h), np.uint64)
    for j in range(words):
        nxt = np.zeros(len(h), np.uint64)
        nxt[: len(h) - j] = h[j:]
        inside = place + np.uint64(j) < n[of].astype(np.uint64) if len(h) else np.zeros(0, bool)
        gram = np.where(inside, mix(gram * ODD + nxt), gram)
    keep = place + np.uint64(words) <= np.maximum(n[of], words).astype(np.uint64) if len(h) else np.zeros(0, bool)
    gram, of = gram[keep], of[keep]
    order = np.lexsort((gram, of))
    gram, of = gram[order], of[order]
    first = np.ones(len(gram), bool)
    first[1:] = (gram[1:] != gram[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(first)
    return gram[at], np.diff([*at, len(gram)]), of[at], keys


#: Bytes of a cell.
CELL = 5


def cells_of(gram: np.ndarray, count: np.ndarray, of: np.ndarray, texts: int) -> list[bytes]:
    """For each text the set of its cells: a shingle that it holds c times is c cells, numbered from 0, hashed to 40 bits and
    sorted, so that what two texts share by weight is what their sets share. (That any cells of two texts of 20,000 words
    collide, which moves their likeness by 1 in 20,000, has a chance of 1 in 2,700.)"""
    at = np.repeat(np.arange(len(gram)), count)
    rank = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    cell, of = mix(gram[at] + rank.astype(np.uint64) * ODD) >> np.uint64(64 - 8 * CELL), of[at]
    order = np.lexsort((cell, of))
    raw = cell[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :CELL]
    ends = np.cumsum(np.bincount(of, minlength=texts)).astype(np.int64)
    return [raw[a:b].tobytes() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def cell_array(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // CELL, 8), np.uint8)
    wide[:, :CELL] = np.frombuffer(raw, np.uint8).reshape(-1, CELL)
    return wide.view("<u8").ravel()

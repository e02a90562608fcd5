"""Token ids of whole texts by the public word BPE, through a cache of blank-separated words.

A text whose characters are all plain (see PLAIN) is normalised by lower-casing alone and no token crosses a blank, so
its ids are those of its words in turn. New words go through the same merges in one call of a faster library, with a
byte END in place of the word-end mark; any other text is encoded as it stands. Tests hold both against the tokenizer.
"""

from __future__ import annotations

import json
import os
import re
from functools import cache

import numpy as np

#: Latin letters, digits, punctuation and ordinary blanks: already composed, and lower-cased one by one in any library.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-įı-ňŊ-ſ–—‘-„€]*")
#: Stands for the word-end mark; no plain text holds it.
END = "\x01"
#: Words kept by a worker, about 25 MB.
WORDS = 100_000


def byte_of() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from
    U+0100 on."""
    shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, words: int = WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, self.words, self.kept = Tokenizer.from_file(path), words, {}
        spec = json.loads(self.tokenizer.to_str())
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern)
        chars, mark = byte_of(), spec["model"]["end_of_word_suffix"]

        def raw(token: str) -> bytes:
            core = token.removesuffix(mark)
            return bytes(chars[c] for c in core) + END.encode() * (core != token)

        joined = [raw("".join(m)) for m in (x.split(" ") if isinstance(x, str) else x for x in merges)]
        order = [bytes([b]) for b in range(256)] + [bytes([b]) + END.encode() for b in range(256)] + joined  # a word's last byte takes its mark first
        ranks = {token: i for i, token in enumerate(dict.fromkeys(order))}
        special = {t["content"] for t in spec["added_tokens"]}
        self.ids = np.zeros(len(ranks), dtype="<u4")
        for token, i in vocab.items():
            if token not in special:
                self.ids[ranks[raw(token)]] = i
        self.merger = tiktoken.Encoding("words", pat_str=f"[^{END} ]+{END}| ", mergeable_ranks=ranks, special_tokens={})

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        ranks = np.array(self.merger.encode_ordinary(self.pieces.sub(rf"\g<0>{END}", " ".join(words))), dtype=np.int64)
        blanks = np.flatnonzero(ranks == ord(" "))
        raw = self.ids[ranks].tobytes()
        for w, a, b in zip(words, [0, *(blanks * 4 + 4).tolist()], [*(blanks * 4).tolist(), len(raw)], strict=True):
            self.kept[w] = raw[a:b]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; none for null and empty ones."""
        if len(self.kept) > self.words:
            self.kept.clear()
        cut: list[list[str] | None] = []
        new: set[str] = set()
        for text in texts:
            if text and PLAIN.fullmatch(text) and "<|" not in text:
                words = text.lower().split()
                new |= set(words).difference(self.kept)
                cut.append(words)
            else:
                cut.append(None)
        if new:
            self._learn(list(new))
        get = self.kept.__getitem__
        return [b"".join(map(get, words)) if words is not None else self._whole(text) if text else b"" for text, words in zip(texts, cut, strict=True)]


@cache
def encoder(path: str) -> Encoder:
    """One for each worker process; its cache outlives a task."""
    return Encoder(path)

"""Encoding whole texts with a public tokenizer, one distinct word at a time."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Words kept in each of the two generations of a worker's cache.
CACHE_WORDS = 600_000
_LONG_WORD = 64


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Texts to ids, equal to encoding the whole text.

    The tokenizer drops white space and no token or normal form reaches over it, so the ids of a
    text are those of its words in turn. Words are encoded once per worker and kept as bytes; the
    cache holds two generations of bounded size, so memory doesn't grow with the corpus.
    """

    def __init__(self, path: str, special_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_text
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        outer = self

        class Words(dict):
            def __missing__(self, word):
                return outer._add(word)

        self.words, self.old = Words(), {}

    def _encode(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, self.dtype).tobytes()

    def _add(self, word: bytes) -> bytes:
        if len(word) > _LONG_WORD:
            return self._encode(word)
        found = self.old.get(word)
        if found is None:
            core = word.rstrip(b".,")
            if core and len(core) < len(word) and core[-1:].isalpha() and core.isascii():
                found = self.words[core] + self.words[word[len(core) :]]
            else:
                found = self._encode(word)
        if len(self.words) >= CACHE_WORDS:
            self.old = dict(self.words)
            self.words.clear()
        self.words[word] = found
        return found

    def encode(self, text: bytes) -> bytes:
        """The ids of a whole UTF-8 text, as little-endian numbers of ``dtype``.

        The text is cut at ASCII white space alone: what else counts as space is the tokenizer's affair.
        """
        if not (b"\xcc" in text or b"\xcd" in text or b"<|" in text):
            text = text.lower()  # A-Z; no combining mark that would compose otherwise, no special token
        return b"".join(map(self.words.__getitem__, text.split()))


@lru_cache(maxsize=2)
def encoder(path: str, special_text: bool = False) -> Encoder:
    """The worker's encoder; workers are used again, and so is its cache."""
    return Encoder(path, special_text)

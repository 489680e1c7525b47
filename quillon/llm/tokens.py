"""Token ids of whole texts, quick enough for a corpus.

The tokenizers library encodes each different word once in a Python worker; texts are put together from the words'
ids. A space before a non-space always begins a new unit of the byte-level vocabulary, and nothing before it changes
how the rest is cut, so the ids equal those of the whole text.
"""

from __future__ import annotations

import os
import re
from array import array

from quillon.llm.memory import claim, remembers

#: Words that a worker remembers; the memory is emptied when full, which changes no result.
CACHE_WORDS = 1_200_000
END_ID = 0
_BREAK = re.compile(r" (?=\S)")
_ODD = re.compile(r" (?:\s|$)")
_ENCODERS: dict[str, "Encoder"] = {}


remembers("tokens", _ENCODERS.clear)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Words(dict):
    """Ids of words, learned when first asked for. A later word has a space before it."""

    def __init__(self, owner: Encoder, lead: str):
        self.owner, self.lead = owner, lead

    def __missing__(self, word: str) -> bytes:
        own = self.owner
        if word.isalpha():  # one unit of the vocabulary's cutting: its merges alone decide
            ids = own.merge(self.lead + word)
        elif word[-1:] in (".", ",") and word[:-1].isalpha():
            ids = self[word[:-1]] + own.marks[word[-1]]
        elif "\n" in word and (parts := word.split("\n")) == word.split():
            ids = own.marks["\n"].join([self[parts[0]], *(own.first[p] for p in parts[1:])])
        else:
            ids = own.whole(self.lead + word)
        self[word] = ids
        return ids


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True  # their strings in a text are ordinary text
        # the byte-level alphabet: printable bytes stand for themselves, the rest for characters from 256 on
        own = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = iter(range(256, 512))
        self.alphabet = {b: b if b in own else next(rest) for b in range(256)}
        self.bpe = self.model.model
        self.marks = {c: self.whole(c) for c in ".,\n"}
        self.first, self.later = _Words(self, ""), _Words(self, " ")

    @classmethod
    def of(cls, path: str) -> Encoder:
        claim("tokens")
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def whole(self, text: str) -> bytes:
        return array("I", self.model.encode(text, add_special_tokens=False).ids).tobytes() if text else b""

    def merge(self, unit: str) -> bytes:
        letters = unit.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.bpe.tokenize(letters)]).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; null counts as empty."""
        if len(self.first) + len(self.later) > CACHE_WORDS:
            self.first.clear(), self.later.clear()
        first, get, out = self.first, self.later.__getitem__, []
        for t in texts:
            if t:
                words = iter(_BREAK.split(t) if _ODD.search(t) else t.split(" "))
                out.append(first[next(words)] + b"".join(map(get, words)))
            else:
                out.append(b"")
        return out

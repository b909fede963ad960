"""Token ids of whole texts by a public tokenizer's file, with a cache of words.

Byte pairs are merged within a word only, so a word's ids never depend on its neighbours. Texts of common scripts are cut
into words by the tokenizer's own rules, and each distinct word is merged once for as long as the cache holds it. Any
other text (special tokens, letters beyond Latin, rare white space) is given to the tokenizer as it is.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
from tokenizers import Tokenizer

#: The pattern that the tokenizer's file states, for texts that _PLAIN lets through, in this language's syntax.
_FILE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: Characters whose class, case or composition the two regular expression engines might see differently, and the start of special tokens.
_OTHER = re.compile("[^\\x00-\\u024f]|[\\x1c-\\x1f\\x85\\xa0²³¹¼-¾İ]|<\\|")
#: Longer words aren't kept, so the cache has a bound in bytes, too.
LONGEST = 64
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies use for each byte: printable ones stand for themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class CachedTokenizer:
    """encode(text) gives the ids as packed little-endian unsigned 32-bit numbers, as the tokenizer would without special tokens added."""

    def __init__(self, description: str, most: int = 250_000) -> None:
        self.tokenizer = Tokenizer.from_str(description)
        file = json.loads(description)
        kinds = [x["type"] for x in (file.get("normalizer") or {}).get("normalizers", [])]
        patterns = [x.get("pattern", {}).get("Regex") for x in (file.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.cacheable = kinds == _NORMALIZERS and _FILE_PATTERN in patterns
        self.letters = _byte_letters()
        self.most, self.words, self.chunks = most, {}, {}

    def _word(self, word: str) -> bytes:
        if (ids := self.words.get(word)) is None:
            spelt = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)
            ids = array("I", [t.id for t in self.tokenizer.model.tokenize(spelt)]).tobytes()
            if len(self.words) >= self.most:
                self.words.clear()
            if len(word) <= LONGEST:
                self.words[word] = ids
        return ids

    def _chunk(self, chunk: str) -> bytes:
        ids = b"".join(map(self._word, _WORDS.findall(chunk)))
        if len(self.chunks) >= self.most:
            self.chunks.clear()
        if len(chunk) <= LONGEST:
            self.chunks[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not self.cacheable or _OTHER.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        known, out = self.chunks.get, []
        for chunk in text.lower().split():
            if (ids := known(chunk)) is None:
                ids = self._chunk(chunk)
            out.append(ids)
        return b"".join(out)

"""Ids of a byte-level BPE tokenizer of the `tokenizers` library, by cached pre-tokens.

Where the tokenizer drops white space and lower-cases (the known normaliser and splitting
rule below), the ids of a text are the ids of its pre-tokens one after another. Plain
texts (ASCII and Latin-1 letters) are split by an equal regular expression and each
distinct pre-token is merged by the library's model once per worker; other texts are cut
at spaces and each distinct chunk goes through the library itself. Any other tokenizer
encodes whole texts. All three give the ids of ``encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np

#: Entries that a worker keeps before it starts again; it bounds memory, never results.
CACHE_ENTRIES = 400_000
BLOCK_CHARS = 1 << 20

_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_PLAIN = re.compile("[\t-\r -~À-ÖØ-öø-ÿ]*").fullmatch
_TOKENS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\s0-9a-zß-öø-ÿ]+").findall
_BLANK = re.compile("[ \t\n\r]")


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class _Cache(dict):
    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.encode(word), "<u4").tobytes()
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        if len(word) <= 64:
            self[word] = ids
        return ids


class WordBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t["content"] for t in said.get("added_tokens", [])]
        first = ((said.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.split_at_blanks = (said.get("normalizer") or {}).get("normalizers") == _NORMALIZERS and first.get("pattern", {}).get("Regex") == _SPLIT
        letters, model = _byte_letters(), self.tokenizer.model
        self._plain = _Cache(lambda w: [t.id for t in model.tokenize("".join([letters[b] for b in w.encode()]))])
        self._chunks = _Cache(lambda w: self.tokenizer.encode(w, add_special_tokens=False).ids)

    def encode(self, text: str) -> np.ndarray:
        """All ids of the text, as little-endian unsigned 32-bit integers."""
        if not self.split_at_blanks:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return np.frombuffer(b"".join([self._block(b) for b in blocks(text)]), "<u4")

    def _block(self, text: str) -> bytes:
        if _PLAIN(text) and not any(s in text for s in self.specials):
            return b"".join(map(self._plain.__getitem__, _TOKENS(text.lower())))
        return b"".join(map(self._chunks.__getitem__, [w for w in _BLANK.split(text) if w]))


def blocks(text: str) -> Iterator[str]:
    """The text cut at white space into pieces of about BLOCK_CHARS."""
    at = 0
    while len(text) - at > BLOCK_CHARS:
        found = _BLANK.search(text, at + BLOCK_CHARS)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end
    yield text[at:] if at else text


_loaded: dict[str, WordBpe] = {}


def tokenizer(path: str) -> WordBpe:
    """The tokenizer, loaded once in a worker."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)

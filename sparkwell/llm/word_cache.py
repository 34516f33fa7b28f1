"""Token ids by the tokenizers library, remembered chunk by chunk.

Both vocabularies cut a text at white space before they merge anything, so the
ids of a text are the ids of its chunks one after the other.  Texts with the
string of an added token go to the library as a whole.  Each Python
worker keeps the ids of the chunks it has met in a bounded table; the library
sees every other chunk once.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

from xxhash import xxh3_128_digest

#: Chunks kept in a worker, and the longest one kept, in characters.
MOST_CHUNKS, LONGEST_CHUNK = 800_000, 64
#: Characters of the shortest text, and bytes of ids, that are kept for copies.
SHORTEST_COPY, MOST_COPIED = 200, 1 << 24
#: White space that byte-level splitting treats by what stands next to it.
_UNEVEN = re.compile(r"\s\s|[^\S \n]|\s\Z")
#: Letters, then marks (all of ASCII but the apostrophe): chunks whose cuts and
#: lower case need no tables.  Both vocabularies cut them there and nowhere else.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable
    Latin-1 signs stand for themselves, the others are numbered from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_BYTE_LETTERS = _byte_letters()

_loaded: dict[str, ChunkedTokenizer] = {}


def tokenizer(name: str, most_chunks: int = MOST_CHUNKS) -> ChunkedTokenizer:
    """The worker's tokenizer for a vocabulary file of ``public_tokenizers`` (or
    a path); one a process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if name not in _loaded:
        _loaded[name] = ChunkedTokenizer(name, most_chunks)
    return _loaded[name]


def _packed(ids: list[int]) -> bytes:
    out = array("H", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class _Known(dict):
    """Ids of chunks that stand after ``lead``; learns those it lacks while there
    is room."""

    def __init__(self, of: ChunkedTokenizer, lead: str) -> None:
        super().__init__()
        self._of, self.lead = of, lead

    def __missing__(self, chunk: str) -> bytes:
        ids = self._of._encode(chunk, self)
        if len(self) < self._of.most_chunks and len(chunk) <= LONGEST_CHUNK:
            self[chunk] = ids
        return ids


class ChunkedTokenizer:
    def __init__(self, name: str, most_chunks: int = MOST_CHUNKS) -> None:
        self.most_chunks = most_chunks
        import json

        import public_tokenizers
        from tokenizers import Tokenizer

        path = name if os.path.isabs(name) else public_tokenizers.path(name)
        self._library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self._spaced = told["pre_tokenizer"]["type"] == "ByteLevel"  # a chunk there includes the space before it
        added = [re.escape(t["content"]) for t in told["added_tokens"]]
        self._added = re.compile("|".join(added) or r"(?!)", re.I)
        # what all of them begin with, up to the first letter, is quickly looked for
        self._sign = re.match(r"[^A-Za-z]*", os.path.commonprefix([t["content"] for t in told["added_tokens"]]))[0]
        self._model = self._library.model
        self._marks: dict[str, bytes] = {}
        self._copies: dict[bytes, bytes] = {}
        self._held = 0
        self._first = _Known(self, "")
        self._later = _Known(self, " ")

    def _one(self, chunk: str) -> list[int]:
        return self._library.encode(chunk, add_special_tokens=False).ids

    def _merged(self, letters: str, lead: str) -> bytes:
        """Ids of letters that are not cut any further, by the library's model alone."""
        if self._spaced:
            letters = lead + letters
        else:
            letters = letters.lower()
        if letters.isascii():
            shown = letters.replace(" ", _BYTE_LETTERS[0x20])  # ASCII letters stand for themselves
        else:
            shown = letters.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return _packed([t.id for t in self._model.tokenize(shown)])

    def _encode(self, chunk: str, known: _Known) -> bytes:
        if chunk.isascii() and chunk.isalpha():
            return self._merged(chunk, known.lead)
        plain = _PLAIN.fullmatch(chunk)
        if not plain:
            return _packed(self._one(known.lead + chunk))
        letters, marks = plain.groups()
        if not marks:
            return self._merged(letters, known.lead)
        if marks not in self._marks:
            self._marks[marks] = _packed(self._one(marks))
        return known[letters] + self._marks[marks]

    def ids(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 16-bit integers."""
        return [self._text(t) for t in texts]

    def _text(self, text: str) -> bytes:
        """Ids of a text; copies of a text met lately are not read again."""
        if len(text) < SHORTEST_COPY:
            return self._read(text)
        key = xxh3_128_digest(text.encode("utf-8", "surrogatepass"))
        ids = self._copies.get(key)
        if ids is None:
            ids = self._read(text)
            self._held += len(ids)
            if self._held > MOST_COPIED:
                self._copies.clear()
                self._held = len(ids)
            self._copies[key] = ids
        return ids

    def _read(self, text: str) -> bytes:
        if self._sign in text and self._added.search(text):  # the library cuts such texts there first
            return _packed(self._one(text))
        if not self._spaced:
            return b"".join(map(self._first.__getitem__, text.replace("\n", " ").split(" ")))
        return _packed(self._one(text)) if _UNEVEN.search(text) else self._by_line(text)

    def _by_line(self, text: str) -> bytes:
        first, later, out = self._first, self._later.__getitem__, []
        for line in text.split("\n"):
            words = line.split(" ")
            out.append(first[words[0]] + b"".join(map(later, words[1:])))
        return first["\n"].join(out)

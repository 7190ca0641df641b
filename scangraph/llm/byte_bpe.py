"""Byte-level BPE ids of whole texts, by the tokenizers library, word by word.

The library's splitter never joins text across a single space that ends a word, nor across a single line break, so
the ids of a text are those of its parts: line breaks, and words with the space before them. Parts repeat, texts
don't: the distinct parts of a batch of texts are found at once, each worker keeps the ids of those it has seen and
asks the library for new ones only, and the ids of the batch are put together from them as arrays. Texts with runs
of white space, where that doesn't hold, go to the library whole.
"""

from __future__ import annotations

import os
import re
import string
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from scangraph.llm.common import tokenizer_path

TOKENIZER = "byte_bpe_50k.json"

#: Parts that a worker has asked for last, at least; at most twice as many are kept (about 200 bytes each).
#: A worker stays for the steps behind and holds them beside theirs.
KEPT_WORDS = 200_000
#: Bytes of text whose parts are looked up together.
TOGETHER = 2 << 20

#: Three blanks in a row are not cut alike wherever they stand, nor are two at the end; a part's end is marked by NUL.
_WHOLE = re.compile(r"\s\s\s|\s\s\Z|\x00")
#: Blanks other than space and line break, and pairs of these two: a text without them needs no closer look.
_BLANKS = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]
_PAIRS = ["\n\n", "  ", " \n", "\n ", "\0"]


def _goes_whole(body: str) -> bool:
    odd = any(pair in body for pair in _PAIRS) or any(blank in body for blank in _BLANKS)
    return odd and _WHOLE.search(body) is not None


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 characters stand
    for themselves, the other bytes, in order, for the characters from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


_LETTERS = _byte_letters()


class _Parts(dict):
    """Ids of parts, made when first asked for."""

    def __init__(self, library, code: str):
        super().__init__()
        self.library, self.code = library, code
        self.older: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def __missing__(self, part: str) -> bytes:
        ids = self.older.get(part)
        if ids is None:
            ids = self._ids(part)
        if len(self) >= KEPT_WORDS:
            self.older = dict(self)
            self.clear()
        self[part] = ids
        return ids

    def _ids(self, part: str) -> bytes:
        word = part.lstrip(" ")
        letters = word.rstrip(string.punctuation)
        if not letters.isalpha():
            return self.whole(part)
        # Letters alone are not split further, so they can go to the library's model directly. Marks behind them are
        # a word of their own.
        marks = word[len(letters) :]
        if not marks:
            own = part.encode().decode("latin-1").translate(_LETTERS)
            return array(self.code, [token.id for token in self.library.model.tokenize(own)]).tobytes()
        ids = self[part[: len(part) - len(marks)]]
        if marks not in self.marks:
            if len(self.marks) >= 10_000:
                self.marks.clear()
            self.marks[marks] = self.whole(marks)
        return ids + self.marks[marks]

    def whole(self, text: str) -> bytes:
        return array(self.code, self.library.encode(text, add_special_tokens=False).ids).tobytes()


class ByteBpe:
    """Ids as little-endian unsigned integers of 16 bits (32 for larger vocabularies)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.code = "H" if self.library.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = "<u2" if self.code == "H" else "<u4"
        self._parts = _Parts(self.library, self.code)

    def ids(self, text: bytes) -> bytes:
        """Ids of one text."""
        return next(self.ids_of([text]))

    def ids_of(self, bodies: list[bytes]) -> Iterator[bytes]:
        """Ids of each of the texts, in order."""
        held, size = [], 0
        for body in bodies:
            held.append(bytes(body).decode("utf-8", "replace"))
            size += len(body)
            if size >= TOGETHER:
                yield from self._together(held)
                held, size = [], 0
        yield from self._together(held)

    def _together(self, bodies: list[str]) -> Iterator[bytes]:
        # A text that goes to the library whole is one part; it isn't kept.
        whole = [_goes_whole(body) for body in bodies]
        marked = [
            "" if alone else body.replace(" ", "\0 ").replace("\n", "\0\n\0")
            for alone, body in zip(whole, bodies, strict=True)
        ]
        listed = pc.split_pattern(pa.array(marked, pa.large_string()), "\0")
        coded = listed.flatten().dictionary_encode()
        found = list(map(self._parts.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False)))
        tokens = np.frombuffer(b"".join(found), self.dtype)
        lengths = np.array([len(ids) for ids in found], np.int64) // np.dtype(self.dtype).itemsize
        starts = np.cumsum(lengths) - lengths
        part = coded.indices.to_numpy()
        own = lengths[part]
        ends = np.cumsum(own)
        places = np.repeat(starts[part] - (ends - own), own)
        places += np.arange(len(places))
        flat = tokens[places]
        bounds = np.concatenate([[0], ends])[listed.offsets.to_numpy()]
        for i, alone in enumerate(whole):
            yield self._parts.whole(bodies[i]) if alone else flat[bounds[i] : bounds[i + 1]].tobytes()


@lru_cache(maxsize=2)
def byte_bpe(path: str | None = None) -> ByteBpe:
    """One encoder per worker process and file."""
    return ByteBpe(path or tokenizer_path(TOKENIZER))

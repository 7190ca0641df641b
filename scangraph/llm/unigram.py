"""A SentencePiece vocabulary read as a unigram model: the segmentation of largest total score.

A text is escaped as the library does it: a blank is ``▁`` and one more stands in front. Characters that
no piece has, and ``▁`` itself in a text, become byte pieces (or the unknown piece without those).
Of equal totals, the one whose last piece is longest is taken, as in the library.
"""

from __future__ import annotations

import re
from functools import lru_cache

from scangraph.llm.common import tokenizer_path

MODEL = "piece_bpe_32k.model"
BLANK = "▁"
#: Stands for a ``▁`` of the text while blanks are escaped.
_LITERAL = "﷐"
#: What a character without a piece costs below the least score, as in the library.
UNKNOWN_PENALTY = 10.0
_MARKED = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")


class Unigram:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        special = [i for i in ids if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)]
        self.unknown = model.unk_id()
        self.names = [model.id_to_piece(i) for i in ids]
        self.bytes = {int(self.names[i][3:5], 16): i for i in ids if model.is_byte(i)}
        plain = set(ids) - set(special) - set(self.bytes.values())
        self.pieces = {self.names[i]: (i, model.get_score(i)) for i in plain}
        self.unknown_score = min(score for _, score in self.pieces.values()) - UNKNOWN_PENALTY
        self.longest = max(map(len, self.pieces))
        #: Longest piece by its last character, so that a search backwards knows where to stop.
        self.reach: dict[str, int] = {}
        for piece in self.pieces:
            self.reach[piece[-1]] = max(len(piece), self.reach.get(piece[-1], 1))
        #: No piece runs from another character into a blank: then every word stands for itself.
        self.parted = not any(re.search(f"[^{BLANK}]{BLANK}", piece) for piece in self.pieces)

    def escape(self, text: str) -> str:
        if not text:
            return ""
        return BLANK + text.replace(BLANK, _LITERAL).replace(" ", BLANK)

    def segments(self, escaped: str) -> list[str]:
        """Parts between which every segmentation has a boundary."""
        return _MARKED.findall(escaped) if self.parted else [escaped] if escaped else []

    def fallback(self, character: str) -> list[int]:
        character = BLANK if character == _LITERAL else character
        raw = character.encode("utf-8", "replace")
        return [self.bytes.get(b, self.unknown) for b in raw] if self.bytes else [self.unknown]

    def best_ends(self, text: str, starts: dict[int, float]) -> tuple[list[float], list[int]]:
        """Best score of reaching each position from ``starts``, and the start of the last piece there."""
        n = len(text)
        best, back = [float("-inf")] * (n + 1), [-1] * (n + 1)
        for at, score in starts.items():
            best[at] = score
        pieces, reach, lost = self.pieces, self.reach, self.unknown_score
        for end in range(1, n + 1):
            top, origin = best[end], -1
            for start in range(max(0, end - reach.get(text[end - 1], 1)), end):
                if best[start] == float("-inf"):
                    continue
                found = pieces.get(text[start:end])
                if found is not None:
                    score = best[start] + found[1]
                elif start == end - 1:
                    score = best[start] + lost
                else:
                    continue
                if score > top:
                    top, origin = score, start
            best[end], back[end] = top, origin
        return best, back

    def trace(self, text: str, back: list[int], end: int) -> list[int]:
        """Ids of the pieces that lead to ``end``."""
        parts: list[list[int]] = []
        while back[end] >= 0:
            start = back[end]
            found = self.pieces.get(text[start:end])
            parts.append([found[0]] if found else self.fallback(text[start]))
            end = start
        return [i for part in reversed(parts) for i in part]

    def segment(self, text: str) -> tuple[list[int], float]:
        best, back = self.best_ends(text, {0: 0.0})
        return self.trace(text, back, len(text)), best[-1]

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``; bytes that are no UTF-8 become replacement characters."""
        out = bytearray()
        values = {i: b for b, i in self.bytes.items()}
        for i in ids:
            if i in values:
                out.append(values[i])
            else:
                out += self.names[i].replace(BLANK, " ").encode()
        return out.decode("utf-8", "replace")[1:]


@lru_cache(maxsize=2)
def unigram(path: str | None = None) -> Unigram:
    """One model per worker process and file."""
    return Unigram(path or tokenizer_path(MODEL))

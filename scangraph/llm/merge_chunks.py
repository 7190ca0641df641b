"""Chunks of giant texts under a SentencePiece model of the BPE kind, for the max-plus scan.

Which tokens may follow depends on the last one only (``piece_bpe``), so the boundary state of two chunks is the token
that ends at or first behind the boundary: how far it reaches into the next chunk, and how long it is. A chunk's
matrix tells which states at its end can be reached from which at its start: entries are 0 or minus infinity, kept
as bits. Products of such matrices (maximum of sums) are those of truth values. A text has one encoding, so one
path of states leads through all chunks.
"""

from __future__ import annotations

import re

import numpy as np

from scangraph.llm.piece_bpe import PieceBpe
from scangraph.llm.unigram import BLANK

_CUT = re.compile(f"[^{BLANK}]{BLANK}")

State = tuple[int, int]  # how far behind the boundary the token ends, and its length; (0, 0) in front of the text


class States:
    """Numbers of the boundary states of a model."""

    def __init__(self, longest: int):
        self.longest, self.number = longest, longest * longest + 1

    def place(self, state: State) -> int:
        reach, size = state
        return self.number - 1 if not size else reach * self.longest + size - 1

    def state(self, place: int) -> State:
        return (0, 0) if place == self.number - 1 else (place // self.longest, place % self.longest + 1)

    def pack(self, matrix: np.ndarray) -> bytes:
        return np.packbits(matrix).tobytes()

    def unpack(self, blob: bytes) -> np.ndarray:
        bits = np.unpackbits(np.frombuffer(blob, np.uint8), count=self.number**2)
        return bits.reshape(self.number, self.number).astype(bool)


def product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Max-plus product of matrices of 0 and minus infinity, as truth values."""
    # Few states can be reached, so most rows and columns are empty.
    rows, between = np.flatnonzero(left.any(axis=1)), np.flatnonzero(left.any(axis=0) & right.any(axis=1))
    out = np.zeros((len(left), right.shape[1]), bool)
    out[rows] = left[np.ix_(rows, between)].astype(np.float32) @ right[between].astype(np.float32) > 0
    return out


class MergeChunk:
    """``size`` characters of an escaped text from ``at`` on; ``text`` has what tokens may reach on both sides.

    ``first`` and ``last`` tell of chunks at the ends of the text.
    """

    def __init__(self, model: PieceBpe, text: str, at: int, size: int, first: bool, last: bool):
        self.model, self.text, self.at, self.size, self.first, self.last = model, text, at, size, first, last
        self.end = at + size
        self.stop = self.end if last else min(len(text), self.end + model.longest - 1)
        # The outermost places that no token spans, as parts stand for themselves.
        self.inner = self._cuts() if model.parted else None

    def _cuts(self) -> tuple[int, int] | None:
        """First and last place inside the chunk where a run of blanks begins behind another character."""
        first = _CUT.search(self.text, self.at, self.end)
        if first is None:
            return None
        place = self.text.rfind(BLANK, self.at, self.end)
        while self.text[place - 1] == BLANK:
            place -= 1
        # Blanks at the chunk's very begin are no cut, but then the first one is behind them.
        return first.start() + 1, place

    def middle(self) -> str:
        """Whole parts that stand for themselves, wherever tokens end at the chunk's ends."""
        return self.text[slice(*self.inner)] if self.inner else ""

    def _is_token(self, token: str) -> bool:
        return token in self.model.pieces or len(token) == 1

    def entries(self) -> list[State]:
        """States that the text before the chunk allows."""
        if self.first:
            return [(0, 0)]
        found = []
        for reach in range(min(self.model.longest, len(self.text) - self.at + 1)):
            for size in range(reach + 1, min(self.model.longest, self.at + reach) + 1):
                end = self.at + reach
                if self._is_token(self.text[end - size : end]):
                    found.append((reach, size))
        return found

    def _spread(self, begin: dict[int, dict[int, int]], until: int) -> dict[int, dict[int, int]]:
        """From tokens by where they end and their length, all that can follow and begin before ``until``.

        The values are bits of the states they come from.
        """
        model, text = self.model, self.text
        table = {place: dict(own) for place, own in begin.items()}
        for place in range(min(table, default=until), until):
            own = table.get(place)
            if not own:
                continue
            for size in range(1, min(model.longest, self.stop - place) + 1):
                token = text[place : place + size]
                if not self._is_token(token):
                    continue
                bits = 0
                for before, known in own.items():
                    if not before or model.follows(text[place - before : place], token):
                        bits |= known
                if bits:
                    ends = table.setdefault(place + size, {})
                    ends[size] = ends.get(size, 0) | bits
        return table

    def _begin(self, entries: list[State]) -> dict[int, dict[int, int]]:
        begin: dict[int, dict[int, int]] = {}
        for i, (reach, size) in enumerate(entries):
            begin.setdefault(self.at + reach, {})[size] = 1 << i
        return begin

    def _exits(self, table: dict[int, dict[int, int]]) -> dict[State, int]:
        return {
            (place - self.end, size): bits
            for place, own in table.items()
            if self.end <= place <= self.stop
            for size, bits in own.items()
        }

    def matrix(self, states: States) -> np.ndarray:
        entries = self.entries()
        out = np.zeros((states.number, states.number), bool)
        if self.inner:
            low, high = self.inner
            head = self._spread(self._begin(entries), low)
            reached = 0
            for bits in head.get(low, {}).values():
                reached |= bits
            # Behind a cut any token may follow.
            exits = {s: reached for s in self._exits(self._spread({high: {0: 1}}, self.end))}
            # A token of the text before may reach over the whole chunk only where there is no cut.
        else:
            exits = self._exits(self._spread(self._begin(entries), self.end))
        for state, bits in exits.items():
            for i, entry in enumerate(entries):
                if bits >> i & 1:
                    out[states.place(entry), states.place(state)] = True
        return out

    def _back(self, table: dict[int, dict[int, int]], place: int, size: int, begin: int) -> list[int]:
        """Ids of the tokens from ``begin`` on up to the one of ``size`` characters that ends at ``place``."""
        tokens: list[list[int]] = []
        while place > begin:
            token = self.text[place - size : place]
            tokens.append(self.model.token_ids(token))
            place -= size
            if place > begin:
                fitting = [b for b in table[place] if self.model.follows(self.text[place - b : place], token)]
                size = fitting[0]
        return [i for token in reversed(tokens) for i in token]

    def ids(self, enter: State, leave: State, parts: bytes | None = None) -> bytes:
        """Ids of the tokens that begin in the chunk, between two states; ``parts`` are those of ``middle``, if known."""
        begin = self.at + enter[0]
        if begin >= self.end:
            return b""
        if not self.inner:
            table = self._spread(self._begin([enter]), self.end)
            return np.array(self._back(table, self.end + leave[0], leave[1], begin), "<u4").tobytes()
        low, high = self.inner
        head = self._spread(self._begin([enter]), low)
        found = self._back(head, low, next(iter(head[low])), begin) if low > begin else []
        if parts is None:
            parts = b"".join([ids for _, _, _, ids in self.model.encode_escaped([self.middle()])])
        tail = self._back(self._spread({high: {0: 1}}, self.end), self.end + leave[0], leave[1], high)
        return np.array(found, "<u4").tobytes() + parts + np.array(tail, "<u4").tobytes()

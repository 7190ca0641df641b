"""The encoding of a SentencePiece model of the BPE kind, found by prefixes instead of merges.

A text is escaped as the library does it: a blank is ``▁`` and one more stands in front; like the library, a ``▁`` of
the text is read as a blank. No piece runs from another character into a blank, so each part between blanks stands for
itself.

The last token of a prefix's encoding depends on the prefix alone: it is the one piece that ends there and may stand
behind the last token of what is left without it. Two pieces may stand side by side if the model's merges
leave them so when they are encoded together. Sequences in which all neighbours do are encodings. A character that
no piece has becomes its bytes; merges never reach across it.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from scangraph.llm.common import tokenizer_path
from scangraph.llm.unigram import BLANK, MODEL, Unigram

#: Answers on neighbours that a worker keeps, and parts that it has asked for last (at most twice as many are kept).
KEPT_PAIRS, KEPT_PARTS = 500_000, 150_000
#: Bytes of text whose parts are looked up together.
TOGETHER = 4 << 20


class PieceBpe:
    """Prefix rules of one model, and the results for parts that it has seen."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        # Parts come escaped, with the blank in front that the library would add.
        proto.normalizer_spec.add_dummy_prefix = False
        self.library = SentencePieceProcessor(model_proto=proto.SerializeToString())
        model = Unigram(path)
        self.segments, self.longest, self.bytes, self.unknown = model.segments, model.longest, model.bytes, model.unknown
        self.parted = model.parted
        #: Pieces that the merges reach, by what they are; others are never a token.
        self.pieces = {piece: i for piece, (i, _) in model.pieces.items() if self.library.encode(piece) == [i]}
        self.scores = [self.library.get_score(i) for i in range(self.library.get_piece_size())]
        values = {i: bytes([b]) for b, i in model.bytes.items()}
        surfaces = [values.get(i, n.replace(BLANK, " ").encode()) for i, n in enumerate(model.names)]
        self._surfaces = pa.array(surfaces, pa.large_binary())
        self.names = model.names
        self._automaton()
        #: Whether two pieces may stand side by side, by ``left * len(names) + right``.
        self._pairs: dict[int, bool] = {}
        self._known: dict[str, tuple[int, float, bytes]] = {}
        self._older: dict[str, tuple[int, float, bytes]] = {}
        self._with_ids = False

    @staticmethod
    def escape(text: str) -> str:
        return BLANK + text.replace(" ", BLANK) if text else ""

    def fallback(self, character: str) -> list[int]:
        """Ids of a character that no piece has."""
        raw = character.encode("utf-8", "replace")
        return [self.bytes.get(b, self.unknown) for b in raw] if self.bytes else [self.unknown]

    def _automaton(self) -> None:
        """States are beginnings of pieces: the longest with which the text read so far ends (Aho and Corasick).

        ``_steps`` has the next state by character, the first state where none is given; ``_ends`` the lengths and ids of
        the pieces that end there, the longest first.
        """
        steps: list[dict[str, int]] = [{}]
        own: dict[int, tuple[int, int]] = {}
        for piece, i in self.pieces.items():
            state = 0
            for character in piece:
                after = steps[state].get(character)
                if after is None:
                    after = steps[state][character] = len(steps)
                    steps.append({})
                state = after
            own[state] = (len(piece), i)
        self._steps, self._ends = steps, [()] * len(steps)
        self._fails = [0] * len(steps)
        self._children = [tuple(step) for step in steps]
        level = [0]
        while level:
            deeper = []
            for state in level:
                self._ends[state] = ((own[state],) if state in own else ()) + (self._ends[self._fails[state]] if state else ())
                for character in self._children[state]:
                    after = steps[state][character]
                    self._fails[after] = self._step(self._fails[state], character) if state else 0
                    deeper.append(after)
            level = deeper
        del self._children

    def _step(self, state: int, character: str) -> int:
        while True:
            after = self._steps[state].get(character)
            if after is not None or not state:
                return after or 0
            state = self._fails[state]

    def follows(self, left: str, right: str) -> bool:
        """Whether the tokens ``left`` and ``right`` may stand side by side."""
        before, after = self.pieces.get(left), self.pieces.get(right)
        if before is None or after is None:
            return True
        found = self._pairs.get(before * len(self.names) + after)
        return self._fits(before, after) if found is None else found

    def _fits(self, left: int, right: int) -> bool:
        both = self.names[left] + self.names[right]
        found = both not in self.pieces and self.library.encode(both) == [left, right]
        if len(self._pairs) >= KEPT_PAIRS:
            self._pairs.clear()
        self._pairs[left * len(self.names) + right] = found
        return found

    def token_ids(self, token: str) -> list[int]:
        own = self.pieces.get(token)
        return self.fallback(token) if own is None else [own]

    def _walk(self, parts: Iterable[str]) -> Iterator[tuple[str, list[int], list[int]]]:
        """Each of the distinct ``parts``, in sorted order: length and id of the last token at the end of every prefix; the
        id is -1 for a character that no piece has.

        Sorted order is the depth-first order of the parts' trie, so each shared prefix is worked on once. The
        lists are used again for the next part.
        """
        steps, all_ends, fails, pairs, number = self._steps, self._ends, self._fails, self._pairs, len(self.names)
        sizes, lasts, states, before = [0], [-1], [0], ""
        for part in sorted(parts):
            shared, most = 0, min(len(before), len(part))
            while shared < most and before[shared] == part[shared]:
                shared += 1
            del sizes[shared + 1 :], lasts[shared + 1 :], states[shared + 1 :]
            state, end = states[shared], shared
            for character in part[shared:] if shared else part:
                end += 1
                after = steps[state].get(character)
                while after is None and state:
                    state = fails[state]
                    after = steps[state].get(character)
                state = after or 0
                for size, own in all_ends[state]:
                    if size == end:
                        break
                    left = lasts[end - size]
                    if left < 0:
                        break
                    fits = pairs.get(left * number + own)
                    if fits or (fits is None and self._fits(left, own)):
                        break
                else:
                    size, own = 1, -1
                    if character in self.pieces:
                        raise RuntimeError(f"no token ends behind {part[:end]!r}")
                sizes.append(size)
                lasts.append(own)
                states.append(state)
            yield part, sizes, lasts
            before = part

    def _tokens(self, part: str, sizes: list[int], lasts: list[int]) -> list[int]:
        """The ids of a part, read backwards off the lists of ``_walk``."""
        tokens, end = [], len(part)
        while end:
            own = lasts[end]
            if own >= 0:
                tokens.append(own)
            else:
                tokens.extend(reversed(self.fallback(part[end - 1])))
            end -= sizes[end]
        tokens.reverse()
        return tokens

    def walk(self, parts: Iterable[str]) -> Iterator[tuple[str, list[int], int, float]]:
        """Each of the distinct ``parts``, in sorted order: the length of the last token at the end of every prefix, and
        the number of pieces and total score of the whole. The list is used again for the next part.
        """
        for part, sizes, lasts in self._walk(parts):
            tokens = self._tokens(part, sizes, lasts)
            yield part, sizes, len(tokens), sum([self.scores[i] for i in tokens])

    def ids(self, part: str, sizes: list[int]) -> list[int]:
        """The ids of a part, read backwards off the lengths of ``walk``."""
        tokens, end = [], len(part)
        while end:
            start = end - sizes[end]
            tokens.append(self.token_ids(part[start:end]))
            end = start
        return [i for token in reversed(tokens) for i in token]

    def known(self, parts: Iterable[str], with_ids: bool) -> list[tuple[int, float, bytes]]:
        """Number, score and, if wanted, ids (32 bits each) of every part; new ones are walked together."""
        if with_ids and not self._with_ids:  # what is known from counting has no ids
            self._known, self._older = {}, {}
        self._with_ids = self._with_ids or with_ids
        parts, known, older, scores = list(parts), self._known, self._older, self.scores
        new = {part for part in parts if part not in known}
        for part in new & older.keys() if older else ():
            known[part] = older[part]
            new.discard(part)
        for part, sizes, lasts in self._walk(new):
            tokens = self._tokens(part, sizes, lasts)
            ids = array("I", tokens).tobytes() if self._with_ids else b""
            known[part] = len(tokens), sum([scores[i] for i in tokens]), ids
        found = [known[part] for part in parts]
        if len(known) > KEPT_PARTS:
            self._known, self._older = {}, known if len(known) <= 2 * KEPT_PARTS else {}
        return found

    def encode(self, bodies: Iterable[bytes]) -> Iterator[tuple[int, int, float, bytes]]:
        """Number of parts and of pieces, total score, and ids of each of the texts."""
        return self._each(bodies, True)

    def count(self, bodies: Iterable[bytes]) -> Iterator[tuple[int, int, float, bytes]]:
        """As ``encode``, without ids."""
        return self._each(bodies, False)

    def _each(self, bodies: Iterable[bytes], with_ids: bool) -> Iterator[tuple[int, int, float, bytes]]:
        held, size = [], 0
        for body in bodies:
            held.append(bytes(body).decode("utf-8", "replace"))
            size += len(body)
            if size >= TOGETHER:
                yield from self._together(held, with_ids)
                held, size = [], 0
        if held:
            yield from self._together(held, with_ids)

    def _together(self, bodies: list[str], with_ids: bool) -> Iterator[tuple[int, int, float, bytes]]:
        mark = next(c for c in map(chr, range(0xE000, 0xF8FF)) if not any(c in body for body in bodies))
        return self._escaped([self.escape(body) for body in bodies], mark, with_ids)

    def encode_escaped(self, escaped: list[str]) -> Iterator[tuple[int, int, float, bytes]]:
        """As ``encode``, of whole parts of escaped texts."""
        held, size = [], 0
        for text in [*escaped, None]:
            if held and (text is None or size >= TOGETHER):
                mark = next(c for c in map(chr, range(0xE000, 0xF8FF)) if not any(c in body for body in held))
                yield from self._escaped(held, mark, True)
                held, size = [], 0
            if text is not None:
                held.append(text)
                size += len(text)

    def _escaped(self, escaped: list[str], mark: str, with_ids: bool) -> Iterator[tuple[int, int, float, bytes]]:
        marked = [
            # A part's first blank is behind the part before, so it has no mark when it stands in front.
            mark.join(self.segments(text)) if BLANK + BLANK in text else text.replace(BLANK, mark + BLANK)[text[:1] == BLANK :]
            for text in escaped
        ]
        listed = pc.split_pattern(pa.array(marked, pa.large_string()), mark)
        coded = listed.flatten().dictionary_encode()
        found = self.known(coded.dictionary.to_numpy(zero_copy_only=False), with_ids)
        place, offsets = coded.indices.to_numpy(), listed.offsets.to_numpy()
        counts = np.array([f[0] for f in found], np.int64)
        own = counts[place]
        pieces = np.add.reduceat(own, offsets[:-1])
        scores = np.add.reduceat(np.array([f[1] for f in found])[place], offsets[:-1])
        words = np.diff(offsets) - np.array([not text for text in escaped])
        blobs = [b""] * len(escaped)
        if with_ids:
            ids, starts = np.frombuffer(b"".join([f[2] for f in found]), "<u4"), np.cumsum(counts) - counts
            ends = np.cumsum(own)
            at = np.repeat(starts[place] - (ends - own), own)
            at += np.arange(len(at))
            flat, bounds = ids[at], np.concatenate([[0], np.cumsum(pieces)])
            blobs = [flat[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield from zip(words.tolist(), pieces.tolist(), scores.tolist(), blobs, strict=True)

    def decode(self, ids: bytes, first: bool = True) -> bytes:
        """The text of ids; in front of a text stands one blank that it does not have."""
        found = self._surfaces.take(pa.array(np.frombuffer(ids, "<u4")))
        text = b"" if not len(found) else found.buffers()[2].to_pybytes()
        return text[1:] if first else text


@lru_cache(maxsize=8)
def is_bpe(path: str | None = None) -> bool:
    """Whether the model's pieces were made by merges, so that its encoding is not that of largest score."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path or tokenizer_path(MODEL), "rb") as file:
        proto.ParseFromString(file.read())
    return proto.trainer_spec.model_type == sentencepiece_model_pb2.TrainerSpec.BPE


@lru_cache(maxsize=2)
def piece_bpe(path: str | None = None) -> PieceBpe:
    """One encoder per worker process and file."""
    return PieceBpe(path or tokenizer_path(MODEL))

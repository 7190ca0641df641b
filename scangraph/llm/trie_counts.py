"""Token counts by dynamic programming over a trie of distinct pre-tokens.

The forward score of a prefix depends on the prefix alone. The distinct pre-tokens of a batch of rows are
walked in sorted order, which is the depth-first order of their trie, so each shared prefix is scored once;
the count at a pre-token's end is kept, and a text's tokens are the sum over its pre-tokens.

For models of the unigram kind that score is the largest one. With a model of the BPE kind the forward state of a
prefix is the last token of its encoding, which the prefix alone fixes (``piece_bpe``), and the counts are the
library's.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

from scangraph.llm.common import texts
from scangraph.llm.piece_bpe import is_bpe, piece_bpe
from scangraph.llm.unigram import Unigram, unigram

#: Pre-tokens whose counts a worker keeps for later batches.
KEPT_TOKENS = 1_000_000


def trie_counts(model: Unigram, tokens: Iterable[str]) -> dict[str, tuple[int, float]]:
    """Number of pieces and score of the best segmentation of each of the distinct ``tokens``."""
    pieces, reach, lost = model.pieces, model.reach, model.unknown_score
    best, count, before = [0.0], [0], ""
    found: dict[str, tuple[int, float]] = {}
    for token in sorted(tokens):
        shared, most = 0, min(len(before), len(token))
        while shared < most and before[shared] == token[shared]:
            shared += 1
        del best[shared + 1 :], count[shared + 1 :]
        for end in range(shared + 1, len(token) + 1):
            last = token[end - 1]
            top, number = float("-inf"), 0
            for start in range(max(0, end - reach.get(last, 1)), end):
                piece = pieces.get(token[start:end])
                if piece is not None:
                    score, more = best[start] + piece[1], 1
                elif start == end - 1:
                    score, more = best[start] + lost, len(model.fallback(last))
                else:
                    continue
                if score > top:
                    top, number = score, count[start] + more
            best.append(top)
            count.append(number)
        found[token] = (count[-1], best[-1])
        before = token
    return found


@lru_cache(maxsize=2)
def _known(path: str | None) -> dict[str, tuple[int, float]]:
    """Counts that the worker process keeps between batches."""
    return {}


def _count(path: str | None):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, known = unigram(path), _known(path)
        for rows in batches:
            cut = [model.segments(model.escape(bytes(t).decode("utf-8", "replace"))) for t in rows.text]
            new = {token for tokens in cut for token in tokens if token not in known}
            if len(known) + len(new) > KEPT_TOKENS:
                known.clear()
                new = {token for tokens in cut for token in tokens}
            known.update(trie_counts(model, new))
            out = []
            for tokens in cut:
                found = [known[token] for token in tokens]
                out.append((len(tokens), sum(n for n, _ in found), sum(score for _, score in found)))
            totals = pd.DataFrame(out, columns=["n_words", "n_tokens", "score"])
            yield pd.concat([rows[["row_id", "doc_id"]].reset_index(drop=True), totals], axis=1)

    return count


def _count_merged(path: str | None):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = piece_bpe(path)
        for rows in batches:
            found = [told[:3] for told in encoder.count(list(rows.text))]
            totals = pd.DataFrame(found, columns=["n_words", "n_tokens", "score"])
            yield pd.concat([rows[["row_id", "doc_id"]].reset_index(drop=True), totals], axis=1)

    return count


def token_counts(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``row_id, doc_id, n_words, n_tokens, score`` of every whole text of ``docs``.

    ``n_words`` counts pre-tokens with repeats. The pieces are those of the model's kind: its own merges for BPE,
    else the segmentation of largest total; ``score`` is the total of their scores. Null and
    empty texts have no tokens; repeated rows are counted each.
    """
    schema = "row_id long, doc_id long, n_words long, n_tokens long, score double"
    return texts(docs).mapInPandas((_count_merged if is_bpe(model) else _count)(model), schema)

"""Stretches of periodically repeated words, found by block convolution.

A run is a stretch of words of smallest period ``q`` (words ``q`` apart are identical) that no neighbouring word
extends, of at least ``REPEATS`` periods and ``SHORTEST`` words. At scale ``B`` (a power of two) runs with periods
of ``B`` to ``2 B - 1`` words are looked for: each of them holds a block of ``B`` words that begins at a multiple
of ``B``, together with its next copy. The sum of squared differences between the block's word codes and
every place of the window behind it is 0 where that copy is. All these sums come from one convolution, which a
number-theoretic transform gives in exact integers. Codes are small enough for the sums to stay below the
modulus; different words may share a code, so a place that is found is compared word by word when it is extended
to both sides.

Two exact tests save work. A word of a run recurs within the period, so a block with a word that does not recur
within ``2 B`` words holds no run of this scale. And where a run of shorter period covers a block and its window, a
period found there can only be a multiple of the shorter one.

Words of different documents never get the same code, so a batch of documents is one sequence. A document is
handled by one task, in memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scangraph.llm.common import texts

REPEATS, SHORTEST = 4, 6
#: Prime with roots of unity of every order up to 2 ** 27, and a generator of its units.
PRIME, GENERATOR = 15 * 2**27 + 1, 31
#: Words of a block that are convolved at most: of a longer block its beginning is located, and then extended.
CONVOLVED = 1 << 15
#: Numbers in one transform's table, and words of documents that are worked on together.
TABLE, TOGETHER = 1 << 19, 1 << 17
#: Distance of a word that does not recur.
NEVER = np.iinfo(np.int64).max


def _roots(n: int, inverse: bool) -> np.ndarray:
    """The powers 0 to n/2 - 1 of an n-th root of unity."""
    root = pow(GENERATOR, (PRIME - 1) // n, PRIME)
    root = pow(root, PRIME - 2, PRIME) if inverse else root
    powers = np.ones(max(n // 2, 1), np.uint64)
    done = 1
    while done < len(powers):
        more = min(done, len(powers) - done)
        powers[done : done + more] = powers[:more] * np.uint64(pow(root, done, PRIME)) % PRIME
        done += more
    return powers


def transform(rows: np.ndarray) -> np.ndarray:
    """Number-theoretic transform of every row, whose length is a power of two; places come bit-reversed."""
    m, n = rows.shape
    half = n // 2
    while half:
        parts = rows.reshape(m, n // (2 * half), 2, half)
        low, high = parts[:, :, 0], parts[:, :, 1]
        rows = np.stack(((low + high) % PRIME, (low + PRIME - high) % PRIME * _roots(2 * half, False) % PRIME), axis=2)
        rows = rows.reshape(m, n)
        half //= 2
    return rows


def inverse_transform(rows: np.ndarray) -> np.ndarray:
    """The rows that ``transform`` gives ``rows`` for."""
    m, n = rows.shape
    half = 1
    while half < n:
        parts = rows.reshape(m, n // (2 * half), 2, half)
        low, high = parts[:, :, 0], parts[:, :, 1] * _roots(2 * half, True) % PRIME
        rows = np.stack(((low + high) % PRIME, (low + PRIME - high) % PRIME), axis=2).reshape(m, n)
        half *= 2
    return rows * np.uint64(pow(n, PRIME - 2, PRIME)) % PRIME


def mismatches(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Sum of squared differences of every block and each of the first places in its window of twice its length.

    Exact as long as a block's length times the square of the largest code is below PRIME.
    """
    m, size = blocks.shape
    padded = np.zeros((m, 2 * size), np.uint64)
    padded[:, :size] = blocks[:, ::-1]
    products = transform(padded) * transform(windows) % PRIME
    cross = inverse_transform(products)[:, size - 1 : 2 * size - 1].astype(np.int64)
    squares = np.zeros((m, 2 * size + 1), np.int64)
    np.cumsum(windows.astype(np.int64) ** 2, axis=1, out=squares[:, 1:])
    own = (blocks.astype(np.int64) ** 2).sum(axis=1, keepdims=True)
    return own + squares[:, size : 2 * size] - squares[:, :size] - 2 * cross


def _occurrences(ids: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Beginnings of blocks, and the distances from ``size`` to ``2 size - 1`` at which their codes recur."""
    lead = min(size, CONVOLVED)
    codes = (ids % (isqrt((PRIME - 1) // lead) + 1)).astype(np.uint64)
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    step = max(TABLE // (2 * lead), 1)
    for first in range(0, len(starts), step):
        at = starts[first : first + step, None]
        blocks = codes[at + np.arange(lead)]
        for further in range(size, 2 * size, lead):
            # Nothing recurs behind the end: what stands there is cut to the last place, and compared later.
            window = codes[np.minimum(at + further + np.arange(2 * lead), len(codes) - 1)]
            row, lag = np.nonzero(mismatches(blocks, window) == 0)
            found.append((starts[first + row], further + lag))
    return tuple(np.concatenate(column) for column in zip(*found, strict=True))


def _equal_until(left: np.ndarray, right: np.ndarray) -> int:
    """Number of equal words at the beginning of two equally long stretches."""
    at, step = 0, 64
    while at < len(left):
        wrong = np.flatnonzero(left[at : at + step] != right[at : at + step])
        if len(wrong):
            return at + int(wrong[0])
        at += step
        step *= 2
    return len(left)


class _Runs:
    """Runs found so far."""

    def __init__(self) -> None:
        self.rows = np.zeros((0, 3), np.int64)  # start, end, period; by start
        self._reach = np.zeros(0, np.int64)

    def add(self, rows: list[tuple[int, int, int]]) -> None:
        if rows:
            merged = np.concatenate([self.rows, np.array(rows, np.int64)])
            self.rows = merged[np.lexsort((merged[:, 2], merged[:, 0]))]
            self._reach = np.maximum.accumulate(self.rows[:, 1])

    def cover(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether one run holds all words from start to end."""
        if not len(self.rows):
            return np.zeros(len(starts), bool)
        place = np.searchsorted(self.rows[:, 0], starts, "right") - 1
        return (place >= 0) & (self._reach[place] >= ends)


def _extended(ids: np.ndarray, starts: np.ndarray, distance: int, size: int) -> Iterator[tuple[int, int]]:
    """Maximal stretches with period ``distance`` that hold a block of ``starts`` (ascending) and its copy."""
    place = 0
    while place < len(starts):
        b = int(starts[place])
        end = b + _equal_until(ids[b : len(ids) - distance], ids[b + distance :])
        if end >= b + size:
            start = b - _equal_until(ids[:b][::-1], ids[distance : b + distance][::-1])
            yield start, end + distance
        # All other blocks up to the first difference lie in the same stretch, or hold that difference.
        place = max(place + 1, int(np.searchsorted(starts, end, "right")))


def word_runs(ids: np.ndarray, longest: int) -> np.ndarray:
    """``start, end, period`` of all runs in a sequence of word numbers, by start, then period.

    No text of the sequence is longer than ``longest`` words, so no period is above a REPEATS-th of that.
    """
    runs = _Runs()
    order = np.argsort(ids, kind="stable")
    ahead = np.full(len(ids), NEVER)
    again = ids[order[1:]] == ids[order[:-1]]
    ahead[order[:-1][again]] = (order[1:] - order[:-1])[again]
    size = 1
    while REPEATS * size <= longest:
        whole = len(ids) // size
        near = ahead[: whole * size].reshape(whole, size).max(axis=1) < 2 * size
        starts = np.flatnonzero(near) * size
        starts = starts[~runs.cover(starts, starts + 3 * size)]
        at, distance = _occurrences(ids, starts, size)
        fresh = (at + distance + size <= len(ids)) & ~runs.cover(at, at + distance + size)
        at, distance = at[fresh], distance[fresh]
        order = np.lexsort((at, distance))
        at, distance = at[order], distance[order]
        added = []
        edges = np.flatnonzero(np.diff(distance, prepend=-1, append=-1))
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            period = int(distance[low])
            for start, end in _extended(ids, at[low:high], period, size):
                if end - start >= max(SHORTEST, REPEATS * period):
                    added.append((start, end, period))
        if added:
            # A stretch whose smallest period is shorter was found at a scale before.
            bounds = np.array(added)
            added = [a for a, known in zip(added, runs.cover(bounds[:, 0], bounds[:, 1]), strict=True) if not known]
            runs.add(added)
        size *= 2
    return runs.rows


class _Numbers(dict):
    """Words to numbers, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _kept(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run holds after its first period, joined by a blank."""
    if len(runs):
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, runs[:, 0] + runs[:, 2], 1)
        np.add.at(change, runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
    return b" ".join(words)


def document_runs(bodies: list[bytes]) -> list[tuple[np.ndarray, bytes]]:
    """The runs (start, end, period) and the collapsed text of every text."""
    split = [body.split() for body in bodies]  # at blanks and 09 to 0D
    numbers = _Numbers()
    lengths = np.array([len(words) for words in split], np.int64)
    firsts = np.concatenate([[0], np.cumsum(lengths)])
    ids = np.empty(firsts[-1], np.int64)
    for first, words in zip(firsts, split, strict=False):
        ids[first : first + len(words)] = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    # The same word of another text gets another number, so runs end where texts end.
    ids += np.repeat(np.arange(len(split), dtype=np.int64) * len(numbers), lengths)
    runs = word_runs(ids, int(lengths.max(initial=0)))
    owner = np.searchsorted(firsts, runs[:, 0], "right") - 1
    bounds = np.searchsorted(owner, np.arange(len(split) + 1))
    found = []
    for i, words in enumerate(split):
        own = runs[bounds[i] : bounds[i + 1]] - [firsts[i], firsts[i], 0]
        found.append((own, _kept(words, own)))
    return found


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _batch(row_ids: list, doc_ids: list, bodies: list[bytes]) -> pa.RecordBatch:
    found = document_runs(bodies)
    runs = np.concatenate([own for own, _ in found])
    offsets = np.cumsum([0, *(len(own) for own, _ in found)]).astype(np.int32)
    parts = [pa.array(part) for part in (runs[:, 0], runs[:, 1] - runs[:, 0], runs[:, 2])]
    structs = pa.StructArray.from_arrays(parts, fields=list(_RUNS.value_type))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(row_ids, pa.int64()),
            pa.array(doc_ids, pa.int64()),
            pa.ListArray.from_arrays(offsets, structs),
            pa.array([kept for _, kept in found], pa.binary()),
        ],
        ["row_id", "doc_id", "runs", "collapsed"],
    )


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        row_ids, doc_ids = rows.column("row_id").to_pylist(), rows.column("doc_id").to_pylist()
        first, size, bodies = 0, 0, []
        for i, text in enumerate(rows.column("text")):
            bodies.append(text.as_py())
            size += len(bodies[-1]) // 6 + 1  # roughly its words
            if size >= TOGETHER:
                yield _batch(row_ids[first : i + 1], doc_ids[first : i + 1], bodies)
                first, size, bodies = i + 1, 0, []
        if bodies:
            yield _batch(row_ids[first:], doc_ids[first:], bodies)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``row_id, doc_id, runs, collapsed`` of every row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. ``runs`` lists ``start, length, period`` of all runs by
    start, then period. ``collapsed`` is the words that no run holds behind its first period, joined by a blank.

    Null and empty texts and those of white space have no words: no runs, and an empty collapsed text. Repeated rows
    and rows without doc_id are worked on like others; an empty table gives an empty result. Texts
    of any length are handled whole, in one task each, in memory of some 20 times their size.
    """
    schema = "row_id long, doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"
    return texts(docs).mapInArrow(_find, schema)


def longest_run(runs: Column) -> Column:
    """The run of the greatest exact length / period; ties go to the smallest start, then period; null for none."""

    def earlier(a: Column, b: Column) -> Column:
        more, less = a["length"] * b["period"], b["length"] * a["period"]
        by_place = F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["period"] - b["period"])
        return F.when(more != less, less - more).otherwise(by_place)

    return F.try_element_at(F.array_sort(runs, lambda a, b: F.signum(earlier(a, b)).cast("int")), F.lit(1))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` in which a tenth of the texts ends in a repeated stretch of its own words.

    With ``h`` the CRC-32 of the decimal ``doc_id`` (null: of nothing) and ``g = floor(h / 10)``, texts of ``n > 0``
    words with ``h % 10 = 0`` change: from word ``a = g % n`` on, the next ``p = 1 + floor((n - a) / (3 + g % 8))``
    words are repeated to the end. Their words are joined by blanks; other texts stay as they are.
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    planted = docs.select("doc_id", "text", h.alias("_h"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    planted = planted.withColumn("_words", F.when(F.col("_h") % 10 == 0, words))
    n, g = F.size("_words").cast("long"), F.floor(F.col("_h") / 10)
    planted = planted.withColumn("_n", n).withColumn("_a", F.when(n > 0, g % n))
    planted = planted.withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + g % 8)))
    a = F.col("_a")
    tail = F.slice("_words", (a + 1).cast("int"), F.col("_p").cast("int"))
    whole = F.concat(
        F.slice("_words", F.lit(1), a.cast("int")),
        F.slice(
            F.flatten(F.array_repeat(tail, F.ceil((F.col("_n") - a) / F.col("_p")).cast("int"))),
            F.lit(1),
            (F.col("_n") - a).cast("int"),
        ),
    )
    text = F.when(F.col("_n") > 0, F.array_join(whole, " ")).otherwise(F.col("text"))
    return planted.select("doc_id", text.alias("text"))

"""Repeated passages across documents, by a logarithmic family of suffix arrays.

A suffix counts by its first ``LENGTH`` bytes (a window). Every window has an anchor, the least hash among
its 16-byte substrings, so equal windows have equal anchors wherever they stand, and the windows of one
anchor lie together in a document.

1. Texts are put into groups, equal texts once per batch of rows, in a table bucketed by group.
2. Anchors of each group go to hash buckets; a bucket answers which of them occur in several documents.
3. Windows of such anchors are compared inside their group; those that the group has no earlier document
   for go on to the anchor's bucket, as the byte runs they overlap in.
4. A bucket reads its runs in batches of ascending document ids. Each batch gets its suffix array, which is
   merge-scanned against the levels of earlier batches; what is new becomes a level, and levels of like size
   are merged. So only the first occurrence of a window is ever kept, however many documents share it.
5. Removed windows go back to their groups, where they are joined to byte spans.

Groups and buckets hold a fixed number of bytes; their number grows with the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scangraph.llm.common import row_column, scratch, stored, texts

LENGTH, ANCHOR = 50, 16
GROUP_BYTES, BUCKET_BYTES = 4 << 20, 4 << 20
MIN_PARTS, MAX_BUCKETED = 32, 20_000
#: Windows in a batch of the index, and in one local suffix array.
BATCH_WINDOWS = 400_000

_NO_ID = (1 << 63) - 1
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_ANCHORS = "bucket int, g int, anchors binary, shared binary"
_RUNS = "bucket int, g int, starts binary, windows binary, ids binary, data binary"
_MARKS = "g int, starts binary, windows binary"
_SPANS = (
    "digest string, first_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
    "spans array<struct<start: long, length: long>>"
)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _C1
    return x ^ (x >> np.uint64(30))


def window_anchors(data: np.ndarray) -> np.ndarray:
    """For the window at each position, the mixed least hash of its substrings of ``ANCHOR`` bytes."""
    count, width = len(data) - LENGTH + 1, LENGTH - ANCHOR + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.empty(count, dtype=np.uint64)
    for at in range(0, count, 1 << 20):
        part = np.ascontiguousarray(data[at : at + (1 << 20) + LENGTH - 1])
        n = len(part)
        words = np.ndarray((n - 7,), dtype="<u8", buffer=part.data, strides=(1,)).astype(np.uint64)
        hashes = _mixed(words[:-8] * _C1 + _mixed(words[8:] * _C2))
        # Sliding minimum: from each position to the end of its block, and from the block's start.
        blocks = -(-len(hashes) // width)
        padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
        padded[: len(hashes)] = hashes
        padded = padded.reshape(blocks, width)
        ahead = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        behind = np.minimum.accumulate(padded, axis=1).ravel()
        own = n - LENGTH + 1
        out[at : at + own] = _mixed(np.minimum(ahead[:own], behind[width - 1 : width - 1 + own]))
    return out


def windows_at(data: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The windows at ``positions`` as fixed-width byte strings, which sort by their bytes."""
    view = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
    return np.ascontiguousarray(view[positions]).view(f"S{LENGTH}").ravel()


def _run_lengths(changes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs, from the indices where a new run begins (0 left out)."""
    starts = np.concatenate([[0], changes]).astype(np.int64) if n else np.zeros(0, dtype=np.int64)
    return starts, np.diff(np.append(starts, n))


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the runs, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Group:
    """The distinct texts of a group in ascending order of their first document id, end to end."""

    def __init__(self, rows: pd.DataFrame):
        first: dict[bytes, int] = {}
        for doc_id, text in zip(rows.doc_id, rows.text, strict=True):
            text, doc_id = bytes(text), int(doc_id)
            first[text] = min(doc_id, first.get(text, _NO_ID))
        order = sorted(first.items(), key=lambda item: (item[1], item[0]))
        self.bodies = [text for text, _ in order]
        self.first = np.array([doc_id for _, doc_id in order], dtype=np.int64)
        sizes = np.array([len(t) for t in self.bodies], dtype=np.int64)
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        self.data = np.frombuffer(b"".join(self.bodies), dtype=np.uint8)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, start, number of windows and text number of each run of windows with one anchor."""
        anchors = window_anchors(self.data)
        fit = np.maximum(self.ends - self.begins - LENGTH + 1, 0)
        positions = _ranges(self.begins, fit)
        owner = np.repeat(np.arange(len(fit)), fit)
        anchors = anchors[positions]
        changes = np.flatnonzero((anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1])) + 1
        starts, lengths = _run_lengths(changes, len(anchors))
        return anchors[starts], positions[starts], lengths, owner[starts]


def _bucket_of(anchors: np.ndarray, bits: int) -> np.ndarray:
    return (anchors >> np.uint64(64 - bits)).astype(np.int64)


def _send_anchors(bits: int):
    def send(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        anchors, _, _, owner = Group(rows).runs()
        order = np.lexsort((owner, anchors))
        anchors, owner = anchors[order], owner[order]
        changes = np.flatnonzero(anchors[1:] != anchors[:-1]) + 1
        starts, lengths = _run_lengths(changes, len(anchors))
        # Owners are sorted within an anchor: it is shared here when the first and the last differ.
        shared = (owner[starts] != owner[starts + lengths - 1]).astype(np.uint8)
        anchors = anchors[starts]
        buckets = _bucket_of(anchors, bits)
        out = []
        for bucket in np.unique(buckets):
            lo, hi = np.searchsorted(buckets, [bucket, bucket + 1])
            out.append((int(bucket), int(key[0]), anchors[lo:hi].tobytes(), shared[lo:hi].tobytes()))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _ANCHORS.split(", ")])

    return send


def _answer_anchors(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """For each group, those of its anchors that occur in more than one document."""
    each = [np.frombuffer(a, np.uint64) for a in rows.anchors]
    flags = np.concatenate([np.frombuffer(s, np.uint8) for s in rows.shared])
    whole = np.concatenate(each)
    found, inverse, counts = np.unique(whole, return_inverse=True, return_counts=True)
    here = np.bincount(inverse, weights=flags, minlength=len(found)) > 0
    shared = found[(counts > 1) | here]
    answers = [a[np.isin(a, shared, assume_unique=True)].tobytes() for a in each]
    out = pd.DataFrame({"g": rows.g, "anchors": answers})
    return out[out.anchors.str.len() > 0]


def _later_windows(windows: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array of ``windows`` (listed by ascending id), start of each run of equal ones in it, and
    whether a window (in the listed order) also has a smaller id."""
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    starts, lengths = _run_lengths(np.flatnonzero(ranked[1:] != ranked[:-1]) + 1, len(ranked))
    later = np.zeros(len(windows), dtype=bool)
    later[order] = ids[order] > np.repeat(ids[order[starts]], lengths)
    return order, starts, later


def _mark_runs(positions: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted positions as runs of neighbours."""
    starts, lengths = _run_lengths(np.flatnonzero(np.diff(positions) != 1) + 1, len(positions))
    return positions[starts].astype(np.int64).tobytes(), lengths.astype(np.int64).tobytes()


def _send_windows(bits: int):
    def send(key: tuple, rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        columns = [c.split()[0] for c in _RUNS.split(", ")]
        if rows.empty or answers.empty:
            return pd.DataFrame([], columns=columns)
        group = Group(rows)
        anchors, starts, lengths, owner = group.runs()
        shared = np.unique(np.concatenate([np.frombuffer(a, np.uint64) for a in answers.anchors]))
        kept = np.flatnonzero(np.isin(anchors, shared))
        # Equal windows have equal anchors, so the runs can be compared in parts of the anchors' order.
        kept = kept[np.argsort(anchors[kept], kind="stable")]
        anchors, starts, lengths, owner = anchors[kept], starts[kept], lengths[kept], owner[kept]
        out, gone, at = [], [], 0
        before = np.concatenate([[0], np.cumsum(lengths)])
        while at < len(anchors):
            end = max(at + 1, int(np.searchsorted(before, before[at] + BATCH_WINDOWS, "right")) - 1)
            end = int(np.searchsorted(anchors, anchors[end - 1], "right"))
            part = np.arange(at, end)
            part = part[np.argsort(starts[part], kind="stable")]  # by position, so by id
            positions = _ranges(starts[part], lengths[part])
            run = np.repeat(part, lengths[part])
            ids = group.first[owner[run]]
            _, _, later = _later_windows(windows_at(group.data, positions), ids)
            gone.append(positions[later])
            positions, run = positions[~later], run[~later]
            broken = (np.diff(positions) != 1) | (np.diff(run) != 0)
            first, windows = _run_lengths(np.flatnonzero(broken) + 1, len(positions))
            begin, run = positions[first], run[first]
            buckets = _bucket_of(anchors[run], bits)
            for bucket in np.unique(buckets):
                own = buckets == bucket
                size = windows[own] + LENGTH - 1
                data = group.data[_ranges(begin[own], size)].tobytes()
                ids = group.first[owner[run[own]]]
                out.append((int(bucket), begin[own].tobytes(), windows[own].tobytes(), ids.tobytes(), data))
            at = end
        rows = [(bucket, int(key[0]), *rest) for bucket, *rest in out]
        marks = np.sort(np.concatenate(gone)) if gone else np.zeros(0, dtype=np.int64)
        if len(marks):
            rows.append((-1, int(key[0]), *_mark_runs(marks), b"", b""))
        return pd.DataFrame(rows, columns=columns)

    return send


class LevelIndex:
    """Sorted arrays of distinct windows, each level more than twice the next."""

    def __init__(self) -> None:
        self.levels: list[np.ndarray] = []

    def scan(self, windows: np.ndarray) -> np.ndarray:
        """Which of the sorted ``windows`` some level has; both sides are read in order."""
        known = np.zeros(len(windows), dtype=bool)
        for level in self.levels:
            at = np.minimum(np.searchsorted(level, windows), len(level) - 1)
            known |= level[at] == windows
        return known

    def add(self, windows: np.ndarray) -> None:
        """Add sorted windows that no level has."""
        if not len(windows):
            return
        self.levels.append(windows)
        while len(self.levels) > 1 and len(self.levels[-2]) <= 2 * len(self.levels[-1]):
            merged = np.concatenate([self.levels.pop(), self.levels.pop()])
            merged.sort(kind="stable")
            self.levels.append(merged)


def _index_windows(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    def column(name: str) -> np.ndarray:
        return np.concatenate([np.frombuffer(blob, np.int64) for blob in rows[name]])

    starts, windows, ids = column("starts"), column("windows"), column("ids")
    groups = np.repeat(rows.g.to_numpy(), [len(blob) // 8 for blob in rows.ids])
    data = np.frombuffer(b"".join(rows.data), np.uint8)
    sizes = windows + LENGTH - 1
    places = np.cumsum(sizes) - sizes
    order = np.argsort(ids, kind="stable")
    index, gone = LevelIndex(), []
    before = np.concatenate([[0], np.cumsum(windows[order])])
    at = 0
    while at < len(order):
        end = max(at + 1, int(np.searchsorted(before, before[at] + BATCH_WINDOWS, "right")) - 1)
        # A document's windows stay in one batch, so all levels have smaller ids.
        end = int(np.searchsorted(ids[order], ids[order[end - 1]], "right"))
        part = order[at:end]
        run = np.repeat(part, windows[part])
        bodies = windows_at(data, _ranges(places[part], windows[part]))
        sa, firsts, later = _later_windows(bodies, ids[run])
        distinct = bodies[sa[firsts]]
        known = index.scan(distinct)
        index.add(distinct[~known])
        later[sa] |= np.repeat(known, np.diff(np.append(firsts, len(sa))))
        positions = _ranges(starts[part], windows[part])
        gone.append((groups[run[later]], positions[later]))
        at = end
    where, positions = (np.concatenate(x) for x in zip(*gone, strict=True))
    order = np.lexsort((positions, where))
    where, positions = where[order], positions[order]
    out = []
    for g in np.unique(where):
        lo, hi = np.searchsorted(where, [g, g + 1])
        out.append((int(g), *_mark_runs(positions[lo:hi])))
    return pd.DataFrame(out, columns=[c.split()[0] for c in _MARKS.split(", ")])


def _join_spans(key: tuple, rows: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
    group = Group(rows)
    steps = np.zeros(len(group.data) + 1, dtype=np.int32)
    for starts, windows in zip(marks.starts, marks.windows, strict=True):
        starts = np.frombuffer(starts, np.int64)
        np.add.at(steps, starts, 1)
        np.add.at(steps, starts + np.frombuffer(windows, np.int64) + LENGTH - 1, -1)
    covered = np.cumsum(steps[:-1]) > 0
    out = []
    for body, first, begin, end in zip(group.bodies, group.first, group.begins, group.ends, strict=True):
        own = covered[begin:end]
        spans, kept = [], body
        if own.any():
            edges = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
            spans = [{"start": int(s), "length": int(e - s)} for s, e in edges.reshape(-1, 2)]
            kept = group.data[begin:end][~own].tobytes()
        digest, first = hashlib.sha256(body).hexdigest(), None if first == _NO_ID else int(first)
        kept_digest = hashlib.sha256(kept).hexdigest()
        out.append((digest, first, len(body), len(body) - len(kept), len(spans), kept_digest, spans))
    names = "digest first_id n_bytes n_removed n_spans kept_sha256 spans".split()
    return pd.DataFrame(out, columns=names).astype({"first_id": "Int64"})


def _once_per_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        yield rows.sort_values("doc_id").drop_duplicates(["g", "text"])


def _bits(parts: float) -> int:
    return max(5, int(np.ceil(np.log2(max(1.0, parts)))))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``row_id, doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans``.

    A byte is removed when it is covered by a string of ``LENGTH`` bytes that also starts in a document
    with a smaller doc_id; texts are UTF-8 bytes and matches never cross documents. ``spans`` are the
    maximal removed runs, by byte. A null text is empty, and texts shorter than ``LENGTH`` stay as they
    are. Rows with the same doc_id are not earlier than one another; rows without doc_id come last.
    """
    spark = docs.sparkSession
    work = scratch(spark)
    rows = texts(docs)
    facts = rows.select("row_id", "doc_id", F.sha2("text", 256).alias("digest"), F.length("text").alias("size"))
    facts = work.write(facts, "facts")
    total = facts.agg(F.sum("size")).first()[0] or 0
    groups, bits = max(MIN_PARTS, -(-total // GROUP_BYTES)), _bits(total / BUCKET_BYTES)

    placed = rows.select(
        F.pmod(F.xxhash64("text"), F.lit(groups)).cast("int").alias("g"),
        F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_id"),
        "text",
    )
    placed = placed.mapInPandas(_once_per_batch, "g int, doc_id long, text binary")
    try:
        table = work.write_bucketed(placed, "texts", min(groups, MAX_BUCKETED), ["g"])
        sent = table.groupBy("g").applyInPandas(_send_anchors(bits), _ANCHORS)
        answers = sent.groupBy("bucket").applyInPandas(_answer_anchors, "g int, anchors binary")
        answers = work.write(answers, "answers")
        runs = table.groupBy("g").cogroup(answers.groupBy("g")).applyInPandas(_send_windows(bits), _RUNS)
        runs = work.write(runs, "runs")
        here = runs.where("bucket < 0").select("g", "starts", "windows")
        across = runs.where("bucket >= 0").groupBy("bucket").applyInPandas(_index_windows, _MARKS)
        marks = work.write(here.union(across), "marks")
        spans = table.groupBy("g").cogroup(marks.groupBy("g")).applyInPandas(_join_spans, _SPANS)
        spans = work.write(spans, "spans")
    finally:
        work.forget_tables()
        for name in ("texts", "runs", "answers"):
            work.delete(name)

    # All but the first of equal texts are covered as a whole.
    joined = facts.join(spans, "digest")
    copy = (F.col("size") >= LENGTH) & F.when(F.col("first_id").isNull(), False).otherwise(
        F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first_id"))
    )
    empty = hashlib.sha256(b"").hexdigest()
    everything = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("length")))
    return joined.select(
        "row_id",
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(copy, F.lit(empty)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        F.when(copy, everything).otherwise(F.col("spans")).alias("spans"),
    )


def _outside(text: str, spans: list[dict]) -> str:
    """``text`` without the byte spans; a character is removed only as a whole."""
    body, kept, at = text.encode(), [], 0
    for span in spans:
        start, end = span["start"], span["start"] + span["length"]
        while start < end and body[start] & 0xC0 == 0x80:
            start += 1
        while end > start and end < len(body) and body[end] & 0xC0 == 0x80:
            end -= 1
        kept.append(body[at:start])
        at = end
    return b"".join([*kept, body[at:]]).decode("utf-8", "replace")


def without_passages(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated passages cut out of ``text`` and ``n_chars``, where there, made to fit.

    Every row stays, also one of which nothing is left; other columns are as they were.
    """
    name = "spans"
    while name in docs.columns:
        name += "_"
    rows = stored(docs, scratch(docs.sparkSession))
    number = row_column(rows)
    spans = repeated_passages(rows).select(F.col("row_id").alias(number), F.col("spans").alias(name))
    joined = rows.join(spans, number).select(F.col(name), *(F.col(f"`{c}`") for c in docs.columns))
    columns, schema = docs.columns, docs.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            arrays = dict(zip(columns, rows.columns[1:], strict=True))
            texts_of = arrays["text"].to_pylist()
            texts_of = [_outside(t, s) if s else t for t, s in zip(texts_of, rows.column(0).to_pylist(), strict=True)]
            arrays["text"] = pa.array(texts_of, arrays["text"].type)
            if "n_chars" in arrays:
                sizes = [None if t is None else len(t) for t in texts_of]
                arrays["n_chars"] = pa.array(sizes, arrays["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(arrays.values()), names=columns)

    return joined.mapInArrow(cut, schema)

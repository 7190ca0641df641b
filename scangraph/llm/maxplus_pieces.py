"""SentencePiece encoding and decoding; giant texts by a max-plus scan over their chunks.

What a chunk needs to know of its neighbours is how far a piece that begins before it reaches into it: the
boundary state. Each chunk yields the matrix of best scores from each state at its start to each state at its
end, in parallel. Matrices multiply associatively (maximum for sum, sum for product), so those of a document
are multiplied up a tree; going down the tree, the best states at the ends of a node give those between its
children, and in the end each chunk finds its own pieces between two known states.

For models of the unigram kind that is the segmentation of largest score. For models of the BPE kind it is the
library's encoding: there the state is the token at the boundary, and scores are 0 where two tokens may stand side by
side and minus infinity elsewhere (``merge_chunks``).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scangraph.llm.common import scratch, stored, texts
from scangraph.llm.merge_chunks import MergeChunk, States, product
from scangraph.llm.piece_bpe import is_bpe, piece_bpe
from scangraph.llm.unigram import Unigram, unigram

#: Characters of a chunk; longer texts are scanned in parallel. Matrices that meet in a node of the tree.
CHUNK, FAN_IN = 1 << 14, 32
KEPT_WORDS = 500_000

_CHUNK = "row_id long, chunk long, text string, size int, last boolean"
_MATRIX = "row_id long, node long, matrix binary"
_STATE = "row_id long, node long, enter int, leave int"


class _Segments(dict):
    """Ids (as bytes) and score of parts that stand for themselves."""

    def __init__(self, model: Unigram):
        super().__init__()
        self.model = model

    def __missing__(self, part: str) -> tuple[bytes, float]:
        if len(self) >= KEPT_WORDS:
            self.clear()
        ids, score = self.model.segment(part)
        found = self[part] = (np.array(ids, "<u4").tobytes(), score)
        return found


@lru_cache(maxsize=2)
def _segments(path: str | None) -> _Segments:
    return _Segments(unigram(path))


def encode_text(text: bytes, path: str | None = None) -> tuple[bytes, float]:
    """Ids (32 bits each) and total score of a whole text, one part after the other."""
    known = _segments(path)
    model = known.model
    found = [known[p] for p in model.segments(model.escape(bytes(text).decode("utf-8", "replace")))]
    return b"".join([ids for ids, _ in found]), sum(score for _, score in found)


class Chunk:
    """A piece of an escaped text with the characters behind it that its last piece may reach into."""

    def __init__(self, text: str, size: int, last: bool, path: str | None):
        self.known = _segments(path)
        self.model, self.text, self.size = self.known.model, text, size
        self.states = self.model.longest
        #: How far a piece may reach behind the chunk; not at all at the end of the text.
        self.exits = 1 if last else min(self.states, len(text) - size + 1)
        # The outermost places that no piece spans; inside, parts stand for themselves.
        cuts, at = [], 0
        for part in self.model.segments(text):
            if 0 < at <= size:
                cuts.append(at)
            at += len(part)
        if last and at == size:
            cuts.append(at)
        self.inner = (cuts[0], cuts[-1]) if cuts else None

    def _ends(self, begin: int, starts: dict[int, float], stop: int) -> tuple[list[float], list[int]]:
        return self.model.best_ends(self.text[begin:stop], {at - begin: s for at, s in starts.items()})

    def _leave(self, begin: int) -> tuple[list[float], list[int]]:
        """From ``begin`` to the exits: pieces must begin inside the chunk."""
        best, back = self._ends(begin, {begin: 0.0}, self.size)
        inside, pieces = len(best) - 1, self.model.pieces
        for out in range(1, self.exits):
            end, top, origin = self.size + out, float("-inf"), -1
            for start in range(max(begin, end - self.states), self.size):
                found = pieces.get(self.text[start:end])
                if found and best[start - begin] + found[1] > top:
                    top, origin = best[start - begin] + found[1], start - begin
            best.append(top)
            back.append(origin)
        return best[inside:], back

    def _middle(self) -> tuple[bytes, float]:
        low, high = self.inner
        found = [self.known[p] for p in self.model.segments(self.text[low:high])]
        return b"".join([ids for ids, _ in found]), sum(score for _, score in found)

    def matrix(self) -> np.ndarray:
        """Best scores from each entry to each exit; a chunk shorter than an entry passes it on."""
        out = np.full((self.states, self.states), -np.inf)
        if self.inner:
            low, high = self.inner
            leave, middle = self._leave(high)[0], self._middle()[1]
            for enter in range(min(self.states, low + 1)):
                head = self._ends(enter, {enter: 0.0}, low)[0][-1]
                out[enter, : len(leave)] = head + middle + np.array(leave)
        else:
            for enter in range(min(self.states, self.size + 1)):
                leave = self._leave(enter)[0]
                out[enter, : len(leave)] = leave
        for enter in range(self.size + 1, self.states):
            if enter - self.size < self.exits:
                out[enter, enter - self.size] = 0.0
        return out

    def ids(self, enter: int, leave: int) -> bytes:
        """Ids of the pieces that begin in the chunk, between two states."""
        if enter > self.size:
            return b""
        if not self.inner:
            back = self._leave(enter)[1]
            return self._ids(enter, back, self.size - enter + leave)
        low, high = self.inner
        back = self._ends(enter, {enter: 0.0}, low)[1]
        head = self._ids(enter, back, low - enter)
        return head + self._middle()[0] + self._ids(high, self._leave(high)[1], self.size - high + leave)

    def _ids(self, begin: int, back: list[int], end: int) -> bytes:
        return np.array(self.model.trace(self.text[begin:], back, end), "<u4").tobytes()


def max_plus(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left[:, :, None] + right[None, :, :]).max(axis=1)


def _split(path: str | None, size: int):
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = unigram(path)
        for rows in batches:
            for row_id, text in zip(rows.row_id, rows.text, strict=True):
                text = model.escape(bytes(text).decode("utf-8", "replace"))
                starts = range(0, len(text), size)
                # Behind each chunk stand the characters that a piece may reach into, less one.
                parts = [text[s : s + size + model.longest - 1] for s in starts]
                sizes = [min(size, len(text) - s) for s in starts]
                last = [s + size >= len(text) for s in starts]
                columns = {"row_id": row_id, "chunk": range(len(parts)), "text": parts, "size": sizes, "last": last}
                yield pd.DataFrame(columns)

    return split


def _chunks(rows: pd.DataFrame, path: str | None) -> Iterator[Chunk]:
    for text, size, last in zip(rows.text, rows["size"], rows["last"], strict=True):
        yield Chunk(text, int(size), bool(last), path)


def _matrices(path: str | None):
    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [c.matrix().tobytes() for c in _chunks(rows, path)]
            yield pd.DataFrame({"row_id": rows.row_id, "node": rows.chunk, "matrix": found})

    return matrices


def _unpack(blob: bytes) -> np.ndarray:
    flat = np.frombuffer(blob, np.float64)
    return flat.reshape(int(len(flat) ** 0.5), -1)


def _multiply(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    whole = None
    for blob in rows.sort_values("node").matrix:
        matrix = _unpack(blob)
        whole = matrix if whole is None else max_plus(whole, matrix)
    return pd.DataFrame({"row_id": [key[0]], "node": [key[1]], "matrix": [whole.tobytes()]})


def _between(key: tuple, rows: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
    """States at the ends of the children of a node, whose own are known."""
    rows = rows.sort_values("node")
    enter, leave = int(states.enter.iloc[0]), int(states.leave.iloc[0])
    matrices = [_unpack(blob) for blob in rows.matrix]
    ahead = [matrices[0][enter]]
    for matrix in matrices[1:]:
        ahead.append((ahead[-1][:, None] + matrix).max(axis=0))
    ends = [leave]
    for best, matrix in zip(ahead[-2::-1], matrices[:0:-1], strict=True):
        ends.append(int(np.argmax(best + matrix[:, ends[-1]])))
    ends.reverse()
    return pd.DataFrame({"row_id": key[0], "node": rows.node, "enter": [enter, *ends[:-1]], "leave": ends})


def _trace(path: str | None):
    def trace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            ends = zip(_chunks(rows, path), rows.enter, rows.leave, strict=True)
            found = [chunk.ids(int(enter), int(leave)) for chunk, enter, leave in ends]
            yield pd.DataFrame({"row_id": rows.row_id, "chunk": rows.chunk, "ids": found})

    return trace


def _scan(long: DataFrame, work, path: str | None, size: int, fan_in: int) -> DataFrame:
    """``row_id, ids, score`` of texts in chunks."""
    chunks = work.write(long.mapInPandas(_split(path, size), _CHUNK), "chunks")
    spread = chunks.repartition("row_id", "chunk")
    levels = [work.write(spread.mapInPandas(_matrices(path), _MATRIX), "level0")]
    most = chunks.agg(F.max("chunk")).first()[0]
    most = 0 if most is None else most + 1
    parent = F.floor(F.col("node") / fan_in).cast("long")
    while most > 1:
        most = -(-most // fan_in)
        groups = levels[-1].groupBy("row_id", parent.alias("up"))
        levels.append(work.write(groups.applyInPandas(_multiply, _MATRIX), f"level{len(levels)}"))

    root = F.lit(0)
    states = levels[-1].select("row_id", "node", root.alias("enter"), root.alias("leave"))
    for depth in range(len(levels) - 2, -1, -1):
        children = levels[depth].groupBy("row_id", parent.alias("up"))
        parents = states.groupBy("row_id", "node")
        states = work.write(children.cogroup(parents).applyInPandas(_between, _STATE), f"states{depth}")
    joined = chunks.join(states.withColumnRenamed("node", "chunk"), ["row_id", "chunk"])
    traced = joined.mapInPandas(_trace(path), "row_id long, chunk long, ids binary")
    whole = traced.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "ids"))).alias("parts"))
    scores = levels[-1].mapInPandas(_root_scores, "row_id long, score double")
    ids = F.aggregate("parts", F.lit(b""), lambda done, part: F.concat(done, part["ids"]))
    return whole.select("row_id", ids.alias("ids")).join(scores, "row_id")


def _root_scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        yield pd.DataFrame({"row_id": rows.row_id, "score": [_unpack(b)[0, 0] for b in rows.matrix]})


def _encode(path: str | None):
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [encode_text(text, path) for text in rows.text]
            columns = {"ids": [ids for ids, _ in found], "score": [float(score) for _, score in found]}
            yield pd.DataFrame({"row_id": rows.row_id, **columns})

    return encode


def encode_pieces(
    docs: DataFrame, model: str | None = None, chunk: int = CHUNK, fan_in: int = FAN_IN
) -> DataFrame:
    """``row_id, ids, score`` of every whole text: ids of 32 bits each, and the total of their scores.

    The segmentation has the largest total score over the model's pieces, whatever its kind. Null and empty texts have no ids.
    Texts of more than ``chunk`` characters are scanned in chunks, which changes nothing but which of equal
    totals may be taken.
    """
    work = scratch(docs.sparkSession)
    rows = texts(docs).select("row_id", "text", F.char_length(F.col("text").cast("string")).alias("n"))
    short = rows.where(F.col("n") < chunk).select("row_id", "text")
    encoded = short.mapInPandas(_encode(model), "row_id long, ids binary, score double")
    return encoded.unionByName(_scan(rows.where(F.col("n") >= chunk), work, model, chunk, fan_in))


def _decode(path: str | None):
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = unigram(path)
        for rows in batches:
            found = [model.decode(np.frombuffer(ids, "<u4").tolist()) for ids in rows.ids]
            yield pd.DataFrame({"row_id": rows.row_id, "text": found})

    return decode


def decode_pieces(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """``row_id, text`` of ids made by ``encode_pieces``."""
    return encoded.select("row_id", "ids").mapInPandas(_decode(model), "row_id long, text string")


_REST = "n_pieces long, score double, ids_crc32 long, decoded_sha256 string, ids binary"
_PART = f"row_id long, doc_id long, {_REST}, chunk long, text string, at int, size int, last boolean"


def _merged(path: str | None, size: int, keep_ids: bool):
    """Short texts encoded, and the chunks of others, with what tokens may reach on both sides."""
    names = [c.split()[0] for c in _PART.split(", ")]

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = piece_bpe(path)
        for rows in batches:
            escaped = [model.escape(bytes(b).decode("utf-8", "replace")) if len(b) >= size else "" for b in rows.text]
            short = (b if len(e) <= size else b"" for b, e in zip(rows.text, escaped, strict=True))
            out = []
            about = zip(rows.row_id, rows.doc_id, escaped, model.encode(short), strict=True)
            for row_id, doc_id, text, (_, n, score, ids) in about:
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                if len(text) <= size:
                    digest = hashlib.sha256(model.decode(ids)).hexdigest()
                    told = (n, score, zlib.crc32(ids), digest, ids if keep_ids else None)
                    out.append((row_id, doc_id, *told, None, None, None, None, None))
                    continue
                for chunk, start in enumerate(range(0, len(text), size)):
                    at = min(start, model.longest)
                    part = text[start - at : start + size + model.longest - 1]
                    last = start + size >= len(text)
                    place = (chunk, part, at, min(size, len(text) - start), last)
                    out.append((row_id, doc_id, *[None] * 5, *place))
            found = pd.DataFrame(out, columns=names)
            kinds = dict.fromkeys(["doc_id", "n_pieces", "ids_crc32", "chunk", "at", "size"], "Int64")
            yield found.astype(kinds | {"last": "boolean"})

    return merged


def _merge_chunks(rows: pd.DataFrame, model) -> Iterator[MergeChunk]:
    for text, at, size, chunk, last in zip(rows.text, rows["at"], rows["size"], rows.chunk, rows["last"], strict=True):
        yield MergeChunk(model, text, int(at), int(size), int(chunk) == 0, bool(last))


def _merge_matrices(path: str | None):
    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = piece_bpe(path)
        states = States(model.longest)
        for rows in batches:
            found = [states.pack(c.matrix(states)) for c in _merge_chunks(rows, model)]
            yield pd.DataFrame({"row_id": rows.row_id, "node": rows.chunk, "matrix": found})

    return matrices


def _merge_multiply(longest: int):
    states = States(longest)

    def multiply(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for blob in rows.sort_values("node").matrix:
            matrix = states.unpack(blob)
            whole = matrix if whole is None else product(whole, matrix)
        return pd.DataFrame({"row_id": [key[0]], "node": [key[1]], "matrix": [states.pack(whole)]})

    return multiply


def _merge_roots(longest: int):
    states = States(longest)

    def roots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begin = states.number - 1
        for rows in batches:
            # Only states at the text's end are left, and one path leads there.
            leave = [int(np.flatnonzero(states.unpack(blob)[begin])[0]) for blob in rows.matrix]
            yield pd.DataFrame({"row_id": rows.row_id, "node": rows.node, "enter": begin, "leave": leave})

    return roots


def _merge_between(longest: int):
    states = States(longest)

    def between(key: tuple, rows: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        enter, leave = int(ends.enter.iloc[0]), int(ends.leave.iloc[0])
        matrices = [states.unpack(blob) for blob in rows.matrix]
        ahead = [matrices[0][enter]]
        for matrix in matrices[1:]:
            ahead.append(matrix[ahead[-1]].any(axis=0))
        found = [leave]
        for reached, matrix in zip(ahead[-2::-1], matrices[:0:-1], strict=True):
            found.append(int(np.flatnonzero(reached & matrix[:, found[-1]])[0]))
        found.reverse()
        return pd.DataFrame({"row_id": key[0], "node": rows.node, "enter": [enter, *found[:-1]], "leave": found})

    return between


def _merge_trace(path: str | None):
    def trace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = piece_bpe(path)
        states = States(model.longest)
        for rows in batches:
            chunks = list(_merge_chunks(rows, model))
            parts = (ids for _, _, _, ids in model.encode_escaped([chunk.middle() for chunk in chunks]))
            ends = zip(chunks, rows.enter, rows.leave, parts, strict=True)
            found = [chunk.ids(states.state(int(a)), states.state(int(b)), known) for chunk, a, b, known in ends]
            yield rows[["row_id", "doc_id", "chunk"]].assign(doc_id=rows.doc_id.astype("Int64"), ids=found)

    return trace


def _merge_digest(path: str | None, keep_ids: bool):
    """Rows of chunks in order, to one row per text: nothing of a text is held but its digests."""
    names = [c.split()[0] for c in f"row_id long, doc_id long, {_REST}".split(", ")]

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, own = piece_bpe(path), None
        scores = np.array(model.scores)

        def told() -> tuple:
            row_id, doc_id, n, score, crc, sha, held = own
            return row_id, doc_id, n, score, crc, sha.hexdigest(), b"".join(held) if keep_ids else None

        for rows in batches:
            out = []
            for row_id, doc_id, chunk, ids in zip(rows.row_id, rows.doc_id, rows.chunk, rows.ids, strict=True):
                if own is None or own[0] != row_id:
                    if own is not None:
                        out.append(told())
                    own = [row_id, None if pd.isna(doc_id) else int(doc_id), 0, 0.0, 0, hashlib.sha256(), []]
                ids = bytes(ids)
                own[2] += len(ids) // 4
                own[3] += float(scores[np.frombuffer(ids, "<u4")].sum())
                own[4] = zlib.crc32(ids, own[4])
                own[5].update(model.decode(ids, first=chunk == 0))
                if keep_ids:
                    own[6].append(ids)
            if out:
                yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})
        if own is not None:
            yield pd.DataFrame([told()], columns=names).astype({"doc_id": "Int64"})

    return digest


def merge_pieces(
    docs: DataFrame, model: str | None = None, chunk: int = CHUNK, fan_in: int = FAN_IN, keep_ids: bool = True
) -> DataFrame:
    """``row_id, doc_id, n_pieces, score, ids_crc32, decoded_sha256, ids`` of every whole text, as the library encodes it
    with a model of the BPE kind; ``ids`` (32 bits each) are null unless ``keep_ids``.

    Texts of more than ``chunk`` characters are scanned in chunks, which changes nothing. Null and empty texts have no
    ids; repeated rows and rows without doc_id are encoded like others; an empty table gives an empty result.
    """
    work, longest = scratch(docs.sparkSession), piece_bpe(model).longest
    parts = work.write(texts(docs).mapInPandas(_merged(model, chunk, keep_ids), _PART), "parts")
    columns = ["row_id", "doc_id", *[c.split()[0] for c in _REST.split(", ")]]
    short = parts.where("chunk is null").select(*columns)
    chunks = parts.where("chunk is not null").drop("n_pieces", "score", "ids_crc32", "decoded_sha256", "ids")
    most = chunks.agg(F.max("chunk")).first()[0]
    if most is None:
        return short
    spread = chunks.repartition("row_id", "chunk")
    levels = [work.write(spread.mapInPandas(_merge_matrices(model), _MATRIX), "level0")]
    parent, most = F.floor(F.col("node") / fan_in).cast("long"), most + 1
    while most > 1:
        most = -(-most // fan_in)
        groups = levels[-1].groupBy("row_id", parent.alias("up"))
        levels.append(work.write(groups.applyInPandas(_merge_multiply(longest), _MATRIX), f"level{len(levels)}"))
    states = work.write(levels[-1].mapInPandas(_merge_roots(longest), _STATE), "states")
    for depth in range(len(levels) - 2, -1, -1):
        children = levels[depth].groupBy("row_id", parent.alias("up"))
        both = children.cogroup(states.groupBy("row_id", "node"))
        states = work.write(both.applyInPandas(_merge_between(longest), _STATE), f"states{depth}")
    joined = chunks.join(states.withColumnRenamed("node", "chunk"), ["row_id", "chunk"])
    traced = joined.mapInPandas(_merge_trace(model), "row_id long, doc_id long, chunk long, ids binary")
    ordered = traced.repartition("row_id").sortWithinPartitions("row_id", "chunk")
    long = ordered.mapInPandas(_merge_digest(model, keep_ids), f"row_id long, doc_id long, {_REST}")
    return short.unionByName(long)


def _digest(path: str | None):
    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = unigram(path)
        for rows in batches:
            out = []
            for ids in rows.ids:
                body = model.decode(np.frombuffer(ids, "<u4").tolist()).encode()
                out.append((len(ids) // 4, zlib.crc32(ids), hashlib.sha256(body).hexdigest()))
            found = pd.DataFrame(out, columns=["n_pieces", "ids_crc32", "decoded_sha256"])
            yield pd.concat([rows[["row_id", "score"]].reset_index(drop=True), found], axis=1)

    return digest


def round_trip(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``doc_id, n_pieces, score, ids_crc32, decoded_sha256`` of every row, encoded and decoded again.

    The encoding is that of the model's kind, and ``score`` the total of its pieces' scores. Null and empty texts have
    no pieces; repeated rows and rows without doc_id have a row each; an empty table gives an empty result.
    """
    if is_bpe(model):
        found = merge_pieces(docs, model, keep_ids=False)
        return found.select("doc_id", "n_pieces", "score", "ids_crc32", "decoded_sha256")
    docs = stored(docs.select("doc_id", "text"), scratch(docs.sparkSession))
    schema = "row_id long, score double, n_pieces long, ids_crc32 long, decoded_sha256 string"
    found = encode_pieces(docs, model).mapInPandas(_digest(model), schema)
    ids = texts(docs).select("row_id", "doc_id")
    return ids.join(found, "row_id").drop("row_id")

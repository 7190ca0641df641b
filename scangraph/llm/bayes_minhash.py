"""Near duplicates: banded MinHash candidates, verified sequentially in the Bayesian way, then exactly.

1. Rows with the same words are one class, represented by its smallest row.
2. Representatives that share a band of MinHash values share a bucket. Pairs of a bucket are not listed.
   First its members are compared with one of them, which brings most near copies into one component. Then
   those outside the bucket's largest component are compared with all members of other components, block
   by block inside tasks. A task holds two blocks of members with their shingles, decides every pair there, and gives
   out only so many links as join the components that it finds linked: fewer rows than members.
3. A candidate's signatures are compared batch by batch; it is dropped when the posterior probability of
   reaching the threshold falls below the chosen miss probability. Survivors are compared on all their
   shingles, and links once more word by word.
4. Links are joined to components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scangraph.llm.common import row_column, scratch, stored, texts
from scangraph.llm.components import components

BANDS, BAND_ROWS = 48, 6
HASHES = BANDS * BAND_ROWS
#: Signature values compared between two looks at the posterior, and its miss probability at each.
BATCH, MISS = 32, 1e-7

#: Members of a bucket in one block, pairs that a task compares at once, and shingles that it counts at once.
BLOCK, PAIRS_AT_ONCE, SHINGLES_AT_ONCE = 512, 100_000, 4096

#: Words whose hashes a task remembers; a new one costs little.
_WORDS_KEPT = 100_000
_rng = np.random.default_rng(20_240_101)
_FACTORS = (_rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * 2 + 1).astype(np.uint32)[:, None]
_SHIFTS = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)[:, None]
_BAND_KEYS = _rng.integers(1, 1 << 63, (BANDS, BAND_ROWS), dtype=np.uint64) | np.uint64(1)
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SET = "row_id long, doc_id long, n_shingles long, words_digest binary, bands array<long>, signature binary"


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_word_hashes = _WordHashes()


def words_of(text: bytes) -> list[bytes]:
    """Runs of bytes other than the six ASCII white-space characters, A-Z lower-cased."""
    return bytes(text).lower().split()


def shingle_set(words: list[bytes], size: int) -> set[tuple]:
    """Distinct runs of ``size`` words; the whole sequence when it is shorter; empty without words."""
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(size)), strict=False))


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * _MIX
    return values ^ (values >> np.uint64(29))


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles."""
    known = _word_hashes
    hashes = np.array([known[w] for w in words], dtype=np.uint64)
    size = min(size, len(words))
    rolled = np.zeros(len(words) - size + 1, dtype=np.uint64)
    for i in range(size):
        rolled = rolled * _BASE + hashes[i : len(words) - size + 1 + i]
    return np.unique(_mixed(rolled))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the set."""
    low = (hashes >> np.uint64(16)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for start in range(0, len(low), 256):
        values = low[None, start : start + 256] * _FACTORS
        values += _SHIFTS
        np.minimum(least, values.min(axis=1), out=least)
    return least


def band_keys(values: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    rows = values.reshape(BANDS, BAND_ROWS).astype(np.uint64)
    mixed = (_mixed(rows * _BASE + np.uint64(1)) * _BAND_KEYS).sum(axis=1, dtype=np.uint64)
    return _mixed(mixed + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _sign(size: int):
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for row_id, doc_id, text in zip(rows.row_id, rows.doc_id, rows.text, strict=True):
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                words = words_of(text)
                if not words:
                    out.append((row_id, doc_id, 0, None, None, None))
                    continue
                hashes = shingle_hashes(words, size)
                values = signature(hashes)
                digest = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
                # 16 bits of each value are enough to compare signatures: by chance they agree in 1 of 65536.
                out.append(
                    (row_id, doc_id, len(hashes), digest, band_keys(values), values.astype("<u2").tobytes())
                )
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _SET.split(", ")]).astype({"doc_id": "Int64"})
        _word_hashes.clear()  # the worker goes on with other stages

    return sign


def least_matches(threshold: float, miss: float, hashes: int = HASHES, batch: int = BATCH) -> np.ndarray:
    """Matches needed after each batch, under a uniform prior of the similarity.

    After m matches of n the posterior is Beta(m + 1, n - m + 1), which lies above the threshold with the
    probability of at most m successes in n + 1 trials at the threshold.
    """
    needed = []
    for n in range(batch, hashes + 1, batch):
        below, m = 0.0, -1
        while below < miss:
            m += 1
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        needed.append(m)
    return np.array(needed)


def _likely(
    left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray, needed: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of rows (a of left, b of right) keep enough matches in every batch of hashes, and how many."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), dtype=np.int64)
    for step, least in enumerate(needed):
        part = slice(step * BATCH, (step + 1) * BATCH)
        matches = matches + (left[a[alive], part] == right[b[alive], part]).sum(axis=1)
        good = matches >= least
        alive, matches = alive[good], matches[good]
    return alive, matches


def _unpack(signatures: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), "<u2").reshape(-1, HASHES)


def _prune(percent: int, miss: float):
    needed = least_matches(percent / 100, miss)

    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            same = np.arange(len(rows))
            alive, _ = _likely(_unpack(rows.sig_a), _unpack(rows.sig_b), same, same, needed)
            yield rows.iloc[alive][["a", "b"]]

    return prune


def common_shingles(hashes: list[bytes], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Number of common shingles of every row of ``left`` and every row of ``right``, as a table."""

    def flat(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = [np.frombuffer(hashes[i], np.uint64) for i in rows]
        return np.concatenate(own), np.repeat(np.arange(len(rows)), [len(o) for o in own])

    (values_a, row_a), (values_b, row_b) = flat(left), flat(right)
    shared = np.intersect1d(values_a, values_b)
    counts = np.zeros((len(left), len(right)), np.float32)  # whole numbers up to 2 ** 24 are exact
    if not len(shared):
        return counts
    sides = []
    for values, row in ((values_a, row_a), (values_b, row_b)):
        place = np.minimum(np.searchsorted(shared, values), len(shared) - 1)
        known = np.flatnonzero(shared[place] == values)
        known = known[np.argsort(place[known], kind="stable")]
        sides.append((place[known], row[known]))
    for first in range(0, len(shared), SHINGLES_AT_ONCE):
        tables = []
        for (place, row), n in zip(sides, counts.shape, strict=True):
            lo, hi = np.searchsorted(place, [first, first + SHINGLES_AT_ONCE])
            table = np.zeros((n, min(SHINGLES_AT_ONCE, len(shared) - first)), np.float32)
            table[row[lo:hi], place[lo:hi] - first] = 1
            tables.append(table)
        counts += tables[0] @ tables[1].T
    return counts


def _forest(a: np.ndarray, b: np.ndarray, comp_a: np.ndarray, comp_b: np.ndarray) -> np.ndarray:
    """Places of so many of the links as join all components that the links join."""
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while root.setdefault(c, c) != c:
            root[c] = c = root[root[c]]
        return c

    _, first = np.unique(np.stack([comp_a, comp_b]), axis=1, return_index=True)
    kept = []
    for i in first.tolist():
        x, y = find(int(comp_a[i])), find(int(comp_b[i]))
        if x != y:
            root[x] = y
            kept.append(i)
    return np.array(kept, np.int64)


def _compare_blocks(percent: int, miss: float, forest: bool):
    """Links of each two blocks of a bucket (sorted rows): members outside the bucket's largest component
    (``outside``) with members of any. With ``forest``, just enough of them to join what they join."""
    needed = least_matches(percent / 100, miss)

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        signatures = _unpack(rows.signature)
        node, comp, size = (rows[c].to_numpy() for c in ("node", "comp", "n_shingles"))
        outside, minor = rows.outside.to_numpy(), rows.minor.to_numpy()
        x, y = np.flatnonzero(outside), np.flatnonzero(~outside)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        step = max(1, PAIRS_AT_ONCE // max(1, len(y)))
        for at in range(0, len(x) if len(y) else 0, step):
            own = x[at : at + step]
            small, large = (f(size[own][:, None], size[y]) for f in (np.minimum, np.maximum))
            fit = (comp[own][:, None] != comp[y]) & (100 * small >= percent * large)
            # Two members outside meet twice: once is enough.
            fit &= ~minor[y] | (node[own][:, None] < node[y])
            i, j = np.nonzero(fit)
            alive, _ = _likely(signatures, signatures, own[i], y[j], needed)
            found.append((at + i[alive], j[alive]))
        i, j = (np.concatenate(side) for side in zip(*found, strict=True))
        if len(i):
            left, i = np.unique(i, return_inverse=True)
            right, j = np.unique(j, return_inverse=True)
            x, y = x[left], y[right]
            common = common_shingles(list(rows.hashes), x, y)[i, j]
            linked = 100 * common >= percent * (size[x[i]] + size[y[j]] - common)
            i, j = x[i[linked]], y[j[linked]]
            if forest:
                kept = _forest(i, j, comp[i], comp[j])
                i, j = i[kept], j[kept]
        return pd.DataFrame({"a": node[i], "b": node[j]}, dtype="int64")

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for rows in batches:
            rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
            keys = rows[["bucket", "block", "other"]].to_numpy()
            starts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            cuts = [0, *starts.tolist()]
            found = [compare(rows.iloc[lo:hi]) for lo, hi in zip(cuts, cuts[1:], strict=False)]
            held = rows.iloc[cuts[-1] :]
            if found:
                yield pd.concat(found)
        if held is not None and len(held):
            yield compare(held)

    return blocks


def _shingles(size: int):
    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [shingle_hashes(words_of(text), size).tobytes() for text in rows.text]
            yield pd.DataFrame({"node": rows.node, "hashes": found})
        _word_hashes.clear()

    return shingles


def _confirm(size: int, percent: int):
    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, left = None, set()
        for rows in batches:
            linked = []
            for a, text_a, text_b in zip(rows.a, rows.text_a, rows.text_b, strict=True):
                if a != last:  # rows come sorted by a
                    last, left = a, shingle_set(words_of(text_a), size)
                right = shingle_set(words_of(text_b), size)
                common = len(left & right)
                linked.append(100 * common >= percent * (len(left) + len(right) - common))
            yield rows.loc[linked, ["a", "b"]]

    return confirm


class _Verifier:
    """Checks pairs ``a, b`` of representatives, first by signatures, then by full sets."""

    def __init__(self, work, signatures: DataFrame, bodies: DataFrame, size: int, percent: int, miss: float):
        self.work, self.signatures, self.bodies = work, signatures, bodies
        self.size, self.percent, self.miss = size, percent, miss

    def _ends(self, pairs: DataFrame, table: DataFrame, end: str, names: dict[str, str]) -> DataFrame:
        columns = [F.col("node").alias(end)] + [F.col(k).alias(f"{v}_{end}") for k, v in names.items()]
        return pairs.join(table.select(columns), end)

    def likely(self, candidates: DataFrame, name: str) -> DataFrame:
        """Candidates whose signatures leave the threshold possible."""
        pairs = self.work.write(candidates.distinct(), f"{name}_candidates")
        names = {"n_shingles": "n", "signature": "sig"}
        signed = self._ends(self._ends(pairs, self.signatures, "b", names), self.signatures, "a", names)
        return signed.mapInPandas(_prune(self.percent, self.miss), "a long, b long")

    def confirmed(self, pairs: DataFrame, name: str) -> DataFrame:
        """Pairs whose full sets reach the threshold."""
        pairs = self.work.write(pairs, f"{name}_likely")
        full = self._ends(self._ends(pairs, self.bodies, "b", {"text": "text"}), self.bodies, "a", {"text": "text"})
        # Equal pivots may be dealt to several tasks but stay together inside one.
        full = full.sortWithinPartitions("a").mapInPandas(_confirm(self.size, self.percent), "a long, b long")
        return self.work.write(full, f"{name}_links")


def _link_buckets(members: DataFrame, verify: _Verifier, work) -> DataFrame:
    """``node, root`` of all linked nodes. ``members``: bucket, node, n_shingles."""
    pivots = members.groupBy("bucket").agg(F.min(F.struct("node", "n_shingles")).alias("p"))
    pivots = work.write(pivots.select("bucket", F.col("p.node").alias("a"), F.col("p.n_shingles").alias("n")), "pivots")
    stars = members.join(pivots, "bucket").where("a <> node")
    fit = F.least("n", "n_shingles") * 100 >= F.greatest("n", "n_shingles") * verify.percent
    stars = stars.where(fit).select("a", F.col("node").alias("b"))
    links = verify.confirmed(verify.likely(stars, "star"), "star")
    roots = components(links, work, "star_roots")
    # Links are decided on hashes of shingles. Should two shingles ever share one, a link may not stand the test on
    # words; then all links of the blocks are tested, not just enough of them.
    for name, forest in (("forest", True), ("every", False)):
        pairs = work.write(_separate_links(members, pivots, roots, verify, work, name, forest), f"{name}_found")
        confirmed = verify.confirmed(pairs, name)
        links = links.union(confirmed)
        roots = components(links, work, f"{name}_roots")
        if confirmed.count() == pairs.count():
            break
    return roots


def _separate_links(
    members: DataFrame, pivots: DataFrame, roots: DataFrame, verify: _Verifier, work, name: str, forest: bool
) -> DataFrame:
    """Links ``a, b`` between members of a bucket that are in different components."""
    comp = F.coalesce("root", "node").alias("comp")
    # The pairs of a bucket's pivot are decided.
    left = members.join(pivots.select("bucket", "a"), "bucket").where("a <> node")
    owned = work.write(left.join(roots, "node", "left").select("bucket", "node", "n_shingles", comp), f"{name}_owned")
    parts = owned.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    top = F.max(F.struct("n", "comp")).alias("top")
    crowds = parts.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("comps"), top)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")
    others = F.ceil((F.col("n") - F.col("top.n")) / BLOCK).cast("int").alias("others")
    crowds = crowds.where("comps > 1").select("bucket", blocks, others, F.col("top.comp").alias("major"))
    crowds = work.write(crowds, f"{name}_crowds")
    minor = (F.col("comp") != F.col("major")).alias("minor")
    live = owned.join(crowds, "bucket").select("bucket", "node", "n_shingles", "comp", "blocks", "others", minor)

    nodes = work.write(live.select("node").distinct(), f"{name}_nodes")
    hashed = verify.bodies.join(nodes, "node").select("node", "text").mapInPandas(_shingles(verify.size), "node long, hashes binary")
    sets = work.write(hashed.join(verify.signatures.select("node", "signature"), "node"), f"{name}_sets")

    def places(count: str, block: Column | None, other: Column | None, outside: bool) -> Column:
        """Where a member is sent: its own block meets every block of the other side."""

        def place(i: Column) -> Column:
            pair = (i if block is None else block), (i if other is None else other)
            return F.struct(pair[0].cast("int").alias("block"), pair[1].cast("int").alias("other"), F.lit(outside).alias("outside"))

        return F.transform(F.sequence(F.lit(0), F.col(count) - 1), place)

    inside = places("others", F.pmod(F.xxhash64("node"), F.col("blocks")), None, False)
    out = places("blocks", None, F.pmod(F.xxhash64("node", F.lit(1)), F.col("others")), True)
    sent = F.explode(F.when(F.col("minor"), F.concat(inside, out)).otherwise(inside)).alias("at")
    placed = live.select("bucket", "node", "n_shingles", "comp", "minor", sent).select("*", "at.*").drop("at")
    ordered = placed.join(sets, "node").repartition("bucket", "block", "other").sortWithinPartitions("bucket", "block", "other")
    return ordered.mapInPandas(_compare_blocks(verify.percent, verify.miss, forest), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, miss: float = MISS) -> DataFrame:
    """One row per row of ``docs``: ``row_id, doc_id, n_shingles, component_id, first_row``.

    Words are runs without ASCII white space, A-Z lower-cased. Two texts are linked when their sets of
    distinct word shingles have a similarity of at least ``percent`` hundredths; a text with fewer words
    has its whole sequence as one shingle; null, empty and blank texts have none and stay alone.
    ``component_id`` is the smallest doc_id reachable over links, null where all are null; ``first_row`` is
    true for one row of each component, that with the smallest doc_id (null last), then the first.
    """
    work = scratch(docs.sparkSession)
    docs = docs if row_column(docs) else stored(docs.select("doc_id", "text"), work)
    sets = work.write(texts(docs).mapInPandas(_sign(shingle_words), _SET), "sets")
    heads = sets.select("row_id", "words_digest").where("words_digest is not null")
    classes = work.write(heads.groupBy("words_digest").agg(F.min("row_id").alias("node")), "classes")

    signed = sets.withColumnRenamed("row_id", "node").where("n_shingles > 0")
    buckets = signed.select("node", "n_shingles", "bands").join(classes.select("node"), "node", "left_semi")
    buckets = buckets.select(F.explode("bands").alias("bucket"), "node", "n_shingles")
    buckets = work.write(buckets, "buckets")
    crowded = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = work.write(buckets.join(work.write(crowded, "crowded"), "bucket"), "members")
    work.delete("buckets")
    nodes = work.write(members.select("node").distinct(), "nodes")
    signatures = work.write(signed.select("node", "n_shingles", "signature").join(nodes, "node"), "signatures")
    bodies = texts(docs).select(F.col("row_id").alias("node"), "text").join(nodes, "node")
    bodies = work.write(bodies, "bodies")

    verify = _Verifier(work, signatures, bodies, shingle_words, percent, miss)
    roots = _link_buckets(members, verify, work)

    rooted = classes.join(roots, "node", "left")
    rooted = work.write(rooted.select("words_digest", F.coalesce("root", "node").alias("root")), "rooted")
    rows = sets.select("row_id", "doc_id", "n_shingles", "words_digest").join(rooted, "words_digest", "left")
    rows = work.write(rows.withColumn("root", F.coalesce("root", "row_id")).drop("words_digest"), "rows")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id")
    tops = work.write(rows.groupBy("root").agg(F.min(order).alias("top")), "tops")
    return rows.join(tops, "root").select(
        "row_id",
        "doc_id",
        "n_shingles",
        F.col("top.doc_id").alias("component_id"),
        (F.col("row_id") == F.col("top.row_id")).alias("first_row"),
    )

import hashlib
import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from scangraph.llm.bayes_minhash import least_matches, near_duplicates, shingle_set, words_of
from scangraph.llm.common import Scratch, keep_rows, row_column, stored, texts
from scangraph.llm.components import components
from scangraph.llm.exact_dedup import exact_duplicates
from scangraph.llm.suffix_levels import LENGTH, LevelIndex, repeated_passages, window_anchors, without_passages


def folded(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


@pytest.mark.parametrize("block", [4, 4096])
def test_exact_duplicates(table, odd_rows, block):
    groups = defaultdict(list)
    for doc_id, text in odd_rows:
        groups[folded(text)].append(doc_id)
    expected = Counter()
    for text, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        for i in ids:
            expected[i, top, len(ids), hashlib.sha256(text.encode()).hexdigest()] += 1
    found = exact_duplicates(table(odd_rows), block_bytes=block).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == expected
    kept = Counter(r.text_sha256 for r in found if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


def test_empty_tables(table):
    empty = table([])
    assert exact_duplicates(empty).collect() == []
    assert near_duplicates(empty).collect() == []
    assert repeated_passages(empty).collect() == []
    assert without_passages(empty).columns == empty.columns


def links(rows, size):
    sets = [shingle_set(words_of((t or "").encode()), size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
            root[find(b)] = find(a)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(rows[i][0])
    least = {i: min((m for m in members[find(i)] if m is not None), default=None) for i in range(len(rows))}
    return Counter((rows[i][0], len(sets[i]), least[i]) for i in range(len(rows))), len(members)


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(table, odd_rows, size):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma".split()
    edits = [(100 + i, " ".join(base[:i] + [f"new{i}"] + base[i + 1 :] + base[:6])) for i in range(0, 18, 2)]
    rows = odd_rows + edits
    expected, groups = links(rows, size)
    found = near_duplicates(table(rows), shingle_words=size).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == expected
    assert sum(r.first_row for r in found) == groups


def test_a_family_just_below_the_threshold(table, monkeypatch):
    """A third of all rows share a template, in several blocks of a bucket; few of them are linked with any other."""
    monkeypatch.setattr("scangraph.llm.bayes_minhash.BLOCK", 16)
    rng = random.Random(5)
    template = [f"t{i}" for i in range(60)]
    rows = []
    for i in range(90):
        words = [w if rng.random() < 0.945 else f"x{rng.randrange(10**6)}" for w in template]
        rows.append((i, " ".join(words)))
    rows += [(200 + i, " ".join(rng.choice(template) for _ in range(40))) for i in range(90)]
    sets = [shingle_set(words_of(t.encode()), 2) for _, t in rows[:90]]
    similar = [len(a & b) / len(a | b) for a, b in combinations(sets, 2)]
    assert np.mean([0.6 < s < 0.8 for s in similar]) > 0.4 and sum(s >= 0.8 for s in similar) > 50
    expected, groups = links(rows, 2)
    found = near_duplicates(table(rows), shingle_words=2).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == expected
    assert sum(r.first_row for r in found) == groups


def test_common_shingles_and_forest(monkeypatch):
    from scangraph.llm import bayes_minhash

    monkeypatch.setattr(bayes_minhash, "SHINGLES_AT_ONCE", 7)
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(12)]
    left, right = np.arange(5), np.arange(5, 12)
    counts = bayes_minhash.common_shingles([s.tobytes() for s in sets], left, right)
    assert counts.tolist() == [[len(set(sets[i]) & set(sets[j])) for j in right] for i in left]
    comp_a, comp_b = np.array([1, 1, 2, 1, 3]), np.array([2, 4, 4, 2, 5])
    kept = bayes_minhash._forest(comp_a, comp_b, comp_a, comp_b)
    assert len(kept) == 3 and {5, 3} in [{comp_a[i], comp_b[i]} for i in kept]


def test_posterior_bounds():
    needed = least_matches(0.8, 1e-7)
    assert (np.diff(needed) > 0).all() and needed[-1] < 0.8 * 288
    # Fewer matches are needed when less may be missed.
    assert (least_matches(0.8, 1e-9) <= needed).all()


def test_components(spark, work):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (7, 7)]
    found = components(spark.createDataFrame(chain, "a long, b long"), work, "roots")
    roots = {r.node: r.root for r in found.collect()}
    assert len({roots[i] for i in range(41)}) == 1 and roots[100] == roots[102] != roots[0]


def passages(rows):
    """Removed bytes by the definition, document by document."""
    far = (1 << 63) - 1
    first = {}
    bodies = [(far if i is None else i, (t or "").encode()) for i, t in rows]
    for doc_id, body in bodies:
        for p in range(len(body) - LENGTH + 1):
            window = body[p : p + LENGTH]
            first[window] = min(doc_id, first.get(window, far))
    out = Counter()
    for (shown, _), (doc_id, body) in zip(rows, bodies, strict=True):
        covered = bytearray(len(body))
        for p in range(len(body) - LENGTH + 1):
            if first[body[p : p + LENGTH]] < doc_id:
                covered[p : p + LENGTH] = b"\1" * LENGTH
        kept = bytes(x for x, c in zip(body, covered, strict=True) if not c)
        spans = sum(c and not (i and covered[i - 1]) for i, c in enumerate(covered))
        out[shown, len(body), sum(covered), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_repeated_passages(table, odd_rows):
    found = repeated_passages(table(odd_rows)).collect()
    columns = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found]
    assert Counter(columns) == passages(odd_rows)


def test_cut_texts_keep_whole_characters(table):
    shared = "é" * 40
    docs = table([(1, "abc" + shared), (2, "日" + shared + "日"), (3, None)])
    found = {r.doc_id: r.text for r in without_passages(docs).collect()}
    assert found == {1: "abc" + shared, 2: "日日", 3: None}


def test_levels_grow_geometrically():
    rng, index, known = np.random.default_rng(1), LevelIndex(), set()
    for _ in range(12):
        windows = np.unique(rng.integers(0, 400, 50).astype(f"S{LENGTH}"))
        expected = [w in known for w in windows.tolist()]
        seen = index.scan(windows)
        assert seen.tolist() == expected
        index.add(windows[~seen])
        known |= set(windows.tolist())
    sizes = [len(level) for level in index.levels]
    assert all(a > 2 * b for a, b in zip(sizes, sizes[1:], strict=False)) and sum(sizes) == len(known)


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(2)
    window = rng.integers(0, 256, LENGTH, dtype=np.uint8)
    data = np.concatenate([rng.integers(0, 256, 90, dtype=np.uint8), window, window[:7], window])
    anchors = window_anchors(data)
    assert anchors[90] == anchors[90 + LENGTH + 7]


def test_keep_rows_keeps_all_columns(spark, table, odd_rows):
    docs = stored(table(odd_rows), Scratch.fresh(spark))
    assert row_column(docs) == "_row_"  # the table has a column _row of its own, which is not trusted
    numbers = texts(docs).where("text = cast('one' as binary)").select("row_id")
    assert [(r.doc_id, r.row_id, r._row) for r in keep_rows(docs, numbers.union(numbers)).collect()] == [(10, "x", "x")]
    assert keep_rows(docs, numbers.limit(0)).collect() == []

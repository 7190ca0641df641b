import hashlib
import random
import re
import zlib
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from scangraph.llm import periodic_runs as runs
from scangraph.llm.queries import ALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF_DIR = "/root/testdata/sf0.001"


def plain_runs(words):
    """All runs, by every period and every place."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            end = i
            while end + q < n and words[end] == words[end + q]:
                end += 1
            if end > i:
                start, end = i, end + q
                smaller = any(all(words[k] == words[k + r] for k in range(start, end - r)) for r in range(1, q))
                if end - start >= max(6, 4 * q) and not smaller:
                    found.append((start, end - start, q))
                i = end - q
            i += 1
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapsed(words, found):
    gone = {i for start, length, q in found for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def made_texts(rng, count):
    for _ in range(count):
        letters, n = "abcd"[: rng.randint(1, 4)], rng.randint(0, 70)
        words = [rng.choice(letters) for _ in range(n)]
        if n and rng.random() < 0.7:
            a = rng.randrange(n)
            p = rng.randint(1, max(1, (n - a) // 3))
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            words += [rng.choice(letters) for _ in range(rng.randint(0, 9))]
        yield words


@pytest.mark.parametrize("convolved", [runs.CONVOLVED, 2])
def test_runs_against_every_period(convolved, monkeypatch):
    monkeypatch.setattr(runs, "CONVOLVED", convolved)
    texts = list(made_texts(random.Random(4), 800))
    for first in range(0, len(texts), 3):
        together = texts[first : first + 3]
        found = runs.document_runs([" ".join(w).encode() for w in together])
        for words, (own, kept) in zip(together, found, strict=True):
            expected = plain_runs(words)
            assert [(int(s), int(e - s), int(q)) for s, e, q in own] == expected
            assert kept.decode() == collapsed(words, expected)


def test_transform_is_exact():
    rng = np.random.default_rng(2)
    rows = rng.integers(0, runs.PRIME, (3, 64), dtype=np.uint64)
    assert (runs.inverse_transform(runs.transform(rows)) == rows).all()
    for size in (1, 2, 16, 128):
        top = int((runs.PRIME // size) ** 0.5)
        blocks = rng.integers(0, top, (5, size)).astype(np.uint64)
        windows = rng.integers(0, top, (5, 2 * size)).astype(np.uint64)
        plain = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y[k : k + size], strict=True)) for k in range(size)]
                 for x, y in zip(blocks, windows, strict=True)]
        assert runs.mismatches(blocks, windows).tolist() == plain


def test_words_that_share_a_code():
    # Of a long block the codes are small: different words have equal ones.
    body = [f"w{i}" for i in range(3000)]
    changed = [f"v{i}" for i in range(3000)]
    found = runs.document_runs([" ".join(body * 4).encode(), " ".join(body + changed + body + changed).encode()])
    assert [own.tolist() for own, _ in found] == [[[0, 12000, 3000]], []]


def expected_row(doc_id, text):
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    words, g = WORD.findall(text or ""), h // 10
    n = len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    digests = [hashlib.sha256(t.encode()).hexdigest() for t in (listed, collapsed(words, found))]
    return (doc_id, len(found), *top, *digests)


COLUMNS = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()


def test_odd_rows(spark, table, odd_rows, tmp_path):
    rows = [r for r in odd_rows if len(r[1] or "") < 9001]
    rows += [(i, " ".join(words)) for i, words in enumerate(made_texts(random.Random(6), 150), 100)]
    rows += [(2000, "\x0b a\x0ba\ta\ra a\xa0 a a\x0ca"), (2001, "x " * 3000), (2002, "a b " * 900 + "a")]
    table(rows, "documents.parquet")
    found = ALL["op12_periodic_runs"](spark, str(tmp_path))
    assert found.columns == COLUMNS
    assert sorted(map(tuple, found.collect()), key=repr) == sorted((expected_row(*r) for r in rows), key=repr)
    assert sum(r.n_runs > 1 for r in found.collect()) > 3


def test_very_long_text(spark, table):
    block = " ".join(f"w{i * i % 5003}" for i in range(9000))
    docs = table([(1, f"start {block} {block} {block} {block} {block} end")])
    (row,) = runs.periodic_runs(docs).collect()
    assert [tuple(r) for r in row.runs] == [(1, 45000, 9000)]
    assert bytes(row.collapsed).decode() == f"start {block} end"



def test_no_rows(spark, table, tmp_path):
    table([], "documents.parquet")
    assert ALL["op12_periodic_runs"](spark, str(tmp_path)).collect() == []


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")
def test_given_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").where(F.length("text") < 4000)
    changed = {r.doc_id: r.text for r in runs.with_planted_runs(docs).collect()}
    found = {r.doc_id: r for r in ALL["op12_periodic_runs"](spark, SF_DIR).collect()}
    for doc_id, text in docs.collect():
        assert tuple(found[doc_id]) == expected_row(doc_id, text)
    assert sum(changed[d] != t for d, t in docs.collect()) > 5

import hashlib
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from scangraph.llm import bloom_lookup, content_archive
from scangraph.llm.bloom_lookup import fingerprints
from scangraph.llm.common import on_scratch
from scangraph.llm.content_archive import (
    archive_pages,
    export_warc,
    read_pages,
    read_warc,
    read_warc_pages,
    records,
    write_archive,
)


@pytest.fixture
def pages(spark, tmp_path):
    big = "<p>" + "ü" * 600
    rows = [
        (1, "http://a/1", big),
        (2, "http://a/2\r\nX: y", big),
        (2, "http://a/2", big),
        (None, None, big),
        (3, "http://a/3", "small"),
        (4, "http://a/4", "small"),
        (5, None, None),
        (6, "http://a/6", ""),
        (7, "http://a/7", "x\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 60),
        (8, "http://a/8", "z" * 300_000),
    ]
    path = str(tmp_path / "pages")
    schema = "page_id long, url string, html string, payload string, digest string, top string"
    spark.createDataFrame([(*r, "x", "y", "z") for r in rows], schema).write.parquet(path)
    return rows, spark.read.parquet(path)


def test_archive_round_trip(spark, pages, tmp_path):
    rows, table = pages
    archive = write_archive(table, str(tmp_path / "archive"))
    found = read_pages(archive).collect()
    expected = Counter()
    for page_id, _, html in rows:
        body = (html or "").encode()
        expected[page_id, len(body), hashlib.sha1(body).hexdigest()] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in found) == expected
    kinds = Counter((r.page_id, r.record_type, r.refers_to) for r in found if r.payload_bytes == 1203)
    assert kinds == Counter([(1, "revisit", 2), (2, "response", None), (2, "revisit", 2), (None, "revisit", 2)])
    assert all(r.record_type == "response" and r.refers_to is None for r in found if r.payload_bytes != 1203)
    assert archive.payloads.count() == len({html or "" for *_, html in rows})

    export_warc(archive, str(tmp_path / "warc"))
    again = read_warc(spark, str(tmp_path / "warc"))
    assert Counter(bytes(r.record) for r in again.collect()) == Counter(
        bytes(r.record) for r in records(archive).collect()
    )
    assert again.where("record_type = 'revisit'").count() == 3
    rows_of = lambda df: Counter(map(tuple, df.select(read_pages(archive).columns).collect()))
    assert rows_of(read_warc_pages(spark, str(tmp_path / "warc"))) == rows_of(read_pages(archive)) == rows_of(archive_pages(table))
    assert archive_pages(table.limit(0)).collect() == []


def test_long_payloads_are_not_shuffled_again(spark, pages, tmp_path, monkeypatch):
    exported = []
    monkeypatch.setattr(content_archive, "export_warc", lambda archive, *more: exported.append(archive) or export_warc(archive, *more))
    archive_pages(pages[1])
    plan = exported[0].payloads.groupBy("digest").count()._jdf.queryExecution().toString()
    assert "Exchange hashpartitioning(digest" not in plan


@pytest.mark.parametrize(("damage", "message"), [("cut", "bytes long|cut off|not found"), ("change", "damaged payload"), ("lose", "no response")])
def test_damaged_files_are_found(spark, pages, tmp_path, damage, message):
    export_warc(write_archive(pages[1], str(tmp_path / "archive")), str(tmp_path / "warc"))
    files = sorted((tmp_path / "warc").glob("part*"))
    texts = [f.read_bytes() for f in files]
    place = next(i for i, t in enumerate(texts) if b"http://a/8" in t) if damage != "lose" else next(
        i for i, t in enumerate(texts) if "ü".encode() in t)
    if damage == "cut":
        texts[place] = texts[place].replace(b"z" * 1000, b"z" * 999)
    elif damage == "change":
        texts[place] = texts[place].replace(b"z" * 1000, b"y" * 1000)
    else:  # the response goes, its revisits stay
        first = texts[place]
        begin = first.rindex(b"WARC/1.1", 0, first.index("ü".encode()))
        end = first.index("ü".encode()) + 1200 + 4
        texts[place] = first[:begin] + first[end:]
    (tmp_path / "damaged").mkdir()
    for f, t in zip(files, texts, strict=True):
        (tmp_path / "damaged" / f.name).write_bytes(t)
    with pytest.raises(Exception, match=message):
        read_warc_pages(spark, str(tmp_path / "damaged")).collect()


def test_damaged_payload_is_found(spark, pages, tmp_path):
    archive = write_archive(pages[1], str(tmp_path / "archive"))
    bad = archive.payloads.withColumn("payload", F.concat("payload", F.lit(b"!")))
    with pytest.raises(Exception, match="damaged payload"):
        read_pages(type(archive)(archive.headers, bad)).collect()


def test_empty_tables(pages, table, tmp_path):
    archive = write_archive(pages[1].limit(0), str(tmp_path / "none"))
    assert read_pages(archive).collect() == []
    assert fingerprints(table([])).collect() == []


def cut(text):
    pieces = set()
    for line in text.split("\n"):
        piece = ""
        for i, word in enumerate(line.split(" ") if len(line) > 80 else []):
            piece += word
            if xxhash.xxh64_intdigest(word.encode(), 42) % 16 == 0 or i % 32 == 31:
                pieces.add(piece)
                piece = ""
            else:
                piece += " "
        pieces.add(piece if len(line) > 80 else line)
    return pieces - {""}


def likeness(a, b):
    a, b = cut(a), cut(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(table, odd_rows):
    many = [(200 + i, "\n".join(f"line {j * (i + 1)}" for j in range(60 * i))) for i in range(4)]
    rows = odd_rows + many
    places = {(i, t or "") for i, t in rows}
    order = sorted(places, key=lambda p: (p[0] is None, -(p[0] or 0), hashlib.sha256(p[1].encode()).hexdigest()))
    expected = Counter()
    for k, (doc_id, text) in enumerate(order):
        following, half = order[(k + 1) % len(order)][1], len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        result = (
            doc_id,
            len(text),
            hashlib.sha256(edited.encode()).hexdigest(),
            round(likeness(text, edited), 9),
            round(likeness(text, following), 9),
        )
        expected[result] += sum((i, t or "") == (doc_id, text) for i, t in rows)
    found = fingerprints(table(rows)).collect()
    columns = [(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in found]
    assert Counter(columns) == expected
    by_text = {}
    for r in found:
        text = next(t or "" for i, t in rows if i == r.doc_id and len(t or "") == r.n_chars)
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
    assert all(len(r.fingerprint) == len(r.edited_fingerprint) for r in found)


def test_a_text_of_one_line_keeps_its_first_half(table):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["re", "and", "of", "thing"]) + str(rng.randrange(500)) for _ in range(200))) for i in range(30)]
    found = fingerprints(table(rows)).collect()
    assert min(r.near_edited for r in found) > 0.15 and np.mean([r.near_edited for r in found]) > 0.25
    assert max(r.near_next for r in found) == 0


def test_fingerprints_shuffle_texts_once_and_store_little(spark, table):
    """Digests are recovered in the rows of their texts, and scratch tables hold neither texts nor all digests."""
    rng = random.Random(8)
    rows = [(i, "\n".join(f"{rng.getrandbits(200):050x}" for _ in range(60))) for i in range(200)]
    spaces, docs = [], table(rows)
    stop = on_scratch(spaces.append)
    try:
        found = fingerprints(docs)
    finally:
        stop()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    stored = sum(f.stat().st_size for f in Path(spaces[0].root.removeprefix("file:")).rglob("*.parquet"))
    assert stored < sum(len(t) for _, t in rows)
    assert all(r.near_next == 0 and 0.3 < r.near_edited < 0.36 for r in found.collect())


def test_fingerprints_of_one_row_and_of_many_ranges(table, monkeypatch):
    monkeypatch.setattr(bloom_lookup, "RANGE_BYTES", 10)
    for n in (1, 2, 40):
        rows = [(i, f"a{i}\nb{i}") for i in range(n)]
        found = {r.doc_id: r.edited_sha256 for r in fingerprints(table(rows, f"docs{n}")).collect()}
        for i, text in rows:
            following, half = rows[(i - 1) % n][1], len(text) // 2
            assert found[i] == hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest()


def test_fingerprint_plan_has_no_python(table, odd_rows):
    plan = fingerprints(table(odd_rows))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan

import random

import pytest

#: Columns that operators use inside.
CLASHING = "row_id _row _scangraph_row name node batch g keep_id bucket text_sha256 row_id_ digest chunk section".split()


@pytest.fixture
def table(spark, tmp_path):
    """Write rows of (doc_id, text) to files and read them, with columns of clashing names beside."""

    def make(rows, name="docs", id_name="doc_id", text_name="text", more=""):
        path = str(tmp_path / name)
        schema = f"{id_name} long, {text_name} string, " + ", ".join(f"{c} string" for c in CLASHING)
        full = [(*r, *["x"] * len(CLASHING)) for r in rows]
        spark.createDataFrame(full, schema).repartition(2).write.parquet(path)
        return spark.read.parquet(path)

    return make


@pytest.fixture
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, copies in other case, shared passages."""
    rng = random.Random(5)
    words = ["the", "Of", "and", "über", "日本", "x1", "loser", "thing", "ing", "re"]

    def text(n):
        return " ".join(rng.choice(words) + rng.choice(["", ",", ".\n"]) for _ in range(n))

    shared = text(40)
    long = text(4000)
    return [
        (1, text(30)),
        (2, shared + " " + text(20)),
        (3, text(25) + shared),
        (4, shared.upper()),
        (5, shared),
        (5, shared),
        (6, ""),
        (7, None),
        (None, text(12)),
        (None, shared),
        (None, None),
        (8, long),
        (9, long + " end"),
        (10, "one"),
        (11, "One"),
        (12, " \n "),
        (13, "  a   b  "),
        (14, shared + "!"),
        (-3, "x" * 9000),
        (15, "x" * 120),
    ]

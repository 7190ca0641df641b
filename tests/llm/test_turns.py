import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache
from pathlib import Path

import pytest

from scangraph.llm import turn_alignment as turns
from scangraph.llm.queries import ALL
from scangraph.llm.turn_alignment import Alignment, damaged, repair_conversations, repaired_turns

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
BLANK = " \t\n\x0b\x0c\r"
NEXT = {"": "us", "s": "u", "u": "a", "a": "u"}


def cheapest(signs):
    """Cost and letters by a search over turns and the last role, without any table of lengths."""

    @lru_cache(None)
    def search(i, last, inserted):
        ways = [(0, "")] if i == len(signs) and last in ("", "a") else []
        if i < len(signs):
            cost, rest = search(i + 1, last, 0)
            ways.append((cost + 3, "D" + rest))
            if signs[i] != "d":
                role, cut = signs[i].lower(), signs[i].isupper()
                for new in NEXT[last]:
                    cost, rest = search(i + 1, new, 0)
                    if role == new:
                        ways.append((cost + cut, "K" + rest))
                    elif new != "s":
                        ways.append((cost + cut + 2, "R" + rest))
        if inserted < 4:
            for new in NEXT[last].replace("s", ""):
                cost, rest = search(i, new, inserted + 1)
                ways.append((cost + 2, "I" + rest))
        return min(ways, default=(10**9, ""))

    return search(0, "", 0)


def plain(rows):
    """The contract's row for one conversation of (turn, role, text), in order."""
    seen, signs, counts = set(), [], dict.fromkeys(["blank", "duplicate", "truncated"], 0)
    for _, role, text in rows:
        body, initial = text.strip(BLANK), role[:1]
        kind = initial if initial and initial in "sua" else "x"
        if not body:
            counts["blank"] += 1
            kind = "d"
        elif (role, text) in seen:
            counts["duplicate"] += 1
            kind = "d"
        elif body[-1] not in ".!?":
            counts["truncated"] += 1
            kind = kind.upper()
        seen.add((role, text))
        signs.append(kind)
    numbers = {r[0] for r in rows if r[0] is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, letters = cheapest("".join(signs))
    lines, i, last = [], 0, ""
    for letter in letters:
        if letter == "D":
            i += 1
            continue
        role = rows[i][1] if letter == "K" else {"u": "assistant"}.get(last, "user")
        lines.append((role, "" if letter == "I" else rows[i][2]))
        i += letter != "I"
        last = role[0]
    assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for role, _ in lines))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
    return (gaps, *counts.values(), illegal, cost, letters, digest), lines


def expected(rows, with_damage=True):
    """Reports and lines of all conversations of (conv_id, turn, role, text)."""
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        own = found[conv]
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if with_damage:
            if h == 0:
                continue
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            role = "user" if h == 4 else role
        own += [(turn, role, text)] * (2 if with_damage and h == 3 else 1)
    for own in found.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return {conv: plain(own) for conv, own in found.items()}


def made(rng, conversations, longest=9):
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["system" if turn == 0 else "user", "user", "assistant", "assistant", "tool", ""])
            role = ["user", "assistant"][turn % 2] if rng.random() < 0.6 else role
            text = rng.choice(["", " \n", "so", "so.", f"turn {turn}?", f"turn {turn}", "日本。", "end! ", "same."])
            rows.append((conv, turn + 3 * (rng.random() < 0.1), role, text))
    return rows


ODD = [
    (None, 0, "user", "one."),
    (None, None, None, None),
    (None, 1, "assistant", "two"),
    (-5, None, "system", "s."),
    (-5, None, "user", "u."),
    (-5, 7, "assistant", "\x85."),
    (-6, 0, "user", "x" * 200_000 + "."),
    (-6, 1, "assistant", "y" * 200_000),
    (-7, 2, None, "a."),
    (-7, 2, None, "a."),
    (-7, 2, "user", "b."),
    (-8, None, "user", None),
]


@pytest.fixture
def write(spark, tmp_path):
    def make(rows, name="conversations.parquet"):
        schema = "conv_id long, turn long, role string, text string, key string, block long, place int, rows string"
        full = [(*r, "k", 1, 2, "r") for r in rows]
        spark.createDataFrame(full, schema).repartition(3).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    return make


def reports(df):
    assert df.columns == COLUMNS
    rows = df.collect()
    found = {r.conv_id: tuple(r)[1:] for r in rows}
    assert len(found) == len(rows)
    return found


def test_tables_against_search():
    rng = random.Random(3)
    for _ in range(1500):
        signs = "".join(rng.choice("uaUAuausSxXdd") for _ in range(rng.randint(0, 9)))
        cost, letters, end = Alignment(signs).best(turns.BEGIN, turns.FINAL)
        assert (cost, letters + "I" * turns.TAIL[end]) == cheapest(signs), signs


def test_blocks_against_search():
    rng = random.Random(8)
    for _ in range(800):
        signs = "".join(rng.choice("uaUAuausSxdd") for _ in range(rng.randint(1, 10)))
        blocks, at = [], 0
        while at < len(signs):
            step = rng.randint(1, 4)
            blocks.append(Alignment(signs[at : at + step]))
            at += step
        after = [turns.FINAL]
        for block in reversed(blocks):
            c = block.costs()
            after.insert(0, tuple(min(turns.NEVER, *(c[4 * s + e] + after[0][e] for e in range(4))) for s in range(4)))
        state, letters = turns.BEGIN, ""
        for block, behind in zip(blocks, after[1:], strict=True):
            _, own, state = block.best(state, behind)
            letters += own
        assert (after[0][turns.BEGIN], letters + "I" * turns.TAIL[state]) == cheapest(signs), signs


def test_query_on_odd_rows(spark, write, tmp_path):
    rows = made(random.Random(1), 120) + ODD
    write(rows)
    found = reports(ALL["op11_turn_alignment"](spark, str(tmp_path)))
    assert found == {conv: report for conv, (report, _) in expected(rows).items()}
    assert {conv for conv, *_ in rows} == set(found)
    assert any(r[5] == 0 and r[6] == "" for r in found.values())  # nothing is left of some


@pytest.mark.parametrize(("block_rows", "block_bytes", "partitions"), [(3, 1 << 20, 5), (512, 40, 3), (1, 1, 1)])
def test_conversations_in_blocks(write, block_rows, block_bytes, partitions):
    rng = random.Random(block_rows)
    rows = made(rng, 30) + ODD
    hot = made(rng, 1, 400) or []
    rows += [(1000, turn, role, text) for _, turn, role, text in hot]
    rows += [(1001, 4, "user", "again.")] * 40
    docs = write(rows, f"c{block_rows}")
    kinds = expected(rows, with_damage=False)
    limits = {"block_rows": block_rows, "block_bytes": block_bytes, "partitions": partitions}
    assert reports(repair_conversations(docs, **limits)) == {conv: report for conv, (report, _) in kinds.items()}
    lines = defaultdict(list)
    for r in sorted(repaired_turns(docs, **limits).collect(), key=lambda r: r.turn):
        assert r.turn == len(lines[r.conv_id])
        lines[r.conv_id].append((r.role, r.text))
    assert dict(lines) == {conv: found for conv, (_, found) in kinds.items() if found}


def test_no_rows(spark, write, tmp_path):
    write([])
    assert ALL["op11_turn_alignment"](spark, str(tmp_path)).collect() == []


def test_damage(spark, write):
    rows = made(random.Random(2), 60)
    found = damaged(write(rows)).collect()
    kinds = [zlib.crc32(f"{c}:{t}".encode()) % 20 for c, t, *_ in rows]
    assert len(found) == len(rows) + kinds.count(3) and sum(not r.present for r in found) == kinds.count(0)


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")
def test_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").collect()]
    found = reports(ALL["op11_turn_alignment"](spark, SF_DIR))
    assert found == {conv: report for conv, (report, _) in expected(rows).items()}

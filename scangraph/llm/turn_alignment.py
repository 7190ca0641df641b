"""Repair of conversations whose turns should read ``(s?(ua)+)?``: system, then user and assistant in turn.

Turns are kept (K, cost 0), given the role user or assistant (R, 2), deleted (D, 3) or, without text, inserted (I, 2);
blank and repeated turns must be deleted, and a cut-off turn that stays adds 1. Of the cheapest repairs the
one whose letters are least in ASCII is taken.

The turns are aligned with the alternating string of each length by Wagner and Fischer's table. An entry is the cost
of the turns from one on against the last ``r`` letters, which do not depend on the length, so one table holds
the alignments with all lengths. A quick repair that resumes at each turn that doesn't fit gives the incumbent
cost; edits cost 2 or more beyond what every repair pays, so only a band around the diagonal can reach it
(Ukkonen). All lengths of least cost are traced back and their letters compared.

A conversation is not gathered anywhere. Its turns are sorted by range over tasks and cut into blocks of
bounded rows and bytes. A conversation within one block, away from the borders of a task, is finished there. For
the others, the tables of each block give the least cost between each two of the four states of the grammar; costs
to the end are added up backwards over these small matrices; each block then traces its letters for each
state it may begin in; and one pass over the blocks in order picks the letters and hashes the result. Insertions
belong to the block of the next turn, so letters of a block never continue in another way in the next one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scangraph.llm.common import scratch

#: Rows and bytes of text of a block at most (the last row may go beyond the bytes).
BLOCK_ROWS, BLOCK_BYTES = 512, 1 << 22
#: Results of short conversations that a task remembers at most.
REMEMBERED = 20_000

KEEP_CUT, REROLE, DELETE, INSERT = 1, 2, 3, 2
NEVER = 1 << 40
#: States: nothing yet, after the system turn, after a user turn, after an assistant turn.
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
#: Cost and number of insertions that end a conversation from each state.
FINAL, TAIL = (0, 2 * INSERT, INSERT, 0), (0, 2, 1, 0)
_LETTER = {USER: "u", ASSISTANT: "a"}
#: How far costs to the end may differ between states, and thus how far a path may be above the incumbent.
_MARGIN = 10


def signature(initial: str, forced: bool, cut: bool) -> str:
    """One character of a turn: ``d`` must go, else its role's initial (x: another), a capital if cut off."""
    if forced:
        return "d"
    kind = initial if initial and initial in "sua" else "x"
    return kind.upper() if cut else kind


class Alignment:
    """Tables of the turns with ``signatures`` against alternating strings that end in user or assistant."""

    def __init__(self, signatures: str):
        self.before = [0]  # turns that must go, in front of every other one and at the end
        self.rows = []
        for s in signatures:
            if s == "d":
                self.before[-1] += 1
            else:
                self.rows.append(s)
                self.before.append(0)
        self.kinds = [s.lower() for s in self.rows]
        cut = [s.isupper() for s in self.rows]
        #: What every repair pays; all else is what it pays beyond that.
        self.base = DELETE * sum(self.before) + KEEP_CUT * sum(cut)
        self.delete = [DELETE - KEEP_CUT if c else DELETE for c in cut]
        self.limit = self._incumbent() + _MARGIN
        self.half = self.limit // 2
        self.tables = {end: self._table(_LETTER[end]) for end in (USER, ASSISTANT)}

    def _incumbent(self) -> int:
        """Cost of keeping every user and assistant turn, with one inserted between two equal ones."""
        cost, expected = 0, "u"
        for kind in self.kinds:
            if kind not in "ua":
                cost += REROLE
            elif kind == expected:
                pass
            else:
                cost += INSERT
                expected = kind
            expected = "a" if expected == "u" else "u"
        return cost

    def _table(self, last: str) -> list[list[int]]:
        """Entry [i][k]: cost of rows i.. against the last ``r = n - i + k - half`` letters, ending in ``last``."""
        n, half, limit = len(self.rows), self.half, self.limit
        width = 2 * half + 1
        below = [NEVER] * (width + 1)
        below[half] = 0  # no turn is inserted behind the last row
        table = [below]
        for i in range(n - 1, -1, -1):
            # Letters with odd r equal the last one.
            odd = 0 if self.kinds[i] == last else REROLE
            even = 0 if self.kinds[i] == ("a" if last == "u" else "u") else REROLE
            delete, row, left = self.delete[i], [NEVER] * (width + 1), NEVER
            first = max(0, half - n + i)
            for k in range(first, width):
                r = n - i + k - half
                best = below[k + 1] + delete
                if r:
                    other = below[k] + (odd if r & 1 else even)
                    if other < best:
                        best = other
                    if left + INSERT < best:
                        best = left + INSERT
                left = row[k] = best if best <= limit else NEVER
            table.append(row)
            below = row
        table.reverse()
        return table

    def _entry(self, end: int, i: int, r: int) -> int:
        k = r - (len(self.rows) - i) + self.half
        return self.tables[end][i][k] if r >= 0 and 0 <= k <= 2 * self.half else NEVER

    def _lengths(self, i: int, start: int, end: int) -> Iterator[tuple[int, int]]:
        """Feasible numbers of letters between two states, and their costs for the rows from ``i`` on."""
        # The first letter follows from the start, the last from the end; equal ones need an odd number.
        odd = (start == USER) == (end == ASSISTANT)
        least = 1 if odd else 0 if start == end else 2
        middle = len(self.rows) - i
        low = max(least, middle - self.half)
        low += (low - least) % 2
        for r in range(low, middle + self.half + 1, 2):
            cost = self._entry(end, i, r)
            if cost < NEVER:
                yield r, cost

    def _paths(self, start: int, end: int) -> list[tuple[int, int, int, int]]:
        """(cost, rows deleted first, 1 if the next is kept as system turn, letters) of all ways to align."""
        n, found, gone = len(self.rows), [], 0
        if start == end and start in (BEGIN, SYSTEM):
            found.append((sum(self.delete), n, 0, 0))
        if end in _LETTER:
            found += [(cost, 0, 0, r) for r, cost in self._lengths(0, start, end)]
        if start == BEGIN and end != BEGIN:
            for i, kind in enumerate(self.kinds):
                if kind == "s":
                    if end == SYSTEM:
                        found.append((gone + sum(self.delete[i + 1 :]), i, 1, 0))
                    else:
                        found += [(gone + cost, i, 1, r) for r, cost in self._lengths(i + 1, SYSTEM, end)]
                gone += self.delete[i]
                if gone > self.limit:
                    break
        return found

    def costs(self) -> list[int]:
        """Least cost from each state to each, row by row; NEVER where there is none worth taking."""
        every = [min((p[0] for p in self._paths(s, e)), default=NEVER) for s in range(4) for e in range(4)]
        return [c + self.base if c < NEVER else NEVER for c in every]

    def _letters(self, end: int, path: tuple[int, int, int, int]) -> str:
        """The least letters of one path, read off the table."""
        _, gone, system, r = path
        out = [("D" * (self.before[i] + 1)) for i in range(gone)]
        i = gone
        out.append("D" * self.before[i])
        if system:
            out.append("K")
            i += 1
            out.append("D" * self.before[i])
        if end not in _LETTER:  # only deletions follow
            for j in range(i, len(self.rows)):
                out.append("D" * (1 + self.before[j + 1]))
            return "".join(out)
        last = _LETTER[end]
        other = "a" if last == "u" else "u"
        while i < len(self.rows):
            cost = self._entry(end, i, r)
            if cost == self._entry(end, i + 1, r) + self.delete[i]:
                out.append("D")
            elif r and cost == self._entry(end, i, r - 1) + INSERT:
                out.append("I")
                r -= 1
                continue
            else:
                out.append("K" if self.kinds[i] == (last if r & 1 else other) else "R")
                r -= 1
            i += 1
            out.append("D" * self.before[i])
        return "".join(out)

    def best(self, start: int, after: tuple[int, ...]) -> tuple[int, str, int]:
        """Least cost with what comes ``after`` each state, its least letters, and the state they end in."""
        ways = [(p[0] + after[e], e, p) for e in range(4) if after[e] < NEVER for p in self._paths(start, e)]
        if not ways:
            return NEVER, "", start
        least = min(w[0] for w in ways)
        letters, end = min((self._letters(e, p), e) for cost, e, p in ways if cost == least)
        return least + self.base, letters, end


def edited(letters: str, start: int, roles: list[bytes], texts: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """Role and text of the turns that ``letters`` leave or make."""
    row, state = 0, start
    for letter in letters:
        if letter == "D":
            row += 1
            continue
        expected = ASSISTANT if state == USER else USER
        if letter == "K" and roles[row][:1] == b"s":
            expected = SYSTEM
        made = b"assistant" if expected == ASSISTANT else b"user"
        yield (roles[row] if letter == "K" else made), (b"" if letter == "I" else texts[row])
        row += letter != "I"
        state = expected


class _Facts:
    """Counts over the turns of a conversation, in order."""

    def __init__(self) -> None:
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.initial = None

    def add(self, turn: int | None, role: bytes, fault: str) -> None:
        if turn is not None:
            if self.first is None:
                self.first = turn
            if turn != self.last:
                self.turns += 1
                self.last = turn
        if self.initial is not None and self.initial + role[:1] not in (b"su", b"ua", b"au"):
            self.illegal += 1
        self.initial = role[:1]
        self.blank += fault == "blank"
        self.duplicate += fault == "duplicate"
        self.truncated += fault == "truncated"

    def row(self) -> tuple[int, ...]:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal


def fault_of(text: bytes, repeated: bool) -> str:
    """A turn's first fault: blank, duplicate, truncated or none."""
    body = text.rstrip()  # blanks and 09 to 0D
    if not body:
        return "blank"
    if repeated:
        return "duplicate"
    return "" if body[-1:] in (b".", b"!", b"?") else "truncated"


def _signed(role: bytes, fault: str) -> str:
    return signature(role[:1].decode("latin-1"), fault in ("blank", "duplicate"), fault == "truncated")


class _Hash:
    """SHA-256 of lines ``role:text`` joined by line feeds."""

    def __init__(self) -> None:
        self.state, self.lines = hashlib.sha256(), 0

    def add(self, role: bytes, text: bytes) -> None:
        self.state.update(b"\n" + role + b":" + text if self.lines else role + b":" + text)
        self.lines += 1


_LINE = pa.struct([("role", pa.binary()), ("text", pa.binary())])
_ROW = pa.struct([("turn", pa.int64()), ("role", pa.binary()), ("text", pa.binary())])
_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_REPORT = ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string"
_LINES = "lines array<struct<role: binary, text: binary>>"


def _finished(rows: list[tuple], remembered: dict[str, tuple[int, str]], with_lines: bool) -> tuple:
    """Report and lines of a whole conversation of (turn, role, text)."""
    facts, seen, signs = _Facts(), set(), []
    for turn, role, text in rows:
        fault = fault_of(text, (role, text) in seen)
        seen.add((role, text))
        facts.add(turn, role, fault)
        signs.append(_signed(role, fault))
    signed = "".join(signs)
    if signed not in remembered:
        cost, letters, end = Alignment(signed).best(BEGIN, FINAL)
        if len(remembered) >= REMEMBERED or len(signed) > 64:
            remembered.clear()
        remembered[signed] = cost, letters + "I" * TAIL[end]
    cost, letters = remembered[signed]
    digest, lines = _Hash(), []
    for line in edited(letters, BEGIN, [r[1] for r in rows], [r[2] for r in rows]):
        digest.add(*line)
        lines.append(line)
    return (*facts.row(), cost, letters, digest.state.hexdigest()), lines if with_lines else None


def _conversations(schema: pa.Schema, rows_at_most: int, bytes_at_most: int, with_lines: bool):
    """Finish the conversations that lie within the task, and cut the others into blocks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        remembered: dict[str, tuple[int, str]] = {}
        out: list[tuple] = []
        rows: list[tuple] = []
        size = held = blocks = 0
        conv, begun, is_open = None, False, part > 0  # what comes first may have begun in the task before

        def block() -> tuple:
            nonlocal blocks
            blocks += 1
            return (conv, (part << 32) + blocks, *[None] * 8, None, [dict(zip(_ROW.names, r, strict=True)) for r in rows])

        def finish() -> tuple:
            report, lines = _finished(rows, remembered, with_lines)
            listed = None if lines is None else [dict(zip(_LINE.names, line, strict=True)) for line in lines]
            return (conv, None, *report, listed, None)

        def flush() -> pa.RecordBatch:
            columns = zip(*out, strict=True)
            arrays = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "present", "turn", "role", "text")]
            for own, present, turn, role, text in zip(*columns, strict=True):
                if not begun or own != conv:
                    if begun:
                        out.append(block() if is_open else finish())
                        held += size
                        rows, size, is_open = [], 0, False
                    conv, begun = own, True
                elif len(rows) >= rows_at_most or size >= bytes_at_most:
                    is_open = True
                    out.append(block())
                    held += size
                    rows, size = [], 0
                if present:
                    rows.append((turn, role, text))
                    size += len(text) + len(role)
                if len(out) >= 2000 or held >= bytes_at_most:
                    yield flush()
                    held = 0
        if begun:
            out.append(block())  # it may go on in the next task
        if out:
            yield flush()

    return work


def _faults(rows: list[dict], repeats) -> list[str]:
    repeated = set() if repeats is None else set(repeats)
    return [fault_of(r["text"], i in repeated) for i, r in enumerate(rows)]


def _signatures(row: dict) -> str:
    faults = _faults(row["rows"], row["repeats"])
    return "".join(_signed(r["role"], f) for r, f in zip(row["rows"], faults, strict=True))


_MATRIX = pa.schema([("key", pa.string()), ("block", pa.int64()), ("costs", pa.list_(pa.int64()))])


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(r["key"], r["block"], Alignment(_signatures(r)).costs()) for r in batch.to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), _MATRIX, strict=True)], schema=_MATRIX)


def _costs_after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks from the last to the first: costs from each state behind a block to the conversation's end."""
    key, after = None, FINAL
    for batch in batches:
        found = []
        for r in batch.to_pylist():
            if r["key"] != key:
                key, after = r["key"], FINAL
            found.append((key, r["block"], list(after)))
            c = r["costs"]
            after = tuple(min(NEVER, min(c[4 * s + e] + after[e] for e in range(4))) for s in range(4))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), _MATRIX, strict=True)], names=["key", "block", "after"])


_WAYS = [f"{what}{s}" for s in range(4) for what in ("cost", "letters", "end")]


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Letters of each block for every state that it may begin in."""
    for batch in batches:
        found = []
        for r in batch.to_pylist():
            aligned, after = Alignment(_signatures(r)), r["after"]
            found.append([v for s in range(4) for v in aligned.best(s, after)])
        if found:
            columns = zip(*found, strict=True)
            types = [pa.int64(), pa.string(), pa.int64()] * 4
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *_WAYS])


def _assembled(schema: pa.Schema, with_lines: bool):
    """Blocks in order: pick the letters, count, hash; a report at the end of each conversation."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = conv = facts = digest = cost = None
        state, letters = BEGIN, []

        def end() -> tuple:
            tail = "I" * TAIL[state]
            lines = list(edited(tail, state, [], []))
            place = digest.lines
            for line in lines:
                digest.add(*line)
            report = (*facts.row(), cost, "".join(letters) + tail, digest.state.hexdigest())
            listed = [dict(zip(_LINE.names, line, strict=True)) for line in lines] if with_lines else None
            return (conv, place, *report, listed)

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["key"] != key:
                    if key is not None:
                        out.append(end())
                    key, conv, facts, digest, state, letters = r["key"], r["conv_id"], _Facts(), _Hash(), BEGIN, []
                    cost = r[f"cost{BEGIN}"]
                rows = r["rows"]
                for row, fault in zip(rows, _faults(rows, r["repeats"]), strict=True):
                    facts.add(row["turn"], row["role"], fault)
                own, place, lines = r[f"letters{state}"], digest.lines, []
                for line in edited(own, state, [row["role"] for row in rows], [row["text"] for row in rows]):
                    digest.add(*line)
                    if with_lines:
                        lines.append(dict(zip(_LINE.names, line, strict=True)))
                letters.append(own)
                state = r[f"end{state}"]
                if with_lines:
                    out.append((conv, place, *[None] * 8, lines))
            if out:
                yield _record(out, schema)
        if key is not None:
            yield _record([end()], schema)

    return work


def _record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _repair(
    turns: DataFrame, with_lines: bool, block_rows: int, block_bytes: int, partitions: int | None
) -> tuple[DataFrame, DataFrame]:
    """Finished conversations, and the others as blocks in order; ``place`` is where lines begin."""
    work, kind = scratch(turns.sparkSession), dict(turns.dtypes)["conv_id"]
    present = F.col("present") if "present" in turns.columns else F.lit(True)
    rows = turns.select(
        "conv_id",
        present.alias("present"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit(" ")).cast("binary").alias("role"),
        F.coalesce(F.col("text"), F.lit(" ")).cast("binary").alias("text"),
    )
    # The number parts equal rows, so that any number of them can be spread.
    order = ["conv_id", "turn", "role", "beginning", "digest", "number"]
    rows = rows.withColumns(
        {
            "beginning": F.substring("text", 1, 32),
            "digest": F.xxhash64("text"),
            "number": F.monotonically_increasing_id(),
        }
    )
    ranged = rows.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order)
    schema = f"conv_id {kind}, block long, {_REPORT}, {_LINES}, rows array<struct<turn: long, role: binary, text: binary>>"
    conv = rows.select("conv_id").limit(0).toArrow().schema.field(0).type
    report = [("conv_id", conv), ("block", pa.int64()), *[(c, pa.int64()) for c in _COUNTS]]
    report += [("audit", pa.string()), ("repaired_sha256", pa.string()), ("lines", pa.list_(_LINE))]
    cut = _conversations(pa.schema([*report, ("rows", pa.list_(_ROW))]), block_rows, block_bytes, with_lines)
    parts = work.write(ranged.mapInArrow(cut, schema), "parts")

    blocks = parts.where(F.col("block").isNotNull()).select("conv_id", "block", "rows")
    key = F.concat(F.isnull("conv_id").cast("string"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    blocks = blocks.select(key.alias("key"), "conv_id", "block", "rows")
    each = blocks.select("key", "block", F.posexplode("rows").alias("i", "r"))
    each = each.select("key", F.struct("block", "i").alias("at"), "r.role", F.sha2("r.text", 256).alias("digest"))
    first = each.groupBy("key", "role", "digest").agg(F.min("at").alias("first"))
    again = each.join(first, ["key", "role", "digest"]).where("at != first")
    repeats = again.groupBy("key", "at.block").agg(F.collect_list("at.i").alias("repeats"))
    marked = work.write(blocks.join(repeats, ["key", "block"], "left"), "blocks")

    costs = marked.mapInArrow(_matrices, "key string, block long, costs array<long>")
    backwards = costs.repartition("key").sortWithinPartitions("key", F.desc("block"))
    after = backwards.mapInArrow(_costs_after, "key string, block long, after array<long>")
    ways = ", ".join(f"cost{s} long, letters{s} string, end{s} long" for s in range(4))
    known = marked.join(after, ["key", "block"]).select("key", "conv_id", "block", "rows", "repeats", "after")
    fields = f"key string, conv_id {kind}, block long, rows array<struct<turn: long, role: binary, text: binary>>"
    traced = known.mapInArrow(_ways, f"{fields}, repeats array<int>, after array<long>, {ways}")
    in_order = traced.repartition("key").sortWithinPartitions("key", "block")
    told = in_order.mapInArrow(_assembled(pa.schema(report), with_lines), f"conv_id {kind}, place long, {_REPORT}, {_LINES}")
    return parts.where(F.col("block").isNull()), told


def repair_conversations(
    turns: DataFrame, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES, partitions: int | None = None
) -> DataFrame:
    """One row per conversation of ``turns`` (``conv_id, turn, role, text``, and ``present`` if there is one).

    ``gaps`` (numbers missing between the least and the greatest turn), ``blank, duplicate, truncated`` (turns by
    their first fault), ``illegal`` (neighbours whose roles don't follow), ``cost`` and ``audit`` of the least repair, and
    the SHA-256 of its lines ``role:text``, joined by line feeds. An inserted turn has no text.

    Turns are taken by number, null first; of equal ones by role, the text's first 32 bytes and its hash. Null roles
    and texts are one blank; null conv_ids are one conversation. Rows with ``present`` false only name their
    conversation; one without turns has zeros, an empty audit and the hash of nothing. Repeated rows are duplicates of
    the first. An empty table gives an empty result. Other columns are left behind. Conversations and texts
    may be of any length; the letters of one are one value.
    """
    closed, told = _repair(turns, False, block_rows, block_bytes, partitions)
    columns = ["conv_id", *_COUNTS, "audit", "repaired_sha256"]
    return closed.select(*columns).unionByName(told.select(*columns))


def repaired_turns(
    turns: DataFrame, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES, partitions: int | None = None
) -> DataFrame:
    """``conv_id, turn, role, text`` of the repaired conversations, numbered from 0; odd rows as in
    ``repair_conversations``."""
    closed, told = _repair(turns, True, block_rows, block_bytes, partitions)
    both = closed.select("conv_id", F.lit(0).cast("long").alias("place"), "lines").unionByName(
        told.select("conv_id", "place", "lines")
    )
    lines = both.select("conv_id", "place", F.posexplode("lines").alias("i", "line"))
    text = [F.col(f"line.{c}").cast("string").alias(c) for c in _LINE.names]
    return lines.select("conv_id", (F.col("place") + F.col("i")).alias("turn"), *text)


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` with faults by ``crc32(conv_id:turn) % 20`` and a column ``present``.

    0 drops a row (``present`` false), 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it, 4 makes its role user.
    Nulls are one blank.
    """
    words = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat_ws(":", *words).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = turns.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (kind != 0).alias("present"),
        F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1)).alias("times"),
    )
    return rows.select("conv_id", "turn", "role", "text", "present", F.explode("times").alias("time")).drop("time")

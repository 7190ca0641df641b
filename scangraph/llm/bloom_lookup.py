"""Document fingerprints as invertible Bloom lookup sketches of their paragraphs, in SQL functions only.

A paragraph is a non-empty line or a part of a long one: lines are cut behind words that a hash chooses, about one in
``CUT_WORDS``, so that a text of few lines has paragraphs, too, and cuts stay where they are when words are put in
elsewhere. Its digest goes into one cell of each of three subtables. A cell holds a
count and the exclusive or of digests and of their check values. The difference of two sketches is the
sketch of the paragraphs that only one text has, and peeling cells that hold a single digest recovers them.
Where that fails, because the texts differ in more than a sketch can hold, the digests are dealt to as many
sections as they need, each of which has a sketch of its own and is retried, until all are recovered. All of this
happens in the row of the text: what is shuffled is every text once, to lie beside the next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scangraph.llm.common import scratch

#: Cells of each of the three subtables, the same of a section's sketch when one is retried, and its expected digests.
WIDTH, SECTION_WIDTH, SECTION = 11, 7, 8
#: One in so many words ends a paragraph, and one at every so many words of a line does in any case.
CUT_WORDS, MOST_WORDS = 16, 32
#: Rounds of peeling; what is left by then goes to sections. Turns that are taken before a table is written.
ROUNDS, TURNS = 2, 2
#: Bytes of text that are sorted together, and about the most ranges of texts; beyond these ranges get longer, and spill.
RANGE_BYTES, MOST_RANGES = 4 << 20, 4096
_CHECK_SEED, _TABLES = 7919, 3
_EMPTY = "named_struct('n', 0L, 'key', 0L, 'mark', 0L)"
_NO_CELL = "cast(null as struct<n: bigint, key: bigint, mark: bigint>)"
_NONE = "cast(array() as array<bigint>)"
_NO_REST = "cast(array() as array<array<struct<n: bigint, key: bigint>>>)"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` worked out once: the variable of a lambda is not worked out again where it is used."""
    return F.transform(F.array(value), f)[0]


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text, in order."""

    def cut(line: Column) -> Column:
        ended = F.transform(
            F.split(line, " "),
            lambda word, i: F.when(
                (F.pmod(F.xxhash64(word), F.lit(CUT_WORDS)) == 0) | (i % MOST_WORDS == MOST_WORDS - 1),
                F.concat(word, F.lit("\n")),
            ).otherwise(F.concat(word, F.lit(" "))),
        )
        return F.array_join(ended, "")

    # Only lines of several words are cut: a short one is a paragraph.
    lines = F.transform(F.split(text, "\n"), lambda line: F.when(F.length(line) > 80, cut(line)).otherwise(line))
    return F.filter(F.split(F.array_join(lines, "\n"), "\n"), lambda piece: piece != "")


def paragraph_digests(text: Column) -> Column:
    """Distinct 64-bit digests of the paragraphs."""
    return F.array_distinct(F.transform(paragraphs(text), lambda piece: F.xxhash64(piece)))


def _mark(key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(_CHECK_SEED)), 32)


def _place(key: Column, table: Column, seed: Column, width: int) -> Column:
    return F.pmod(F.xxhash64(key, seed, table), F.lit(width)).cast("int")


def _cell(n: Column, key: Column, mark: Column) -> Column:
    return F.struct(n.alias("n"), key.alias("key"), mark.alias("mark"))


def _listed(c: Column, at: Column) -> Column:
    return F.struct(c["n"].alias("n"), c["key"].alias("key"), c["mark"].alias("mark"), at.alias("at"))


def signed(digests: Column, n: int = 1) -> Column:
    """Digests that are put in (``n`` 1) or taken out (-1)."""
    return F.transform(digests, lambda k: F.struct(F.lit(n).cast("long").alias("n"), k.alias("key")))


def sketch(digests: Column, seed: Column, width: int = WIDTH) -> Column:
    """``3 * width`` cells (n, key, mark) of signed digests, subtable after subtable."""

    def placed(d: Column) -> Column:
        places = [_place(d["key"], F.lit(table), seed, width).alias(f"p{table}") for table in range(_TABLES)]
        return F.struct(_cell(d["n"], d["key"], _mark(d["key"])).alias("c"), *places)

    def cells(known: Column) -> Column:
        def cell(table: int, place: Column) -> Column:
            def put(c: Column, d: Column) -> Column:
                more = d["c"]
                both = _cell(c["n"] + more["n"], c["key"].bitwiseXOR(more["key"]), c["mark"].bitwiseXOR(more["mark"]))
                return F.when(c.isNull(), more).otherwise(both)

            # Most cells hold one digest or none: these are not made anew.
            own = F.filter(known, lambda d: d[f"p{table}"] == place)
            return F.aggregate(own, F.expr(_NO_CELL), put, lambda c: F.coalesce(c, F.expr(_EMPTY)))

        def subtable(table: int) -> Column:
            places = F.sequence(F.lit(0), F.lit(width - 1))
            return F.transform(places, lambda place: cell(table, place))

        return F.concat(*map(subtable, range(_TABLES)))

    return _let(F.transform(digests, placed), cells)


def difference(left: Column, right: Column) -> Column:
    """Cells of the digests that only one sketch has; those of ``right`` count negatively."""
    return F.zip_with(
        left,
        right,
        lambda a, b: _cell(a["n"] - b["n"], a["key"].bitwiseXOR(b["key"]), a["mark"].bitwiseXOR(b["mark"])),
    )


def peel(cells: Column, seed: Column, most: Column, width: int = WIDTH) -> Column:
    """``(plus, minus, ok)``: the digests recovered of each side, and whether these are all.

    ``most`` bounds the number of digests. A round goes through the subtables and takes out all digests that are alone
    in a cell of one; within a subtable these are different ones.
    """
    # The subtable whose turn it is comes first and goes to the end. Peeling ends when no subtable has given any.
    # A subtable is the list of its cells that aren't empty, with their places.
    def filled(c: Column) -> Column:
        return (c["n"] != 0) | (c["key"] != 0) | (c["mark"] != 0)

    def listed(table: int) -> Column:
        own = F.transform(F.slice(cells, table * width + 1, width), lambda c, at: _listed(c, at))
        return F.filter(own, filled)

    state = F.struct(
        *(listed(table).alias(f"t{table}") for table in range(_TABLES)),
        F.expr(_NONE).alias("plus"),
        F.expr(_NONE).alias("minus"),
        F.lit(0).alias("idle"),
    )

    def alone(c: Column) -> Column:
        return (F.abs(c["n"]) == 1) & (c["mark"] == _mark(c["key"]))

    def without(c: Column, own: Column) -> Column:
        return F.struct(
            (c["n"] - own["n"]).alias("n"),
            c["key"].bitwiseXOR(own["key"]).alias("key"),
            c["mark"].bitwiseXOR(own["mark"]).alias("mark"),
            c["at"].alias("at"),
        )

    def step(s: Column, i: Column) -> Column:
        def placed(c: Column) -> Column:
            places = (_place(c["key"], F.pmod(i + k, F.lit(_TABLES)), seed, width).alias(f"p{k}") for k in (1, 2))
            return F.struct(c.alias("c"), *places)

        def rest(s: Column, single: Column, k: int) -> Column:
            def less(c: Column) -> Column:
                return F.aggregate(F.filter(single, lambda f: f[f"p{k}"] == c["at"]), c, lambda c, f: without(c, f["c"]))

            return F.filter(F.transform(s[f"t{k}"], less), filled)

        def keys(single: Column, n: int) -> Column:
            return F.transform(F.filter(single, lambda f: f["c"]["n"] == n), lambda f: f["c"]["key"])

        def after(s: Column, single: Column) -> Column:
            none = F.struct(
                s["t1"].alias("t0"),
                s["t2"].alias("t1"),
                s["t0"].alias("t2"),
                s["plus"].alias("plus"),
                s["minus"].alias("minus"),
                (s["idle"] + 1).alias("idle"),
            )
            some = F.struct(
                rest(s, single, 1).alias("t0"),
                rest(s, single, 2).alias("t1"),
                F.filter(s["t0"], lambda c: ~alone(c)).alias("t2"),
                F.concat(s["plus"], keys(single, 1)).alias("plus"),
                F.concat(s["minus"], keys(single, -1)).alias("minus"),
                F.lit(0).alias("idle"),
            )
            return F.when(F.size(single) == 0, none).otherwise(some)

        single = F.transform(F.filter(s["t0"], alone), placed)
        # What is found is worked out once.
        return F.when(s["idle"] >= _TABLES, s).otherwise(F.aggregate(F.array(single), s, after))

    rounds = F.greatest(F.lit(1), F.least(most, F.lit(ROUNDS)))
    steps = F.sequence(F.lit(0), rounds * _TABLES - 1)

    def ended(s: Column) -> Column:
        left = F.size(s["t0"]) + F.size(s["t1"]) + F.size(s["t2"])
        return F.struct(s["plus"].alias("plus"), s["minus"].alias("minus"), (left == 0).alias("ok"))

    return F.aggregate(steps, state, step, ended)


def fingerprint(n: Column, cells: Column) -> Column:
    """Number of digests and the cells, in hexadecimal digits of fixed widths."""

    def digits(value: Column, width: int) -> Column:
        return F.lpad(F.hex(value), width, "0")

    parts = F.transform(cells, lambda c: F.concat(digits(c["n"], 8), digits(c["key"], 16), digits(c["mark"], 8)))
    return F.concat(digits(n, 8), F.array_join(parts, ""))


def _sections(part: Column, turn: int) -> Column:
    """The signed digests of ``part`` dealt to sections of about ``SECTION``.

    They are dealt to groups of sections first, so that the work does not grow with the square of a long text.
    """

    def dealt(n: Column) -> Column:
        place = lambda d: F.pmod(F.xxhash64(d["key"], F.lit(-turn)), n).cast("int")
        known = F.transform(part, lambda d: F.struct(d.alias("d"), place(d).alias("at")))
        size = F.ceil(F.sqrt(n)).cast("int")

        def section(group: Column, at: Column) -> Column:
            return F.transform(F.filter(group, lambda d: d["at"] == at), lambda d: d["d"])

        def grouped(known: Column, first: Column) -> Column:
            group = F.filter(known, lambda d: (d["at"] >= first) & (d["at"] < first + size))
            places = F.sequence(first, F.least(first + size, n) - 1)
            return _let(group, lambda group: F.transform(places, lambda at: section(group, at)))

        firsts = F.sequence(F.lit(0), n - 1, size)
        return _let(known, lambda known: F.flatten(F.transform(firsts, lambda first: grouped(known, first))))

    return _let(F.ceil(F.size(part) / SECTION).cast("int"), dealt)


def _first_turn(left: Column, right: Column, cells: Column) -> Column:
    """The state of a pair after its two whole sketches were compared: ``here, there, n_here, rest``.

    ``here`` and ``there`` are the digests recovered of each side, ``n_here`` is the number of the former, and
    ``rest`` has the parts of the signed digests that could not be peeled.
    """

    def state(found: Column) -> Column:
        whole = F.array(F.concat(signed(left), signed(right, -1)))
        return F.struct(
            F.when(found["ok"], found["plus"]).otherwise(F.expr(_NONE)).alias("here"),
            F.when(found["ok"], found["minus"]).otherwise(F.expr(_NONE)).alias("there"),
            F.when(found["ok"], F.size(found["plus"])).otherwise(0).alias("n_here"),
            F.when(found["ok"], F.expr(_NO_REST)).otherwise(whole).alias("rest"),
        )

    return _let(peel(cells, F.lit(0), F.size(left) + F.size(right)), state)


def _next_turn(state: Column, turn: int) -> Column:
    """The state after the parts that were left have been peeled in sections of their digests, with another seed."""
    seed = F.lit(turn)

    def tried(part: Column) -> Column:
        found = peel(sketch(part, seed, SECTION_WIDTH), seed, F.size(part), SECTION_WIDTH)
        return F.struct(part.alias("part"), found.alias("found"))

    def added(parts: Column) -> Column:
        ok = F.filter(parts, lambda p: p["found"]["ok"])
        here, there = (F.flatten(F.transform(ok, lambda p: p["found"][side])) for side in ("plus", "minus"))
        return F.struct(
            F.concat(state["here"], here).alias("here"),
            F.concat(state["there"], there).alias("there"),
            (state["n_here"] + F.size(here)).alias("n_here"),
            F.transform(F.filter(parts, lambda p: ~p["found"]["ok"]), lambda p: p["part"]).alias("rest"),
        )

    parts = F.flatten(F.transform(state["rest"], lambda part: _sections(part, turn)))
    return F.when(F.size(state["rest"]) == 0, state).otherwise(_let(F.transform(parts, tried), added))


def _counted(state: Column) -> Column:
    """The state without recovered digests, of which only the number is needed."""
    none = F.expr(_NONE)
    return F.struct(none.alias("here"), none.alias("there"), state["n_here"].alias("n_here"), state["rest"].alias("rest"))


def _turned(pairs: Column, turn: int) -> Column:
    """Another turn of both pairs of a row: with its edited text, and with the next one."""
    return _let(F.transform(pairs, lambda p: _next_turn(p, turn)), lambda both: F.array(both[0], _counted(both[1])))


def _likeness(left: Column, right: Column, n_here: Column) -> Column:
    """Common paragraphs by all paragraphs, from the numbers of paragraphs; texts without any are alike."""
    common, either = left - n_here, right + n_here
    return F.when(either == 0, 1.0).otherwise(common.cast("double") / either)


def _with_next(docs: DataFrame, work) -> DataFrame:
    """``doc_id, n_chars, copies, text, digests, cells`` of each distinct (doc_id, text), and ``next_*`` of the one behind it.

    The order is that of descending doc_id, then SHA-256; after the last comes the first. The places are cut into
    ranges at some of them, a text goes to its range, and the first of each range to the range before it as well.
    """
    spark = docs.sparkSession
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    # Digits whose order is that of the places: nulls last, then the id turned round.
    turned = F.coalesce(F.bitwise_not(doc_id), F.lit(0)).bitwiseXOR(F.lit(-(2**63)))
    place = F.concat(F.when(doc_id.isNull(), "1").otherwise("0"), F.lpad(F.hex(turned), 16, "0"), F.sha2(text, 256))
    placed = docs.select(place.alias("place"), doc_id.alias("doc_id"), text.alias("text"))

    places = work.write(placed.select("place", F.octet_length("text").alias("size")), "places")
    rows, size, first = places.agg(F.count("*"), F.sum("size"), F.min("place")).first()
    ranges = max((size or 0) // RANGE_BYTES, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    every = max(rows // min(ranges, MOST_RANGES), 1)
    # About MOST_RANGES places at most. The first of all is one of them.
    chosen = places.where(F.pmod(F.xxhash64("place"), F.lit(every)) == 0).select("place").distinct().collect()
    cuts = sorted({r.place for r in chosen} | ({first} if rows else set()))
    ranges = max(len(cuts), 1)
    known = F.split(F.lit(",".join(cuts)), ",")

    at = F.lit(0)
    if ranges > 1:
        halves = F.array(*(F.lit(1 << k) for k in reversed(range((ranges - 1).bit_length()))))
        at = F.aggregate(
            halves,
            F.lit(0),
            lambda low, more: F.when(F.get(known, low + more) <= F.col("place"), low + more).otherwise(low),
        )
    dealt = placed.withColumn("at", at).withColumn("first", F.get(known, F.col("at")) == F.col("place"))
    homes = F.when(
        F.col("first"), F.array(F.col("at"), F.pmod(F.col("at") - 1, F.lit(ranges)))
    ).otherwise(F.array("at"))
    dealt = dealt.select("place", "doc_id", "text", F.posexplode(homes).alias("guest", "at")).repartition("at")
    once = dealt.groupBy("at", "guest", "place", "doc_id").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    once = once.withColumn("digests", paragraph_digests(F.col("text")))
    once = once.withColumn("cells", sketch(signed(F.col("digests")), F.lit(0)))
    # The guest, which is the first of the next range, comes last.
    order = Window.partitionBy("at").orderBy("guest", "place")
    following = [F.lead(c).over(order).alias(f"next_{c}") for c in ("text", "digests", "cells")]
    n_chars = F.char_length("text").cast("long").alias("n_chars")
    return once.select("*", n_chars, *following).where("guest = 0").drop("at", "guest", "place")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, only_here, only_edited``.

    The edited text has the last half of the code points (rounded down) replaced by the first as many of
    the next document in descending order of doc_id; the last is followed by the first. A null text is
    empty. Rows without doc_id come last, and texts of one doc_id in the order of their SHA-256; rows
    repeated with the same doc_id and text have one place in the order and equal results. ``only_here`` and
    ``only_edited`` are the recovered digests of paragraphs that one of the two versions has.
    """
    work = scratch(docs.sparkSession)
    whole = _with_next(docs, work)
    take = F.shiftright("n_chars", 1)
    kept, lent = F.substring("text", F.lit(1), F.col("n_chars") - take), F.substring("next_text", F.lit(1), take)
    versions = whole.withColumn("edited", F.concat(kept, lent)).drop("text", "next_text")
    versions = versions.withColumn("edited_digests", paragraph_digests(F.col("edited")))
    versions = versions.withColumn("edited_cells", sketch(signed(F.col("edited_digests")), F.lit(0)))

    others = (F.struct(*(F.col(f"{other}_{c}").alias(c) for c in ("digests", "cells"))) for other in ("edited", "next"))
    own = F.col("digests")
    pairs = F.transform(
        F.array(*others), lambda o: _first_turn(own, o["digests"], difference(F.col("cells"), o["cells"]))
    )
    table = versions.select(
        "doc_id",
        "n_chars",
        "copies",
        F.sha2("edited", 256).alias("edited_sha256"),
        *(F.size(f"{c}digests").alias(f"{c}n") for c in ("", "edited_", "next_")),
        "cells",
        "edited_cells",
        pairs.alias("pairs"),
    )
    for turn in range(1, TURNS + 1):
        table = table.withColumn("pairs", _turned(F.col("pairs"), turn))
    # What is left after a turn goes on alone, until every pair is recovered.
    done = []
    left = (F.size(F.col("pairs")[0]["rest"]) > 0) | (F.size(F.col("pairs")[1]["rest"]) > 0)
    while True:
        table = work.write(table, f"peeled{turn}")
        done.append(table.where(~left))
        table = table.where(left)
        if table.isEmpty():
            break
        turn += 1
        table = table.withColumn("pairs", _turned(F.col("pairs"), turn))
    found = done[0]
    for more in done[1:]:
        found = found.union(more)

    edited, following = F.col("pairs")[0], F.col("pairs")[1]
    printed = found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("n"), F.col("cells")).alias("fingerprint"),
        fingerprint(F.col("edited_n"), F.col("edited_cells")).alias("edited_fingerprint"),
        _likeness(F.col("n"), F.col("edited_n"), edited["n_here"]).alias("near_edited"),
        _likeness(F.col("n"), F.col("next_n"), following["n_here"]).alias("near_next"),
        edited["here"].alias("only_here"),
        edited["there"].alias("only_edited"),
        F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"),
    )
    return printed.drop("copy")
